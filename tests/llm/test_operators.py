"""The training-data operators against brute force on small inputs and the smallest tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from conftest import SF, normal
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, cotraining, langid, licenses, quality, queries, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", F.lit(1).alias("fp"), F.lit("x").alias("score"), F.lit(2).alias("ids")) if extra else df


ODD_TEXTS = [None, "", " ", "a", "word " * 30_000, "x" * 50_000, "same text here for all of us", "same text here for all of us", "ÀÉ ñandú 漢字 🙂 <|endoftext|>", "tab\tand\x0bfeed\n\nlines\r\n", "   wide blanks　"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    found, expected = queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert normal(found.toPandas()) == normal(expected)


# 1 ---------------------------------------------------------------------------------


def brute_top(vectors, queries_, k):
    out = {}
    for qi, q in queries_:
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qi))[:k]
        out[qi] = [(i, -s) for s, i in scored]
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    random.seed(1)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(random.choice([6, 6, 3]))]) for i in range(200)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)] + [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(7)).withColumn("score", F.lit(1))
    ints = topk.integer_vectors(df, "vec_id", "embedding", 256)
    made = [(r.id, list(r.v)) for r in ints.collect()]
    assert {i for i, _ in made} == {i for i, v in rows if i is not None and i < 300} | {304}
    asked = [x for x in made if x[0] % 10 == 0]
    got = collections.defaultdict(list)
    for r in topk.top_k(ints.filter("id % 10 = 0"), ints, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == brute_top(made, asked, 5)
    assert topk.top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_top_k_large_components(spark):
    ints = spark.createDataFrame([(0, [2**31, 1]), (1, [2**31, 2]), (2, [2**31, 3])], "id long, v array<bigint>")
    got = [(r.vec_id, r.score) for r in topk.top_k(ints.filter("id = 0"), ints, 2).orderBy("rank").collect()]
    assert got == [(2, 2**62 + 3), (1, 2**62 + 2)]


def test_top_k_beyond_long(spark, monkeypatch):
    """Scores beyond long are ranked by value and shown as NULL; components beyond long take no part; repeated rows stay."""
    monkeypatch.setattr(topk, "ROWS", 2)
    rows = [(1, [1e12, 1.0]), (2, [1e12, 2.0]), (3, [-1e12, 0.0]), (4, [1.0, 1.0]), (5, [1e300, 0.0]), (6, [4e16, 0.0]), (7, [1e12, 1.0]), (7, [1e12, 1.0])]
    ints = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)), "vec_id", "embedding", 256)
    kept = [(r.id, list(r.v)) for r in ints.collect()]
    assert sorted(i for i, _ in kept) == [1, 2, 3, 4, 7, 7]
    got = collections.defaultdict(list)
    for r in topk.top_k(ints, ints, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    shown = lambda s: s if -(2**63) <= s < 2**63 else None
    for q in (1, 2, 3, 4):
        assert got[q] == [(i, shown(s)) for i, s in brute_top(kept, [(q, dict(kept)[q])], 5)[q]]


# 2 ---------------------------------------------------------------------------------


def test_quality(spark):
    texts = [*ODD_TEXTS, "a b c a b c", "good words " * 40, "\n".join(["same line of words"] * 9), "x#% y&& z " * 30]
    rows = quality.ledger(docs_of(spark, texts, extra=True)).orderBy("doc_id").collect()
    assert [r.n_words for r in rows][:6] == [0, 0, 0, 1, 30_000, 1]
    assert rows[11].n_repeat_words == 6 and rows[13].n_dup_lines == 8 and rows[14].n_symbols == 120
    assert rows[8].word_chars == len("ÀÉñandú漢字🙂<|endoftext|>")
    frame = spark.createDataFrame(rows)
    out = {r.rule: r for r in quality.ablations(frame, "v2").collect()}
    mask = {name: 1 << i for i, name in enumerate(quality.RULES)}
    for name, r in out.items():
        assert r.n_failed == sum(bool(x.failed & mask[name]) for x in rows)
        assert r.n_kept_without == sum(not x.failed & ~mask[name] for x in rows)
    assert quality.ledger(docs_of(spark, []).limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------


def test_language(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    out = queries.QUERIES["op3_language_id"](spark, SF).collect()
    held = [r for r in out if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)
    model = langid.fit(documents)
    odd = langid.identify(docs_of(spark, ODD_TEXTS + ["123 456"], extra=True), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, True] + [False] * 8 + [True]
    assert langid.identify(documents.limit(3), langid.fit(documents.limit(0))).filter("lang_pred = 'und'").count() == 3


def test_language_filter_counts():
    grams = {"a": np.arange(1000, dtype=np.uint64), "b": np.arange(500, 2000, dtype=np.uint64)}
    made = langid.Filter.build(grams)
    at = langid.cells_of(np.array([700, 20], np.uint64), made.bits)
    mask = np.bitwise_and.reduce([made.cells[x, 0] for x in at])
    assert mask[0] == 3 and mask[1] & 1


# 5 ---------------------------------------------------------------------------------


def test_cotraining(spark):
    out = cotraining_rows(spark)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert out.keys() == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    right = [(out[i] >= 0.5) == bool(y) for i, y in labels.items()]
    assert np.mean(right) > 0.9
    empty = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    odd = docs_of(spark, ODD_TEXTS, extra=True)
    assert cotraining.fit(odd, empty) == 0.5 and cotraining.score(odd, 0.5, ["doc_id"]).count() == len(ODD_TEXTS)


def cotraining_rows(spark):
    return {r.doc_id: r.score for r in queries.QUERIES["op5_cotraining"](spark, SF).collect()}


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900)
    text, meta = y[:, None] + rng.normal(0, 0.25, (900, 1)), y[:, None] + rng.normal(0, 0.25, (900, 1))
    labelled = np.arange(900) < 200
    views = cotraining.cotrain(text, meta, np.where(labelled, y, -1), labelled, labelled & (np.arange(900) % 4 == 0))
    assert sum(map(sum, views.handed)) > 0


# 6 ---------------------------------------------------------------------------------


def test_licenses(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.upper().replace(",", " ,").replace("LICENSE", "LICENCE")
    texts = [mit, licenses.MIT[:-20], *ODD_TEXTS, "ISC Licence\n\n" + licenses.ISC_GRANT + licenses.ISC_NOTICE + licenses.ISC_END]
    got = licenses.scan(docs_of(spark, texts, extra=True), licenses.digests(spark, licenses.LICENSES)).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT", None, *[None] * len(ODD_TEXTS), "ISC"]


# 7 ---------------------------------------------------------------------------------


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, bits):
    label = list(range(len(codes)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(codes))]


def test_simhash(spark, documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(60).collect()] + ODD_TEXTS
    got = simhash.near_duplicates(docs_of(spark, texts, extra=True)).orderBy("doc_id").collect()
    codes = [brute_fingerprint(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in got] == codes
    assert [r.component_id for r in got] == brute_components(codes, 4)
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("together", [1, 3])
def test_components_of_many_close_codes(spark, monkeypatch, together):
    """Chunks of one mask value, chains, codes whose top bit is set; bands and combinations of bands."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    masks = simhash.band_masks
    monkeypatch.setattr(simhash, "band_masks", lambda bits, codes: masks(bits, 0 if together == 1 else 16 << 25))
    random.seed(2)
    codes = [random.getrandbits(64)]
    while len(codes) < 300:
        base = random.choice(codes[-20:]) if random.random() < 0.8 else random.getrandbits(64)
        for b in random.sample(range(64), random.choice([1, 2, 4, 5, 6])):
            base ^= 1 << b
        codes.append(base)
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.with_components(marked).collect()}
    assert [got[i] for i in range(300)] == brute_components(codes, 4)


def test_components_of_a_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(-5, -6), (7, 7)], "a long, b long"))
    got = simhash.components(links)
    assert got.select("label").distinct().count() == 2 and got.count() == 403
    assert got.groupBy("label").count().orderBy("count").first()["count"] == 2


def test_gray_rank(spark):
    rows = spark.range(256).select(F.col("id").bitwiseXOR(F.shiftright("id", 1)).alias("g"), "id").select((simhash.gray_rank(F.col("g")).bitwiseXOR(F.lit(-(2**63)))).alias("r"), "id").collect()
    assert all(r.r == r.id for r in rows)


# 8 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    ranks, pattern = bpe.default_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, documents, reference_encoding):
    texts = [r.text for r in documents.limit(40).collect()] + ODD_TEXTS + ["don't we'll I'M 12345 !!??", "a" * 97 + " " + "abcdefgh" * 40]
    frame = docs_of(spark, texts, extra=True)
    got = {r.doc_id: r for r in bpe.encoded_digests(frame).collect()}
    ranks, pattern = bpe.default_ranks()
    encoded = bpe.encode(frame, "text", ["doc_id"], ranks, pattern)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, "ids", ["doc_id"], ranks).collect()}
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    for i, text in enumerate(texts):
        want = reference_encoding.encode_ordinary(text or "")
        assert ids[i] == want and back[i] == (text or "").encode()
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encoded_digests(frame.limit(0)).count() == 0


def test_long_words(reference_encoding):
    ranks, _ = bpe.default_ranks()
    random.seed(3)
    word = "".join(random.choice("abcdeéß") for _ in range(3000))
    assert bpe.merge_long(word.encode(), ranks) == reference_encoding.encode_ordinary(word)


# 10 --------------------------------------------------------------------------------


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 50)
    control = f"{chat.END}{chat.START}assistant ok"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "assistant", " \n lead\\|<\\|🙂漢"), (2, 0, None, None), (3, 0, "us\ner\\", "x"), (3, 0, "assistant", ""), (None, 1, "assistant", "no id")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"\n\n turn {i} <| " + "é" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == len(chat.render([(r, x) for _, r, x in turns])[0])
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_mask():
    """Ids equal those of another library that has the same vocabulary; the mask covers what the offsets say."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    encoder = chat.Encoder()
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (chat.START, chat.END)])
    turns = [("user", "hi 漢字 🙂"), ("assistant", "\n yes é<|im_end|>"), ("assistant", ""), ("system", "x" * 500), ("assistant", "🙂🙂 " * 40 + "<|endoftext|>")]
    made = chat.format_turns(turns, encoder)
    want = other.encode(made["formatted"], add_special_tokens=False)
    assert made["ids"].tolist() == want.ids and encoder.decode(made["ids"]) == made["formatted"]
    spans, at = [], 0
    for role, text in turns:
        lo = at + len(chat.START) + len(role) + 1
        hi = lo + len(chat.escape(text))
        spans += [(lo, hi)] * (role == "assistant")
        at = hi + len(chat.END) + 1
    assert made["mask"].tolist() == [any(a < hi and b > lo for lo, hi in spans) for a, b in want.offsets]
    assert made["loss_texts"] == [text for role, text in turns if role == "assistant"]


def test_chat_long_texts(spark):
    """A text of several million characters, one of blanks only, and a role of the same size."""
    rows = [(1, 0, "assistant", " " * 1_500_000), (1, 1, "user", "é" * 1_000_000), (1, 2, "assistant", "word " * 400_000), (2, 0, "r" * 300_000, "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    whole = "".join(f"{r}\n{x}\n" for c, _, r, x in rows if c == 1)
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].loss_chars == 3_500_000 and got[2].n_turns == 1
