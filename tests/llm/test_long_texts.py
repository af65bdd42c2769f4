"""Length alone drops no text."""

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_very_long_clean_text(spark, tmp_path):
    text = "\n".join(" ".join(f"word{i}" for i in range(k, k + 10)) for k in range(0, 100_010, 10))
    spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "too short", "en", "a", 9)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op2_quality_rules"](spark, str(tmp_path)).collect()}
    assert rows[1].n_words == 100_010 and rows[1].failed_rules == quality.mask_of(["too_many_words"])
    assert rows[1].kept and not rows[2].kept
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.apply_quality_rules(spark, docs, str(tmp_path)).collect()] == [1]


def test_texts_of_several_megabytes(spark):
    """Whole texts, never beginnings: 500,000 distinct words, then one word that tells."""
    import hashlib

    import numpy as np
    import tiktoken
    import xxhash

    from gridloom.llm import bpe, cotraining, langid, licenses, nearcopies, simhash, toxicity

    words = [f"w{i:06d}" for i in range(500_000)]
    text = " ".join(words) + " idiot"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    first = lambda df: df.filter("doc_id = 1").first()
    got = first(quality.ledger(docs))
    assert (got.n_words, got.n_repeat_words) == (500_001, 0)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(w), 42) for w in zip(*(([*words, "idiot"])[k:] for k in range(4)))], np.uint64)
    bits = np.array([((hashes >> np.uint64(b)) & np.uint64(1)).sum() * 2 > len(hashes) for b in range(64)])
    assert int(first(simhash.near_duplicates(docs)).fingerprint, 16) == sum(1 << b for b in range(64) if bits[b])
    ranks, pattern = bpe.default_ranks()
    ids = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    coded = first(bpe.encoded_digests(docs))
    assert coded.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and coded.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    examples = [(i, i % 2, b"calm words here idiot" if i % 2 else b"calm words there friend") for i in range(400)]
    judged = first(toxicity.score(docs, toxicity.fit_rows(examples)))
    assert judged.evidence == ["idiot"] and len(judged.neighbours) == 5 and all(i % 2 for i in judged.neighbours)
    assert first(langid.identify(docs, langid.fit(docs))).lang_pred == "en"
    assert first(cotraining.score(docs, 0.5, ["doc_id"])).score == 0.5 and len(cotraining.text_features(text.encode())) == 9 + cotraining.WORDS
    assert first(licenses.scan(docs, licenses.digests(spark, licenses.LICENSES))).license is None
    assert sorted(r.id for r in nearcopies.first_of_groups(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10))).collect()) == [1, 2]
