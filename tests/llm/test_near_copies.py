"""Near copies by exact Jaccard similarity against brute force."""

import random
from itertools import combinations

import corpus_pipeline
import pytest

from gridloom.llm import nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = (nearcopies.shingle_set(t.encode()) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("parts", [4, 40])
def test_near_copies(spark, parts, monkeypatch):
    """One edit in texts of 80 words gives a similarity of 0.87, far from 4 bits; half a text in common stays."""
    if parts > 4:  # texts looked up by shuffle
        monkeypatch.setattr(nearcopies, "FEW", 0)
    random.seed(3)
    texts = []
    for g in range(60):
        words = [f"w{random.randrange(5000)}" for _ in range(80)]
        for _ in range(g % 4):
            copy = list(words)
            copy[random.randrange(5, 75)] = f"x{random.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts += [" ".join(words), " ".join(words[:40] + [f"y{random.randrange(10**6)}" for _ in range(40)])]
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    far = sum((simhash.fingerprint_text(texts[i].encode()) ^ simhash.fingerprint_text(texts[j].encode())).bit_count() > 4 for i, j in near)
    assert far > len(near) / 2
    label = list(range(len(texts)))
    for i, j in near:
        label = [label[i] if x == label[j] else x for x in label]
    expected = {min(i for i, x in enumerate(label) if x == y) for y in set(label)}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == sorted(expected)


def test_repeated_id_of_two_texts(spark):
    """A repeated id names a row of either group, so no group vanishes."""
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1)], DOCS)
    assert sorted(r.text for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [a, b]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 1), (2, " ", "en", "s", 1), (3, "a b", "en", "s", 1), (4, "A  b", "en", "s", 1), (5, "word " * 30_000, "en", "s", 1)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 5]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_templated_pages(spark):
    """Pages of one template with little of their own (similarity about 0.6) stay, their planted copies go; nothing else does."""
    random.seed(9)
    template = [f"t{i}" for i in range(150)]
    page = lambda: " ".join(template + [f"o{random.randrange(10**7)}" for _ in range(45)])
    texts = [page() for _ in range(1_200)]
    assert 0.5 < sum(jaccard(texts[i], texts[i + 1]) for i in range(100)) / 100 < 0.7
    planted = []
    for i in range(0, 1_200, 15):
        words = texts[i].split()
        words[random.randrange(155, 190)] = "changed"
        planted.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts + planted)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(1_200))


def brute_first(texts):
    """The smallest index of each component of all pairs at 0.8 or more."""
    sets = [nearcopies.shingle_set(t.encode()) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both * 10 >= (len(sets[i]) + len(sets[j]) - both) * 8:
            low, high = sorted((top(i), top(j)))
            label[high] = low
    return sorted({top(i) for i in range(len(texts))})


def test_pairs_that_share_no_band(spark):
    """500 pairs at and about 0.8, sizes differing too: of those at 0.8 some share no band, and all are found."""
    random.seed(21)
    texts = []
    for g in range(500):
        words = [f"p{random.randrange(10**7)}" for _ in range(104)]
        cut = [5, 17, 20, 21][g % 4]  # words that only the longer text holds, or a changed one
        texts.append(" ".join(words))
        texts.append(" ".join(words[:-cut]) if g % 4 else " ".join(words[:50] + ["new"] + words[51:96] + ["end"] + words[97:]))
    none = (nearcopies.np.zeros(0, nearcopies.np.uint64), nearcopies.np.zeros(0, nearcopies.np.uint8))
    bands = [nearcopies.marks(t.encode(), none)[1] for t in texts]
    near = [i for i in range(0, 1_000, 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    assert any(not any(x == y for x, y in zip(bands[i], bands[i + 1])) for i in near) and len(near) < 500
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == brute_first(texts)


@pytest.mark.parametrize("common", [0, 500_000])
def test_bands_alone_find_nothing(spark, monkeypatch, common):
    """With no candidates from bands the rare shingles find every component by themselves, whatever the order of shingles."""
    monkeypatch.setattr(nearcopies, "COMMON", common)
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "RADIUS", -1)
    random.seed(4)
    template, texts = [f"t{i}" for i in range(120)], ["", " ", "one", "ONE", "a b", "A  b"]
    for _ in range(60):  # pages of one template, near and just below 0.8
        texts.append(" ".join(template + [f"o{random.randrange(10**7)}" for _ in range(random.randrange(8, 30))]))
    for g in range(64):
        words = [f"w{random.randrange(40)}" for _ in range(random.randrange(6, 90) if g % 16 else 900)]
        texts.append(" ".join(words))
        for _ in range(g % 4):
            copy = list(words)
            copy[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
            texts.append(" ".join(copy[: random.randrange(len(copy) * 4 // 5, len(copy)) + 1]))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == brute_first(texts)


def equal_by_xxhash64():
    """Two texts of 16 bytes, alike in nothing, whose xxhash64 is the same: the second eight bytes make up for the first."""
    p1, p2, p4, p5, all64 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 2**64 - 1
    turn = lambda x, n: (x << n | x >> (64 - n)) & all64
    lane = lambda b: turn(int.from_bytes(b, "little") * p2 & all64, 31) * p1 & all64
    after = lambda b: (turn((42 + p5 + 16) ^ lane(b), 27) * p1 + p4) & all64
    first, rest = b"one two ", b"and more"
    for i in range(10**6):
        other = b"x%06d " % i
        need = after(other) ^ after(first) ^ lane(rest)
        made = (turn(need * pow(p1, -1, 2**64) & all64, 33) * pow(p2, -1, 2**64) & all64).to_bytes(8, "little")
        if all(0x21 <= c <= 0x7E for c in made):
            return (first + rest).decode(), (other + made).decode()


def test_texts_of_equal_hash(spark, monkeypatch):
    """A hash of a text doesn't stand for the text: texts of one hash are two texts."""
    a, b = equal_by_xxhash64()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate([a, b, a, "another text of some words"])], DOCS)
    assert docs.select(corpus_pipeline.F.xxhash64("text").alias("h")).distinct().count() == 2
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [(0, a), (1, b), (3, "another text of some words")]
    # numbers that meet are given out again
    node_of, used = nearcopies.node_of, []
    monkeypatch.setattr(nearcopies, "node_of", lambda digest, salt: used.append(salt) or (node_of(digest, salt) % 2 if salt < 1 else node_of(digest, salt)))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 1, 3] and max(used) == 1
