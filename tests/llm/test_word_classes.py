"""Words are cut by tiktoken's classes of characters: every code point, alone and before contractions."""

import hashlib
import tracemalloc

import numpy as np
import tiktoken

from gridloom.llm import bpe


def test_every_code_point(spark):
    ranks, pattern = bpe.default_ranks()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", "plain only"]
    for k in range(0, len(points), 2_000):
        part = points[k : k + 2_000]
        texts += ["".join(chr(c) + " " for c in part), " ".join(f"x{chr(c)}'s 1{chr(c)}2{chr(c)}'re  {chr(c)}\t{chr(c)}" for c in part)]
    rows = {r.doc_id: r for r in bpe.encoded_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, text in enumerate(texts):
        ids = encoding.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), i
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_ids_beside_plain_texts(spark):
    """Odd and plain texts in one batch keep their own ids, in their order."""
    ranks, pattern = bpe.default_ranks()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = chr(0x1E4D0)
    assert len(encoding.encode_ordinary(f"{odd}'s")) == len(encoding.encode_ordinary(odd)) + 1
    texts = [f"{odd}'s", "", "it's plain", None, f"漢字 {odd}", "漢字 'll", f"{odd}{odd}'re {odd}", "end"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(df, "text", ["doc_id"], ranks, pattern).collect()}
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_tables_take_little_of_the_driver(spark):
    """The tables are 2 MB; all code points are never held at once as numbers or as one text."""
    tracemalloc.start()
    try:
        classes = bpe.classes_of(spark)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8e6 and int(classes.odd.sum()) == 9_917
