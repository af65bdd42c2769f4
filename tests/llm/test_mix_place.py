"""The mix reaches the end of the pipeline."""

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_place_in_the_mix(spark, tmp_path):
    """The last stage's rows follow the schedule, whatever the order its files are read in."""
    rows = [(i, " ".join(f"t{i * 7 + k}" for k in range(1 + i % 40)), "en", ("a", "a", "a", "b", None)[i % 5], i % 40) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    planned = {r.doc_id: r.mix_position for r in mixing.mix(docs, key=corpus_pipeline.MIX_KEY).collect()}
    corpus_pipeline.mix_sources(spark, docs, "").repartition(7, F.rand(1)).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert mixed.rdd.getNumPartitions() > 1
    out = corpus_pipeline.encode_tokens(spark, mixed, "").collect()
    assert {r.doc_id: r.mix_position for r in out} == planned and len(out) == len(set(planned.values())) == 600
