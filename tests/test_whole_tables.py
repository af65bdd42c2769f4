"""Queries that once read a part of their tables, over all rows."""

from conftest import SF
from pyspark.sql import functions as F

from gridloom.plans import catalogue


def test_all_rows_take_part(spark):
    queries, events = catalogue.queries(), spark.read.parquet(f"{SF}/events.parquet")
    assert queries["reading_orders_all"](spark, SF).count() == events.count() == queries["reading_orders"](spark, SF).count()
    counts = {r.user_id: r.n for r in queries["version_counts_all"](spark, SF).collect()}
    assert counts == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert queries["version_counts"](spark, SF).agg(F.sum("n")).first()[0] == events.count()
    whole = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.sum(F.col("l_tax") * F.col("l_tax"))).first()[0]
    for name in ("product_sumsq_sumproduct", "product_sumsq_sumproduct_all"):
        assert abs(queries[name](spark, SF).agg(F.sum("squares")).first()[0] - whole) < 1e-3


def test_document_findings(spark, tmp_path):
    texts = ["# a\n\n### b\n\ntext", "# a\n\n## b\n\n# c", "```chart\n{broken\n```", '```chart\n{"type": "bar"}\n```', "| a | b |\n|---|---|\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.path.split("/")[1], r.message) for r in catalogue.queries()["document_findings"](spark, str(tmp_path)).collect()}
    assert got == {("0", "heading skips from 1 to 3"), ("2", "unreadable chart"), ("4", "empty table")}
