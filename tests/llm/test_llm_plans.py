"""Plans of the training-data operators: one scan without shuffle where promised, no Python in native ones."""

import pytest
from conftest import SF

from pyspark.sql import functions as F

from gridloom.llm import queries, simhash


def plan(spark, name):
    return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_byte_bpe"])
def test_one_scan(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["op4_pfair_mix", "op6_license_scan"])
def test_native(spark, name):
    text = plan(spark, name)
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_mixing_reads_no_texts(spark):
    assert "text:string" not in plan(spark, "op4_pfair_mix")


@pytest.mark.parametrize("length", [2_000, 20_000])
def test_component_plan_is_linear(spark, length):
    """A table of each round stands in the plan once, however long the chains are."""
    links = spark.range(length).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    made = simhash.components(links)
    leaves = made._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 14 and made.count() == length + 1 and made.select("label").distinct().count() == 1


def test_masks_of_large_tables():
    """Every pair within the bits agrees on a mask, and a value stays within a chunk."""
    for codes, least in ((0, 12), (1 << 26, 20), (1 << 34, 26)):
        masks = simhash.band_masks(4, codes)
        assert min(m.bit_count() for m in masks) >= least
        for bits in ((0, 1, 2, 3), (0, 17, 33, 50), (63, 31, 12, 40)):
            off = sum(1 << b for b in bits)
            assert any(not m & off for m in masks)
