"""Plans stay what they are meant to be: pruned scans, few shuffles, no cross joins."""

import re

from conftest import SF
from pyspark.sql import functions as F

from gridloom.operators.rules import criteria
from gridloom.plans import catalogue

QUERIES = catalogue.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditional_sums_read_only_their_columns_and_shuffle_once(spark):
    text = plan(QUERIES["sumifs_lineitem"](spark, SF))
    read = set(re.findall(r"(l_\w+):", re.search(r"ReadSchema: struct<(.*)>", text)[1]))
    assert read == {"l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"}
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in plan(QUERIES["filtered_events"](spark, SF))
    prices = spark.read.parquet(f"{SF}/orders.parquet").filter(criteria(F.col("o_totalprice"), ">=1000"))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan(prices)


def test_exact_lookup_aggregates_before_its_shuffle(spark):
    text = plan(QUERIES["vlookup_first_match"](spark, SF))
    assert "partial_min_by" in text and "CartesianProduct" not in text


def test_nearest_match_is_no_range_join(spark):
    text = plan(QUERIES["vlookup_approximate"](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_no_cartesian_products(spark):
    for name in ("flagged_ranked", "color_scaled", "fold_series_nations", "average_deviation"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
