"""Charts as tables: data from ranges, long and wide series, measures, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import slice_range


def chart_data(cells: DataFrame, area: str, orientation: str = "columns") -> DataFrame:
    """First column (or row) = labels, first cell of each series = its name; errors and texts are gaps."""
    from .cells import shown

    x = slice_range(cells, area)
    point, series = ("r", "c") if orientation == "columns" else ("c", "r")
    marked = x.withColumn("_v", shown())
    labels = marked.filter((F.col(series) == 1) & (F.col(point) > 1)).select("sheet_id", F.col(point).alias("p"), F.col("_v").alias("label"))
    names = marked.filter((F.col(point) == 1) & (F.col(series) > 1)).select("sheet_id", F.col(series).alias("s"), F.col("_v").alias("name"))
    values = marked.filter((F.col(point) > 1) & (F.col(series) > 1)).select("sheet_id", F.col(point).alias("p"), F.col(series).alias("s"), F.when(F.col("t") == "n", F.col("v_num")).alias("value"))
    return values.join(labels, ["sheet_id", "p"], "left").join(names, ["sheet_id", "s"], "left").select("sheet_id", F.col("s").alias("series_no"), "name", F.col("p").alias("point_no"), F.coalesce("label", F.col("p").cast("string")).alias("label"), "value")


def charts_from_ranges(charts: DataFrame, cells: DataFrame) -> DataFrame:
    """charts(chart_id, sheet_id, range, labels, series) -> points read from each chart's own range.

    A range that is no address, or that holds no number, is unusable: such a chart keeps its stored numbers."""
    from .cells import shown
    from .documents import parse_area

    placed = charts.select("chart_id", "sheet_id", parse_area(F.col("range")).alias("a")).filter("a IS NOT NULL")
    inside = cells.join(placed, "sheet_id").filter("row BETWEEN a.r0 AND a.r1 AND col BETWEEN a.c0 AND a.c1")
    marked = inside.select("chart_id", (F.col("row") - F.col("a.r0")).alias("r"), (F.col("col") - F.col("a.c0")).alias("c"), shown().alias("said"), F.when(F.col("t") == "n", F.col("v_num")).alias("number"))
    labels = marked.filter("c = 0 AND r > 0").select("chart_id", "r", F.col("said").alias("label"))
    names = marked.filter("r = 0 AND c > 0").select("chart_id", "c", F.col("said").alias("name"))
    values = marked.filter("r > 0 AND c > 0").join(labels, ["chart_id", "r"], "left").join(names, ["chart_id", "c"], "left")
    read = values.select("chart_id", (F.col("c") - 1).alias("series_no"), "name", (F.col("r") - 1).alias("point_no"), F.coalesce("label", F.col("r").cast("string")).alias("label"), F.col("number").alias("value"))
    usable = read.filter("value IS NOT NULL").select("chart_id").distinct()
    return read.join(usable, "chart_id", "left_semi").unionByName(chart_points(charts.join(usable, "chart_id", "left_anti")))


def chart_points(charts: DataFrame) -> DataFrame:
    """charts(chart_id, labels, series array<struct<name, values>>) -> one row a point; a missing label is the point number."""
    series = charts.select("chart_id", "labels", F.posexplode("series").alias("series_no", "s"))
    return series.select("chart_id", "series_no", F.col("s.name").alias("name"), F.posexplode("s.values").alias("point_no", "value"), "labels").select("chart_id", "series_no", "name", "point_no", F.coalesce(F.get("labels", F.col("point_no")), (F.col("point_no") + 1).cast("string")).alias("label"), "value")


def chart_table(charts: DataFrame, names: list[str]) -> DataFrame:
    """Series as columns."""
    return chart_points(charts).groupBy("chart_id", "point_no", "label").pivot("name", names).agg(F.first("value"))


def chart_measures(points: DataFrame) -> DataFrame:
    """Per point: share of a pie (absolute values of the first series, gaps 0) and the base and end of
    its piece of a stack, positives and negatives apart."""
    size = F.abs(F.coalesce("value", F.lit(0.0)))
    first = F.col("series_no") == F.min("series_no").over(Window.partitionBy("chart_id"))
    pie = F.sum(F.when(F.col("_first"), size).otherwise(0.0)).over(Window.partitionBy("chart_id"))
    value = F.coalesce("value", F.lit(0.0))
    stack = Window.partitionBy("chart_id", "point_no", F.signum(value) >= 0).orderBy("series_no").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(value).over(stack), F.lit(0.0))
    return points.withColumn("_first", first).select("*", F.when(F.col("_first"), F.try_divide(size, pie)).alias("share"), base.alias("base"), (base + value).alias("end")).drop("_first")


def axis(measures: DataFrame, steps: int = 5) -> DataFrame:
    """Per chart: low, high and a 1-2-5 step over stack ends (0 included)."""
    ends = measures.groupBy("chart_id").agg(F.least(F.min("end"), F.lit(0.0)).alias("low"), F.greatest(F.max("end"), F.lit(0.0)).alias("high"))
    raw = F.greatest((F.col("high") - F.col("low")) / steps, F.lit(1e-9))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    nice = F.when(raw / unit <= 1, 1).when(raw / unit <= 2, 2).when(raw / unit <= 5, 5).otherwise(10) * unit
    return ends.select("chart_id", "low", "high", nice.alias("step"))


def describe_charts(charts: DataFrame) -> DataFrame:
    """One line: type, title, series names, points, range."""
    names = F.array_join(F.transform("series", lambda s: s["name"]), ", ")
    points = F.greatest(F.size("labels"), F.coalesce(F.array_max(F.transform("series", lambda s: F.size(s["values"]))), F.lit(0)))
    return charts.select("chart_id", F.concat_ws(", ", F.concat_ws(" ", "type", F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit('"'), F.col("title"), F.lit('"')))), F.concat(F.lit("series: "), names), F.concat(points.cast("string"), F.lit(" points")), F.when(F.col("range").isNotNull(), F.concat(F.lit("range "), F.col("range")))).alias("description"))
