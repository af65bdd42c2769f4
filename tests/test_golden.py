"""Golden cases: small inputs with stated results."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import errors as E
from gridloom.functions import scalars as X
from gridloom.functions import typed as P
from gridloom.operators import aggregates as A
from gridloom.operators import cells as K
from gridloom.operators import documents as D
from gridloom.operators import finance as N
from gridloom.operators import lookups as J
from gridloom.operators import ordered as O
from gridloom.operators import shape as H
from gridloom.operators.rules import criteria, filter_rows


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


@pytest.fixture(scope="module")
def report(spark):
    rows = [(1, "서울", 1200.0, 800.0), (2, "부산", 800.0, 500.0), (3, "서울", 1500.0, 900.0), (4, "대구", 600.0, 400.0), (5, "서울", 1800.0, 1100.0), (6, "부산", 900.0, 600.0)]
    return spark.createDataFrame(rows, "row_no int, region string, revenue double, cost double").cache()


def test_report(report):
    seoul, x, y = criteria(F.col("region"), "서울"), F.col("revenue"), F.col("cost")
    busan = criteria(F.col("region"), "부산")
    got = report.agg(
        A.sumifs(x, seoul), A.countifs(seoul), A.averageifs(x, seoul), A.sumifs(x, seoul, criteria(x, ">1200")), A.countifs(seoul, criteria(x, ">1200")),
        A.maxifs(x, busan), A.minifs(x, busan), A.sumproduct(F.col("region") == "서울", x), F.round(F.stddev_samp(x), 4), F.round(F.stddev_pop(x), 4),
        A.median(x), A.percentile(x, 0.75), A.quartile(x, 3), F.round(A.correl(x, y), 6), F.round(A.slope(x, y), 6), A.subtotal(9, x),
    ).first()
    assert list(got) == [4500, 3, 1500, 3300, 2, 900, 800, 4500, 454.6061, 414.9967, 1050, 1425, 1425, 0.994521, 1.712919, 6800]
    assert filter_rows(report, F.col("region") == "서울").agg(F.sum("revenue")).first()[0] == 4500
    assert filter_rows(report, F.col("region") == "광주", (0, "none", 0.0, 0.0)).first()["region"] == "none"
    assert filter_rows(report, F.col("region") == "서울", (0, "none", 0.0, 0.0)).count() == 3


def test_lookups(spark, report):
    keys = spark.createDataFrame([("대구",), ("부산",), ("광주",)], "k string")
    found = {r.k: r.revenue for r in J.xlookup(keys, "k", report, "region", "revenue", "row_no", "revenue", if_missing=-1.0).collect()}
    assert found == {"대구": 600, "부산": 800, "광주": -1}
    assert J.xmatch(keys.filter("k = '대구'"), "k", report, "region", "row_no").first()["matched"] == 4
    prices = spark.createDataFrame([(1000.0,), (100.0,)], "p double")
    got = {r.p: r.v for r in J.lookup_vector(prices, "p", report, "revenue", "revenue", "v").collect()}
    assert got == {1000.0: 900.0, 100.0: None}
    assert {r.p: r.v for r in J.nearest(prices, "p", report, "revenue", "region", "v", "above").collect()} == {1000.0: "서울", 100.0: "대구"}
    assert O.nth(report.withColumn("g", F.lit(1)), "revenue", 2, ["g"]).first()["revenue"] == 1500
    assert O.rank_eq(report, "revenue", []).filter("revenue = 1500").first()["rank"] == 2
    assert O.unique_values(report, F.col("region"), "row_no").count() == 3
    numbers = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, 3.0)], "i int, x double")
    assert A.mode(numbers, "x", "i").first()["mode"] == 2.0
    assert H.sequence_table(spark, 5).agg(F.sum("value")).first()[0] == 15


def test_finance(spark):
    d = F.lit
    got = one(
        spark, pay=N.pmt(d(0.05) / 12, d(360), d(300_000_000.0)), interest=N.interest_part(d(0.05) / 12, d(1), d(360), d(300_000_000.0)),
        fv=N.future_value(d(0.03) / 12, d(120), d(-500_000.0)), n=N.periods(d(0.05) / 12, d(-1_610_000.0), d(300_000_000.0)),
    )
    assert got["pay"] == pytest.approx(-1610464.8690, abs=1e-3)
    assert got["interest"] == pytest.approx(-1250000, abs=1e-3)
    assert got["fv"] == pytest.approx(69870709.4382, abs=1e-3)
    assert got["n"] == pytest.approx(360.2409, abs=1e-3)
    flows = spark.createDataFrame([(1, 0, -1000.0), (1, 1, 300.0), (1, 2, 420.0), (1, 3, 680.0), (2, 0, 1.0), (2, 1, 2.0)], "id int, t int, v double")
    rates = {r.id: r.irr for r in N.cashflow_returns(flows, "id", "t", "v").collect()}
    assert rates[1] == pytest.approx(0.163406, abs=1e-6) and (rates[2] is None or rates[2] != rates[2])
    assert A.npv(flows.filter("id = 1"), 0.1, "v", "t", ["id"]).first()["npv"] == pytest.approx(118.844341, abs=1e-5)
    plan = N.depreciation_schedule(spark.createDataFrame([(1, 10000.0, 1000.0, 5, 2.0)], "asset_id int, cost double, salvage double, life int, factor double")).orderBy("period").collect()
    assert (plan[0].sln, plan[1].syd, plan[0].ddb) == (1800, 2400, 4000)


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    got = one(
        spark, a=X.edate(d("2026-01-31"), F.lit(1)).cast("string"), b=X.eomonth(d("2026-02-05"), F.lit(0)).cast("string"),
        y=X.datedif(d("2020-03-15"), d("2026-09-02"), "Y"), m=X.datedif(d("2020-03-15"), d("2026-09-02"), "M"), md=X.datedif(d("2020-03-15"), d("2026-09-02"), "MD"),
        f=X.yearfrac(d("2026-01-01"), d("2026-07-01")), n=X.days360(d("2026-01-31"), d("2026-03-31")), w=X.weeknum(d("2026-09-02")), iso=X.isoweeknum(d("2026-09-02")),
        w4=X.weeknum(d("2026-01-04")), time=F.concat_ws(":", *X.hms(X.time(F.lit(13), F.lit(45), F.lit(30)))),
    )
    assert got == {"a": "2026-02-28", "b": "2026-02-28", "y": 6, "m": 77, "md": 18, "f": 0.5, "n": 60, "w": 36, "iso": 36, "w4": 2, "time": "13:45:30"}
    calendar = N.business_calendar(spark, "2026-01-01", "2026-12-31")
    row = spark.createDataFrame([("2026-09-01", "2026-09-30", 5)], "a string, b string, k int").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), "k")
    out = N.workday(N.networkdays(row, "a", "b", calendar), "a", "k", calendar).first()
    assert (out["days"], str(out["workday"])) == (22, "2026-09-08")


def test_text_and_numbers(spark):
    got = one(
        spark, s=X.search(F.lit("서"), F.lit("강남 서초")), b=X.search(F.lit("A"), F.lit("banana")), r=X.replace_at(F.lit("2026-09"), F.lit(6), F.lit(2), F.lit("12")), rep=X.rept(F.lit("■"), F.lit(3)),
        before=X.text_before(F.lit("서울-강남"), "-"), after=X.text_after(F.lit("서울-강남"), "-"), m=X.mround(F.lit(17.0), F.lit(5.0)), e=X.even(F.lit(3.0)), o=X.odd(F.lit(4.0)),
        c=X.combin(F.lit(10), F.lit(3)), f=X.fact(F.lit(5)), q=X.quotient(F.lit(17.0), F.lit(5.0)), at=F.round(X.atan2(F.lit(1.0), F.lit(1.0)), 6), log=X.log(F.lit(8.0), 2),
        nth=X.substitute(F.lit("a-b-c"), "-", "+", 2), last=X.text_after(F.lit("a-b-c"), "-", -1), bad=E.divide(F.lit(1.0), F.lit(0.0)), word=X.rept(F.lit("x"), F.lit(-1)),
    )
    assert got == {"s": 4, "b": 2, "r": "2026-12", "rep": "■■■", "before": "서울", "after": "강남", "m": 15, "e": 4, "o": 5, "c": 120, "f": 120, "q": 3, "at": 0.785398, "log": 3, "nth": "a-b+c", "last": "c", "bad": None, "word": None}
    pairs = spark.createDataFrame([(24,), (36,)], "x int").agg(*A.gcd_lcm(F.col("x")))
    assert tuple(pairs.first()) == (12, 72)


def test_typing(spark):
    texts = ["TRUE", "12%", "₩1,200", "1,234.5", "1e3", "2026-09-02", "2026/9/2", "text", "", "2026-13-01", "12,34"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", P.infer(F.col("s")).alias("v")).orderBy("i").collect()
    assert [r.v.t for r in rows] == ["b", "n", "n", "n", "n", "d", "d", "s", None, "s", "s"]
    assert [r.v.num for r in rows[1:6]] == [0.12, 1200, 1234.5, 1000, 46267]


def cells_of(spark, sheet, grid):
    rows = []
    for r, line in enumerate(grid, 1):
        for c, value in enumerate(line, 1):
            if value is None:
                continue
            f = value if isinstance(value, str) and value.startswith("=") else None
            n = float(value) if isinstance(value, (int, float)) else None
            rows.append(("p", sheet, r, c, f, n, None if n is not None or f else value, "n" if n is not None or f else "s"))
    made = spark.createDataFrame(rows, "project_id string, sheet_id string, row int, col int, f string, v_num double, v_str string, t string")
    return made.select("*", F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("map<string,string>").alias("style"))


def test_profiles(spark):
    budget = cells_of(spark, "s", [["항목", "1분기", "2분기", "합계"], ["A", 1200, 1350], ["B", 980, 1120], ["C", 640, 890], ["합계", 2820, 3360]])
    sheets = spark.createDataFrame([("s", 0)], "sheet_id string, frozen_rows int")
    b = K.column_profile(budget, sheets).filter("col = 2").first()
    assert (b.type, b.numbers, b.total, b.average) == ("number", 3, 2820, 940)
    gap = cells_of(spark, "s", [["n", "v"], ["x", 10], [], ["y", 999]])
    assert K.column_profile(gap, sheets).filter("col = 2").first()["total"] == 10
    assert K.summary_scope(gap, sheets).first()["cut_off"] and K.find_regions(gap).count() == 2
    summed = cells_of(spark, "s", [["n", "v"], ["x", 10], ["y", 20], ["z", "=SUM(B2:B3)"]])
    assert [r.row for r in K.total_rows(summed).collect()] == [4]
    filled = cells_of(spark, "s", [["a"], *[[1, f"=A{r}*2"] for r in range(2, 8)]])
    run = K.formula_runs(filled).collect()
    assert len(run) == 1 and (run[0].first_row, run[0].last_row) == (2, 7)
    loop = cells_of(spark, "s", [["=B1"], ["x"]]).unionByName(cells_of(spark, "s", [[None, "=A1", "=A1"]]))
    assert {r.cell for r in K.circular_cells(K.formula_edges(loop)).collect()} == {"p!s!1!1", "p!s!1!2"}


def test_blocks():
    text = "# Title\npara\nline\n\n- a\n  more\n- b\n| x |\n|---|\n\n> q\ngo on\n\n```py\n# no heading\n\n```\n---\n![i](u)\n "
    kinds = [k for k, _ in D.split_markdown(text)]
    assert kinds == ["heading", "paragraph", "list", "table", "quote", "code", "hr", "image"]
    assert D.split_markdown(None) == [] and D.split_markdown("\n \n") == []


def test_tree(spark):
    docs = spark.createDataFrame([(1, "# A\n\ntext\n\n## B\n\n- x\n\n# A\n\nend")], "doc_id long, text string")
    blocks = D.split_blocks(docs)
    nodes = D.build_nodes(docs.select("doc_id", F.lit("t").alias("title")), blocks).cache()
    paths = {r.path: (r.parent_path, r.child_count) for r in nodes.collect()}
    assert paths["doc/1"][1] == 2 and paths["doc/1/h/a"] == ("doc/1", 2) and paths["doc/1/h/b"][0] == "doc/1/h/a" and "doc/1/h/a-2" in paths
    assert all(p in paths for p, _ in paths.values() if p) and sum(n for _, n in paths.values()) == len(paths) - 1
    assert D.resolve(nodes, "doc/1/#2").first()["path"] == "doc/1/h/a-2" and [(r.path, r.kind, r.found) for r in D.resolve(nodes, "doc/9").collect()] == [("doc/9", None, False)]


def test_extend_series(spark):
    rows = spark.createDataFrame([("one", 1, "ID-008"), ("two", 1, "a"), ("two", 2, "b")], "k string, o int, v string")
    got = {(r.k, r.step_no): r.v for r in O.extend_series(rows, "v", "o", ["k"], 2).collect()}
    assert got == {("one", 1): "ID-009", ("one", 2): "ID-010", ("two", 1): "a", ("two", 2): "b"}


def test_rounding_of_formats_follows_sql(spark, duck):
    """Percentages whose double lies at or beside a half, and prices of three decimals."""
    rows = [(2985.0,), (6295.0,), (-905.0,), (5.0,), (-0.4,), (1.005,), (2.675,), (-1.005,), (1e300,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    got = [tuple(r) for r in df.select(X.text(F.col("x") / 10000, "0.0%"), X.fixed(F.col("x")), X.fixed(F.col("x"), 0)).collect()]
    sql = "SELECT format('{:.1f}%', round(?::DOUBLE / 10000 * 100, 1)), format('{:,.2f}', round(?::DOUBLE, 2)), format('{:,.0f}', round(?::DOUBLE, 0))"
    assert got[:8] == [duck.execute(sql, [x, x, x]).fetchone() for (x,) in rows[:8]]
    assert got[8][1].startswith("1,000,000,000") and got[9] == (None, None, None)


def test_rates_of_long_series(spark):
    """Hundreds of periods overflow neither end of the bracket; equal to a closed form."""
    rows = [(1, t, -1000.0 if t == 0 else 1000 * 0.01 / (1 - 1.01**-400)) for t in range(401)] + [(2, 0, 5.0), (3, 0, None), (4, 1, -1.0), (4, 0, -100.0), (4, 2, 110.0), (4, 3, None), (None, 0, -10.0), (None, 1, 11.0)]
    rates = {r.id: r.irr for r in N.cashflow_returns(spark.createDataFrame(rows, "id long, t long, v double"), "id", "t", "v").collect()}
    assert rates[1] == pytest.approx(0.01, abs=1e-10) and rates[2] is None and rates[3] is None and rates[None] == pytest.approx(0.1, abs=1e-12)
    assert -100 - 1 / (1 + rates[4]) + 110 / (1 + rates[4]) ** 2 == pytest.approx(0, abs=1e-9)
    loans = spark.createDataFrame([(360.0, -1000 * 0.005 / (1 - 1.005**-360)), (None, 1.0), (360.0, 5.0)], "n double, pay double")
    assert [r[0] if r[0] is None else round(r[0], 10) for r in loans.select(N.rate(F.col("n"), F.col("pay"), F.lit(1000.0))).collect()] == [0.005, None, None]


def test_odd_numbers_of_formats_follow_sql(spark, duck):
    """Zeros below 0, as rounding makes them, numbers that are none and more digits than name a double."""
    odd = [0.0, -0.0, -5e-324, -0.004, float("nan"), float("inf"), float("-inf"), 2.0**46 + 0.109375, -(2.0**46) - 0.890625, 1e15 + 0.125, 2.0**53 + 2, -(2.0**63), 1e23, -9.9e35]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    x = F.col("x")
    got = [tuple(r) for r in df.select(X.fixed(x), X.dollar(x), X.text(x, "#,##0"), X.text(x / 10000, "0.0%"), X.text(x, "$0.00")).collect()]
    sql = """SELECT format('{:,.2f}', round(x, 2)), CASE WHEN round(x, 2) < 0 THEN format('(${:,.2f})', abs(round(x, 2))) ELSE format('${:,.2f}', abs(round(x, 2))) END,
    format('{:,.0f}', round(x, 0)), format('{:.1f}%', round(x / 10000 * 100, 1)), regexp_replace(format('{:.2f}', round(x, 2)), '^(-?)', '\\1$') FROM (SELECT ?::DOUBLE AS x)"""
    assert got == [duck.execute(sql, [x]).fetchone() for x in odd]
    assert got[1] == ("-0.00", "$0.00", "-0", "-0.0%", "-$0.00") and got[4][0] == "nan"
