"""Queries over the scalar functions, typing, rules and finance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import scalars as X
from ..functions import typed as P
from ..operators import cells as K
from ..operators import finance as N
from ..operators import rules as R
from .registry import query, table


@query("""SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, substring(p_name, 2, 3) AS m, upper(p_name) AS u, length(p_name) AS n, repeat('ab', p_size % 4) AS rept, unicode(p_brand) AS code,
chr(65 + p_size % 26) AS ch, p_name || '/' || p_brand AS joined, p_name = lower(p_name) AS same FROM part""")
def text_direct(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", X.left(c("p_name"), F.lit(4)).alias("l"), X.right(c("p_name"), F.lit(3)).alias("r"), X.mid(c("p_name"), F.lit(2), F.lit(3)).alias("m"), F.upper("p_name").alias("u"), F.length("p_name").alias("n"), X.rept(F.lit("ab"), c("p_size") % 4).alias("rept"), X.code(c("p_brand")).alias("code"), X.char(65 + c("p_size") % 26).alias("ch"), E.concat(c("p_name"), F.lit("/"), c("p_brand")).alias("joined"), X.exact(c("p_name"), F.lower("p_name")).alias("same"))


@query("""SELECT p_partkey, replace(p_brand, '#', '-') AS sub, CASE WHEN position('#' IN p_brand) > 0 THEN position('#' IN p_brand) END AS found, position('brand' IN lower(p_brand)) AS searched,
split_part(p_brand, '#', 1) AS before, split_part(p_brand, '#', 2) AS after, left(p_name, 1) || 'XX' || substring(p_name, 4) AS replaced, regexp_replace(trim('  a   b ' || p_name || '  '), ' +', ' ', 'g') AS trimmed FROM part""")
def text_composed(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", X.substitute(c("p_brand"), "#", "-").alias("sub"), X.find(F.lit("#"), c("p_brand")).alias("found"), X.search(F.lit("BRAND"), c("p_brand")).alias("searched"), X.text_before(c("p_brand"), "#").alias("before"), X.text_after(c("p_brand"), "#").alias("after"), X.replace_at(c("p_name"), F.lit(2), F.lit(2), F.lit("XX")).alias("replaced"), X.trim(F.concat(F.lit("  a   b "), c("p_name"), F.lit("  "))).alias("trimmed"))


@query("""SELECT c_custkey, format('{:,.2f}', round(x, 2)) AS fixed, CASE WHEN round(x, 2) < 0 THEN format('(${:,.2f})', abs(round(x, 2))) ELSE format('${:,.2f}', abs(round(x, 2))) END AS dollar,
format('{:,.0f}', round(x, 0)) AS whole, format('{:.1f}%', round(x / 10000 * 100, 1)) AS pct FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""")
def fixed_formats(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", X.fixed(x).alias("fixed"), X.dollar(x).alias("dollar"), X.text(x, "#,##0").alias("whole"), X.text(x / 10000, "0.0%").alias("pct"))


@query("""SELECT o_orderkey, year(d)::INTEGER AS y, month(d)::INTEGER AS m, day(d)::INTEGER AS dd, (dayofweek(d) + 1)::INTEGER AS wd, weekofyear(d)::INTEGER AS iso,
(floor((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) / 7) + 1)::INTEGER AS wn, date_diff('day', DATE '1899-12-30', d)::INTEGER AS serial,
(make_date(year(d), 1, 1) + to_months((month(d) + 13)::INTEGER) + to_days(39))::DATE::VARCHAR AS made FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def date_parts(spark, sf_dir):
    d = F.col("d")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return rows.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("dd"), X.weekday(d).alias("wd"), X.isoweeknum(d).alias("iso"), X.weeknum(d).alias("wn"), X.date_to_serial(d).alias("serial"), X.date(F.year(d), F.month(d) + 14, F.lit(40)).cast("string").alias("made"))


@query("""SELECT o_orderkey, (d + to_months((o_orderkey % 30)::INTEGER))::DATE::VARCHAR AS edate, last_day((d + to_months(2))::DATE)::VARCHAR AS eomonth, date_diff('day', d, e)::INTEGER AS dd,
(date_diff('month', d, e) - (day(e) < day(d))::INT)::INTEGER AS mm, ((date_diff('month', d, e) - (day(e) < day(d))::INT) // 12)::INTEGER AS yy, ((date_diff('month', d, e) - (day(e) < day(d))::INT) % 12)::INTEGER AS ym,
round(date_diff('day', d, e) / 365.0, 8) AS frac3, round(date_diff('day', d, e) / 360.0, 8) AS frac2,
((year(e) - year(d)) * 360 + (month(e) - month(d)) * 30 + least(day(e), 30) - least(day(d), 30))::INTEGER AS eu360
FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + (o_orderkey % 900)::INTEGER)::DATE AS e FROM orders)""")
def date_shifts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).withColumn("e", F.date_add("d", (F.col("o_orderkey") % 900).cast("int")))
    d, e = F.col("d"), F.col("e")
    return rows.select("o_orderkey", X.edate(d, (F.col("o_orderkey") % 30).cast("int")).cast("string").alias("edate"), X.eomonth(d, F.lit(2)).cast("string").alias("eomonth"), X.datedif(d, e, "D").alias("dd"), X.datedif(d, e, "M").alias("mm"), X.datedif(d, e, "Y").alias("yy"), X.datedif(d, e, "YM").alias("ym"), F.round(X.yearfrac(d, e, 3), 8).alias("frac3"), F.round(X.yearfrac(d, e, 2), 8).alias("frac2"), X.days360(d, e, True).alias("eu360"))


@query("""SELECT event_id, extract('hour' FROM ts)::INTEGER AS h, extract('minute' FROM ts)::INTEGER AS m, floor(extract('second' FROM ts))::INTEGER AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def times_of_day(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    h, m, s = X.hms(X.time(F.hour("ts"), F.minute("ts"), F.second("ts")))
    return rows.select("event_id", h.alias("h"), m.alias("m"), s.alias("s"))


@query("""WITH days AS (SELECT d::DATE AS d, (isodow(d) < 6)::INT AS open FROM range(DATE '1990-01-01', DATE '2030-01-01', INTERVAL 1 DAY) t(d)), c AS (SELECT d, open, sum(open) OVER (ORDER BY d) AS n FROM days)
SELECT o_orderkey, (b.n - a.n + a.open)::BIGINT AS days, w.d::VARCHAR AS workday FROM (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 100)::INTEGER)::DATE AS e, 1 + o_orderkey % 20 AS k FROM orders) o
JOIN c a ON a.d = s JOIN c b ON b.d = e JOIN c w ON w.open = 1 AND w.n = a.n + k""")
def business_days(spark, sf_dir):
    calendar = N.business_calendar(spark, "1990-01-01", "2029-12-31")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 100).cast("int")).alias("e"), (1 + F.col("o_orderkey") % 20).alias("k"))
    return N.workday(N.networkdays(rows, "s", "e", calendar), "s", "k", calendar).select("o_orderkey", "days", F.col("workday").cast("string").alias("workday"))


@query("""SELECT c_custkey, round(CASE WHEN x >= 0 THEN sqrt(x) END, 8) AS root, round(CASE WHEN x > 0 THEN ln(x) END, 8) AS ln, round(CASE WHEN x > 0 THEN log(x) / log(2) END, 8) AS log2, sign(x)::INTEGER AS sgn,
round(atan2(2, x), 8) AS at, round(sin(x), 6) AS s, round(degrees(1.5), 8) AS deg, round(exp(x / 10000), 8) AS e FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""")
def math_direct(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(X.sqrt(x), 8).alias("root"), F.round(X.ln(x), 8).alias("ln"), F.round(X.log(x, 2), 8).alias("log2"), F.signum(x).cast("int").alias("sgn"), F.round(X.atan2(x, F.lit(2.0)), 8).alias("at"), F.round(F.sin(x), 6).alias("s"), F.round(F.degrees(F.lit(1.5)), 8).alias("deg"), F.round(F.exp(x / 10000), 8).alias("e"))


@query("""SELECT l_orderkey, l_linenumber, ceil(x / 7) * 7 AS up7, floor(x / 7) * 7 AS down7, round(x / 5) * 5 AS near5, x - 7 * floor(x / 7) AS m, trunc(x / 7) AS q, ceil(x / 2) * 2 AS ev,
CASE WHEN x = 0 THEN 1 ELSE ceil((x - 1) / 2) * 2 + 1 END AS od, trunc(-x / 3) AS rd, -ceil(x / 3) AS ru FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x FROM lineitem)""")
def rounding(spark, sf_dir):
    x = F.col("l_quantity")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d(X.ceiling(x, F.lit(7.0))).alias("up7"), d(X.floor(x, F.lit(7.0))).alias("down7"), d(X.mround(x, F.lit(5.0))).alias("near5"), d(X.mod(x, F.lit(7.0))).alias("m"), d(X.quotient(x, F.lit(7.0))).alias("q"), d(X.even(x)).alias("ev"), d(X.odd(x)).alias("od"), d(X.rounddown(-x / 3)).alias("rd"), d(X.roundup(-x / 3)).alias("ru"))


@query("""SELECT p_partkey, (factorial(n) / (factorial(3) * factorial(n - 3)))::DOUBLE AS c3, (n * (n - 1))::DOUBLE AS p2, factorial(n)::DOUBLE AS f, upper(format('{:x}', p_partkey)) AS hex, p_partkey AS back FROM (SELECT p_partkey, 3 + p_size % 10 AS n FROM part)""")
def counting_and_bases(spark, sf_dir):
    n = 3 + F.col("p_size") % 10
    return table(spark, sf_dir, "part").select("p_partkey", X.combin(n, F.lit(3)).alias("c3"), X.permut(n, F.lit(2)).alias("p2"), X.fact(n).alias("f"), X.base(F.col("p_partkey"), 16).alias("hex"), X.decimal(X.base(F.col("p_partkey"), 16), 16).alias("back"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' END AS ifs, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS sw,
CASE 1 + o_orderkey % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'z' END AS ch, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_totalprice / (o_custkey % 5) END AS safe, ((o_orderstatus = 'F')::INT + (o_totalprice > 100000)::INT) % 2 = 1 AS x,
(o_orderkey % 2 = 0) AS even FROM orders""")
def logic(spark, sf_dir):
    c = F.col
    price = c("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.ifs((price > 300000, F.lit("a")), (price > 100000, F.lit("b"))).alias("ifs"), E.switch(c("o_orderstatus"), (F.lit("F"), F.lit("done")), (F.lit("O"), F.lit("open")), default=F.lit("part")).alias("sw"), E.choose(1 + c("o_orderkey") % 3, F.lit("x"), F.lit("y"), F.lit("z")).alias("ch"), E.if_error(E.divide(price, c("o_custkey") % 5), F.lit(-1.0)).alias("safe"), E.xor_(c("o_orderstatus") == "F", price > 100000).alias("x"), E.is_even(c("o_orderkey")).alias("even"))


@query("""SELECT word, count(*) AS n, CASE WHEN regexp_full_match(word, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN 'n' ELSE 's' END AS t, try_cast(CASE WHEN regexp_full_match(word, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN word END AS DOUBLE) AS num
FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Za-z0-9]+') AND NOT regexp_full_match(word, '(?i)true|false|[0-9]+e[0-9]+') GROUP BY word""")
def typed_words(spark, sf_dir):
    """Every word of every text that SQL can type as well."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter(F.col("word").rlike("^[A-Za-z0-9]+$") & ~F.col("word").rlike("(?i)^(true|false|[0-9]+e[0-9]+)$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", P.infer(F.col("word")).alias("v")).select("word", "n", "v.t", "v.num")


@query("""SELECT c_custkey, c_acctbal AS back, c_acctbal / 100 AS pct FROM customer""")
def numbers_from_text(spark, sf_dir):
    text = F.format_number("c_acctbal", 2)
    return table(spark, sf_dir, "customer").select("c_custkey", P.to_number(text).alias("back"), (F.round(P.to_number(F.concat(text, F.lit("%"))), 10)).alias("pct"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN lower(p_brand) LIKE '%#1%' THEN 'first' WHEN p_retailprice BETWEEN 1000 AND 1100 THEN 'mid' END AS flag FROM part""")
def flagged_parts(spark, sf_dir):
    rules = [
        {"name": "mid", "priority": 3, "column": "p_retailprice", "kind": "between", "value": 1000, "value2": 1100},
        {"name": "big", "priority": 1, "column": "p_size", "kind": "gt", "value": 40},
        {"name": "first", "priority": 2, "column": "p_brand", "kind": "contains", "value": "#1"},
    ]
    return R.flag_rules(table(spark, sf_dir, "part"), rules).select("p_partkey", "flag")


@query("""WITH t AS (SELECT min(o_totalprice) AS b FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10)) SELECT o_orderkey, o_totalprice >= b AS top, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above,
count(*) OVER (PARTITION BY o_custkey) > 1 AS dup FROM orders, t""")
def flagged_ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = R.flag_ranked(rows, "o_totalprice", "top", 10, into="top")
    out = R.flag_ranked(out, "o_totalprice", "above", into="above")
    return R.flag_ranked(out, "o_custkey", "duplicate", into="dup").select("o_orderkey", "top", "above", "dup")


@query("""SELECT s_suppkey, '#' || upper(printf('%02x%02x%02x', round(255 + t * -255)::INT, round(255 * t)::INT, 0)) AS color FROM (SELECT s_suppkey, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS t FROM supplier)""")
def color_scaled(spark, sf_dir):
    return R.color_scale(table(spark, sf_dir, "supplier"), "s_acctbal", ["#FF0000", "#00FF00"]).select("s_suppkey", "color")


@query("""WITH a AS (SELECT range AS i FROM range(1, 16385)) SELECT i AS col, a3 || a2 || a1 AS name, '$' || a3 || a2 || a1 || '$' || (i * 3) AS address FROM (SELECT i, chr(65 + ((i - 1) % 26)::INT) AS a1,
CASE WHEN i > 26 THEN chr(65 + (((i - 1) // 26 - 1) % 26)::INT) ELSE '' END AS a2, CASE WHEN i > 702 THEN chr(65 + ((i - 703) // 676)::INT) ELSE '' END AS a3 FROM a WHERE i <= (SELECT count(*) FROM part))""")
def addresses(spark, sf_dir):
    from ..operators.lookups import positions

    cols = positions(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"]).filter(F.col("position") <= 16384)
    named = cols.select(F.col("position").alias("col"), K.column_name(F.col("position")).alias("name"), K.address(F.col("position") * 3, F.col("position")).alias("address"))
    return named.filter(K.parse_ref(F.col("address"))["col"] == F.col("col"))


LOANS = "(SELECT c_custkey AS loan_id, 0.01 + (c_custkey % 5) * 0.002 AS rate, 6 + c_custkey % 7 AS nper, 1000.0 + c_custkey AS pv, 0.0 AS fv, 0 AS due FROM customer)"


@query(f"""WITH p AS (SELECT *, -(pv * power(1 + rate, nper)) * rate / (power(1 + rate, nper) - 1) AS pay FROM {LOANS}), s AS (SELECT *, unnest(range(1, nper::BIGINT + 1))::INTEGER AS period FROM p)
SELECT loan_id, period, round(pay, 6) AS payment, round(-(pv * power(1 + rate, period - 1) + pay * (power(1 + rate, period - 1) - 1) / rate) * rate, 6) AS interest,
round(pv * power(1 + rate, period) + pay * (power(1 + rate, period) - 1) / rate, 4) + 0.0 AS balance FROM s""")
def loan_schedules(spark, sf_dir):
    c = F.col("c_custkey")
    loans = table(spark, sf_dir, "customer").select(c.alias("loan_id"), (F.lit(0.01) + (c % 5) * 0.002).alias("rate"), (6 + c % 7).cast("int").alias("nper"), (c + 1000.0).alias("pv"), F.lit(0.0).alias("fv"), F.lit(0).alias("due"))
    out = N.loan_schedule(loans)
    return out.select("loan_id", "period", F.round("payment", 6).alias("payment"), F.round("interest", 6).alias("interest"), (F.round("balance", 4) + 0.0).alias("balance"))


@query("""WITH a AS (SELECT p_partkey AS asset_id, p_retailprice AS cost, p_retailprice / 10 AS salvage, 3 + p_size % 5 AS life FROM part), s AS (SELECT *, unnest(range(1, life::BIGINT + 1))::INTEGER AS period FROM a)
SELECT asset_id, period, round((cost - salvage) / life, 6) AS sln, round((cost - salvage) * (life - period + 1) / (life * (life + 1) / 2), 6) AS syd,
round(greatest(greatest(cost * power(1 - 2.0 / life, period - 1), salvage) - greatest(cost * power(1 - 2.0 / life, period), salvage), 0), 6) AS ddb FROM s""")
def depreciation_schedules(spark, sf_dir):
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_retailprice").alias("cost"), (F.col("p_retailprice") / 10).alias("salvage"), (3 + F.col("p_size") % 5).alias("life"), F.lit(2.0).alias("factor"))
    return N.depreciation_schedule(assets).select("asset_id", "period", *[F.round(c, 6).alias(c) for c in ("sln", "syd", "ddb")])


@query("""WITH RECURSIVE n AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders),
f AS (SELECT o_custkey, list(CASE WHEN no = 1 THEN -o_totalprice ELSE o_totalprice / 4 END ORDER BY no) AS v FROM n GROUP BY 1),
b AS (SELECT o_custkey, v, -0.999999::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM f WHERE len(v) > 1 AND list_sum(list_transform(v, lambda x, k: x / power(11.0, k - 1))) < 0
  UNION ALL SELECT o_custkey, v, CASE WHEN list_sum(list_transform(v, lambda x, k: x / power(1 + (lo + hi) / 2, k - 1))) > 0 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN list_sum(list_transform(v, lambda x, k: x / power(1 + (lo + hi) / 2, k - 1))) > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 60)
SELECT o_custkey, round(lo, 8) AS irr FROM f LEFT JOIN (SELECT o_custkey, lo FROM b WHERE i = 60) USING (o_custkey)""")
def cashflow_rates(spark, sf_dir):
    """Each customer pays the first order's price and gets back parts of the later ones."""
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    flows = table(spark, sf_dir, "orders").select("o_custkey", no.alias("no"), "o_totalprice").withColumn("amount", F.when(F.col("no") == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 4))
    return N.cashflow_returns(flows, "o_custkey", "no", "amount").withColumn("irr", F.round("irr", 8))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey, o_totalprice AS pv, 6 + o_orderkey % 54 AS n FROM orders), p AS (SELECT *, -pv * (1.2 + (o_orderkey % 7) / 10.0) / n AS pmt FROM f),
b AS (SELECT o_orderkey, pv, n, pmt, 1e-9::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM p
  UNION ALL SELECT o_orderkey, pv, n, pmt, CASE WHEN pv + pmt * (1 - power(1 + (lo + hi) / 2, -n)) / ((lo + hi) / 2) < 0 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN pv + pmt * (1 - power(1 + (lo + hi) / 2, -n)) / ((lo + hi) / 2) < 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 70)
SELECT o_orderkey, round(lo, 8) AS rate FROM b WHERE i = 70""")
def loan_rates(spark, sf_dir):
    """Each order is paid off in instalments that add up to more than its price: at what rate?"""
    price, n = F.col("o_totalprice"), 6 + F.col("o_orderkey") % 54
    payment = -price * (1.2 + (F.col("o_orderkey") % 7) / 10) / n
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(N.rate(n, payment, price), 8).alias("rate"))
