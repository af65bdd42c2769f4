"""URL filters: stated host rules first, then association rules mined from labels.

1. A url is cut into host and path.  A stated rule fits its host and all subdomains where the path
   begins with the rule's; the longest rule that fits decides.
2. Other urls are judged by rules mined with Spark's FP-growth: a transaction holds the tokens of
   a labelled page's url (scheme, host and its ends, path segments with digits folded, query keys,
   fragment) and its label.  Kept are token sets that imply the label often enough (SUPPORT pages)
   and surely enough (CONFIDENCE), less those of which a smaller set is at least as sure.
3. Mined rules are matched by an inverted index: each stands under its rarest token only, urls meet
   it there by an equi-join and are then checked for its other tokens.  Urls of one token set are
   judged once.  A url that fits a mined rule is blocked, any other allowed.

Tokens that occur in exactly the same transactions are mined as one (the smallest of them), so the
many parts of a common template do not multiply token sets.

A page's label is that of the document its path ends in (`/en/123`, `/en/123.html`): bad if any
of its labels says toxic 1 or quality 0.

Rules: a null url, or one without `://`, has an empty host and path and no tokens, so it is allowed.
Only A-Z are lower-cased.  Pages of repeated or null ids are judged row by row; labels with null ids
teach nothing.  Columns other than id and url are not read; an empty table gives no rows; without
labels, or with none of a kind, nothing is mined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, named, table

#: Stated rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A mined rule holds on this share of the labelled pages (in thousandths), and on LEAST_PAGES, at least.
SUPPORT_THOUSANDTHS, LEAST_PAGES = 5, 10
#: Share of bad pages among those that hold the tokens, in tenths.
CONFIDENCE_TENTHS = 6
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first `://`; NULL where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest stated rule that fits; NULL fields if none does."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    # the last `when` of equal length that is put around the others decides
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(chosen)
    return chosen


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url; none without `://`."""
    parts = F.split(host, "\\.")
    ends = F.when(F.size(parts) > 1, F.concat(F.lit("domain="), F.element_at(parts, -2), F.lit("."), F.element_at(parts, -1)))
    outer = F.when(F.size(parts) > 2, F.concat(F.lit("sub="), F.element_at(parts, 1)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "#")))
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key="), F.split(s, "=", 2)[0]))
    whole = F.array(
        F.concat(F.lit("scheme="), F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)), F.concat(F.lit("host="), host), ends, outer,
        F.concat(F.lit("end="), F.element_at(parts, -1)), F.when(path.endswith("/"), F.lit("slash")), F.when(F.locate("#", url) > 0, F.concat(F.lit("fragment="), F.substr(url, F.locate("#", url) + 1))),
    )
    made = F.array_sort(F.array_distinct(F.concat(F.filter(whole, lambda t: t.isNotNull()), segments, keys)))
    return F.when(F.locate("://", url) > 0, made).otherwise(F.array().cast("array<string>"))


def addressed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, tokens) of each page."""
    cut = pages.select(named("page_id").alias("page_id"), named("url").alias("url"))
    cut = cut.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return cut.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tx, tokens, bad) of the pages whose document has a label."""
    marks = labels.filter(named("doc_id").isNotNull()).groupBy(named("doc_id").alias("doc")).agg(
        F.coalesce(F.max(((named("toxic") == 1) | (named("quality") == 0)).cast("int")), F.lit(0)).alias("bad"))
    doc = F.regexp_extract("path", "/([0-9]{1,18})(\\.[A-Za-z]+)?/?$", 1).try_cast("bigint")
    met = pages.withColumn("doc", doc).filter("doc IS NOT NULL").select("tokens", "doc").join(marks, "doc")
    return met.select(F.monotonically_increasing_id().alias("tx"), "tokens", "bad")


def mine(known: DataFrame, thousandths: int = SUPPORT_THOUSANDTHS, least_pages: int = LEAST_PAGES, tenths: int = CONFIDENCE_TENTHS) -> DataFrame:
    """(antecedent array<string>, n_bad, n_all): the token sets that imply a bad page.

    Tokens rarer than the support can be in no rule and go first."""
    spark = known.sparkSession
    known = materialise(known)
    pages = known.count()
    least = max(least_pages, -(-pages * thousandths // 1_000))
    each = known.select("tx", F.explode("tokens").alias("token"))
    # equal counts and equal sums of hashes: the same transactions
    signed = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("tx").cast("decimal(38,0)")).alias("which"), F.min("tx").alias("first")).filter(F.col("n") >= least)
    # at most (tokens a url / support) tokens are left
    frequent = materialise(signed.groupBy("n", "which", "first").agg(F.min("token").alias("token")).select("token"))
    items = each.join(F.broadcast(frequent), "token").groupBy("tx").agg(F.collect_set("token").alias("items"))
    baskets = items.join(known.select("tx", "bad"), "tx").select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    schema = "antecedent array<string>, n_bad bigint, n_all bigint"
    baskets = materialise(baskets)
    count = baskets.count()
    if count < least:
        return spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / count, minConfidence=0.0).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    found = materialise(found)
    bad = found.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("n_bad"))
    sure = bad.join(found.select("items", F.col("freq").alias("n_all")), "items").filter(F.col("n_bad") * 10 >= F.col("n_all") * tenths)
    sure = materialise(sure.select(F.col("items").alias("antecedent"), "n_bad", "n_all"))
    # a rule goes if one of its subsets is a rule as sure: met under the subset's rarest token
    smaller = indexed(sure, "antecedent").select("token", F.col("antecedent").alias("part"), F.col("n_bad").alias("p_bad"), F.col("n_all").alias("p_all"))
    needless = sure.select("antecedent", "n_bad", "n_all", F.explode("antecedent").alias("token")).join(smaller, "token").filter(
        (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("p_bad") * F.col("n_all") >= F.col("n_bad") * F.col("p_all"))
    )
    return sure.join(needless.select("antecedent").distinct(), "antecedent", "left_anti").select("antecedent", "n_bad", "n_all")


def indexed(rules: DataFrame, antecedent: str) -> DataFrame:
    """The rules with `token`, the one of theirs that is in the fewest rules: the inverted index."""
    spread = rules.withColumn("token", F.explode(antecedent))
    lists = spread.groupBy("token").agg(F.count("*").alias("in_rules"))
    rarest = Window.partitionBy(antecedent).orderBy("in_rules", "token")  # a row a token of one rule
    return spread.join(lists, "token").withColumn("no", F.row_number().over(rarest)).filter("no = 1").drop("no", "in_rules")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, antecedent, n_bad, n_all): for each distinct token set the surest rule within it; sets without one are left out."""
    met = sets.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(indexed(rules, "antecedent"), "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    surest = F.max_by(F.struct("antecedent", "n_bad", "n_all"), F.struct(F.col("n_bad") / F.col("n_all"), F.col("n_bad"), -F.size("antecedent"), F.concat_ws(" ", "antecedent")))
    return met.groupBy("tokens").agg(surest.alias("best")).select("tokens", "best.*")


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of `addressed` pages."""
    ruled = pages.withColumn("said", stated(F.col("host"), F.col("path"), rules))
    hits = matched(ruled.filter("said IS NULL"), mined).select(F.col("tokens").alias("of"), F.concat_ws(" ", "antecedent").alias("found"))
    mined_rule = F.when(F.col("said").isNull(), F.col("found"))
    verdict = F.coalesce(F.col("said.verdict"), F.when(mined_rule.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(hits, F.col("tokens") == F.col("of"), "left").select("page_id", "host", "path", F.col("said.rule").alias("rule"), verdict.alias("verdict"), mined_rule.alias("mined_rule"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = addressed(table(spark, sf_dir, "pages"))
    return judge(pages, materialise(mine(labelled(pages, table(spark, sf_dir, "labels")))))


def _rules_sql() -> str:
    by_length = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    return " ".join(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}') THEN {{verdict: '{verdict}', rule: '{of + start}'}}" for verdict, of, start in by_length)


#: Token sets of every labelled page, one by one: for small tables.
OP12_SQL = rf"""
WITH marks AS (
  SELECT doc_id, coalesce(max((toxic = 1 OR quality = 0)::INT), 0) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), r AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, url, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM r
), s AS (SELECT *, string_split(host, '.') AS parts FROM h), t AS MATERIALIZED (
  SELECT page_id, host, path, CASE {_rules_sql()} END AS said, try_cast(regexp_extract(path, '/([0-9]{{1,18}})([.][A-Za-z]+)?/?$', 1) AS BIGINT) AS doc_id,
         CASE WHEN rest IS NULL THEN [] ELSE list_sort(list_distinct(list_concat([
           'scheme=' || translate(string_split(url, '://')[1], '{UPPER}', '{LOWER}'), 'host=' || host, 'end=' || parts[-1],
           CASE WHEN len(parts) > 1 THEN 'domain=' || parts[-2] || '.' || parts[-1] END, CASE WHEN len(parts) > 2 THEN 'sub=' || parts[1] END,
           CASE WHEN ends_with(path, '/') THEN 'slash' END, CASE WHEN contains(url, '#') THEN 'fragment=' || substr(url, position('#' IN url) + 1) END
         ], list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '#', 'g')),
         list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'key=' || string_split(x, '=')[1])))) END AS tokens
  FROM s
), k AS MATERIALIZED (SELECT row_number() OVER () AS tx, tokens, bad FROM t JOIN marks USING (doc_id)),
l AS (SELECT greatest({LEAST_PAGES}, (count(*) * {SUPPORT_THOUSANDTHS} + 999) // 1000) AS least FROM k),
e AS (SELECT tx, bad, unnest(tokens) AS token FROM k),
f AS (SELECT token, list(tx ORDER BY tx) AS which FROM e GROUP BY token HAVING count(*) >= (SELECT least FROM l)),
q AS (SELECT min(token) AS token FROM f GROUP BY which),
i AS MATERIALIZED (SELECT tx, bad, list(token ORDER BY token) AS items FROM e WHERE token IN (SELECT token FROM q) GROUP BY tx, bad),
c AS (SELECT bad, items, unnest(range(1, (1::BIGINT << len(items)))) AS m FROM i),
g AS (SELECT list_filter(items, lambda x, n: ((m >> (n - 1)) & 1) = 1) AS antecedent, bad FROM c),
u AS MATERIALIZED (
  SELECT antecedent, sum(bad)::BIGINT AS n_bad, count(*) AS n_all FROM g GROUP BY antecedent
  HAVING sum(bad) >= (SELECT least FROM l) AND sum(bad) * 10 >= count(*) * {CONFIDENCE_TENTHS}
), v AS MATERIALIZED (
  SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS p WHERE len(p.antecedent) < len(u.antecedent) AND list_has_all(u.antecedent, p.antecedent) AND p.n_bad * u.n_all >= u.n_bad * p.n_all)
), d AS (SELECT DISTINCT tokens FROM t WHERE said IS NULL),
b AS (
  SELECT tokens, array_to_string(antecedent, ' ') AS mined_rule FROM d JOIN v ON list_has_all(d.tokens, v.antecedent)
  QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY n_bad / n_all DESC, n_bad DESC, len(antecedent), mined_rule DESC) = 1
)
SELECT page_id, host, path, said.rule AS rule, coalesce(said.verdict, CASE WHEN mined_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN said IS NULL THEN mined_rule END AS mined_rule
FROM t LEFT JOIN b USING (tokens)
"""
