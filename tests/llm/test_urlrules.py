"""URL filters: stated rules and parts by table, mined rules against all token sets (in SQL) on planted pages."""

import duckdb
import pytest
from conftest import normal
from pyspark.sql import functions as F

from gridloom.llm import queries, urlrules

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, None),
        ("no scheme/net/", "", "", None, None),
        ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://net", "net", "", None, None),
        ("http://net?/", "net", "", None, None),
        ("http://xnet/", "xnet", "/", None, None),
        ("http://example.net/en/5?a=b#c", "example.net", "/en/5", "example.net/en/", "allow"),
        ("HTTP://W.EXAMPLE.NET/EN/5", "w.example.net", "/EN/5", "net/", "block"),
        ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("x://a.example.com/de/y", "a.example.com", "/de/y", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("http://e.org/fr/://net/", "e.org", "/fr/://net/", "org/fr/", "allow"),
        ("://", "", "", None, None),
        ("http://ÀB.org/ñ\n/#q", "Àb.org", "/ñ\n/", None, None),
        ("http://user@h.net:80/", "user@h.net:80", "/", None, None),
    ],
)
def test_parts_and_stated_rules(spark, url, host, path, rule, verdict):
    page = urlrules.addressed(spark.createDataFrame([(1, url, "")], PAGES))
    got = page.select("host", "path", urlrules.stated(F.col("host"), F.col("path")).alias("s")).select("host", "path", "s.rule", "s.verdict").first()
    assert tuple(got) == (host, path, rule, verdict)


def planted():
    """Pages of bad hosts, of a bad pair of tokens, of a template of many parts, and of mixed ones."""
    pages, labels = [], []
    for i in range(600):
        n = 1_000 + i
        url = {
            0: f"https://spam.example.org/en/{n}",
            1: f"http://m.site{i % 7}.example.com/{'x' if i % 2 else 'y'}/{n}?{'ref=1' if i % 3 == 1 else 'page=2'}",
            2: f"http://shop.example.org/a/b/c/d/e/f/g/h/i/j/k/l/m/{n}.html",
            3: f"https://fine{i % 5}.example.org/de/{n}/#top",
            4: f"https://blog.other.example.com/es/{n}",
        }[i % 5]
        bad = i % 5 == 0 and i % 10 < 8 or i % 5 == 1 and i % 6 == 1 or i % 5 == 2 and i % 4 == 0
        pages.append((n * 2, url, "<p>"))
        if i % 6:
            labels.append((n, 0 if bad and i % 2 else 1, int(bad and i % 2 == 0)))
    pages += [(None, "https://spam.example.org/en/5", None), (7, "https://spam.example.org/en/6", ""), (7, "https://spam.example.org/en/6", ""), (8, None, None), (9, "", ""), (10, "https://q.example.com/" + "z" * 50_000, "")]
    labels += [(None, 0, 1), (1_001, 1, 0), (1_001, 0, None), (9_999, 0, 0)]
    return pages, labels


def test_mined_rules(spark, tmp_path):
    pages, labels = planted()
    spark.createDataFrame(pages, PAGES).withColumn("tokens", F.lit(1)).withColumn("host", F.lit(2)).withColumn("a.b", F.lit(3)).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, LABELS).withColumn("bad", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op12_url_filters"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert normal(got) == normal(con.execute(urlrules.OP12_SQL).df())
    assert set(got[got["host"] == "spam.example.org"]["verdict"]) == {"block"} and len(got) == len(pages)
    pair = got[got["host"].str.startswith("m.site") & got["rule"].isna()]
    assert {(("/x/" in r.path), r.verdict) for r in pair.itertuples()} >= {(False, "allow"), (True, "block")}
    assert set(got[got["host"] == "blog.other.example.com"]["verdict"]) == {"allow"}


def test_no_labels_and_no_pages(spark):
    pages, labels = planted()
    pages, labels = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    none = urlrules.mine(urlrules.labelled(urlrules.addressed(pages), labels.limit(0)))
    assert none.count() == 0
    judged = urlrules.judge(urlrules.addressed(pages), none)
    assert judged.count() == pages.count() and judged.filter("mined_rule IS NOT NULL").count() == 0
    assert urlrules.judge(urlrules.addressed(pages.limit(0)), none).count() == 0
    assert urlrules.mine(urlrules.labelled(urlrules.addressed(pages), labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)}))).count() == 0
