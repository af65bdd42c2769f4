"""Headings, spellings, notices and long licence texts that the licence scan must see, and its SQL on planted variants."""

import os

import pytest
from conftest import SF, normal
from pyspark.sql import functions as F

from gridloom.llm import licenses

HEADINGS = ["Copyright (c) 2020 A\nCopyright 2021 B\n", "Copyright (c) 2020 A\nAll rights reserved.\n\n", "Copyright (c) 2020 A\r\nCopyright (c) 2021 B\r\nAll rights reserved.\r\n\r\n", "(c) A\n© B\n * copyright by C\n\n", "Copyright The Foo Authors\n", "Copyright Foo Inc. 2020\nCopyright, 2020 A\n", "  Portions Copyright (c) 2020 A\nPortions Copyright Émile B.\r\n\n"]
TEXTS = {"MIT": licenses.MIT, "BSD-2-Clause": licenses.BSD_START + licenses.BSD_END, "BSD-3-Clause": licenses.BSD_START + licenses.BSD_NAMES + licenses.BSD_END, "BSL-1.0": licenses.BOOST, "Unlicense": licenses.UNLICENSE}
LONG = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def planted():
    """(text, licence, notices): texts under headings and other spellings, near misses, and lines that name a licence."""
    rows = [(h + t, name, []) for h in HEADINGS for name, t in TEXTS.items()] + [(t + "\n" + h, name, []) for h in HEADINGS for name, t in TEXTS.items()]
    rows += [(licenses.MIT.upper().replace(",", " ,").replace("SUBLICENSE", "SUBLICENCE").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS"), "MIT", [])]
    rows += [(licenses.MIT[:-9], None, []), (licenses.MIT + " per cents", None, []), ("Copyright 2020 X\n" * 3, None, []), ("Copyright Holders\n" + licenses.MIT, None, []), ("copyright foo\n" + licenses.MIT, None, []), (None, None, []), ("", None, []), ("!!", None, []), ("\r", None, [])]
    rows += [("some text\nReleased under the MIT licence\nLICENSED UNDER CC BY-NC 4.0.\r\nmore", None, ["CC-BY-NC-4.0", "MIT"]), ("Licensed under the Apache License, Version 2.0.\nx\nLicensed under the Apache License, Version 2.0", None, ["Apache-2.0"])]
    rows += [("not Released under the MIT License.", None, []), ("superlicence licence licences licence", None, []), ("é" * 200_000 + "\nSPDX-License-Identifier: MIT", None, ["MIT"])]
    return rows


def scanned(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string").select("*", F.lit(1).alias("digest"), F.lit(2).alias("k0"))
    return licenses.scan(docs, licenses.digests(spark, licenses.LICENSES, licenses.DIGESTS))


def test_planted(spark):
    rows = planted()
    got = {r.doc_id: r for r in scanned(spark, rows).collect()}
    assert [(got[i].license, got[i].notices) for i in range(len(rows))] == [(name, held) for _, name, held in rows]


def test_sql_on_planted_variants(spark, duck):
    rows = planted()
    con = duck.cursor()
    con.execute("CREATE SCHEMA planted")
    con.execute("CREATE TABLE planted.documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO planted.documents VALUES (?, ?)", [(i, t) for i, (t, *_) in enumerate(rows)])
    expected = con.execute(licenses.OP6_SQL.replace("FROM documents", "FROM planted.documents")).df()
    assert normal(scanned(spark, rows).withColumn("notices", F.concat_ws(",", "notices")).toPandas()) == normal(expected)


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="no published texts on this machine")
def test_long_texts(spark):
    rows = [("Copyright (c) 2020 A\n" + open(f"/usr/share/common-licenses/{f}").read().upper(), name, None) for f, name in LONG.items()]
    assert [r.license for r in scanned(spark, rows).orderBy("doc_id").collect()] == list(LONG.values())


def test_documents_are_not_shuffled(spark):
    plan = licenses.op6_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_large_tables_of_digests_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(licenses, "FEW", 3)
    rows = planted()
    assert sum(r.license is not None for r in scanned(spark, rows).collect()) == sum(name is not None for _, name, _ in rows)


def test_empty_table_and_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, license string")
    assert licenses.scan(docs, licenses.digests(spark, licenses.LICENSES)).count() == 0
    held = spark.createDataFrame([("x", "text!")], "`a.b` string, text string")
    assert licenses.scan(held, licenses.digests(spark, licenses.LICENSES), keep=["a.b"]).columns == ["a.b", "digest", "license", "notices"]
