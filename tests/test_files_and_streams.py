"""Sources and sinks on small folders; streams against their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.sources import files as S
from gridloom.streaming import history as T
from gridloom.streaming import store


def test_sheets_and_projects(spark, tmp_path):
    folder = tmp_path / "budget.grid"
    folder.mkdir()
    sheet = {"id": "s1", "name": "One", "styles": {"st1": {"bold": "true"}}, "cells": {"A1": {"v": "name", "st": "st1"}, "B1": {"v": "n"}, "A2": {"v": "x"}, "B2": {"v": 5, "f": "=2+3"}, "??": {"v": 1}, "C9": {}}}
    (folder / "one.cells.json").write_text(json.dumps(sheet))
    (folder / "manifest.json").write_text(json.dumps({"title": "Budget", "modified": "2026-01-02", "entries": [{"id": "s1"}]}))
    got = {(r.ref, r.v_num, r.v_str, r.f) for r in S.scan_cells(spark, f"{folder}/*.cells.json").collect()}
    assert got == {("A1", None, "name", None), ("B1", None, "n", None), ("A2", None, "x", None), ("B2", 5.0, None, "=2+3")}
    project = S.list_projects(spark, f"{tmp_path}/*/manifest.json").first()
    assert (project.folder, project.type, project.title, project.item_count, project.warning) == ("budget.grid", "grid", "Budget", 1, False)
    files = S.file_inventory(spark, str(tmp_path)).first()
    assert (files.project, files.files) == ("budget.grid", 2)


def test_markdown_and_layouts(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 'T'\n---\n\nbody")
    (tmp_path / "b.md").write_text("no front")
    got = {r.body: r.meta for r in S.scan_markdown(spark, f"{tmp_path}/*.md").collect()}
    assert got == {"body": {"title": "T"}, "no front": {}}
    regions = spark.createDataFrame([("s", "x", "hi"), ("s", "y", "ho")], "item_id string, block_id string, md string")
    layouts = spark.createDataFrame([("s", json.dumps({"blocks": [{"id": "x", "x": 1, "y": 2, "w": 3, "h": 4}]}))], "item_id string, layout string")
    assert {r.block_id: r.geom and r.geom.w for r in S.scan_blocks(regions, layouts).collect()} == {"x": 3.0, "y": None}
    listed = spark.createDataFrame([("p", 1, "b.md"), ("p", 2, "gone.md")], "project_id string, item_no int, md_path string")
    there = spark.createDataFrame([("p", "a.md"), ("p", "b.md")], "project_id string, md_path string")
    assert [(r.md_path, r.listed) for r in S.resolve_items(listed, there).orderBy("item_no").collect()] == [("b.md", True), ("a.md", False)]


def test_csv_and_tsv(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', " x", 1), ("line\nbreak", None, 2)], "s string, t string, n int").coalesce(1)
    S.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_bytes().decode()
    assert text.startswith("﻿s,t,n\r\n") and '"a ""q"", b", x,1\r\n' in text
    S.write_tsv(df.select(F.lit("a\tb").alias("s"), F.lit("12%").alias("t")).limit(1), str(tmp_path / "tsv"))
    back = S.read_tsv(spark, str(tmp_path / "tsv"), ["s", "t"]).filter("s.str <> 's'").first()
    assert (back.s.str, back.t.num) == ("a b", 0.12)


def saves(spark):
    rows = [(1, 1, 0, None, "a"), (2, 1, 60, 0, "b"), (3, 1, 100, 0, "c"), (4, 1, 300, 60, "d"), (5, 1, 500, None, "e"), (6, 2, 10, 5, "x")]
    df = spark.createDataFrame(rows, "event_id long, project long, s long, b long, content string")
    return df.select("event_id", "project", F.timestamp_seconds("s").alias("saved_at"), F.timestamp_seconds("b").alias("base"), "content", F.lit(False).alias("forced"))


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def test_history(spark, tmp_path):
    batch = saves(spark)
    want = {1: "accepted", 2: "accepted", 3: "conflict", 4: "accepted", 5: "accepted", 6: "conflict"}
    assert {r.event_id: r.outcome for r in T.accept_saves(batch).collect()} == want
    kept = T.snapshot_trail(batch.filter("project = 1")).orderBy("saved_at").collect()
    assert [r.content for r in kept] == ["a", "c", "d"] and [r.version_no for r in kept] == [3, 2, 1]
    assert T.version_at(T.snapshot_trail(batch), 1, "1970-01-01 00:04:00").first()["content"] == "c"
    for k, part in enumerate((batch.filter("event_id <= 3"), batch.filter("event_id > 3"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    read = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    assert {r.event_id: r.outcome for r in drain(T.accept_stream(read()), "accepted_stream").collect()} == want
    assert {r.content for r in drain(T.snapshot_stream(read()), "kept_stream").filter("project = 1").collect()} == {"a", "c", "d"}


TOTALS = lambda c: c.groupBy("project_id", "sheet_id").agg(F.sum("v_num").alias("total"), F.count("*").alias("n"))
CELLS = "project_id string, sheet_id string, row int, col int, v_num double"


def test_stream_cells(spark, tmp_path):
    """Sheets of one id in two projects are two; a later file of a sheet adds to it and changes it."""
    put = lambda k, rows: spark.createDataFrame(rows, CELLS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    start = lambda: store.stream_cells(spark.readStream.schema(CELLS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), TOTALS, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=3)
    profiles = lambda: {(r.project_id, r.sheet_id): (r.total, r.n) for r in store.stored(spark, f"{tmp_path}/out", "profiles").collect()}
    put(0, [("p", "a", 1, 1, 1.0), ("p", "a", 2, 1, 4.0), ("p", "b", 1, 1, 2.0), ("q", "b", 1, 1, 7.0), (None, None, 1, 1, 9.0)])
    start().awaitTermination()
    put(1, [("p", "b", 1, 1, 5.0), ("p", "a", 2, 1, 5.0), ("p", "a", 3, 1, 10.0), (None, None, 1, 1, 8.0), (None, None, 1, 2, 1.0)])
    start().awaitTermination()
    assert profiles() == {("p", "a"): (16.0, 3), ("p", "b"): (5.0, 1), ("q", "b"): (7.0, 1), (None, None): (9.0, 2)}
    assert {(r.row, r.v_num) for r in store.stored(spark, f"{tmp_path}/out").filter("project_id = 'p' AND sheet_id = 'a'").collect()} == {(1, 1.0), (2, 5.0), (3, 10.0)}
    start().awaitTermination()  # nothing new
    assert len(profiles()) == 4


def test_replays_and_broken_batches(spark, tmp_path):
    target = f"{tmp_path}/t"
    schema = f"{CELLS}, version int, deleted boolean"
    of = lambda rows: spark.createDataFrame(rows, schema)
    cells = lambda: sorted((r.sheet_id, r.row, r.v_num) for r in store.stored(spark, target).collect())
    first = of([("p", "a", 1, 1, 1.0, 1, False), ("p", "a", 2, 1, 2.0, 1, None), ("p", "b", 1, 1, 3.0, 1, False), ("p", "a", 1, 1, 1.5, 2, False)])
    assert store.merge_batch(first, 0, TOTALS, target, ["version"], 2)
    assert cells() == [("a", 1, 1.5), ("a", 2, 2.0), ("b", 1, 3.0)]
    assert not store.merge_batch(of([("p", "a", 1, 1, 99.0, 9, False)]), 0, TOTALS, target, ["version"], 2) and cells()[0] == ("a", 1, 1.5)

    def dies(_):
        raise RuntimeError("lost")

    change = of([("p", "a", 1, 1, 7.0, 3, False), ("p", "a", 2, 1, None, 3, True), ("p", "c", 5, 1, 4.0, 1, False)])
    with pytest.raises(RuntimeError):
        store.merge_batch(change, 1, dies, target, ["version"], 2)
    assert cells() == [("a", 1, 1.5), ("a", 2, 2.0), ("b", 1, 3.0)]  # written in part, not committed
    assert store.merge_batch(change, 1, TOTALS, target, ["version"], 2)
    late = of([("p", "a", 2, 1, 2.5, 2, False), ("p", "a", 1, 1, 0.0, 1, False)])
    assert store.merge_batch(late, 2, TOTALS, target, ["version"], 2)
    assert cells() == [("a", 1, 7.0), ("b", 1, 3.0), ("c", 5, 4.0)]
    assert store.merge_batch(late.limit(0), 3, TOTALS, target, ["version"], 2)
    profiles = lambda: {r.sheet_id: (r.total, r.n) for r in store.stored(spark, target, "profiles").collect()}
    assert profiles() == {"a": (7.0, 1), "b": (3.0, 1), "c": (4.0, 1)}
    assert store.vacuum(spark, target) > 0 and profiles()["b"] == (3.0, 1) and len(cells()) == 3


def test_versions_leave_the_stream(spark, tmp_path):
    """More versions than are kept: what is kept and not dropped is the batch form's trail."""
    rows = [(i, i % 2, 1_000 + 130 * i, f"t{i // 2}", i % 11 == 0) for i in range(160)] + [(900, None, 5_000, "n", False), (901, None, 9_000, "m", False)]
    batch = spark.createDataFrame(rows, "event_id long, project long, s long, content string, forced boolean").select("event_id", "project", F.timestamp_seconds("s").alias("saved_at"), "content", "forced")
    for k in range(3):
        batch.filter(f"event_id >= {60 * k} AND ({k} = 2 OR event_id < {60 * k + 60})").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = drain(T.snapshot_stream(read), "versions_stream")
    of = lambda change: {(r.project, r.event_id) for r in seen.collect() if r.change == change}
    want = [(r.project, r.event_id) for r in T.snapshot_trail(batch).collect()]
    assert of("kept") - of("dropped") == set(want) and len(set(want)) == len(want)
    assert of("dropped") and sum(p == 0 for p, _ in want) == T.VERSIONS


def test_states_of_versions_pass_by_the_batch(spark, tmp_path):
    """The stream of versions exchanges states with Python in Arrow batches, not value by value; over two batches it gives what the batch form does."""
    rows = [(p * 1000 + i, p, f"2024-01-01 00:{i % 60:02}:{i // 60:02}", f"c{i % 7}", i % 3 == 0) for p in (1, 2) for i in range(90)]
    saves = spark.createDataFrame(rows, "event_id long, project long, at string, content string, forced boolean").selectExpr("event_id", "project", "CAST(at AS timestamp) AS saved_at", "content", "forced")
    early, late = saves.filter("saved_at < '2024-01-01 00:30:00'"), saves.filter("saved_at >= '2024-01-01 00:30:00'")
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    made = T.snapshot_stream(spark.readStream.schema(saves.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 5)
    assert "TransformWithState" not in made._jdf.queryExecution().analyzed().toString()
    made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(made.schema).parquet(f"{tmp_path}/out").groupBy("project", "event_id", "saved_at").agg(F.bool_or(F.col("change") == "dropped").alias("gone")).filter("NOT gone")
    assert {(r.project, r.event_id, r.saved_at) for r in seen.collect()} == {(r.project, r.event_id, r.saved_at) for r in T.snapshot_trail(saves, 5).collect()}


def test_batches_do_not_grow_with_files(spark, monkeypatch):
    """Changes of many files each are merged a change at a time."""
    from conftest import SF

    from gridloom.plans import catalogue

    batches, merge = [], store.merge_batch
    monkeypatch.setattr(store, "merge_batch", lambda changes, number, *rest: (batches.append(number), merge(changes, number, *rest))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalogue.queries()["streamed_updates"](spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 <= len(batches) <= 4


def test_blocks_are_given_back_in_slices(spark):
    """A batch of texts is not held as blocks all at once, and each text keeps its own blocks."""
    import pandas as pd

    from gridloom.operators import documents as D

    sizes = [len(x) for x in D.by_slices(iter([pd.Series(["a"] * 10_000), pd.Series([], dtype=object)]), lambda x: [x])]
    assert max(sizes) <= D.SLICE and sum(sizes) == 10_000
    docs = spark.range(0, 3_000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id", F.lit("\n\nq"), "id").alias("text"))
    got = D.split_blocks(docs).filter(F.col("md") != F.concat(F.when(F.col("pos") == 0, "p").otherwise("q"), "doc_id"))
    assert got.isEmpty() and D.split_blocks(docs).count() == 6_000
