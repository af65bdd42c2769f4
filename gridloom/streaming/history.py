"""Change history, in batch and as a stream: accepted saves and kept versions.

The stateful stream and the batch form share one step function per project, so both give
the same rows for events in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds between kept versions, versions kept.
LEAST_SECONDS, VERSIONS = 120, 30
ACCEPT = "event_id long, project long, saved_at timestamp, outcome string"
KEPT = "project long, event_id long, saved_us long, content string"


def accept_step(version: pd.Timestamp | None, rows: pd.DataFrame) -> tuple[pd.Timestamp | None, list[tuple]]:
    """A save with a base is taken only if the base is the current version; without one always."""
    out = []
    for r in rows.sort_values(["saved_at", "event_id"]).itertuples(index=False):
        based = not pd.isna(r.base)
        taken = not based or (version is not None and r.base == version)
        out.append((r.event_id, r.project, r.saved_at, "accepted" if taken else "conflict"))
        version = r.saved_at if taken else version
    return version, out


def fold_projects(saves: DataFrame, step, start: tuple, schema: str, time: str = "saved_at") -> DataFrame:
    """Run a step function over each project's saves in time order, batch by batch.

    Rows are sorted within partitions and read as a stream with the state of one project at
    a time, so a project of any size needs the memory of one batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, start
        for batch in batches:
            out = []
            for project, rows in batch.groupby("project", sort=False, dropna=False):
                state = state if last == (project,) else start
                *state, made = step(*state, rows)
                last = (project,)
                out += made
            yield pd.DataFrame(out, columns=names)

    return saves.repartition("project").sortWithinPartitions("project", time, "event_id").mapInPandas(run, schema)


def accept_saves(saves: DataFrame) -> DataFrame:
    """saves(event_id, project, saved_at, base) -> each save with accepted or conflict."""
    return fold_projects(saves, accept_step, (None,), ACCEPT)


def accept_stream(saves: DataFrame) -> DataFrame:
    """The same on a stream, with the current version of each project as state."""
    names = [x.split()[0] for x in ACCEPT.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        version, out = accept_step(version, rows)
        if version is not None:
            state.update((version.to_pydatetime(),))
        yield pd.DataFrame(out, columns=names)

    return saves.groupBy("project").applyInPandasWithState(step, ACCEPT, "version timestamp", "append", GroupStateTimeout.NoTimeout)


def keep_step(kept: tuple | None, current: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, tuple | None, list[tuple]]:
    """Before a save, the state about to be replaced is kept if it differs from the last kept one,
    whose own save lies long enough back; a forced save keeps it whatever the clock says.

    Times are whole microseconds (saved_us); where one is missing only a forced save keeps."""
    out = []
    columns = (rows[c].tolist() for c in ("project", "saved_us", "event_id", "content", "forced"))
    saves = [(p, None if us != us or us is None else int(us), *rest) for p, us, *rest in zip(*columns)]
    for project, us, event, content, forced in sorted(saves, key=lambda s: (s[1] is None, s[1], s[2])):
        if current is not None:
            late = us is not None and kept is not None and kept[1] is not None and us - kept[1] >= LEAST_SECONDS * 1_000_000
            if kept is None or current[2] != kept[2] and (bool(forced) or late):
                kept = current
                out.append((project, *kept))
        current = (event, us, content)
    return kept, current, out


def _in_micros(saves: DataFrame) -> DataFrame:
    return saves.select("project", "event_id", F.unix_micros("saved_at").alias("saved_us"), "content", "forced")


def _in_time(versions: DataFrame) -> DataFrame:
    return versions.select(*[F.timestamp_micros("saved_us").alias("saved_at") if c == "saved_us" else c for c in versions.columns])


def snapshot_trail(saves: DataFrame, versions: int = VERSIONS) -> DataFrame:
    """saves(event_id, project, saved_at, content, forced) -> kept versions, the newest `versions` of each project."""
    kept = _in_time(fold_projects(_in_micros(saves), keep_step, (None, None), KEPT, "saved_us"))
    newest = Window.partitionBy("project").orderBy(F.desc("saved_at"), F.desc("event_id"))
    return kept.withColumn("version_no", F.row_number().over(newest)).filter(F.col("version_no") <= versions)


def snapshot_stream(saves: DataFrame, versions: int = VERSIONS) -> DataFrame:
    """Versions as they are kept (change `kept`) and as they leave the newest `versions` of their project (change `dropped`).

    The state of a project is a list of its kept versions, oldest first and never longer than `versions`, with
    the current save behind them; what is kept and not dropped is what `snapshot_trail` gives.  States pass to and from Python
    by the batch.  They are held in the RocksDB state store, which the session is set to."""
    names = [*[x.split()[0] for x in KEPT.split(", ")], "change"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        kept, current = held[:-1], held[-1] if held else None
        _, current, made = keep_step(kept[-1] if kept else None, current, pd.concat(list(batches), ignore_index=True))
        kept += [m[1:] for m in made]
        cut = max(0, len(kept) - versions)
        gone, kept = kept[:cut], [*kept[cut:], current]
        state.update(tuple(list(x) for x in zip(*kept)))
        yield pd.DataFrame([(*m, "kept") for m in made] + [(key[0], *s, "dropped") for s in gone], columns=names)

    saves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    state = "ids array<bigint>, saved_us array<bigint>, contents array<string>"
    return _in_time(_in_micros(saves).groupBy("project").applyInPandasWithState(step, f"{KEPT}, change string", state, "append", GroupStateTimeout.NoTimeout))


def version_at(trail: DataFrame, project: int, at: str) -> DataFrame:
    """The kept version of a project that was current at a time."""
    return trail.filter((F.col("project") == project) & (F.col("saved_at") <= F.lit(at).cast("timestamp"))).orderBy(F.desc("saved_at"), F.desc("event_id")).limit(1)


def versions_at(trail: DataFrame, at: str) -> DataFrame:
    """The same for every project: its newest kept version at a time."""
    before = trail.filter(F.col("saved_at") <= F.lit(at).cast("timestamp"))
    return before.groupBy("project").agg(F.max_by(F.struct("event_id", "saved_at", "content"), F.struct("saved_at", "event_id")).alias("v")).select("project", "v.*")


def restore(trail: DataFrame, current: DataFrame, project: int, version_no: int) -> DataFrame:
    """Saves to append for a restore: the current state first (forced), then the chosen version."""
    chosen = trail.filter((F.col("project") == project) & (F.col("version_no") == version_no)).select("project", "content")
    now = current.filter(F.col("project") == project).select("project", "content")
    return now.withColumn("step", F.lit(1)).unionByName(chosen.withColumn("step", F.lit(2)))


def restore_all(trail: DataFrame, current: DataFrame, version_no: int) -> DataFrame:
    """The same for every project that has a version of this number."""
    chosen = trail.filter(F.col("version_no") == version_no).select("project", "content")
    now = current.select("project", "content").join(chosen.select("project"), "project", "left_semi")
    return now.withColumn("step", F.lit(1)).unionByName(chosen.withColumn("step", F.lit(2)))
