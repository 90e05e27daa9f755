"""Tables of parsed reports: append once per key, delete or replace a source, reset, publish a copy, and the refresh that chains
them. Every change is one commit (`commits`): readers in any session see it whole or not at all, and writers do not undo each
other."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from podium.sources import commits
from podium.sources.commits import file_system, read, sweep

__all__ = ["append_events", "compact", "delete_sources", "file_system", "once_per_key", "publish", "read", "refresh",
           "replace_source", "reset", "shared_dir", "stored", "sweep"]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where unset, a fresh temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def once_per_key(rows: DataFrame, key: str = "post_id", record: str = "record") -> DataFrame:
    """Rows without those that repeat a key of the same batch: where a column `record` tells records apart, the first record
    of a key stays; equal rows stay once."""
    if record in rows.columns:
        first = F.min(record).over(Window.partitionBy(key))
        rows = rows.withColumn("_first", first).filter(F.col(record).eqNullSafe(F.col("_first"))).drop("_first", record)
    return rows.distinct()


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder, for plans that read them more than once."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _staged(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows, computed once and written aside, and what deletes them; rows that cannot be computed raise here."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    fs, there = file_system(spark, path)
    return spark.read.schema(rows.schema).parquet(path), lambda: fs.delete(there, True)


def append_events(
    rows: DataFrame,
    path: str,
    *,
    key: str = "post_id",
    stream: tuple[str, int] | None = None,
    partials: Callable[[DataFrame], DataFrame] | None = None,
    replaced: Iterable[str] = (),
) -> DataFrame:
    """Append the rows of events that have a date, a placement, and a key that is neither loaded nor met before in the batch;
    returns (status, n) counts of events: added, exists, no_date, no_placements.

    `replaced` sources go in the same commit, so their keys do not count as loaded. `partials` makes partial aggregates of the
    new rows, kept beside them. To replace rows by none is refused. A `stream` is a name and the number of its batch: a batch that was committed before is
    left out, with the status repeated. Of the loaded keys only those are read whose files may hold one of the new ones, by
    their filters. A writer that loses a race to others keeps its files unless these may hold one of its keys.
    """
    spark, replaced = rows.sparkSession, list(replaced)
    staged, clear = _staged(once_per_key(rows, key))
    cleared = [clear]
    try:
        keys, name, seen = commits.Keys(staged, key), None, set()
        while True:
            at = commits.snapshot(spark, path)
            if stream and at.streams.get(stream[0], -1) >= stream[1]:
                counts = [("repeated", staged.select(key).distinct().count())]
                break
            base = at.without(replaced)
            if name is None or keys.may_be_in(spark, path, [b for b in base.batches if b not in seen]):
                if name is not None:
                    commits.drop_files(spark, path, name)
                near = tuple(keys.may_be_in(spark, path, base.batches))
                loaded = commits.read(spark, path, at=replace(base, batches=near)) if near else None
                events, clear_events = _staged(_events(staged, loaded, key))
                cleared.append(clear_events)
                marked = _marked(staged, events, key)
                counts = [tuple(r) for r in marked.groupBy("status").agg(F.count_distinct(key).alias("n")).collect()]
                new = marked.filter("status = 'added'").drop("status")
                new = new.filter("place IS NOT NULL") if "place" in new.columns else new
                name, added = commits.add_files(new, path, key=key, partials=partials)
            if not added and base.batches != at.batches:
                raise ValueError("not one event to put in the place of those that are there")
            seen = set(base.batches)
            change = commits.with_schema(replace(base, batches=base.batches + tuple(added)), staged.schema)
            if stream:
                change = replace(change, streams=at.streams | {stream[0]: stream[1]})
            if change == at or commits.commit(spark, path, at, change):
                break
        return spark.createDataFrame(counts, "status string, n long")
    finally:
        for clear in cleared:
            clear()


def _events(rows: DataFrame, loaded: DataFrame | None, key: str) -> DataFrame:
    """(_key, _placed, _old) of every key: whether one of its rows has a place, and whether it is loaded."""
    placed = F.max(F.col("place").isNotNull()) if "place" in rows.columns else F.max(F.lit(True))
    events = rows.groupBy(F.col(key).alias("_key")).agg(placed.alias("_placed"))
    if loaded is None:
        return events.withColumn("_old", F.lit(False))
    known = loaded.select(F.col(key).alias("_key")).distinct().withColumn("_old", F.lit(True))
    return events.join(known, "_key", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))


def _marked(rows: DataFrame, events: DataFrame, key: str, *, broadcast_keys: int = 200_000) -> DataFrame:
    """Rows with their event's status; `events` are stored, and broadcast up to `broadcast_keys` of them (counted)."""
    if events.count() <= broadcast_keys:
        events = F.broadcast(events)
    status = F.when(F.col("_old"), "exists").when(F.col("date").isNull(), "no_date")
    status = status.when(~F.col("_placed"), "no_placements").otherwise("added")
    rows = rows.join(events, F.col(key).eqNullSafe(F.col("_key"))).withColumn("status", status)
    return rows.drop("_key", "_placed", "_old")


def replace_source(rows: DataFrame, path: str, *, key: str | None = None, partials=None) -> None:
    """Put the rows in the place of all rows of the sources that they hold, and leave the others."""
    spark = rows.sparkSession
    _, added = commits.add_files(rows, path, key=key, partials=partials)
    gone = {b.source for b in added}

    def change(at):
        kept = at.without(gone)
        return commits.with_schema(replace(kept, batches=kept.batches + tuple(added)), rows.schema)

    commits.update(spark, path, change)


def delete_sources(spark: SparkSession, path: str, sources: list[str]) -> list[str]:
    """Delete all rows of the sources; returns those that were there."""
    found: set[str] = set()

    def change(at):
        found.clear()
        found.update(b.source for b in at.batches if b.source in sources)
        return at.without(sources)

    commits.update(spark, path, change)
    return [s for s in sources if s in found]


def reset(spark: SparkSession, path: str, schema: StructType) -> None:
    """Drop the table and create it anew, empty."""
    commits.update(spark, path, lambda at: replace(at, schema=schema.json(), batches=()))


def compact(spark: SparkSession, path: str, *, key: str | None = "post_id", partials=None) -> int:
    """Write the rows of all batches as one batch a source; how many batches there were. What is appended meanwhile stays."""
    at = commits.snapshot(spark, path)
    if not at.batches:
        return 0
    _, added = commits.add_files(read(spark, path, at=at), path, key=key, partials=partials)
    old = set(at.batches)

    def change(now):
        if not old <= set(now.batches):  # some were deleted or replaced meanwhile
            return now
        return replace(now, batches=tuple(b for b in now.batches if b not in old) + tuple(added))

    commits.update(spark, path, change)
    return len(old)


def publish(spark: SparkSession, path: str, target: str, view: str | None = None, *, keep: int = 2) -> int:
    """Put a copy of the table in the place of the one at `target`, by one commit; returns its version there.

    Readers of any session get it by `read(spark, target)`, or by the view of this one. Older copies than the last `keep` go
    after a while.
    """
    at = commits.snapshot(spark, path)
    _, added = commits.add_files(read(spark, path, at=at), target)
    done = commits.update(spark, target, lambda now: replace(now, schema=at.schema, batches=tuple(added)))
    if view:
        read(spark, target, at=done).createOrReplaceTempView(view)
    sweep(spark, target, keep=keep)
    return done.version


def refresh(
    spark: SparkSession,
    sources: dict[str, Callable[[SparkSession], DataFrame]],
    path: str,
    *,
    incremental: bool = False,
    normalise: Callable[[DataFrame], DataFrame] | None = None,
    partials: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Load the sources in order: each is read to its end and normalised aside, then takes the place of its old rows in one
    commit (or is added to them, if `incremental`), once per key.

    Returns (source, status, n, message): counts of events, and of what the normaliser changed (fixes). A source that fails, or
    that has not one event to add where it had rows, keeps the rows it had; its status is failed, and the others go on.
    """
    out = []
    for name, load in sources.items():
        clear = None
        try:
            rows = load(spark).withColumn("source", F.lit(name))
            rows, clear = _staged(normalise(rows) if normalise is not None else rows)
            fixes = int(rows.agg(F.sum("fixes")).first()[0] or 0) if "fixes" in rows.columns else None
            rows = rows.drop("fixes")
            counts = append_events(rows, path, partials=partials, replaced=() if incremental else [name]).collect()
            out += [(name, "fixes", fixes, None)] if fixes is not None else []
            out += [(name, r["status"], r["n"], None) for r in counts]
        except Exception as error:  # noqa: BLE001
            out.append((name, "failed", 0, f"{type(error).__name__}: {str(error)[:2000]}"))
        finally:
            if clear:
                clear()
    return spark.createDataFrame(out, "source string, status string, n long, message string")
