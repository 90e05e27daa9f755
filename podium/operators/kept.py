"""What is kept up to date as tables change: partial aggregates beside every batch, and the dimension of parts.

Partial aggregates are counts by day, region and combo. They are made of a batch's own rows and committed with it, so an append
reads nothing that was there, a deleted or replaced source takes its share along, and the views are sums of what the commit log
names: at any version they equal a count of all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions.scoring import count_if, scoped
from podium.operators import dictionaries, parts, rankings
from podium.sources import commits, tables
from podium.sources.orders_adapter import usage

COMBO = ["lock_chip", "blade", "assist", "ratchet", "bit"]
COUNTS = ["total", "first", "second", "third"]


def daily(rows: DataFrame) -> DataFrame:
    """(source, tournament_date, region, combo, counts) of table rows (date, region, place, combo): mergeable by sums."""
    place = F.col("place")
    return rows.groupBy("source", F.col("date").alias("tournament_date"), "region", *COMBO).agg(
        F.count("*").alias("total"), *[count_if(place == k).alias(n) for k, n in ((1, "first"), (2, "second"), (3, "third"))]
    )


@scoped
def part_stats(days: DataFrame) -> DataFrame:
    """The view of part statistics from partial aggregates."""
    kinds = ", ".join(f"'{k}', {k}" for k in ("blade", "ratchet", "bit", "assist", "lock_chip"))
    rows = days.select(*COUNTS, F.expr(f"stack(5, {kinds}) AS (part_type, part_name)"))
    rows = rows.filter("part_name IS NOT NULL OR part_type IN ('blade', 'ratchet', 'bit')")
    out = rows.groupBy("part_name", "part_type").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return out.withColumn("win_rate", F.round(F.col("first") / F.col("total"), 3))


@scoped
def combo_stats(days: DataFrame) -> DataFrame:
    """The view of combo statistics from partial aggregates."""
    label = F.concat_ws(" ", "lock_chip", "blade", F.concat("ratchet", "bit"))
    out = days.groupBy("lock_chip", "blade", "ratchet", "bit").agg(F.sum("total").alias("total"), F.sum("first").alias("first"))
    return out.withColumns({"combo": label, "win_rate": F.round(F.col("first") / F.col("total"), 3)})


# -- queries: the usage put into a table by several commits ----------------------------------------------------------


def loaded(spark: SparkSession, sf_dir: str) -> str:
    """The usage as a table: the early half appended, then the late one with early events offered once more; source 3 is
    replaced by its large tournaments, source 5 deleted, and the table made compact in between."""
    path = f"{tables.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows = usage(spark, sf_dir).withColumnRenamed("tournament_date", "date").drop("series")
    rows = rows.withColumn("post_id", F.concat_ws("_", "source", "tournament_id"))
    # equal rows of one placement are different slots of its deck; a post has one source, date and region, which are named so
    # that the filters below reach the scan, and no commit numbers rows that it leaves out
    same = Window.partitionBy("post_id", "source", "date", "region", "place", "player_name", *COMBO, "stage").orderBy(F.lit(1))
    rows = rows.withColumn("slot", F.row_number().over(same))
    late = F.col("date") >= "1995-06-01"
    tables.append_events(rows.filter(~late), path, partials=daily)
    tables.append_events(rows.filter(late | (F.col("date") < "1993-01-01")), path, partials=daily)
    tables.compact(spark, path, partials=daily)
    tables.append_events(rows.filter("source = '3' AND region <> 'ASIA'"), path, partials=daily, replaced=["3"])
    tables.delete_sources(spark, path, ["5", "none"])
    return path


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.read(spark, loaded(spark, sf_dir))
    return out.groupBy("source", "region", F.year("date").alias("year")).agg(
        F.count("*").alias("uses"), F.count_distinct("tournament_id").alias("tournaments"), F.sum("place").alias("places")
    )


def _kept(view: Callable[..., DataFrame], **scope) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view(commits.read_stats(spark, loaded(spark, sf_dir), daily), **scope)


def with_stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage without its lines, and those of a stored dimension of parts, loaded twice, joined to it."""
    path = f"{tables.shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    dimension = parts.QUERIES["src_parts"](spark, sf_dir)
    parts.load_parts(dimension.filter("type = 'bit'"), path)
    parts.load_parts(dimension, path)
    series = dictionaries.series_names(parts.stored_parts(spark, path))
    return dictionaries.with_series(usage(spark, sf_dir).drop("series"), series)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_rows": _rows,
    "kept_part_stats": _kept(part_stats),
    "kept_combo_stats": _kept(combo_stats),
    "kept_part_stats_scoped": _kept(part_stats, as_of="1996-12-31", region="EUROPE"),
    "series_joined": lambda spark, sf_dir: rankings.rank_blades_by_series(with_stored_series(spark, sf_dir), "BX"),
    "top_by_series_joined": lambda spark, sf_dir: rankings.top_by_series(with_stored_series(spark, sf_dir)),
}


def oracle_sql(sql: dict[str, str]) -> dict[str, str]:
    """The SQL of the views over the rows that are left, and of the series rankings over the fact's own lines."""
    left = "(SELECT * FROM u WHERE source <> '5' AND NOT (source = '3' AND region = 'ASIA'))"
    scope = f"(SELECT * FROM {left} WHERE tournament_date <= DATE '1996-12-31' AND region = 'EUROPE')"
    over = lambda name, rows: sql[name].replace("FROM u", f"FROM {rows} u")
    usage_sql = sql["view_part_stats"].split(", k AS")[0]
    return {
        "log_rows": f"""{usage_sql} SELECT source, region, CAST(year(tournament_date) AS INTEGER) AS year, count(*) AS uses,
count(DISTINCT tournament_id) AS tournaments, CAST(sum(place) AS BIGINT) AS places FROM {left} GROUP BY ALL""",
        "kept_part_stats": over("view_part_stats", left),
        "kept_combo_stats": over("view_combo_stats", left),
        "kept_part_stats_scoped": over("view_part_stats", scope),
        "series_joined": sql["rank_blades_by_series"],
        "top_by_series_joined": sql["top_by_series"],
    }
