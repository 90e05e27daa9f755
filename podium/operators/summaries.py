"""Views, summaries, snapshots and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.scoring import SITE, count_if, latest, ordinal, scoped, scored, total, trend_class
from podium.operators.rankings import rank_blades, shown


@scoped
def part_stats(usage: DataFrame) -> DataFrame:
    """Counts and win rate of every part, all five kinds from one scan; absent assists and chips are left out."""
    kinds = ", ".join(f"'{k}', {k}" for k in ("blade", "ratchet", "bit", "assist", "lock_chip"))
    rows = usage.select("place", F.expr(f"stack(5, {kinds}) AS (part_type, part_name)"))
    rows = rows.filter("part_name IS NOT NULL OR part_type IN ('blade', 'ratchet', 'bit')")
    place = F.col("place")
    return rows.groupBy("part_name", "part_type").agg(
        F.count("*").alias("total"),
        *[count_if(place == k).alias(n) for k, n in ((1, "first"), (2, "second"), (3, "third"))],
        F.round(count_if(place == 1) / F.count("*"), 3).alias("win_rate"),
    )


@scoped
def combo_stats(usage: DataFrame) -> DataFrame:
    """Counts and win rate of every (chip, blade, ratchet, bit); ratchet and bit are joined without a space."""
    label = F.concat_ws(" ", "lock_chip", "blade", F.concat("ratchet", "bit"))
    return usage.groupBy("lock_chip", "blade", "ratchet", "bit").agg(
        F.first(label).alias("combo"),
        F.count("*").alias("total"),
        count_if(F.col("place") == 1).alias("first"),
        F.round(count_if(F.col("place") == 1) / F.count("*"), 3).alias("win_rate"),
    )


@scoped
def summary(usage: DataFrame) -> DataFrame:
    """One row: tournaments, placements, uses, distinct players and blades, and the date range."""
    return usage.agg(
        F.count_distinct("tournament_id").alias("tournaments"),
        F.count_distinct("tournament_id", "place").alias("placements"),
        F.count("*").alias("combo_uses"),
        F.count_distinct("player_name").alias("players"),
        F.count_distinct("blade").alias("blades"),
        F.min("tournament_date").alias("first_date"),
        F.max("tournament_date").alias("last_date"),
    )


@scoped
def top_parts_stats(usage: DataFrame, *, limit: int = 10) -> DataFrame:
    """The most used blades and combos, tournaments of each region and of each source, as (kind, name, total)."""
    blades = usage.groupBy(F.col("blade").alias("name")).agg(F.count("*").alias("total"))
    blades = blades.orderBy(F.desc("total"), "name").limit(limit).select(F.lit("blade").alias("kind"), "name", "total")
    combos = combo_stats(usage).select(F.lit("combo").alias("kind"), F.col("combo").alias("name"), "total")
    combos = combos.orderBy(F.desc("total"), "name").limit(limit)
    events = F.count_distinct("tournament_id").alias("total")
    regions = usage.groupBy(F.coalesce("region", F.lit("Unknown")).alias("name")).agg(events)
    sources = usage.groupBy(F.col("source").alias("name")).agg(events)
    return (
        blades.union(combos)
        .union(regions.select(F.lit("region"), "name", "total"))
        .union(sources.select(F.lit("source"), "name", "total"))
    )


@scoped
def recent_by_source(usage: DataFrame, source: str, *, limit: int = 5) -> DataFrame:
    rows = usage.filter(F.col("source") == source).select("tournament_id", "tournament_date").distinct()
    return rows.orderBy(F.desc("tournament_date"), "tournament_id").limit(limit)


@scoped
def snapshot(usage: DataFrame, *, days: int = 30, limit: int = 10, fused: bool = False) -> DataFrame:
    """Top blades and combos by uses in the last days, with wins and the period's number of tournaments."""
    rows = usage.filter(F.col("tournament_date") >= F.date_sub(latest(usage), days))
    rows = rows.withColumn(
        "combo", F.concat("blade", F.lit(" "), "ratchet", F.lit("" if fused else " "), "bit")
    )
    wins = count_if(F.col("place") == 1).alias("wins")
    out = None
    for kind in ("blade", "combo"):
        top = rows.groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("uses"), wins)
        top = top.orderBy(F.desc("uses"), F.desc("wins"), "name").limit(limit)
        top = top.select(F.lit(kind).alias("kind"), "name", "uses", "wins")
        out = top if out is None else out.union(top)
    count = rows.agg(F.count_distinct("tournament_id").alias("tournaments"))
    return out.crossJoin(F.broadcast(count))  # one row


@scoped
def combo_point(
    usage: DataFrame, blade: str, ratchet: str, bit: str, *, lock_chip: str | None = None, assist: str | None = None
) -> DataFrame:
    """One configuration's figures; no row where it was never used."""
    rows = scored(usage, SITE).filter(
        (F.lower("blade") == blade.lower()) & (F.lower("ratchet") == ratchet.lower()) & (F.lower("bit") == bit.lower())
    )
    for column, value in (("lock_chip", lock_chip), ("assist", assist)):
        if value is not None:
            rows = rows.filter(F.lower(column) == value.lower())
    place = F.col("place")
    label = " ".join(x for x in (lock_chip, blade, assist, f"{ratchet}{bit}") if x)
    out = rows.agg(
        F.lit(label).alias("combo"),
        F.round(total("ws"), 2).alias("raw_score"),
        F.count("*").alias("uses"),
        *[count_if(place == k).alias(n) for k, n in ((1, "first"), (2, "second"), (3, "third"))],
    ).filter("uses > 0")
    podiums = F.col("first") + F.col("second") + F.col("third")
    average = F.try_divide(F.col("first") + 2 * F.col("second") + 3 * F.col("third"), podiums)
    return out.withColumn("avg_placement", F.round(F.coalesce(average, F.lit(0.0)), 2))


@scoped
def distinct_parts(usage: DataFrame) -> DataFrame:
    """(kind, name) of every part under its display name."""
    rows = shown(usage)
    kinds = ", ".join(f"'{k}', {k}" for k in ("blade", "ratchet", "bit", "assist", "lock_chip"))
    rows = rows.select(F.expr(f"stack(5, {kinds}) AS (kind, name)")).filter("name IS NOT NULL").distinct()
    return rows.orderBy("kind", "name")


@scoped
def blade_cards(usage: DataFrame, *, limit: int = 50) -> DataFrame:
    """Ranked blades with the class of their trend and their average placement as an ordinal."""
    podiums = F.col("first") + F.col("second") + F.col("third")
    average = F.coalesce(F.try_divide(F.col("first") + 2 * F.col("second") + 3 * F.col("third"), podiums), F.lit(0.0))
    ranked = rank_blades(usage, limit=limit, min_uses=1)
    return ranked.select(
        "blade", "rank", trend_class(F.col("trend")).alias("trend_class"), ordinal(average).alias("placement")
    )
