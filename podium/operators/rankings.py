"""Rankings of combos and parts by decayed score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import names
from podium.functions.scoring import CLI, SITE, count_if, scoped, scored, tier7, total

#: The last 30 days, and the 30 before (SQL conditions, since columns need a running session).
RECENT_SQL, PREVIOUS_SQL = "days <= 30", "days > 30 AND days <= 60"


def _places() -> list[Column]:
    place = F.col("place")
    return [count_if(place == k).alias(name) for k, name in ((1, "first"), (2, "second"), (3, "third"))]


@scoped
def cli_ranking(usage: DataFrame, keys: list[str], *, limit: int, min_uses: int, where: Column | None = None) -> DataFrame:
    """Score by the 90-day rules; the trend sets the last 30 days against everything before."""
    rows = scored(usage, CLI)
    if where is not None:
        rows = rows.filter(where)
    out = rows.groupBy(*keys).agg(
        total("ws").alias("raw_score"),
        total("ws", F.expr(RECENT_SQL)).alias("recent_score"),
        total("ws", ~F.expr(RECENT_SQL)).alias("older_score"),
        F.count("*").alias("uses"),
        *_places(),
    )
    older, recent = F.col("older_score"), F.col("recent_score")
    trend = F.when(older > 0, recent / F.greatest(older, F.lit(0.1)) - 1).otherwise(
        F.when(recent > 0, 1.0).otherwise(0.0)
    )
    return (
        out.filter(F.col("uses") >= min_uses)
        .withColumn("avg_score", F.col("raw_score") / F.col("uses"))
        .withColumn("trend", F.round(trend, 6))
        .orderBy(F.desc("raw_score"), *keys)
        .limit(limit)
    )


def site_trend() -> Column:
    """Scores per use of the last 30 days against the 30 before; fixed values where one period is empty."""
    ru, ou = F.col("recent_uses"), F.col("older_uses")
    rate, before = F.col("recent_score") / ru, F.col("older_score") / F.when(ou > 0, ou)
    return F.round(
        F.when((ru > 0) & (ou > 0), F.try_divide(rate - before, before))
        .when(ru > 0, 0.5)
        .when(ou > 0, -F.least(F.lit(0.5), ou * 0.1))
        .otherwise(0.0),
        6,
    )


def shown(usage: DataFrame) -> DataFrame:
    """Usage under display names."""
    return usage.withColumns(
        {
            "blade": names.display_blade(F.col("blade")),
            "ratchet": names.display_ratchet(F.col("ratchet")),
            "bit": names.display_bit(F.col("bit")),
        }
    )


def site_ranking(rows: DataFrame, keys: list[str], *, limit: int | None, min_uses: int) -> DataFrame:
    """Score by the 30-day rules with stages, and its trend, of scored rows; ordered and cut where a limit is given."""
    out = rows.groupBy(*keys).agg(
        total("ws").alias("raw_score"),
        F.count("*").alias("uses"),
        *_places(),
        total("ws", F.expr(RECENT_SQL)).alias("recent_score"),
        count_if(F.expr(RECENT_SQL)).alias("recent_uses"),
        total("ws", F.expr(PREVIOUS_SQL)).alias("older_score"),
        count_if(F.expr(PREVIOUS_SQL)).alias("older_uses"),
    )
    out = (
        out.filter(F.col("uses") >= min_uses)
        .withColumn("avg_score", F.col("raw_score") / F.col("uses"))
        .withColumn("trend", site_trend())
        .drop("recent_score", "recent_uses", "older_score", "older_uses")
    )
    return out if limit is None else out.orderBy(F.desc("raw_score"), *keys).limit(limit)


def _ranked(out: DataFrame, keys: list[str], tiers: bool = True) -> DataFrame:
    """Rank and, with `tiers`, tier of what was returned; the window only sees the returned rows."""
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("raw_score"), *keys)))
    if tiers:
        out = out.withColumn("tier", tier7(F.col("rank"), F.count("*").over(Window.partitionBy())))
    return out


@scoped
def rank_blades(usage: DataFrame, *, limit: int = 20, min_uses: int = 3) -> DataFrame:
    rows = shown(scored(usage, SITE))
    return _ranked(site_ranking(rows, ["blade", "series"], limit=limit, min_uses=min_uses), ["blade", "series"])


COMBO = ["combo", "blade", "ratchet", "bit", "lock_chip", "assist"]


def labelled(rows: DataFrame) -> DataFrame:
    """Rows under display names: full blade name (with its chip), and the combo's label."""
    named = rows.withColumns(
        {
            "ratchet": names.display_ratchet(F.col("ratchet")),
            "bit": names.display_bit(F.col("bit")),
            "blade": names.full_blade(F.col("lock_chip"), F.col("blade")),
        }
    )
    return named.withColumn("combo", names.label(*map(F.col, ("blade", "assist", "ratchet", "bit"))))


def combo_rows(rows: DataFrame) -> DataFrame:
    """labelled() of valid combos: a main blade without its chip is dropped."""
    return labelled(rows.filter(~(F.col("blade").isin(names.NEEDS_LOCK_CHIP) & F.col("lock_chip").isNull())))


@scoped
def rank_combos(usage: DataFrame, *, limit: int = 20, min_uses: int = 2) -> DataFrame:
    rows = combo_rows(scored(usage, SITE))
    return _ranked(site_ranking(rows, COMBO, limit=limit, min_uses=min_uses), COMBO)


@scoped
def rank_parts(
    usage: DataFrame, part: str, *, limit: int = 15, min_uses: int = 3, ranked: bool = True
) -> DataFrame:
    """Ranking of one part column under its display name, absent parts left out."""
    rows = shown(scored(usage, SITE)).filter(F.col(part).isNotNull())
    out = site_ranking(rows.withColumn("name", F.col(part)), ["name"], limit=limit, min_uses=min_uses)
    return _ranked(out, ["name"], tiers=False) if ranked else out


@scoped
def rank_blades_by_series(usage: DataFrame, series: str, *, limit: int = 50, min_uses: int = 2) -> DataFrame:
    """The first 200 blades, cut to one series; ranks stay those of the whole ranking."""
    return rank_blades(usage, limit=200, min_uses=min_uses).filter(F.col("series") == series).orderBy("rank").limit(limit)


@scoped
def top_by_series(usage: DataFrame, *, k: int = 5, min_uses: int = 2) -> DataFrame:
    order = Window.partitionBy("series").orderBy("rank")
    found = rank_blades(usage, limit=200, min_uses=min_uses).withColumn("series_rank", F.row_number().over(order))
    return found.filter(F.col("series_rank") <= k)


@scoped
def rank_unique_blade(usage: DataFrame, *, limit: int = 500, min_uses: int = 2) -> DataFrame:
    """The best combo of each blade, in ranking order."""
    order = Window.partitionBy("blade").orderBy("rank")
    return rank_combos(usage, limit=limit, min_uses=min_uses).withColumn("k", F.row_number().over(order)).filter(
        "k = 1"
    ).drop("k")


@scoped
def rank_search(
    usage: DataFrame, text: str, *, height: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Combos whose name or parts hold the text (any case), down to one use; by ratchet height if given."""
    rows = combo_rows(scored(usage, SITE))
    found = site_ranking(rows, COMBO, limit=None, min_uses=1)
    low = text.lower()
    hit = F.lower("combo").contains(low) | F.lower("ratchet").contains(low) | F.lower("bit").contains(low)
    found = found.filter(hit)
    if height:
        found = found.filter(F.regexp_extract("ratchet", r"-(\d+)", 1) == height)
    return found.orderBy(F.desc("raw_score"), *COMBO).offset(offset).limit(limit)


@scoped
def best_for(usage: DataFrame, part: str, name: str, *, limit: int = 10) -> DataFrame:
    """The pairs of other parts that did best with one part, whose stored name is compared without case; blades stand under
    their stored names, ratchets and bits under display names."""
    others = [c for c in ("blade", "ratchet", "bit") if c != part]
    rows = scored(usage, SITE).filter(F.lower(part) == name.lower()).withColumns(
        {"ratchet": names.display_ratchet(F.col("ratchet")), "bit": names.display_bit(F.col("bit"))}
    )
    out = rows.groupBy(*others).agg(total("ws").alias("raw_score"), F.count("*").alias("uses"), *_places())
    return (
        out.withColumn("avg_score", F.col("raw_score") / F.col("uses"))
        .orderBy(F.desc("raw_score"), *others)
        .limit(limit)
    )


@scoped
def best_for_blade_cli(usage: DataFrame, name: str, *, limit: int = 10) -> DataFrame:
    rows = scored(usage, CLI).filter(F.lower("blade") == name.lower())
    out = rows.groupBy("ratchet", "bit").agg(total("ws").alias("raw_score"), F.count("*").alias("uses"), *_places())
    return out.orderBy(F.desc("raw_score"), "ratchet", "bit").limit(limit)
