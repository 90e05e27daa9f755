"""Rating of decks of three combos, many decks at once."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.scoring import SITE, count_if, scope, scored, total
from podium.operators.rankings import rank_combos, shown

WEIGHTS = {"meta": 0.30, "consistency": 0.20, "upside": 0.20, "synergy": 0.15, "surprise": 0.05, "trend": 0.10}


def _tier(score: Column, limits: tuple[int, ...]) -> Column:
    out = F.when(score >= limits[0], "S")
    for limit, name in zip(limits[1:], "ABCD", strict=True):
        out = out.when(score >= limit, name)
    return out.otherwise("F")


#: How many of each kind of part, by score, lend their figures to combos without data.
TOP_PARTS = {"blade": 30, "ratchet": 15, "bit": 15}


def _top_parts(rows: DataFrame, min_uses: int = 2) -> DataFrame:
    """One row: for each kind of part a map from the names of the best ones to their win rate and uses."""
    kinds = ", ".join(f"'{k}', {k}" for k in TOP_PARTS)
    long = rows.select("ws", "place", F.expr(f"stack({len(TOP_PARTS)}, {kinds}) AS (kind, name)")).filter("name IS NOT NULL")
    sums = long.groupBy("kind", "name").agg(
        total("ws").alias("score"), F.count("*").alias("uses"), count_if(F.col("place") == 1).alias("first")
    )
    order = Window.partitionBy("kind").orderBy(F.desc("score"), "name")
    best = sums.filter(F.col("uses") >= min_uses).withColumn("k", F.row_number().over(order))
    limit = F.lit(0)
    for kind, most in TOP_PARTS.items():
        limit = F.when(F.col("kind") == kind, most).otherwise(limit)
    best = best.filter(F.col("k") <= limit)
    figures = F.struct(F.round(F.col("first") / F.col("uses"), 6).alias("rate"), "uses")
    entry = F.struct("name", figures.alias("figures"))
    return best.agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(f"_{kind}s") for kind in TOP_PARTS]
    )


def _meta(usage: DataFrame, limit: int = 20) -> DataFrame:
    """One row: the leading combos in order of rank."""
    top = rank_combos(usage, limit=limit, min_uses=2)
    entry = F.struct("rank", "blade", "ratchet", "bit", "raw_score")
    return top.agg(F.sort_array(F.collect_list(entry)).alias("_meta"))


def rate_combos(
    decks: DataFrame, usage: DataFrame, *, as_of: datetime.date | str | None = None, region: str | None = None
) -> DataFrame:
    """Six sub-scores of every (deck_id, blade, ratchet, bit) row; combos without data are rated by their parts."""
    rated = _in_decks(decks, _rated(decks.select(*COMBO).distinct(), scope(usage, as_of, region)).drop("_meta"))
    return rated.select("deck_id", *COMBO, *[c for c in rated.columns if c not in ("deck_id", *COMBO)])


COMBO = ("blade", "ratchet", "bit")


def _in_decks(decks: DataFrame, rated: DataFrame) -> DataFrame:
    """The ratings of every combo of every deck; a missing part is a value like others."""
    named = rated.withColumnsRenamed({c: f"_of_{c}" for c in COMBO})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in COMBO]
    return decks.select("deck_id", *COMBO).join(named, same).drop(*[f"_of_{c}" for c in COMBO])


def _rated(combos: DataFrame, usage: DataFrame) -> DataFrame:
    """Ratings of distinct combos, and _meta; a combo is rated once, in however many decks it is. The usage is read once for
    the combos, once for all parts and once for the leaders."""
    rows = shown(scored(usage, SITE))
    key = list(COMBO)
    place, days = F.col("place"), F.col("days")
    own = rows.groupBy(*key).agg(
        total("ws").alias("_score"),
        F.count("*").alias("uses"),
        *[count_if(place == k).alias(n) for k, n in ((1, "wins"), (2, "second"), (3, "third"))],
        total("p", days.between(0, 27)).alias("_late"),
        total("p", days.between(28, 55)).alias("_early"),
    )
    out = combos.join(own, key, "left").crossJoin(F.broadcast(_top_parts(rows))).crossJoin(F.broadcast(_meta(usage)))  # one row each
    for part in key:
        figures = F.try_element_at(F.col(f"_{part}s"), F.col(part))
        out = out.withColumns({f"{part}_rate": figures["rate"], f"{part}_uses": figures["uses"]})
    same = F.exists(
        "_meta", lambda m: (m["blade"] == F.col("blade")) & (m["ratchet"] == F.col("ratchet")) & (m["bit"] == F.col("bit"))
    )
    top_score = F.array_max(F.transform("_meta", lambda m: m["raw_score"]))
    out = out.withColumns({"is_meta_pick": same, "top_score": top_score})
    has = F.col("uses").isNotNull()
    uses, wins = F.coalesce("uses", F.lit(0)), F.coalesce("wins", F.lit(0))
    podiums = wins + F.coalesce("second", F.lit(0)) + F.coalesce("third", F.lit(0))
    average = F.try_divide(wins + 2 * F.coalesce("second", F.lit(0)) + 3 * F.coalesce("third", F.lit(0)), podiums)
    average = F.round(F.coalesce(average, F.lit(0.0)), 2)
    rate = F.coalesce(F.try_divide(wins.cast("double"), uses.cast("double")), F.lit(0.0))
    score = F.round(F.coalesce("_score", F.lit(0.0)), 2)
    rates = [F.col(f"{p}_rate") for p in key]
    known = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in rates[1:]), F.when(rates[0].isNotNull(), 1).otherwise(0))
    mean_rate = F.coalesce(F.try_divide(sum((F.coalesce(r, F.lit(0.0)) for r in rates[1:]), F.coalesce(rates[0], F.lit(0.0))), known), F.lit(0.25))
    theory = F.lit(0.0)
    for p, w, u in (("blade", 50, 2), ("ratchet", 30, 1), ("bit", 30, 1)):
        own_part = F.col(f"{p}_rate") * w + F.least(F.col(f"{p}_uses"), F.lit(20)) * u
        theory = theory + F.coalesce(own_part, F.lit(0.0))
    theory = F.coalesce(F.try_divide(theory, known), F.lit(0.0))
    trend = F.coalesce(F.when(F.col("_early") > 0, (F.col("_late") - F.col("_early")) / F.col("_early") * 10), F.lit(0.0))
    full = known == 3
    meta_score = F.when(has, F.least(F.coalesce(F.try_divide(score, F.col("top_score")) * 100, F.lit(50.0)), F.lit(100.0)))
    place_score = F.when(average > 0, F.greatest(F.lit(0.0), (4 - average) / 3) * 100).otherwise(0.0)
    consistency = F.least(place_score * 0.8 + F.least(uses / 10, F.lit(1.0)) * 20, F.lit(100.0))
    upside = F.least(rate * 60 + F.least(wins * 10, F.lit(50)), F.lit(100.0))
    ratio = F.when(mean_rate > 0, rate / mean_rate).otherwise(1.0)
    synergy = F.least(F.greatest((ratio - 0.5) * 100, F.lit(0.0)), F.lit(100.0))
    rarity = F.greatest(F.lit(0.0), 1 - uses / 20) * 50
    surprise = F.least(rarity + F.when(rate > 0.3, (rate - 0.3) * 100).otherwise(0.0), F.lit(100.0))
    trend_score = 50 + F.greatest(F.lit(-50.0), F.least(F.lit(50.0), trend * 10))
    scores = {
        "meta": F.coalesce(meta_score, F.least(theory * 0.5, F.lit(50.0))),
        "consistency": F.when(has, consistency).otherwise(0.0),
        "upside": F.when(has, upside).otherwise(theory * 0.6),
        "synergy": F.when(has, synergy).otherwise(F.when(full, theory * 0.7).otherwise(0.0)),
        "surprise": F.when(has, surprise).otherwise(F.when(full, 40.0).otherwise(0.0)),
        "trend": F.when(has, trend_score).otherwise(50.0),
    }
    out = out.select(
        "_meta",
        *key,
        has.alias("has_data"),
        score.alias("score"),
        uses.cast("bigint").alias("uses"),
        wins.cast("bigint").alias("wins"),
        average.alias("avg_place"),
        F.round(rate * 100, 4).alias("win_rate"),
        *[F.round(v, 4).alias(f"{k}_score") for k, v in scores.items()],
        F.coalesce("is_meta_pick", F.lit(False)).alias("is_meta_pick"),
        (has & uses.between(2, 10) & (rate >= 0.3)).alias("is_hidden_gem"),
        (has & (trend > 2)).alias("is_rising"),
    )
    overall = sum((F.col(f"{k}_score") * w for k, w in list(WEIGHTS.items())[1:]), F.col("meta_score") * 0.30)
    out = out.withColumn("overall", F.round(overall, 6))
    return out.withColumn("tier", F.when(F.col("has_data"), _tier(F.col("overall"), (85, 70, 55, 40, 25))).otherwise("?"))


def rate_decks(
    decks: DataFrame, usage: DataFrame, *, as_of: datetime.date | str | None = None, region: str | None = None
) -> DataFrame:
    """Deck scores: overall, meta coverage, diversity, consistency, upside, surprise, tier, named strengths and weaknesses."""
    combos = _rated(decks.select(*COMBO).distinct(), scope(usage, as_of, region))
    leaders = F.array_distinct(F.transform(F.slice("_meta", 1, 10), lambda m: m["blade"]))
    combos = combos.withColumns(
        {
            "_leads": F.array_contains(leaders, F.col("blade")),
            "_first": F.col("blade") == F.get(leaders, F.lit(0)),
            "_top": F.least(F.size(leaders), F.lit(3)),
        }
    )
    combos = _in_decks(decks, combos.drop("_meta"))
    # a deck has three combos, so its parts fit in a set and the rows need not be expanded for each distinct count
    kinds = lambda c: F.size(F.collect_set(c)).cast("bigint")
    tier_in = lambda *names: count_if(F.col("tier").isin(*names))
    out = combos.groupBy("deck_id").agg(
        F.round(F.sum("overall") / 3, 6).alias("overall"),
        count_if(F.col("is_meta_pick")).alias("picks"),
        kinds(F.when(F.col("_leads"), F.col("blade"))).alias("overlap"),
        F.max("_top").alias("top_blades"),
        (kinds("blade") / 3 * 40 + kinds("ratchet") / 3 * 30 + kinds("bit") / 3 * 30).alias("diversity"),
        kinds("blade").alias("_blades"),
        F.round(F.sum("consistency_score") / 3, 4).alias("consistency"),
        F.round(F.max("upside_score") * 0.6 + F.sum("upside_score") / 3 * 0.4, 4).alias("upside"),
        F.round(F.least(F.sum("surprise_score") / 3 + count_if(F.col("is_hidden_gem")) * 15, F.lit(100.0)), 4)
        .alias("surprise"),
        F.max("has_data").alias("_data"),
        F.max("is_rising").alias("_rising"),
        tier_in("S", "A").alias("_strong"),
        tier_in("D", "F", "?").alias("_weak"),
        F.max("_first").alias("_leader"),
        F.min(F.struct(F.round(F.col("meta_score") + F.col("consistency_score"), 4).alias("s"), "tier"))["tier"].alias("_worst"),
    )
    coverage = F.coalesce("overlap", F.lit(0)) / F.greatest("top_blades", F.lit(1)) * 50 + F.col("picks") / 3 * 50
    out = out.withColumn("meta_coverage", F.round(coverage, 4)).withColumn("diversity", F.round("diversity", 4))
    cover, steady, high, varied, surprise = map(F.col, ("meta_coverage", "consistency", "upside", "diversity", "surprise"))

    def notes(*pairs):
        return F.filter(F.array(*[F.when(when, text) for when, text in pairs]), lambda x: x.isNotNull())

    strengths = notes(
        (cover >= 70, "meta coverage"), (steady >= 70, "consistency"), (high >= 70, "high ceiling"),
        (varied >= 80, "diversity"), (surprise >= 60, "upset potential"), (F.col("_rising"), "rising picks"),
        (F.col("_strong") >= 2, "strong core"),
    )
    strengths = F.when(F.size(strengths) > 0, strengths).otherwise(
        F.array(F.when(F.col("_data"), "tested").otherwise("new combinations"))
    )
    weaknesses = notes(
        (cover < 40, "meta coverage"), (steady < 40, "inconsistent"), (high < 40, "low ceiling"),
        (varied < 50, "predictable"), (~F.col("_data"), "untested"), (F.col("_weak") >= 2, "weak core"),
    )
    advice = notes(
        ((cover < 50) & ~F.coalesce("_leader", F.lit(True)), "add the leading blade"),
        (F.col("_worst").isin("D", "F", "?"), "replace the weakest combo"),
        ((varied < 50) & (F.col("_blades") < 3), "vary the blades"),
        ((steady < 50) & (high > 60), "add steady combos"),
        ((surprise < 30) & (cover > 70), "add a surprise"),
    )
    return out.withColumn("tier", _tier(F.col("overall"), (80, 65, 50, 35, 20))).select(
        "deck_id", "overall", "tier", "meta_coverage", "diversity", "consistency", "upside", "surprise",
        F.array_join(strengths, ", ").alias("strengths"), F.array_join(weaknesses, ", ").alias("weaknesses"),
        F.array_join(advice, ", ").alias("advice"),
    )
