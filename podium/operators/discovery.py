"""Under-used, forgotten and rising combos, and the analysis of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.scoring import SITE, count_if, ratio, scoped, scored, total
from podium.functions.texts import sentence
from podium.operators.rankings import shown
from podium.operators.timelines import with_era

GEM = ["blade", "ratchet", "bit", "lock_chip"]


@scoped
def hidden_gems(usage: DataFrame, *, min_uses: int = 4, max_uses: int = 20, limit: int = 20) -> DataFrame:
    """Combos with few uses and many wins, by potential."""
    rows = shown(scored(usage, SITE))
    recent, older = F.expr("days <= 60"), F.expr("days > 60 AND days <= 90")
    out = rows.groupBy("blade", "ratchet", "bit").agg(
        F.count("*").alias("uses"),
        count_if(F.col("place") == 1).alias("wins"),
        count_if(F.col("place") <= 3).alias("podiums"),
        total("ws").alias("score"),
        count_if(recent).alias("ru"),
        total("p", recent).alias("rs"),
        count_if(older).alias("ou"),
        total("p", older).alias("os"),
    )
    win, top3 = F.col("wins") / F.col("uses"), F.col("podiums") / F.col("uses")
    hidden = F.greatest(F.lit(1.0), F.log2(max_uses / F.col("uses")))
    bonus = F.when(F.col("ru") > 0, 1.2).otherwise(1.0)
    potential = (win * 40 + top3 * 30 + F.col("score") / F.col("uses") * 5) * hidden * bonus
    rate, before = F.col("rs") / F.col("ru"), F.col("os") / F.col("ou")
    trend = (
        F.when((F.col("ru") >= 2) & (F.col("ou") >= 2), F.when(rate > before * 1.15, "up").when(rate < before * 0.85, "down"))
        .when((F.col("ru") >= 2) & (F.col("ou") == 0), F.lit("up"))
    )
    return (
        out.filter(F.col("uses").between(min_uses, max_uses) & (win >= 0.2) & (top3 >= 0.4))
        .select(
            "blade", "ratchet", "bit", "uses", F.round(win, 6).alias("win_rate"),
            F.round(F.col("score") / F.col("uses"), 6).alias("avg_score"),
            F.round(potential, 4).alias("potential"), F.coalesce(trend, F.lit("stable")).alias("trend"),
        )
        .orderBy(F.desc("potential"), "blade", "ratchet", "bit")
        .limit(limit)
    )


@scoped
def gem_stats(usage: DataFrame) -> DataFrame:
    """Per combo (with chip): totals, uses, wins and points per era of three, the last 60 and 90 days, and the peak."""
    rows = with_era(shown(scored(usage, SITE)), usage, 3)
    win = F.col("place") == 1
    eras = []
    for i, era in enumerate(("early", "mid", "current")):
        here = F.col("era") == i
        eras += [
            count_if(here).alias(f"{era}_uses"),
            count_if(here & win).alias(f"{era}_wins"),
            total("p", here).alias(f"{era}_score"),
        ]
    best = F.min(F.struct(F.round(-F.col("ws"), 6).alias("s"), F.col("tournament_date").alias("d")))
    return rows.groupBy(*GEM).agg(
        F.count("*").alias("uses"),
        count_if(win).alias("wins"),
        total("ws").alias("score"),
        F.round(F.avg("place"), 6).alias("avg_place"),
        *eras,
        count_if(F.col("days") <= 60).alias("last60_uses"),
        count_if((F.col("days") <= 60) & win).alias("last60_wins"),
        total("p", F.expr("days <= 60")).alias("last60_score"),
        count_if(F.col("days") <= 90).alias("last90_uses"),
        best["d"].alias("peak_date"),
    )


def peak_era() -> Column:
    """The era with the most points; the earlier one on a tie."""
    e, m, c = F.col("early_score"), F.col("mid_score"), F.col("current_score")
    return F.when((e >= m) & (e >= c), "early").when(m >= c, "mid").otherwise("current")


def gem_trend() -> Column:
    past, wins = F.col("early_uses") + F.col("mid_uses"), F.col("early_wins") + F.col("mid_wins")
    active = F.col("last60_uses") > 0
    strong = (past >= 3) & (wins >= 0.25 * past)
    return (
        F.when((F.col("uses") <= F.col("last90_uses")) & active, "rising")
        .when(strong & ~active & (F.col("last90_uses") > 0), "returning")
        .when((F.col("last60_uses") >= 2) & (F.col("current_score") > F.col("mid_score")), "rising")
        .when(~active & (F.col("last90_uses") == 0), "falling")
        .otherwise("stable")
    )


def _quality(uses: Column, strong: int, moderate: int) -> Column:
    return F.when(uses >= strong, "strong").when(uses >= moderate, "moderate").otherwise("limited")


def _texts(kind: str, **values: Column) -> list[Column]:
    return [sentence(kind, what, **values).alias(what) for what in ("reason", "insight")]


def meta_blades(stats: DataFrame, *, k: int = 10) -> DataFrame:
    """Blades of the current era's top combos."""
    top = stats.filter("current_uses >= 3").orderBy(F.desc("current_score"), *GEM).limit(k)
    return top.select("blade").distinct()


@scoped
def gems_underused(
    usage: DataFrame, *, limit: int = 8, min_uses: int = 5, max_recent: int = 5, min_win_rate: float = 0.2
) -> DataFrame:
    """Blades that win but are hardly used now, each with its best combo."""
    stats = gem_stats(usage)
    blades = stats.groupBy("blade").agg(
        F.sum("uses").alias("blade_uses"),
        F.sum("wins").alias("blade_wins"),
        F.sum("last60_uses").alias("recent_uses"),
    )
    order = Window.partitionBy("blade").orderBy(F.desc("score"), *GEM[1:])
    best = stats.withColumn("k", F.row_number().over(order)).filter("k = 1")
    win = F.col("blade_wins") / F.col("blade_uses")
    return (
        blades.filter((F.col("blade_uses") >= min_uses) & (win >= min_win_rate) & (F.col("recent_uses") <= max_recent))
        .join(meta_blades(stats), "blade", "left_anti")
        .join(best, "blade")
        .select(
            *GEM, F.col("blade_uses").alias("total_uses"), F.round(win, 6).alias("win_rate"), "recent_uses",
            _quality(F.col("blade_uses"), 15, 8).alias("data_quality"), peak_era().alias("peak_era"),
            gem_trend().alias("trend"), *_texts("underused", blade=F.col("blade"), win=win, recent=F.col("recent_uses")),
        )
        .orderBy(F.desc("win_rate"), F.desc("total_uses"), "blade")
        .limit(limit)
    )


@scoped
def gems_forgotten(usage: DataFrame, *, limit: int = 8) -> DataFrame:
    """Former winners that hardly appear in the current era."""
    past, wins = F.col("early_uses") + F.col("mid_uses"), F.col("early_wins") + F.col("mid_wins")
    rows = gem_stats(usage).filter((wins >= 1) & (past >= 2) & (F.col("current_uses") <= 3) & (F.col("last60_uses") <= 2))
    return (
        rows.select(
            *GEM, past.alias("total_uses"), wins.alias("past_wins"), F.round(wins / past, 6).alias("win_rate"),
            _quality(past, 8, 4).alias("data_quality"), peak_era().alias("peak_era"), "peak_date",
            *_texts("forgotten", wins=wins, win=wins / past, era=peak_era()),
            F.when(F.col("last90_uses") > 0, "returning").otherwise("stable").alias("trend"),
        )
        .orderBy(F.desc("past_wins"), F.desc("win_rate"), *GEM)
        .limit(limit)
    )


@scoped
def gems_rising(usage: DataFrame, *, limit: int = 8, max_uses: int = 15) -> DataFrame:
    """New combos of the current era that already win."""
    recent = F.col("last60_wins") / F.col("last60_uses")
    rows = gem_stats(usage).filter(
        (F.col("current_uses") >= 0.6 * F.col("uses"))
        & (F.col("last60_uses") >= 2)
        & (F.col("last60_wins") >= 1)
        & (F.col("uses") <= max_uses)
    )
    return (
        rows.select(
            *GEM, F.col("last60_uses").alias("recent_uses"), F.col("last60_wins").alias("recent_wins"),
            F.round(recent, 6).alias("recent_win_rate"), F.col("last60_score").alias("recent_score"),
            _quality(F.col("last60_uses"), 6, 3).alias("data_quality"),
            *_texts("rising", wins=F.col("last60_wins")),
        )
        .orderBy(F.desc("recent_win_rate"), F.desc("recent_uses"), *GEM)
        .limit(limit)
    )


@scoped
def gems_counter_meta(usage: DataFrame, *, limit: int = 8) -> DataFrame:
    """Combos of blades outside the current top that win in the current era."""
    stats = gem_stats(usage)
    rows = stats.filter("current_uses >= 2 AND (current_wins >= 1 OR 4 * current_wins >= current_uses) AND last90_uses >= 2")
    return (
        rows.join(meta_blades(stats), "blade", "left_anti")
        .select(
            *GEM, F.col("current_uses").alias("total_uses"), "current_wins",
            F.round(F.col("current_wins") / F.col("current_uses"), 6).alias("win_rate"),
            _quality(F.col("current_uses"), 6, 3).alias("data_quality"), gem_trend().alias("trend"),
            *_texts("counter", wins=F.col("current_wins")),
        )
        .orderBy(F.desc("current_wins"), F.desc("win_rate"), *GEM)
        .limit(limit)
    )


@scoped
def eras3(usage: DataFrame, *, k: int = 5) -> DataFrame:
    """Top combos of three equal eras, used twice or more in theirs."""
    rows = with_era(shown(scored(usage, SITE)), usage, 3)
    sums = rows.groupBy("era", *GEM).agg(total("p").alias("score"), F.count("*").alias("uses")).filter("uses >= 2")
    order = Window.partitionBy("era").orderBy(F.desc("score"), *GEM)
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@scoped
def part_analysis(usage: DataFrame, part: str = "blade", *, min_uses: int = 3, top: int = 10) -> DataFrame:
    """Per part: win rate, average place, versatility, consistency, and how often the other parts are top ones.

    `synergy_same` compares the other parts with the top parts of the same kind, `synergy_other` with those of theirs.
    """
    rows = shown(scored(usage, SITE))
    others = [c for c in ("blade", "ratchet", "bit") if c != part]

    def tops(kind: str) -> DataFrame:
        counts = rows.groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("n"))
        return counts.orderBy(F.desc("n"), "name").limit(top).select("name")

    marked = rows
    for kind in others:
        for flag, frame in (("same", tops(part)), ("own", tops(kind))):
            names = frame.select(F.col("name").alias(kind), F.lit(1).alias(f"{flag}_{kind}"))
            marked = marked.join(F.broadcast(names), kind, "left")
    same = F.coalesce(*[F.col(f"same_{k}") for k in others]).isNotNull()
    own = F.coalesce(*[F.col(f"own_{k}") for k in others]).isNotNull()
    out = marked.groupBy(F.col(part).alias("name")).agg(
        F.count("*").alias("uses"),
        ratio(count_if(F.col("place") == 1), F.count("*")).alias("win_rate"),
        F.round(F.avg("place"), 6).alias("avg_place"),
        F.count_distinct("blade", "ratchet", "bit").alias("versatility"),
        ratio(count_if(same), F.count("*")).alias("synergy_same"),
        ratio(count_if(own), F.count("*")).alias("synergy_other"),
        F.round(1 / (1 + F.stddev_pop("place")), 6).alias("consistency"),
    )
    return out.filter(F.col("uses") >= min_uses).orderBy(F.desc("win_rate"), "name")


@scoped
def variance(usage: DataFrame, *, min_uses: int = 3) -> DataFrame:
    """Mean, population variance, ceiling and floor of each combo's decayed scores."""
    rows = shown(scored(usage, SITE))
    out = rows.groupBy("blade", "ratchet", "bit").agg(
        F.count("*").alias("uses"),
        F.round(F.avg("ws"), 6).alias("avg_score"),
        F.round(F.var_pop("ws"), 6).alias("variance"),
        F.round(F.stddev_pop("ws"), 6).alias("std_dev"),
        F.round(F.max("ws"), 6).alias("ceiling"),
        F.round(F.min("ws"), 6).alias("floor"),
    )
    return out.filter(F.col("uses") >= min_uses).withColumn(
        "high_variance", F.col("std_dev") > F.round(F.col("avg_score") * 0.5, 6)
    )


@scoped
def part_matrix(usage: DataFrame, *, blades: int = 10, ratchets: int = 8, bits: int = 10) -> DataFrame:
    """Win rate of the top blades with the top ratchets and bits, zero where a pair was never used."""
    rows = shown(scored(usage, SITE))

    def tops(kind: str, k: int) -> DataFrame:
        counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
        return counts.orderBy(F.desc("n"), kind).limit(k).select(kind)

    out = None
    top_blades = tops("blade", blades)
    for kind, k in (("ratchet", ratchets), ("bit", bits)):
        cells = top_blades.crossJoin(tops(kind, k))  # blades times parts: at most a hundred rows
        sums = rows.groupBy("blade", kind).agg(
            F.count("*").alias("uses"), ratio(count_if(F.col("place") == 1), F.count("*")).alias("win_rate")
        )
        part = cells.join(sums, ["blade", kind], "left").select(
            "blade",
            F.lit(kind).alias("kind"),
            F.col(kind).alias("part"),
            F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"),
            F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        )
        out = part if out is None else out.union(part)
    return out


@scoped
def landscape(usage: DataFrame, *, limit: int = 20) -> DataFrame:
    """Bubble data of the top blades: uses, share of wins, radius by score, champion share and bar length."""
    rows = shown(scored(usage, SITE))
    out = rows.groupBy("blade", "series").agg(
        total("ws").alias("score"), F.count("*").alias("uses"), count_if(F.col("place") == 1).alias("first")
    )
    out = out.orderBy(F.desc("score"), "blade", "series").limit(limit)
    whole = Window.partitionBy()
    win = F.col("first") / F.col("uses")
    return out.select(
        "blade",
        "series",
        "uses",
        F.round(win * 100, 4).alias("first_pct"),
        F.round(F.try_divide("score", F.max("score").over(whole)) * 20 + 4, 4).alias("radius"),
        F.round(F.col("uses") / 100.0 * win, 4).alias("champion_share"),
        F.round(F.col("uses") * 100.0 / F.max("uses").over(whole), 4).alias("bar_pct"),
    )


