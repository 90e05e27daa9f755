"""Two entities side by side, and their meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.scoring import CLI, SITE, Rules, count_if, ratio, scoped, scored, total


def _sides(rows: DataFrame, is_a: Column, is_b: Column, name_a: str, name_b: str) -> DataFrame:
    """One row per side with its figures, and the head-to-head of the tournaments both entered (best place counts).

    A row may belong to both sides.
    """
    sides = F.array(
        F.when(is_a, F.struct(F.lit(0).alias("side"), F.lit(name_a).alias("name"))),
        F.when(is_b, F.struct(F.lit(1).alias("side"), F.lit(name_b).alias("name"))),
    )
    rows = rows.withColumn("_s", F.explode(F.filter(sides, lambda x: x.isNotNull()))).select("*", "_s.*").drop("_s")
    place = F.col("place")
    totals = rows.groupBy("side", "name").agg(
        total("ws").alias("raw_score"),
        F.count("*").alias("uses"),
        *[count_if(place == k).alias(n) for k, n in ((1, "first"), (2, "second"), (3, "third"))],
        ratio(count_if(place == 1), F.count("*")).alias("win_rate"),
        F.round(F.avg("place"), 6).alias("avg_place"),
    )
    best = rows.groupBy("tournament_id").agg(
        F.min(F.when(F.col("side") == 0, place)).alias("a"), F.min(F.when(F.col("side") == 1, place)).alias("b")
    )
    met = best.filter("a IS NOT NULL AND b IS NOT NULL").agg(
        F.count("*").alias("met"),
        count_if(F.col("a") < F.col("b")).alias("a_won"),
        count_if(F.col("b") < F.col("a")).alias("b_won"),
        count_if(F.col("a") == F.col("b")).alias("tied"),
    )
    out = totals.crossJoin(F.broadcast(met))  # one row
    mine = F.col("side") == 0
    return out.select(
        *totals.columns[1:],
        "met",
        F.coalesce(F.when(mine, F.col("a_won")).otherwise(F.col("b_won")), F.lit(0)).alias("won"),
        F.coalesce(F.when(mine, F.col("b_won")).otherwise(F.col("a_won")), F.lit(0)).alias("lost"),
        F.coalesce("tied", F.lit(0)).alias("tied"),
    )


@scoped
def compare_blades(usage: DataFrame, a: str, b: str, *, rules: Rules = SITE) -> DataFrame:
    rows = scored(usage, rules).filter(F.lower("blade").isin(a.lower(), b.lower()))
    blade = F.lower("blade")
    return _sides(rows, blade == a.lower(), blade == b.lower(), a, b)


@scoped
def compare_blades_cli(usage: DataFrame, a: str, b: str) -> DataFrame:
    return compare_blades(usage, a, b, rules=CLI)


@scoped
def compare_combos(usage: DataFrame, a: tuple[str | None, ...], b: tuple[str | None, ...]) -> DataFrame:
    """Two configurations (blade, ratchet, bit, and where they matter lock chip and assist), by stored names without case."""
    columns = ("blade", "ratchet", "bit", "lock_chip", "assist")

    def same(x):
        out = F.lit(True)
        for column, value in zip(columns, x, strict=False):
            if value:
                out = out & F.coalesce(F.lower(column) == value.lower(), F.lit(False))
        return out

    def label(x):
        blade, ratchet, bit, lock_chip, assist = (*x, None, None)[:5]
        return " ".join(v for v in (lock_chip, blade, assist, f"{ratchet}{bit}") if v)

    return _sides(scored(usage, SITE).filter(same(a) | same(b)), same(a), same(b), label(a), label(b))


@scoped
def compare_share(usage: DataFrame, a: str, b: str) -> DataFrame:
    """Each side's share in percent of score, uses, wins and inverted average place; halves where both are 0."""
    rows = compare_blades(usage, a, b)
    inverted = F.greatest(4 - F.col("avg_place"), F.lit(0.0))
    rows = rows.withColumn("inverted", inverted)
    sums = rows.agg(*[F.sum(c).alias(f"sum_{c}") for c in ("raw_score", "uses", "first", "inverted")])
    both = rows.crossJoin(F.broadcast(sums))  # one row
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col(f"sum_{c}")), F.lit(50.0)), 4)
    return both.select(
        "name",
        share("raw_score").alias("score_share"),
        share("uses").alias("use_share"),
        share("first").alias("win_share"),
        share("inverted").alias("place_share"),
    )
