"""Scoring columns of usage rows, under two named sets of rules."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Half-life in days, and whether the stage counts."""

    half_life: float
    staged: bool


CLI = Rules(90.0, False)
SITE = Rules(30.0, True)


def points(place: Column) -> Column:
    return F.when(place == 1, 3.0).when(place == 2, 2.0).when(place == 3, 1.0).otherwise(0.0)


def stage_factor(stage: Column) -> Column:
    return F.when(stage == "first", 0.5).when(stage == "both", 1.15).otherwise(1.0)


def recency(days: Column, half_life: float) -> Column:
    """0.5 to the days over the half-life; future dates weigh 1, an unknown date 0.5."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / half_life), F.lit(0.5))


def latest(usage: DataFrame) -> Column:
    """The reference date: the one the usage was scoped to, else its newest date, as a scalar subquery."""
    if "as_of" in usage.columns:
        return F.col("as_of")
    return usage.agg(F.max("tournament_date")).scalar()


def scope(usage: DataFrame, as_of: datetime.date | str | None = None, region: str | None = None) -> DataFrame:
    """The usage of one region, as it stood on a reference date: later rows are left out and ages count from that date.

    Without one, ages count from the newest date of all regions.
    """
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        usage = usage.filter(F.col("tournament_date") <= day).withColumn("as_of", day)
    if region not in (None, "ALL"):
        usage = usage.withColumn("as_of", latest(usage)).filter(F.col("region") == region)
    return usage


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator on usage take `as_of` and `region`."""

    @functools.wraps(operator)
    def run(usage: DataFrame, *args, as_of: datetime.date | str | None = None, region: str | None = None, **options):
        return operator(scope(usage, as_of, region), *args, **options)

    return run


def scored(usage: DataFrame, rules: Rules = SITE, *, as_of: Column | None = None) -> DataFrame:
    """Usage with days before the reference date, points (p), and the decayed score (ws); dates default to the newest."""
    as_of = latest(usage) if as_of is None else as_of
    own = points(F.col("place"))
    if rules.staged:
        own = own * stage_factor(F.col("stage"))
    return (
        usage.withColumn("days", F.datediff(as_of, "tournament_date"))
        .withColumn("p", own)
        .withColumn("ws", F.col("p") * recency(F.col("days"), rules.half_life))
    )


def trend_class(trend: Column) -> Column:
    """up, down or neutral at a tenth."""
    return F.when(trend > 0.1, "up").when(trend < -0.1, "down").otherwise("neutral")


def ordinal(average: Column) -> Column:
    """An average placement as 1st, 2nd, 3rd, or -- where there is none (0)."""
    rounded = F.floor(average + 0.5)
    return F.when(average == 0, "--").when(rounded <= 1, "1st").when(rounded == 2, "2nd").otherwise("3rd")


def total(column: str, when: Column | None = None) -> Column:
    """A sum rounded to 6 places, so that it does not depend on the order of addition; 0 where nothing is summed."""
    value = F.col(column) if when is None else F.when(when, F.col(column)).otherwise(0.0)
    return F.round(F.coalesce(F.sum(value), F.lit(0.0)), 6)


def count_if(when: Column) -> Column:
    return F.sum(F.when(when, 1).otherwise(0)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a over b rounded to 6 places, null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def tier7(rank: Column, n: Column) -> Column:
    """Tier by the share of the returned rows that rank higher."""
    share = (rank - 1) / n * 100
    out = F.when(share < 3, "SS")
    for limit, name in ((13, "S"), (30, "A"), (50, "B"), (70, "C"), (97, "D")):
        out = out.when(share < limit, name)
    return out.otherwise("F")
