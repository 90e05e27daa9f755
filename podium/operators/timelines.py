"""Weekly, monthly and era views of usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.scoring import SITE, count_if, latest, scoped, scored, total
from podium.operators.rankings import labelled, shown


def label() -> Column:
    return F.concat_ws(" ", "blade", "ratchet", "bit")


@scoped
def weekly(usage: DataFrame, keys: list[str], *, weeks: int = 7) -> DataFrame:
    """Undecayed points per entity used in the period and week (week 0 is the oldest), zero filled over all weeks."""
    rows = shown(scored(usage, SITE)).withColumn("combo", label())
    week = F.floor(F.col("days") / 7)
    rows = rows.withColumn("week_idx", (weeks - 1 - week).cast("int")).filter((week >= 0) & (week < weeks))
    sums = rows.groupBy(*keys, "week_idx").agg(total("p").alias("score"), F.count("*").alias("uses"))
    spine = sums.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week_idx"))
    return spine.join(sums, [*keys, "week_idx"], "left").select(
        *keys,
        "week_idx",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"),
    )


def _series(usage: DataFrame, weeks: int, **wanted: str) -> DataFrame:
    """(week_idx, score) of the rows whose stored parts are the wanted ones without case, zero filled."""
    rows = scored(usage, SITE)
    for column, value in wanted.items():
        rows = rows.filter(F.lower(column) == value.lower())
    week = F.floor(F.col("days") / 7)
    sums = rows.filter((week >= 0) & (week < weeks)).groupBy((weeks - 1 - week).cast("int").alias("week_idx")).agg(
        total("p").alias("score")
    )
    spine = usage.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week_idx"))
    return spine.join(sums, "week_idx", "left").select("week_idx", F.coalesce("score", F.lit(0.0)).alias("score"))


@scoped
def spark_blade(usage: DataFrame, blade: str, *, weeks: int = 7) -> DataFrame:
    return _series(usage, weeks, blade=blade)


@scoped
def spark_combo(usage: DataFrame, blade: str, ratchet: str, bit: str, *, weeks: int = 7) -> DataFrame:
    return _series(usage, weeks, blade=blade, ratchet=ratchet, bit=bit)


@scoped
def rising_trends(usage: DataFrame, *, weeks: int = 8, min_uses: int = 3, limit: int = 15) -> DataFrame:
    """Growth of the last four weeks over the first four, momentum and projection; more than 10 % growth is kept."""
    rows = weekly(usage, ["blade"], weeks=weeks)
    part = lambda a, b: F.round(F.sum(F.when(F.col("week_idx").between(a, b), F.col("score")).otherwise(0.0)), 6)
    out = rows.groupBy("blade").agg(
        F.sum("uses").alias("uses"),
        part(weeks - 4, weeks - 1).alias("recent"),
        part(0, 3).alias("older"),
        part(2, 5).alias("mid"),
    )
    recent, older, mid = F.col("recent"), F.col("older"), F.col("mid")
    growth = F.when(older > 0, (recent - older) / older * 100).otherwise(F.when(recent > 0, 100.0).otherwise(0.0))
    return (
        out.filter(F.col("uses") >= min_uses)
        .withColumn("growth_rate", F.round(growth, 6))
        .filter("growth_rate > 10")
        .withColumn("momentum", F.round((recent - mid) - (mid - older), 6))
        .withColumn("projected", F.round(recent / 4 * (1 + F.col("growth_rate") / 100), 6))
        .orderBy(F.desc("growth_rate"), "blade")
        .limit(limit)
        .select("blade", "uses", "growth_rate", "momentum", "projected")
    )


def with_era(rows: DataFrame, usage: DataFrame, eras: int) -> DataFrame:
    """era 0 to eras - 1 of equal spans of the whole date range; a boundary day belongs to the earlier era."""
    span = usage.agg(F.min("tournament_date").alias("lo"), F.max("tournament_date").alias("hi"))
    days = F.datediff("tournament_date", "lo")
    all_days = F.datediff("hi", "lo")
    era = F.lit(eras - 1)
    for i in range(eras - 1, 0, -1):
        era = F.when(days * eras <= all_days * i, i - 1).otherwise(era)
    return rows.crossJoin(F.broadcast(span)).withColumn("era", era).drop("lo", "hi")  # one row


@scoped
def evolution_eras(usage: DataFrame) -> DataFrame:
    """Top five blades and top three combos of each of four eras, by undecayed points."""
    rows = with_era(shown(scored(usage, SITE)), usage, 4).withColumn("combo", label())
    out = None
    for kind, k in (("blade", 5), ("combo", 3)):
        sums = rows.groupBy("era", F.col(kind).alias("name")).agg(
            total("p").alias("score"), count_if(F.col("place") == 1).alias("wins"), F.count("*").alias("uses")
        )
        order = Window.partitionBy("era").orderBy(F.desc("score"), "name")
        top = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        top = top.select("era", F.lit(kind).alias("kind"), "name", "score", "wins", "uses", "rank")
        out = top if out is None else out.union(top)
    return out


def _monthly(usage: DataFrame, key: Column) -> DataFrame:
    """(month, name, score, rank) by undecayed points."""
    rows = shown(scored(usage, SITE))
    sums = rows.groupBy(F.date_format("tournament_date", "yyyy-MM").alias("month"), key.alias("name")).agg(
        total("p").alias("score")
    )
    order = Window.partitionBy("month").orderBy(F.desc("score"), "name")
    return sums.withColumn("rank", F.row_number().over(order))


@scoped
def evolution_timeline(usage: DataFrame) -> DataFrame:
    """Per month: top blade, top combo, distinct event dates and tournaments."""
    month = F.date_format("tournament_date", "yyyy-MM").alias("month")
    counts = usage.groupBy(month).agg(
        F.count_distinct("tournament_date").alias("event_dates"), F.count_distinct("tournament_id").alias("tournaments")
    )
    blade = _monthly(usage, F.col("blade")).filter("rank = 1").select("month", F.col("name").alias("top_blade"))
    combo = _monthly(usage, label()).filter("rank = 1").select("month", F.col("name").alias("top_combo"))
    return counts.join(blade, "month").join(combo, "month")


@scoped
def evolution_journeys(usage: DataFrame, *, top: int = 5, limit: int = 10) -> DataFrame:
    """Blades ever in a month's top: peak rank and month, current rank, and how they move."""
    ranks = _monthly(usage, F.col("blade"))
    months = ranks.select("month").distinct()
    # a handful of months: numbering them on one task is bounded by the calendar
    numbered = months.withColumn("m", F.row_number().over(Window.orderBy("month")))
    numbered = numbered.withColumn("last", F.count("*").over(Window.partitionBy()))
    notable = ranks.filter(F.col("rank") <= top).select("name").distinct()
    own = ranks.join(notable, "name").join(F.broadcast(numbered), "month")
    found = own.groupBy("name").agg(
        F.min(F.struct("rank", "month")).alias("peak"),
        F.min("m").alias("first_m"),
        F.max("m").alias("last_m"),
        F.max("last").alias("last"),
        F.max(F.when(F.col("m") == F.col("last"), F.col("rank"))).alias("current_rank"),
        F.max(F.when(F.col("m") == F.col("last") - 1, F.col("rank"))).alias("previous_rank"),
    )
    now, before = F.col("current_rank"), F.col("previous_rank")
    trend = (
        F.when(F.col("first_m") >= F.col("last") - 1, "new")
        .when(now.isNull() & (F.col("last_m") < F.col("last") - 1), "gone")
        .when(now < before - 1, "rising")
        .when(now > before + 1, "falling")
        .otherwise("stable")
    )
    return (
        found.select(
            F.col("name").alias("blade"),
            F.col("peak.rank").alias("peak_rank"),
            F.col("peak.month").alias("peak_month"),
            "current_rank",
            trend.alias("trend"),
        )
        .orderBy("peak_rank", "peak_month", "blade")
        .limit(limit)
    )


@scoped
def spotlight(usage: DataFrame, *, days: int = 30, k: int = 3) -> DataFrame:
    """Champion of the days up to the newest tournament, and the combos that rose or fell by three ranks or more since the
    days before; with the date of that tournament, and whether it is stale (older than `days` on the reference date)."""
    newest = usage.agg(F.max("tournament_date")).scalar()
    rows = labelled(scored(usage, SITE, as_of=newest)).filter(F.col("days") <= 2 * days)
    rows = rows.withColumn("recent", F.col("days") <= days)
    sums = rows.groupBy("recent", "combo").agg(
        total("p").alias("score"), F.count("*").alias("uses"), count_if(F.col("place") == 1).alias("wins")
    )
    order = Window.partitionBy("recent").orderBy(F.desc("score"), "combo")
    sums = sums.withColumn("rank", F.row_number().over(order))
    sums = sums.withColumn("all", F.sum("uses").over(Window.partitionBy("recent")))
    now = sums.filter("recent")
    percent = lambda a, b: F.floor(F.col(a) * 100.0 / F.col(b) + 0.5)
    champion = now.filter("uses >= 2").orderBy(F.desc("score"), "combo").limit(1)
    champion = champion.select(
        F.lit("champion").alias("kind"), "combo", "score", "uses", percent("wins", "uses").alias("win_rate"),
        percent("uses", "all").alias("dominance"), F.col("rank").alias("new_rank"), F.lit(0).alias("change"),
    )
    moved = now.select("combo", "score", "uses", "wins", "all", F.col("rank").alias("new_rank")).join(
        sums.filter(~F.col("recent")).select("combo", F.col("rank").alias("old_rank")), "combo"
    )
    moved = moved.withColumn("change", F.col("old_rank") - F.col("new_rank")).filter(F.abs("change") >= 3)
    out = champion
    for kind, sign in (("riser", 1), ("faller", -1)):
        # risers by their new rank on a tie, fallers by their old one
        tie = F.col("new_rank") if sign > 0 else F.col("old_rank")
        side = moved.filter(F.col("change") * sign > 0).orderBy(F.desc(F.col("change") * sign), tie).limit(k)
        out = out.union(
            side.select(
                F.lit(kind), "combo", "score", "uses", percent("wins", "uses"), percent("uses", "all"), "new_rank", "change"
            )
        )
    today = usage.agg(F.max("as_of")).scalar() if "as_of" in usage.columns else newest
    return out.withColumns({"last_date": newest, "is_stale": F.datediff(today, newest) > days})


@scoped
def distribution(usage: DataFrame, *, days: int = 30, limit: int = 6) -> DataFrame:
    """Share of uses in percent for the most used blades of the last days."""
    rows = shown(scored(usage, SITE)).filter(F.col("days") <= days)
    counts = rows.groupBy("blade").agg(F.count("*").alias("uses"))
    counts = counts.withColumn("all", F.sum("uses").over(Window.partitionBy()))
    out = counts.orderBy(F.desc("uses"), "blade").limit(limit)
    return out.select("blade", "uses", F.round(F.col("uses") * 100.0 / F.col("all"), 1).alias("share"))


@scoped
def share_monthly(usage: DataFrame, *, months: int = 6, k: int = 5) -> DataFrame:
    """Monthly percentages of the combos ever among a month's top, and of all others together."""
    start = F.add_months(F.trunc(latest(usage), "month"), -(months - 1))
    rows = shown(usage).filter(F.col("tournament_date") >= start)
    rows = rows.withColumn("month", F.date_format("tournament_date", "yyyy-MM")).withColumn("combo", label())
    counts = rows.groupBy("month", "combo").agg(F.count("*").alias("uses"))
    order = Window.partitionBy("month").orderBy(F.desc("uses"), "combo")
    counts = counts.withColumn("k", F.row_number().over(order))
    totals = counts.groupBy("month").agg(F.sum("uses").alias("all"))
    top = counts.filter(F.col("k") <= k).select("combo").distinct()
    spine = totals.join(top, how="cross")  # months times their top combos: at most months * months * k rows
    share = F.floor(F.coalesce("uses", F.lit(0)) * 100.0 / F.col("all") + 0.5).cast("bigint")
    shares = spine.join(counts.select("month", "combo", "uses"), ["month", "combo"], "left").select(
        "month", "combo", share.alias("share")
    )
    others = shares.groupBy("month").agg(F.greatest(F.lit(0), 100 - F.sum("share")).cast("bigint").alias("share"))
    return shares.union(others.select("month", F.lit("Others").alias("combo"), "share"))


def stream_weekly(events: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Weekly points per event type, for a stream or a table; late rows are taken up to the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(
        F.count("*").alias("uses"), F.round(F.sum("value"), 4).alias("points")
    )
    return out.select(F.col("w.start").cast("date").alias("week"), "event_type", "uses", "points")


