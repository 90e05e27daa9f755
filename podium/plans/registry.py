"""The queries over tournament usage and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import names
from podium.operators import comparisons, decks, dictionaries, discovery, ingest, kept, parts, places, rankings, summaries, timelines
from podium.plans.oracle import ORACLE_SQL as ANALYTIC_SQL
from podium.sources.orders_adapter import usage


def _of(fn: Callable[..., DataFrame], *args, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(usage(spark, sf_dir), *args, **options)


def deck_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks drawn from the usage itself: the winners of the newest tournaments, one row per combo, by display name."""
    rows = rankings.shown(usage(spark, sf_dir)).filter("place = 1")
    key = F.concat_ws("|", "tournament_id", "player_name")
    return rows.select(key.alias("deck_id"), "blade", "ratchet", "bit").distinct()


def named_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage with aliased, chip-less and mixed-case names in place of some of the tables' names."""
    swap = lambda c, table: names.renamed(F.col(c), table)
    return usage(spark, sf_dir).withColumns(
        {
            "blade": swap("blade", {"Brand#11": "Soar Phoenix", "Brand#12": "Dark", "Brand#13": "DARK"}),
            "bit": swap("bit", {"PROMO": "BS", "ECONOMY": "economy"}),
        }
    )


def _named(fn: Callable[..., DataFrame], *args, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(named_usage(spark, sf_dir), *args, **options)


def _deck(fn):
    return lambda spark, sf_dir: fn(deck_table(spark, sf_dir), usage(spark, sf_dir))


A, B = ("Brand#2", "Brand#3"), (("Brand#2", "10-60", "ECONOMY"), ("Brand#3", "11-80", "STANDARD"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "view_usage": lambda spark, sf_dir: usage(spark, sf_dir),
    "view_part_stats": _of(summaries.part_stats),
    "view_combo_stats": _of(summaries.combo_stats),
    "rank_combos_cli": _of(rankings.cli_ranking, ["blade", "ratchet", "bit"], limit=20, min_uses=2),
    "rank_blades_cli": _of(rankings.cli_ranking, ["blade"], limit=20, min_uses=3),
    "rank_ratchets_cli": _of(rankings.cli_ranking, ["ratchet"], limit=15, min_uses=3),
    "rank_bits_cli": _of(rankings.cli_ranking, ["bit"], limit=15, min_uses=3),
    "rank_blades": _of(rankings.rank_blades),
    "rank_blades_region": _of(rankings.rank_blades, region="ASIA"),
    "rank_combos": _of(rankings.rank_combos),
    "rank_ratchets": _of(rankings.rank_parts, "ratchet"),
    "rank_bits": _of(rankings.rank_parts, "bit"),
    "rank_assists": _of(rankings.rank_parts, "assist", min_uses=2, ranked=False),
    "rank_lock_chips": _of(rankings.rank_parts, "lock_chip", min_uses=2, ranked=False),
    "rank_blades_by_series": _of(rankings.rank_blades_by_series, "BX"),
    "top_by_series": _of(rankings.top_by_series),
    "rank_unique_blade": _of(rankings.rank_unique_blade),
    "rank_search": _of(rankings.rank_search, "econ", height="60"),
    "best_for_blade_cli": _of(rankings.best_for_blade_cli, "Brand#2"),
    "best_for_blade": _of(rankings.best_for, "blade", "Brand#2"),
    "best_for_ratchet": _of(rankings.best_for, "ratchet", "10-60"),
    "best_for_bit": _of(rankings.best_for, "bit", "ECONOMY"),
    "top_parts_stats": _of(summaries.top_parts_stats),
    "recent_by_source": _of(summaries.recent_by_source, "1"),
    "summary": _of(summaries.summary),
    "summary_region": _of(summaries.summary, region="EUROPE"),
    "snapshot": _of(summaries.snapshot),
    "snapshot_cli": _of(summaries.snapshot, fused=True),
    "combo_stats_point": _of(summaries.combo_point, "Brand#2", "10-60", "ECONOMY"),
    "distinct_parts": _of(summaries.distinct_parts),
    "compare_blades_cli": _of(comparisons.compare_blades_cli, *A),
    "compare_blades": _of(comparisons.compare_blades, *A),
    "compare_combos": _of(comparisons.compare_combos, *B),
    "compare_share": _of(comparisons.compare_share, *A),
    "rate_combo": _deck(decks.rate_combos),
    "rate_deck": _deck(decks.rate_decks),
    "hidden_gems": _of(discovery.hidden_gems),
    "eras3": _of(discovery.eras3),
    "gem_stats": _of(discovery.gem_stats),
    "gems_underused": _of(discovery.gems_underused, max_recent=5000, min_win_rate=0.1),
    "gems_underused_as_of": _of(discovery.gems_underused, as_of="1998-06-30", region="ASIA", min_win_rate=0.1),
    "gems_forgotten": _of(discovery.gems_forgotten),
    "gems_rising": _of(discovery.gems_rising, max_uses=60),
    "gems_counter_meta": _of(discovery.gems_counter_meta),
    "part_analysis": _of(discovery.part_analysis),
    "variance": _of(discovery.variance),
    "part_matrix": _of(discovery.part_matrix),
    "landscape": _of(discovery.landscape),
    "spark_blade": _of(timelines.spark_blade, "Brand#2"),
    "spark_blades": _of(timelines.weekly, ["blade"]),
    "spark_combos": _of(timelines.weekly, ["combo"]),
    "rising_trends": _of(timelines.rising_trends),
    "evolution_eras": _of(timelines.evolution_eras),
    "evolution_timeline": _of(timelines.evolution_timeline),
    "evolution_journeys": _of(timelines.evolution_journeys),
    "spotlight": _of(timelines.spotlight),
    "spotlight_named": _named(timelines.spotlight),
    "rank_combos_named": _named(rankings.rank_combos),
    "rank_blades_named": _named(rankings.rank_blades),
    "best_for_ratchet_named": _named(rankings.best_for, "ratchet", "H10-60"),
    "best_for_bit_named": _named(rankings.best_for, "bit", "bs"),
    "spark_blade_named": _named(timelines.spark_blade, "dark"),
    "spark_combo": _of(timelines.spark_combo, "brand#2", "10-60", "Economy"),
    "compare_combos_named": _named(
        comparisons.compare_combos, ("dark", "h1-80", "Economy"), ("Dark", "H1-80", "ECONOMY", "o")
    ),
    "compare_combos_stored": _named(
        comparisons.compare_combos, ("dark", "49-80", "Economy", "o"), ("Dark", "h50-60", "MEDIUM", "f", None)
    ),
    "blade_cards": _of(summaries.blade_cards),
    "rank_combos_as_of": _of(rankings.rank_combos, as_of="1998-06-30"),
    "rank_combos_region": _of(rankings.rank_combos, region="ASIA"),
    "distribution": _of(timelines.distribution),
    "share_monthly": _of(timelines.share_monthly),
    "stream_weekly": lambda spark, sf_dir: timelines.stream_weekly(spark.read.parquet(f"{sf_dir}/events.parquet")),
} | ingest.QUERIES | parts.QUERIES | places.QUERIES | dictionaries.QUERIES | kept.QUERIES

ORACLE_SQL: dict[str, str] = ANALYTIC_SQL | ingest.ORACLE_SQL | parts.ORACLE_SQL | places.ORACLE_SQL
ORACLE_SQL |= dictionaries.ORACLE_SQL | kept.oracle_sql(ORACLE_SQL)
