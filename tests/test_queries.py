"""Every query over tournament usage against its SQL."""

import pytest
from helpers import same_rows

from podium.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0


def test_decks_by_hand(spark, sf_dir):
    from podium.operators import decks
    from podium.sources.orders_adapter import usage

    table = registry.deck_table(spark, sf_dir)
    rated = decks.rate_combos(table, usage(spark, sf_dir))
    assert rated.count() == table.count()
    bad = rated.filter("overall < 0 OR overall > 100 OR (uses = 0) <> (tier = '?')")
    assert bad.isEmpty()
    best = rated.filter("has_data").select("overall", "tier").collect()
    limits = [(85, "S"), (70, "A"), (55, "B"), (40, "C"), (25, "D"), (-1, "F")]
    assert all(r.tier == next(t for x, t in limits if r.overall >= x) for r in best)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_decks_that_share_combos(spark, sf_dir):
    """A combo in many decks, twice in one, of unknown parts or without a part is rated alike wherever it is."""
    from podium.operators import decks
    from podium.sources.orders_adapter import usage

    rows = usage(spark, sf_dir)
    known = registry.deck_table(spark, sf_dir).select("blade", "ratchet", "bit").orderBy("blade", "ratchet", "bit").first()
    combos = [tuple(known), ("Nothing", "0-00", "None"), (None, "0-00", None)]
    table = spark.createDataFrame(
        [(d, *c) for d in ("x", "y") for c in combos] + [("z", *combos[0])] * 3, "deck_id string, blade string, ratchet string, bit string"
    )
    rated = decks.rate_combos(table, rows).collect()
    assert len(rated) == 9 and len({tuple(r)[1:] for r in rated}) == 3
    assert sorted(r.has_data for r in rated) == [False] * 4 + [True] * 5
    found = {r.deck_id: tuple(r)[1:] for r in decks.rate_decks(table, rows).collect()}
    assert set(found) == {"x", "y", "z"} and found["x"] == found["y"] != found["z"]
