"""Scoring, names and parsers on literals."""

import datetime

from pyspark.sql import functions as F

from podium.functions import names, scoring
from podium.operators import ingest


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_worked_score(spark):
    rows = spark.createDataFrame(
        [("2024-03-01", 1, "both"), ("2024-02-15", 2, "final"), ("2024-01-16", 1, "first")],
        "d string, place int, stage string",
    ).select(F.to_date("d").alias("tournament_date"), "place", "stage")
    total = scoring.scored(rows, as_of=F.to_date(F.lit("2024-03-01"))).agg(F.sum("ws")).first()[0]
    assert round(total, 4) == round(3.45 + 2 * 0.5**0.5 + 1.5 * 0.5**1.5, 4) == 5.3945


def test_names(spark):
    r = one(
        spark,
        a=names.display_ratchet(F.lit("H9-60")),
        b=names.display_bit(F.lit("HN")),
        c=names.display_blade(F.lit("Soar Phoenix")),
        d=names.full_blade(F.lit(None).cast("string"), F.lit("Dran")),
        e=names.display_ratchet(F.lit("odd")),
        f=names.full_blade(F.lit("Sol"), F.lit("Soar Phoenix")),
    )
    assert tuple(r) == ("9-60", "High Needle", "Phoenix Wing", "Dran", "odd", "Sol Phoenix Wing")


def test_combos(spark):
    cases = {
        "DranSword 3-60F": ("DranSword", None, "3-60", "F"),
        "- KnightShield 3-80N (Both Stages)": ("KnightShield", None, "3-80", "N"),
        "HellScythe Phoenix Wing 4-80B": ("HellScythe Phoenix Wing", None, "4-80", "B"),
        "Ada: Wizard Rod 9-60 Ball": ("Wizard Rod", None, "9-60", "Ball"),
        "no combo here": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ingest.combo_en(F.col("t")).alias("c"))
    for r in df.collect():
        assert (tuple(r.c) if r.c else None) == cases[r.t]
    r = one(
        spark,
        ja=ingest.combo_ja(F.lit("ウィザードロッド ジャギー 3-60HN")),
        de=ingest.combo_de(F.lit("T. Rex 1-70b")),
        deh=ingest.combo_de(F.lit("Wolf Blast F4-50H")),
        stage=ingest.stage_note(F.lit("x (3on3 Finals Only)")),
    )
    assert tuple(r.ja) == ("ウィザードロッド", "ジャギー", "3-60", "HN")
    whole = one(spark, c=ingest.combo_ja(F.lit("ウィザード ロッド 3-60F"), ("ウィザードロッド",)), d=ingest.combo_ja(F.lit("ドラン Dash 3-60F")))
    assert tuple(whole.c) == ("ウィザード ロッド", None, "3-60", "F") and tuple(whole.d) == ("ドラン Dash", None, "3-60", "F")
    assert tuple(r.de) == ("T. Rex", None, "1-70", "B")
    assert tuple(r.deh) == ("Wolf Blast", None, "F4-50", "H")
    assert r.stage == "final"


def test_dates_places_formats(spark):
    as_of = F.to_date(F.lit("2025-01-01"))
    r = one(
        spark,
        a=ingest.date_en(F.lit("Cup - 07/29/23"), as_of),
        b=ingest.date_en(F.lit("May 4, 2024"), as_of),
        c=ingest.date_en(F.lit("13/45/23"), as_of),
        d=ingest.date_ja(F.lit("2024年5月6日"), F.lit("x")),
        e=ingest.date_ja(F.lit("?"), F.lit("http://x/2023/a")),
        f=ingest.date_de(F.lit("am 03.02.2024"), F.lit(None).cast("date")),
        g=ingest.location(F.lit("Toronto, ON, Canada - X Format - Unranked 1on1")),
        h=ingest.event_format(F.lit("X Format - Unranked 1on1")),
        i=ingest.title(F.lit("【JP】Cup 2024-01-02 | Blog")),
    )
    day = datetime.date
    assert (r.a, r.b, r.c) == (day(2023, 7, 29), day(2024, 5, 4), None)
    assert (r.d, r.e, r.f) == (day(2024, 5, 6), day(2023, 1, 1), day(2024, 2, 3))
    assert (r.g.city, r.g.state, r.g.country) == ("Toronto", "ON", "Canada")
    assert tuple(r.h) == ("1on1", False)
    assert r.i == "Cup"


HEAD = {
    "name with its date": (
        "Harbour Open\n- 03/09/24\nLeeds, UK - X Format - Ranked 3on3",
        ("Harbour Open", datetime.date(2024, 3, 9), "Leeds", None, "UK", "3on3", True),
    ),
    "location before the name": (
        "03/09/24\nLeeds, Kent, UK - Unranked 1on1\nSpring Meeting",
        ("Spring Meeting", datetime.date(2024, 3, 9), "Leeds", "Kent", "UK", "1on1", False),
    ),
    "date in words on its own line": (
        "Spring Meeting\nMarch 9, 2024\nNice, France",
        ("Spring Meeting", datetime.date(2024, 3, 9), "Nice", None, "France", None, None),
    ),
    "bars": (
        "Spring Meeting | X Format (Unranked)\nNice, France | March 9, 2024",
        ("Spring Meeting", datetime.date(2024, 3, 9), "Nice", None, "France", None, False),
    ),
    "notes are no names": (
        "Winning Combos\nX Format\nSpring Meeting\nMarch 9, 2024",
        ("Spring Meeting", datetime.date(2024, 3, 9), None, None, None, None, None),
    ),
    "the search ends at a placement": ("03/09/24\n1st Place: Ada\nNot A Name", (None, datetime.date(2024, 3, 9), *[None] * 5)),
}


def test_headers(spark):
    rows = [(name, f"{head}\n\n1st Place: Ada\nAlpha Beta 3-60F") for name, (head, _) in HEAD.items()]
    posts = spark.createDataFrame(rows, "post_id string, text string")
    found = ingest.headers(ingest.with_event(ingest.lines(posts)), F.to_date(F.lit("2025-01-01"))).collect()
    assert {r.post_id: (r.name, r.date, r.city, r.state, r.country, r.format, r.ranked) for r in found} == {
        name: expected for name, (_, expected) in HEAD.items()
    }


def test_two_events_in_a_post(spark):
    text = """Harbour Open
- 03/09/24
Leeds, UK - Ranked 1on1

1st Place: Ada
Alpha Beta 3-60F (Both Stages)
2nd
(click to view)
Brook
Gamma Delta S 9-60 Ball
4th: Cleo
Epsilon 5-80GN

03/16/24
Harbour Return
Leeds, UK
1st Place - Drew
Alpha Beta 3-60F"""
    posts = spark.createDataFrame([("p", text), ("q", "Just a moment 3-60F")], "post_id string, text string")
    rows = ingest.with_event(ingest.lines(ingest.wanted_posts(posts)))
    head = sorted((h.event, h.name, str(h.date)) for h in ingest.headers(rows, F.to_date(F.lit("2025-01-01"))).collect())
    assert head == [(0, "Harbour Open", "2024-03-09"), (1, "Harbour Return", "2024-03-16")]
    found = sorted((r.event, r.place, r.player, r.blade, r.stage) for r in ingest.placements(rows).collect())
    assert found[0] == (0, 1, "Ada", "Alpha Beta", "both") and (1, 1, "Drew", "Alpha Beta", None) in found
    named = {(r.event, r.place): r for r in ingest.placements(rows, place=ingest.ANY_PLACE, named=True).collect()}
    assert set(named) == {(0, 1), (0, 2), (0, 4), (1, 1)}
    assert (named[0, 2].player, named[0, 2].blade, named[0, 2].assist, named[0, 2].bit) == ("Brook", "Gamma Delta", "Slash", "Ball")
    assert (named[0, 4].player, named[0, 4].blade, named[0, 4].bit) == ("Cleo", "Epsilon", "GearNeedle")


def test_trends_and_ordinals(spark):
    r = one(
        spark,
        up=scoring.trend_class(F.lit(0.2)), down=scoring.trend_class(F.lit(-0.2)), flat=scoring.trend_class(F.lit(0.1)),
        none=scoring.ordinal(F.lit(0.0)), first=scoring.ordinal(F.lit(1.4)), second=scoring.ordinal(F.lit(1.5)),
        third=scoring.ordinal(F.lit(3.9)),
    )
    assert tuple(r) == ("up", "down", "neutral", "--", "1st", "2nd", "3rd")


def test_normaliser_folds_chains(spark):
    rules = {"Might Blast": "Emperor Might", "Emperor Might": "Might", "x": "y"}
    assert ingest.folded(rules)["Might Blast"] == "Might"
    df = spark.createDataFrame([("Might Blast",), ("Might",), (None,)], "blade string")
    once = ingest.normalised(df, ["blade"], rules)
    assert sorted(str(r.blade) for r in once.collect()) == ["Might", "Might", "None"]
    assert ingest.normalised(once.drop("fixes"), ["blade"], rules).agg(F.sum("fixes")).first()[0] == 0


def test_loading_rules(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert sorted(tuple(r) for r in ingest.first_wins(rows, ["k"], "n").collect()) == [("a", 1), ("b", 3)]
    loaded = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in ingest.not_loaded(rows, loaded, "k").collect()] == ["b"]
    events = spark.createDataFrame([("d1", "G1 Cup"), ("d1", "Open"), ("d2", "Open")], "date string, name string")
    other = spark.createDataFrame([("d1", "Big G1"), ("d2", "Open")], "date string, name string")
    left = ingest.not_in_other_source(events, other, ["G1"])
    assert [tuple(r) for r in left.select("date", "name").collect()] == [("d1", "Open")]
