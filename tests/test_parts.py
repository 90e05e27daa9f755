"""Names of parts and places on literals."""

import pytest
from pyspark.sql import functions as F

from podium.operators import ingest, parts, places


def table(spark, cases, **columns):
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    return {r.t: r for r in df.select("t", *[c.alias(n) for n, c in columns.items()]).collect()}


def test_compound_blades(spark):
    cases = {
        "Pegasus Blast": ("Pegasus", "Blast"),
        "Blast Pegasus": ("Pegasus", "Blast"),
        "PegasusBlast": ("Pegasus", "Blast"),
        "Valkyrie Blast W": ("Valkyrie", "Blast"),
        "pegasus blast": ("Pegasus", "Blast"),
        "Pegasus Flame": ("Pegasus", "Flare"),
        "Blast": (None, "Blast"),
        "Wizard Rod": (None, "Wizard Rod"),
    }
    found = table(spark, cases, c=parts.compound(F.col("t")))
    assert {k: (r.c.lock_chip, r.c.blade) for k, r in found.items()} == cases


def test_compound_flags(spark):
    none = F.lit(None).cast("string")
    cases = {
        "Blast": (True, False, "Blast"),
        "Might Blast": (False, True, "Emperor Might"),
        "Fang Blast": (False, True, "Fang"),
        "typo": (False, False, "Dran Sword"),
        "Dran Sword": (False, False, "Dran Sword"),
    }
    found = table(spark, cases, f=parts.compound_flags(F.col("t"), none, {"typo": "Dran Sword"}))
    assert {k: tuple(r.f) for k, r in found.items()} == cases


def test_blades_assists_bits(spark):
    cases = {
        "Courage Dran S": ("Courage Dran", "Slash"),
        "Pegasus Blast Jaggy": ("Pegasus Blast", "Jaggy"),
        "Wizard Rod": ("Wizard Rod", None),
        "HellsScythe": ("Hells Scythe", None),
        "wyvern hover": ("Hover Wyvern", None),
        "SwordDran": ("Dran Sword", None),
        "-phoenixwing": ("Phoenix Wing", None),
        "NewBlade": ("New Blade", None),
        "lonely": ("lonely", None),
    }
    found = table(spark, cases, c=parts.split_assist(F.col("t")))
    assert {k: tuple(r.c) for k, r in found.items()} == cases
    bits = {" HN ": "High Needle", "LowOrb": "Low Orb", "GF": "GearFlat", "GearFlat": "Gear Flat", "odd": "odd"}
    assert {k: r.b for k, r in table(spark, bits, b=parts.expanded_bit(F.col("t"))).items()} == bits
    titles = {"t. rex-two o'neil": "T. Rex-Two O'Neil"}
    assert {k: r.b for k, r in table(spark, titles, b=parts.title_case(F.col("t"))).items()} == titles


def test_translations(spark):
    blades, bits = parts.KANA_BLADES, parts.KANA_BITS
    names = {"ドランソード": "Dran Sword", "ドラン　ソード": "Dran Sword", "other": "other"}
    found = table(spark, names, b=parts.translated(F.col("t"), blades, squeeze=True), j=parts.is_japanese(F.col("t")))
    assert {k: r.b for k, r in found.items()} == names and [r.j for r in found.values()] == [True, True, False]
    combos = {
        "ドランソード 3-60フラット": ("Dran Sword", "3-60", "Flat"),
        "ドランソード 3-60 F": ("Dran Sword", "3-60", "F"),
        "ヘルズサイズ 3-60": ("Hells Scythe", "3-60", ""),
        "x": ("x", "", ""),
    }
    found = table(spark, combos, c=parts.translated_combo(F.col("t"), blades, bits))
    assert {k: tuple(r.c) for k, r in found.items()} == combos


def test_regions(spark):
    cases = {
        "Canada": "NA", " uk ": "EU", "Springfield, OH": "NA", "Whitby ON": "NA", "Greater London": "EU",
        "somewhere in Brazil": "NA", "near Brazil": "SA", "日本": "JAPAN", "winning": None, "bus stop": None, "": None,
    }
    assert {k: r.x for k, r in table(spark, cases, x=places.region_of_text(F.col("t"))).items()} == cases
    none = F.lit(None).cast("string")
    r = spark.range(1).select(
        places.region_of_event(F.lit("Osaka Cup"), F.lit("Town"), none, F.lit("Peru")).alias("a"),
        places.region_or_default(none, F.lit(""), {}).alias("b"),
        places.region_or_default(F.lit("EU"), F.lit("jp"), {"jp": "JAPAN"}).alias("c"),
        places.region_or_default(none, F.lit("other"), {"jp": "JAPAN"}).alias("d"),
    ).first()
    assert tuple(r) == ("SA", "NA", "JAPAN", None)


def test_places_move_when_they_come_again(spark):
    rows = [("p", i, x) for i, x in enumerate([1, 2, 3, 2, 3, 1, 1])] + [("q", 0, 1), ("q", 1, 4)]
    df = spark.createDataFrame(rows, "post_id string, at long, place int")
    found = ingest.offset_places(df, "post_id", "at").orderBy("post_id", "at").collect()
    assert [r.place for r in found] == [1, 2, 3, 102, 103, 101, 201, 1, 4]


def test_dimension(spark):
    rows = spark.createDataFrame([("B", "blade"), ("A", "blade"), ("3-60", "ratchet")], "name string, type string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("spin_direction", "series", "notes")})
    assert [r.name for r in parts.parts_dimension(rows).collect()] == ["A", "B", "3-60"]
    with pytest.raises(ValueError, match="twice"):
        parts.parts_dimension(rows.union(rows))
    series = {"Dran Sword": "BX", "Blast": "CX", "Wizard": "UX"}
    cases = {"Dran Sword": "BX", "Pegasus Blast": "CX", "Wizard Rod": "UX", "Other": None}
    assert {k: r.s for k, r in table(spark, cases, s=parts.series_of(F.col("t"), series)).items()} == cases
