"""Statistics that are kept by batch, dictionaries, regions by rules, match pages and sentences, on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from podium.functions import texts
from podium.operators import dictionaries, ingest, kept, parts, places
from podium.sources import commits, reports, tables

USE = "post_id string, source string, date date, region string, place int, lock_chip string, blade string, assist string, ratchet string, bit string"


def use(k, source, place, blade="A", day=1, chip=None):
    return (k, source, datetime.date(2024, 1, day), "NA", place, chip, blade, None, "3-60", "F")


def view(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_kept_statistics_equal_a_recount(spark, tmp_path):
    path = f"{tmp_path}/t"

    def same():
        whole = kept.daily(tables.read(spark, path))
        found = commits.read_stats(spark, path, kept.daily)
        assert view(kept.part_stats(found)) == view(kept.part_stats(whole))
        assert view(kept.combo_stats(found)) == view(kept.combo_stats(whole))
        return {r.part_name: (r.total, r.first) for r in kept.part_stats(found).collect()}

    add = lambda *rows, **more: tables.append_events(spark.createDataFrame(rows, USE), path, partials=kept.daily, **more)
    add(use("a", "s", 1), use("a", "s", 2, "B"), use("b", "r", 1, chip="X"))
    assert same()["A"] == (2, 2)
    seen = []
    counted = lambda rows: seen.append(sorted(r.post_id for r in rows.collect())) or kept.daily(rows)
    tables.append_events(spark.createDataFrame([use("b", "r", 3), use("c", "r", 3, day=9)], USE), path, partials=counted)
    assert seen == [["c"]]  # what is kept is made of the new rows alone
    assert same()["A"] == (3, 2) and kept.part_stats(commits.read_stats(spark, path, kept.daily), as_of="2024-01-05").count() == 5
    tables.append_events(spark.createDataFrame([use("d", "q", 1, "C")], USE), path)  # a batch that nothing is kept of
    assert same()["C"] == (1, 1)
    tables.delete_sources(spark, path, ["r"])
    assert same() == {"A": (1, 1), "B": (1, 0), "C": (1, 1), "3-60": (3, 2), "F": (3, 2)}
    tables.compact(spark, path, partials=kept.daily)
    assert same()["A"] == (1, 1) and all(b.stats for b in commits.snapshot(spark, path).batches)
    add(use("e", "s", 1, "D"), replaced=["s"])
    assert set(same()) == {"C", "D", "3-60", "F"}
    with pytest.raises(ValueError, match="not one event"):
        add(use("d", "s", 1), replaced=["s"])  # its key is another source's
    tables.reset(spark, path, tables.read(spark, path).schema)
    assert same() == {}


def test_dictionary(spark):
    rows = [("blade", "", "アー", "Second", 2), ("blade", "", "アー", "First", 1), ("blade", "de", "アー", "German", 0),
            ("bit", "", "アー", "Bit", 0), ("blade", "", None, "x", 0), ("blade", "", "y", None, 0)]
    names = dictionaries.dictionary(spark.createDataFrame(rows, "kind string, source string, written string, name string, priority int"))
    assert names.entries == 3
    data = [("ア ー", "de"), ("アー", "fr"), ("?", None), (None, "de")]
    frame = spark.createDataFrame(data, "blade string, source string").withColumns({"_name0": F.lit(1), "_source0": F.lit(2)})
    got = dictionaries.translated_parts(frame, names, bit=None)
    assert got.columns == ["source", "_name0", "_source0", "blade"]
    assert sorted(str(r.blade) for r in got.collect()) == ["?", "First", "First", "None"]
    own = dictionaries.lookup(frame, names, "blade", [(F.col("source"), dictionaries.unspaced(F.col("blade")))], "into", F.lit("-"))
    assert sorted(r.into for r in own.collect()) == ["-", "-", "-", "German"]


def test_plan_does_not_grow_with_the_dictionary(spark):
    frame = spark.createDataFrame([("n5",), ("n9999",)], "blade string")

    def plan(n, most=None):
        rows = spark.range(n).select(F.lit("blade").alias("kind"), F.concat(F.lit("n"), "id").alias("written"), F.col("id").cast("string").alias("name"))
        names = dictionaries.dictionary(rows)
        out = dictionaries.translated_parts(frame, names, bit=None)
        return out, len(out._jdf.queryExecution().optimizedPlan().toString())

    small, short = plan(10)
    large, long = plan(10_000)
    assert abs(long - short) < 200
    assert [r.blade for r in small.collect()] == ["5", "n9999"] and [r.blade for r in large.collect()] == ["5", "9999"]


def test_large_dictionaries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dictionaries, "BROADCAST_ENTRIES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = dictionaries.dictionary(dictionaries.from_maps(spark, {"bit": {"F": "Flat", "B": "Ball"}}))
        out = dictionaries.translated_parts(spark.createDataFrame([("F",)], "bit string"), names, blade=None)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.bit for r in out.collect()] == ["Flat"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_and_places(spark):
    names = dictionaries.dictionary(dictionaries.standard(spark))
    texts_in = ["東京 G1大会 準決勝", "決勝戦", "no words", "", None, "大阪大阪"]
    rows = spark.createDataFrame([(t,) for t in texts_in], "title string")
    got = {r.title for r in dictionaries.replaced_words(rows, names, "title").collect()}
    assert got == {"Tokyo G1 Tournament Semi-Finals", "Finals戦", "no words", "", None, "OsakaOsaka"}
    rows = spark.createDataFrame([("優勝",), ("準優勝",), (" 3位入賞 ",), ("4位",), (None,)], "word string")
    assert sorted(str(r.place) for r in dictionaries.place_of(rows, names, "word").collect()) == ["1", "2", "3", "None", "None"]


def test_bits_by_source(spark):
    names = dictionaries.dictionary(dictionaries.standard(spark))
    rows = [("fb", "de"), ("RA", "de"), ("RA", "jp"), ("W", "jp"), ("RA", "en"), ("fb", "en"), (" FB ", None), ("zz", "de"), (None, "de")]
    got = dictionaries.expanded_bits(spark.createDataFrame(rows, "bit string, source string"), names).collect()
    want = [("de", "Free Ball"), ("de", "Rush Accel"), ("jp", "RA"), ("jp", "W"), ("en", "Rubber Accel"), ("en", "fb"), (None, "Free Ball"), ("de", "ZZ"), ("de", None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_stored_parts_give_series(spark, tmp_path):
    row = "name string, type string, spin_direction string, series string, notes string"
    path = f"{tmp_path}/parts"
    parts.load_parts(spark.createDataFrame([("Old", "blade", None, "BX", None)], row), path)
    new = [("Dran Sword", "blade", "right", "BX", None), ("Brave", "blade", "right", "CX", None), ("Sol", "blade", None, "UX", None), ("F", "bit", None, "BX", None)]
    assert parts.load_parts(spark.createDataFrame(new, row), path) == 4
    series = dictionaries.series_names(parts.stored_parts(spark, path))
    frame = spark.createDataFrame([("Dran Sword",), ("Dran Brave",), ("Sol Eclipse",), ("Old",), ("F",), (None,)], "blade string")
    got = {r.blade: r.series for r in dictionaries.with_series(frame, series).collect()}
    assert got == {"Dran Sword": "BX", "Dran Brave": "CX", "Sol Eclipse": "UX", "Old": None, "F": None, None: None}
    with pytest.raises(ValueError, match="twice"):
        parts.load_parts(spark.createDataFrame(new[:1] * 2, row), path)
    assert parts.stored_parts(spark, path).count() == 4


def test_region_rules(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("kind,pattern,region,priority\nexact,UK,EU,0\nword,in,NA,1\npart,rome,EU,2\nexact,rome,XX,3\n")
    rules = places.rules_from_file(spark, f"{tmp_path}/rules.csv")
    rows = [(None, None, None, "Winning in Rome"), (" uk ", None, "Rome", ""), ("ukraine", "", "Winning", "x"), ("Rome", None, None, None), (None,) * 4]
    got = places.with_regions(spark.createDataFrame(rows, "country string, state string, city string, name string"), rules).collect()
    assert sorted((str(r.country), str(r.region)) for r in got) == [
        (" uk ", "EU"), ("None", "NA"), ("None", "None"), ("Rome", "EU"), ("ukraine", "None")]


PAGE = """<html><head><title>T | Site</title><script>var x = "2020年1月1日";</script></head><body><h1>【速報】Cup One | Site</h1>{time}
<p>開催 2024年5月3日</p><div class="entry-content"><div>{body}</div>
after</div><article>【優勝者：Nobody】
Brand 1-60F</article></body></html>"""
TABLE = "<table><tr><th>Adaさん使用ベイ</th><th>Bo</th></tr><tr><td>Alpha 3-60RA</td><td>Beta_9-60B</td></tr></table>"
PROSE = "【優勝者：Cy選手】\nアルファ 3-60F\n【準優勝者：Di選手】\nベータ 5-60B"


def test_match_pages(spark):
    pages = [
        ("https://x/2023/one/", PAGE.format(time='<time datetime="2024-02-01">', body=TABLE + PROSE)),
        ("https://x/2023/two", PAGE.format(time='<time datetime="2024-02-01T10:00">', body="\n" + PROSE)),
        ("https://x/2023/three", "<title>Plain</title><table></table>" + PROSE),  # a page with tables is not read as prose
        ("https://x/2023/four", None),
    ]
    got = ingest.match_pages(spark.createDataFrame(pages, "url string, html string"), prefix="p_").collect()
    want = [
        ("p_one", "Cup One", "2024-02-01", 1, "Ada", "Alpha", "3-60", "RA"),
        ("p_one", "Cup One", "2024-02-01", 2, "Bo", "Beta", "9-60", "Ball"),
        ("p_two", "Cup One", "2024-05-03", 1, "Cy", "アルファ", "3-60", "Flat"),
        ("p_two", "Cup One", "2024-05-03", 2, "Di", "ベータ", "5-60", "Ball"),
    ]
    assert sorted((r.post_id, r.name, str(r.date), r.place, r.player, r.blade, r.ratchet, r.bit) for r in got) == want
    rows = reports.page_rows(spark.createDataFrame(pages[2:], "page string, html string")).collect()
    assert {(r.page[-5:], r.kind, r.text) for r in rows if r.kind in ("title", "tables")} == {("three", "title", "Plain"), ("three", "tables", "1"), ("/four", "tables", "0")}


def test_sentences(spark):
    row = spark.createDataFrame([("A", 0.125, 0, 1, 7)], "blade string, win double, none int, one int, many int")
    made = [
        texts.sentence("underused", "reason", blade=F.col("blade"), win=F.col("win"), recent=F.col("none")),
        texts.sentence("underused", "reason", blade=F.col("blade"), win=F.col("win"), recent=F.col("one")),
        texts.sentence("forgotten", "reason", wins=F.col("many"), era=F.lit("mid"), win=F.col("win")),
        texts.sentence("forgotten", "insight", wins=F.col("many"), era=F.lit("mid"), win=F.col("win")),
        texts.sentence("rising", "reason", wins=F.col("none")),
        texts.sentence("counter", "reason", wins=F.col("one")),
    ]
    assert list(row.select(*made).first()) == [
        "A has 13% win rate with no recent appearances", "A has 13% win rate but only 1 recent appearance", "Won 7 tournaments in mid era",
        "Former champion with 13% past win rate - meta may have moved on prematurely", "New combo showing potential in last 60 days",
        "Non-meta blade with 1 win in current era"]
