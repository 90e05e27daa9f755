"""Sources, sinks and streams on small files."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from podium.operators import ingest
from podium.operators.timelines import stream_weekly
from podium.sources import commits, reports, tables
from podium.streaming.reports import ingest_stream

POST = """<div class="post" id="pid{n}"><div class="post_body">Cup {n} - 07/29/23<br>
Toronto, ON, Canada - Unranked 1on1<br>1st Place: Ann<br>DranSword 3-60F<br>2nd Place: Bob<br>KnightShield 3-80N</div></div>"""


def test_dumps_and_posts(spark, tmp_path):
    (tmp_path / "dump.json").write_text(json.dumps({"2": POST.format(n=2), "10": "<p>Just a moment</p>"}))
    (tmp_path / "page_3.html").write_text(POST.format(n=3))
    pages = reports.page_dump(spark, f"{tmp_path}/dump.json").union(reports.page_folder(spark, str(tmp_path)))
    assert sorted(r.page_no for r in pages.collect()) == [2, 3, 10]
    found = {r.post_id: r.text for r in reports.posts(pages).collect()}
    assert set(found) == {"2", "3"} and found["2"].split("\n")[2] == "1st Place: Ann"


def test_nested_json(spark, tmp_path):
    combo = {"blade": "A", "ratchet": "3-60", "bit": "F"}
    events = [{"wbo_post_id": "e1", "name": "Cup", "date": None, "placements": [{"place": 1, "player": "p", "combos": [combo]}]}]
    (tmp_path / "e.json").write_text(json.dumps(events))
    row = reports.event_json(spark, f"{tmp_path}/e.json").first()
    assert (row.post_id, str(row.date), row.player, row.combos[0].blade) == ("e1", "2024-01-01", "p", "A")
    champ = {"tournaments": [{"id": "x", "name": "C", "date": "2024-05-01", "placements": [
        {"place": 1, "player": "p", "combos": [combo]}, {"place": 2, "player": "q", "combos": []}]}]}
    (tmp_path / "c.json").write_text(json.dumps(champ))
    rows = reports.championship_json(spark, f"{tmp_path}/c.json").collect()
    assert [(r.post_id, r.region, r.place) for r in rows] == [("champ_x", "JAPAN", 1)]


def test_append_replace_refresh(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", "2024-01-01", "s"), ("b", None, "s")], "post_id string, d string, source string")
    rows = rows.select("post_id", F.to_date("d").alias("date"), "source")
    assert {r.status: r.n for r in tables.append_events(rows, path).collect()} == {"added": 1, "no_date": 1}
    assert {r.status: r.n for r in tables.append_events(rows, path).collect()} == {"exists": 1, "no_date": 1}
    other = rows.limit(1).withColumn("source", F.lit("z"))
    tables.replace_source(other, path)
    assert sorted(r.source for r in tables.read(spark, path).collect()) == ["s", "z"]
    assert tables.delete_sources(spark, path, ["z", "none"]) == ["z"]
    assert [r.source for r in tables.read(spark, path).collect()] == ["s"]
    assert tables.publish(spark, path, f"{tmp_path}/published", "seen") == 1

    def broken(_):
        return spark.range(3).select(F.raise_error(F.lit("cut off")).cast("string").alias("post_id"))

    new = spark.createDataFrame([("c", "Might Blast"), ("a", "x")], "post_id string, blade string")
    new = new.withColumn("date", F.to_date(F.lit("2024-02-02")))
    fix = lambda df: ingest.normalised(df, ["blade"], {"Might Blast": "Emperor Might"}) if "blade" in df.columns else df
    for _ in range(2):  # a source replaces its own rows, so a second run gives the same
        out = tables.refresh(spark, {"z": lambda s: new, "bad": broken}, path, normalise=fix).collect()
        assert {tuple(r)[:3] for r in out} == {("z", "fixes", 1), ("z", "added", 1), ("z", "exists", 1), ("bad", "failed", 0)}
        assert "cut off" in [r.message for r in out if r.status == "failed"][0]
    again = tables.refresh(spark, {"z": lambda s: new}, path, incremental=True)
    assert {tuple(r) for r in again.collect()} == {("z", "exists", 2, None)}
    # what breaks, or has nothing to add, leaves the rows that were there
    kept = sorted(map(tuple, tables.read(spark, path).collect()), key=repr)
    out = tables.refresh(spark, {"z": broken, "s": lambda s: new.limit(0)}, path)
    assert [(r.source, r.status) for r in out.collect()] == [("z", "failed"), ("s", "failed")]
    assert sorted(map(tuple, tables.read(spark, path).collect()), key=repr) == kept
    assert spark.table("seen").count() == 1 and tables.read(spark, f"{tmp_path}/published").count() == 1
    tables.reset(spark, path, tables.read(spark, path).schema)
    assert tables.read(spark, path).isEmpty()


def events(spark, *rows):
    out = spark.createDataFrame([(k, s, p) for k, s, p in rows], "post_id string, source string, place int")
    return out.withColumn("date", F.to_date(F.lit("2024-01-01")))


def test_writers_at_once(spark, tmp_path):
    path, other = f"{tmp_path}/t", spark.newSession()
    both = [[("a", "s", 1), ("shared", "s", 1)], [("b", "r", 1), ("shared", "r", 1)]]
    with ThreadPoolExecutor(2) as pool:
        work = [pool.submit(tables.append_events, events(x, *rows), path) for x, rows in zip((spark, other), both)]
        added = [{r.status: r.n for r in w.result().collect()} for w in work]
    # whoever comes second keeps what is its own, and leaves the key that both had to the first
    assert sorted(a["added"] for a in added) == [1, 2]
    assert sorted(r.post_id for r in tables.read(spark, path).collect()) == ["a", "b", "shared"]
    assert commits.versions(spark, path) == [1, 2]


def test_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    path, real = f"{tmp_path}/t", commits.commit
    tables.append_events(events(spark, ("a", "s", 1)), path)
    rivals = [events(spark, ("b", "r", 1)), events(spark, ("c", "r", 1))]

    def late(*args):
        if rivals:  # another writer is first: once without one of our keys, once with
            rows = rivals.pop(0)
            monkeypatch.setattr(commits, "commit", real)
            tables.append_events(rows, path)
            monkeypatch.setattr(commits, "commit", late)
        return real(*args)

    monkeypatch.setattr(commits, "commit", late)
    counts = tables.append_events(events(spark, ("c", "s", 1), ("d", "s", 1)), path).collect()
    assert {r.status: r.n for r in counts} == {"added": 1, "exists": 1}
    found = sorted((r.post_id, r.source) for r in tables.read(spark, path).collect())
    assert found == [("a", "s"), ("b", "r"), ("c", "r"), ("d", "s")]


def test_readers_see_one_version(spark, tmp_path):
    path, target, other = f"{tmp_path}/t", f"{tmp_path}/out", spark.newSession()
    tables.append_events(events(spark, ("a", "s", 1), ("b", "r", 2)), path)
    tables.publish(spark, path, target)
    reader = tables.read(other, target)  # opened before the next copy
    tables.delete_sources(spark, path, ["s"])
    tables.append_events(events(spark, ("c", "s", 1)), path)
    assert {r.post_id for r in tables.read(other, target).collect()} == {"a", "b"}
    tables.publish(spark, path, target)
    assert {r.post_id for r in reader.collect()} == {"a", "b"}
    assert {r.post_id for r in tables.read(other, target).collect()} == {"b", "c"}
    for _ in range(3):
        tables.publish(spark, path, target)
    assert commits.sweep(spark, target, keep=1, grace=0) > 0
    assert len(list((tmp_path / "out" / "data").iterdir())) == 1 and len(commits.versions(spark, target)) == 1
    assert {r.post_id for r in tables.read(other, target).collect()} == {"b", "c"}


def test_compact_and_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    for k in "abc":
        tables.append_events(events(spark, (k, "1", 1)), path)
    tables.append_events(events(spark, ("d", None, 1)).withColumn("player", F.lit("p")), path)
    assert tables.compact(spark, path) == 4 and len(commits.snapshot(spark, path).batches) == 2
    rows = sorted(map(tuple, tables.read(spark, path).select("post_id", "source", "player").collect()), key=repr)
    assert rows == [("a", "1", None), ("b", "1", None), ("c", "1", None), ("d", None, "p")]
    assert {r.status for r in tables.append_events(events(spark, ("a", "x", 1)), path).collect()} == {"exists"}
    with pytest.raises(ValueError, match="place is int"):
        tables.append_events(events(spark, ("e", "1", 1)).withColumn("place", F.lit("1st")), path)


def test_filters_name_the_batches_to_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i in range(4):
        tables.append_events(events(spark, *[(f"k{i}-{j}", "s", 1) for j in range(50)]), path)
    batches = commits.snapshot(spark, path).batches
    keys = commits.Keys(events(spark, ("k2-7", "s", 1)), "post_id")
    assert batches[2] in keys.may_be_in(spark, path, batches) and len(keys.may_be_in(spark, path, batches)) < 4
    assert len(commits.Keys(events(spark, ("k2-7", "s", 1)), "post_id", most=0).may_be_in(spark, path, batches)) == 4


def test_batch_of_a_stream_is_added_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = tables.append_events(events(spark, ("a", "s", 1)), path, stream=("q", 0))
    again = tables.append_events(events(spark, ("a", "s", 1), ("new", "s", 1)), path, stream=("q", 0))
    assert [tuple(r) for r in first.collect()] == [("added", 1)] and [tuple(r) for r in again.collect()] == [("repeated", 2)]
    tables.append_events(events(spark, ("b", "s", 1)), path, stream=("other", 0))
    tables.append_events(events(spark, ("c", "s", 1)), path, stream=("q", 1))
    assert sorted(r.post_id for r in tables.read(spark, path).collect()) == ["a", "b", "c"]


def test_once_in_a_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1, "p", 1), ("a", 2, "q", 1), ("a", 1, "late", 2), ("b", None, "r", 3), ("c", 1, "s", 4), ("c", 1, "s", 4)],
        "post_id string, place int, player string, record int",
    ).withColumns({"date": F.to_date(F.lit("2024-01-01")), "source": F.lit("s")})
    counts = {r.status: r.n for r in tables.append_events(rows, f"{tmp_path}/t").collect()}
    assert counts == {"added": 2, "no_placements": 1}
    found = sorted((r.post_id, r.place, r.player) for r in tables.read(spark, f"{tmp_path}/t").collect())
    assert found == [("a", 1, "p"), ("a", 2, "q"), ("c", 1, "s")]


def test_broken_dump_is_an_error(spark, tmp_path):
    (tmp_path / "dump.json").write_text('{"1": "<p>')
    with pytest.raises(Exception):  # noqa: B017, PT011
        reports.page_dump(spark, f"{tmp_path}/dump.json").collect()


def test_match_tables(spark):
    html = """<table><tr><th>Adaさん使用ベイ</th><th>Brook</th></tr><tr><td>ペガサスブラスト<br>3-60 F</td><td>Beta_9-60</td></tr>
    <tr><td>ペガサスブラスト 3-60F</td><td>none</td></tr><tr><td>alone 1-60A</td></tr></table>
    <table><tr><td>勝ち方</td><td>ポイント</td></tr></table><table><tr><td>Cleo</td><td>Ada</td></tr><tr><td>Gamma 5-80B</td><td>Delta 4-60HN</td></tr></table>"""
    cells = reports.table_cells(spark.createDataFrame([("u", html)], "page string, html string"))
    found = ingest.match_placements(cells, {"ペガサスブラスト": "Pegasus Blast"})
    assert sorted((r.place, r.player, r.n, r.lock_chip, r.blade, r.ratchet, r.bit) for r in found.collect()) == [
        (1, "Ada", 1, "Pegasus", "Blast", "3-60", "Flat"),
        (1, "Ada", 2, None, "Delta", "4-60", "High Needle"),
        (2, "Brook", 1, None, "Beta", "9-60", ""),
        (3, "Cleo", 1, None, "Gamma", "5-80", "Ball"),
    ]


def test_stream_ingest_adds_once(spark, tmp_path):
    folder, path = tmp_path / "in", f"{tmp_path}/table"
    folder.mkdir()
    for name in ("1", "0"):  # two dumps with one post in the same batch
        (folder / f"{name}.json").write_text(json.dumps({"1": POST.format(n=1)}))
    ingest_stream(spark, str(folder), path, f"{tmp_path}/c").awaitTermination()
    (folder / "2.json").write_text(json.dumps({"1": POST.format(n=1), "2": POST.format(n=2)}))
    ingest_stream(spark, str(folder), path, f"{tmp_path}/c").awaitTermination()
    version = commits.snapshot(spark, path).version
    for f in (tmp_path / "c" / "commits").glob("*1*"):  # as if the stream had been stopped before it noted its last batch
        f.unlink()
    ingest_stream(spark, str(folder), path, f"{tmp_path}/c").awaitTermination()
    assert commits.snapshot(spark, path).version == version
    found = sorted((r.post_id, r.place, r.player) for r in tables.read(spark, path).collect())
    assert found == [("1", 1, "Ann"), ("1", 2, "Bob"), ("2", 1, "Ann"), ("2", 2, "Bob")]
    assert {r.region for r in tables.read(spark, path).collect()} == {"NA"}


def test_weekly_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = stream_weekly(stream).writeStream.outputMode("complete").format("memory").queryName("weekly")
    query.trigger(availableNow=True).start().awaitTermination()
    batch = sorted(map(tuple, stream_weekly(events).collect()))
    assert sorted(map(tuple, spark.table("weekly").collect())) == batch
