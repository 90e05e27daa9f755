"""What one task holds, and what is read again, must not grow faster than the input."""

from pyspark.sql import functions as F

from podium.operators import kept
from podium.sources import commits, orders_adapter, tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fact_is_built_in_parts_of_bounded_size(spark, sf_dir, monkeypatch):
    whole = sorted(map(repr, orders_adapter._fact(spark, sf_dir).collect()))
    monkeypatch.setattr(orders_adapter, "TASK_ROWS", 300)
    monkeypatch.setattr(orders_adapter, "HELD_ROWS", 10)  # neither customers nor parts are held whole
    fact = orders_adapter._fact(spark, sf_dir)
    assert sorted(map(repr, fact.collect())) == whole
    sizes = fact.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1200
    planned = orders_adapter._fact(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert planned.count("BroadcastHashJoin") <= 2  # nations and regions
    assert planned.count("WindowGroupLimit") == 1  # lines are dealt by order first; none sorts a whole split of the file


def test_commits_number_only_their_own_rows(spark, sf_dir, monkeypatch):
    offered = []
    monkeypatch.setattr(tables, "append_events", lambda rows, path, **_: offered.append(rows))
    monkeypatch.setattr(tables, "compact", lambda *_, **__: None)
    monkeypatch.setattr(tables, "delete_sources", lambda *_: None)
    kept.loaded(spark, sf_dir)
    assert len(offered) == 3
    for rows in offered:
        assert "Filter" not in _plan(rows).split("Window ")[0]  # all of them stand below the window


def test_status_of_events_needs_no_window(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01", 1), ("a", None, 2), ("b", "2024-01-01", None), ("c", "2024-01-01", 1), (None, "2024-01-01", 1)],
        "post_id string, date string, place int",
    )
    events = tables._events(rows, spark.createDataFrame([("c",), (None,)], "post_id string"), "post_id")
    for most in (10, 0):
        marked = tables._marked(rows, events, "post_id", broadcast_keys=most)
        assert "Window" not in _plan(marked)
        assert sorted(map(str, [tuple(r) for r in marked.select("post_id", "date", "status").collect()])) == sorted(
            map(str, [("a", "2024-01-01", "added"), ("a", None, "no_date"), ("b", "2024-01-01", "no_placements"), ("c", "2024-01-01", "exists"), (None, "2024-01-01", "added")])
        )


def test_a_key_is_hashed_once_for_its_filter(spark, monkeypatch):
    hashed = spark.sparkContext.accumulator(0)

    def counted(key):
        def one(k):
            hashed.add(1)
            return hash(k)
        return [F.udf(one, "long")(F.col(key))]

    monkeypatch.setattr(commits, "_hashes", counted)
    commits.key_filter(spark.range(2000).select((F.col("id") % 10).cast("string").alias("k")), "k")
    assert hashed.value <= 40
