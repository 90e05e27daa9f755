"""Reports that keep arriving: new page dumps are parsed and appended once per key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from podium.operators import ingest, places
from podium.sources.commits import read_bytes
from podium.sources.reports import posts
from podium.sources.tables import append_events


def parsed(pages: DataFrame, *, least_year: int = 2023, game_names: tuple[str, ...] = ()) -> DataFrame:
    """(post_id, name, date, region, place, player, lock_chip, blade, assist, ratchet, bit, stage) of the posts in a batch of
    pages.

    A post that several pages of the batch hold is read once (of different texts the one that sorts first).
    """
    once = posts(pages).groupBy("post_id").agg(F.min("text").alias("text"))
    rows = ingest.with_event(ingest.lines(ingest.wanted_posts(once, game_names)))
    key = F.when(F.col("event") > 0, F.concat_ws("_", "post_id", "event")).otherwise(F.col("post_id")).alias("post_id")
    head = ingest.headers(rows, F.current_date(), least_year, game_names)
    region = places.region_or_default(
        places.region_of_event(*map(F.col, ("name", "city", "state", "country"))), F.lit(""), {}
    )
    head = head.select(key, "name", "date", region.alias("region"))
    found = ingest.placements(rows, named=True)
    found = found.select(key, "place", "player", "lock_chip", "blade", "assist", "ratchet", "bit", "stage")
    return found.join(head, "post_id")


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, *, source: str = "forum") -> StreamingQuery:
    """Append every new dump of `folder` (files of page-number-to-HTML JSON) to the table, then stop when all are read.

    The number of a batch is committed together with its rows, under the id that the checkpoint gives the stream: a batch that
    was stopped after its commit and runs again adds nothing, whatever its pages hold by then.
    """
    text = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    dump = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    pages = text.select(F.explode(dump).alias("page_no", "html"))

    def add(batch: DataFrame, number: int) -> None:
        name = json.loads(read_bytes(spark, f"{checkpoint}/metadata"))["id"]
        append_events(parsed(batch).withColumn("source", F.lit(source)), path, stream=(name, number))

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
