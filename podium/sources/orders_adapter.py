"""Order tables read as tournaments: a week in a region is a tournament, an order a placement, its lines the combos."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.sources.commits import file_system
from podium.sources.tables import shared_dir

TABLES = ("region", "nation", "customer", "orders", "lineitem", "part")
#: Rows that one task sorts when the fact is built, and rows of a table that every task may hold. Files tell little of either:
#: repeated values take next to no place in them.
TASK_ROWS, HELD_ROWS = 300_000, 500_000


def _cut(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The `n` rows by key, in as many parts as keep each to about TASK_ROWS, however large the files' splits are."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *key)


def _joined(rows: DataFrame, n: int, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """The `n` rows with those of a table that is broadcast up to HELD_ROWS rows (counted), and shuffled beyond, a hash table a part."""
    if (m := other.count()) <= HELD_ROWS:
        return rows.join(F.broadcast(other), F.col(key) == F.col(other_key))
    return _cut(rows, max(n, m), key).join(_cut(other, max(n, m), other_key).hint("shuffle_hash"), F.col(key) == F.col(other_key))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, tournament_id, tournament_date, region, place, player_name, source) of every order."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders")
    n = orders.count()
    people = (
        read("customer")
        .join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "r_name")
    )
    week = F.date_trunc("week", "o_orderdate").cast("date")
    order = Window.partitionBy("tournament_date", "region").orderBy(F.desc("o_totalprice"), "o_orderkey")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return (
        _joined(orders, n, "o_custkey", people, "c_custkey")
        .select(
            "o_orderkey",
            "o_totalprice",
            F.concat("r_name", F.lit("_"), week.cast("string")).alias("tournament_id"),
            week.alias("tournament_date"),
            F.col("r_name").alias("region"),
            F.col("c_name").alias("player_name"),
            F.substring("o_orderpriority", 1, 1).alias("source"),
        )
        .withColumn("place", F.row_number().over(order))
        .drop("o_totalprice")
    )


def _version(spark: SparkSession, sf_dir: str) -> str:
    """A name for the present state of the tables: it changes with their files."""
    seen = []
    for table in TABLES:
        fs, there = file_system(spark, f"{sf_dir}/{table}.parquet")
        for f in fs.listStatus(there):
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


#: The columns of the fact; building it only to learn them would read every table's footer for each query.
FACT = """tournament_id string, tournament_date date, region string, place int, player_name string, blade string,
ratchet string, bit string, assist string, lock_chip string, stage string, series string, source string"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened fact, one row per combo used.

    It is stored in the shared folder, by region and sorted by date, so regions and days are pruned at the scan. When the files
    of the tables have changed it is written anew under another name; a writer finishes its copy aside and then renames it, so
    sessions that start together read whole copies, and copies of earlier files go after a day.
    """
    place = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    path = f"{shared_dir(spark)}/usage-{place}-{_version(spark, sf_dir)}"
    fs, done = file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        part = f"{path}.{uuid.uuid4().hex}"
        rows = _fact(spark, sf_dir).sortWithinPartitions("region", "tournament_date")
        rows.write.partitionBy("region").parquet(part)
        if not fs.rename(file_system(spark, part)[1], file_system(spark, path)[1]) or not fs.exists(done):
            fs.delete(file_system(spark, part)[1], True)  # another session was first
        _forget(spark, f"usage-{place}-", path)
    columns = [c.split()[0] for c in FACT.split(",")]
    return spark.read.schema(FACT).parquet(path).select(columns)


def _forget(spark: SparkSession, prefix: str, path: str, after: float = 86_400.0) -> None:
    """Delete copies of the fact over earlier files of the same tables that are older than `after` seconds."""
    fs, folder = file_system(spark, shared_dir(spark))
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith(prefix) and not path.endswith(name) and f.getModificationTime() < (time.time() - after) * 1000:
            fs.delete(f.getPath(), True)


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_extendedprice"
    )
    n = lines.count()
    # dealt before they are sorted: a limit of the window's groups would sort each split of the file whole
    lines = _cut(lines, n, "l_orderkey").withColumn("slot", F.row_number().over(slot)).filter("slot <= 3")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size")
    flag, size = F.col("l_returnflag"), F.col("p_size")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    placed = _cut(placements(spark, sf_dir), n, "o_orderkey").hint("shuffle_hash")
    lines = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        _joined(lines, n, "l_partkey", parts, "p_partkey")
        .select(
            "tournament_id",
            "tournament_date",
            "region",
            "place",
            "player_name",
            F.col("p_brand").alias("blade"),
            F.concat(
                F.when(F.col("l_partkey") % 2 == 1, "H").otherwise(""),
                size.cast("string"),
                F.when(size % 2 == 0, "-60").otherwise("-80"),
            ).alias("ratchet"),
            F.col("p_type").alias("bit"),
            F.when(size > 40, flag).alias("assist"),
            F.when(size > 25, F.col("l_linestatus")).alias("lock_chip"),
            F.when(F.col("l_linenumber") != 7, F.when(flag == "R", "first").when(flag == "A", "final").otherwise("both"))
            .alias("stage"),
            F.element_at(F.array(F.lit("BX"), F.lit("UX"), F.lit("CX")), brand % 3 + 1).alias("series"),
            "source",
        )
    )


#: The same mapping as a DuckDB common table expression.
USAGE_SQL = """
pl AS (SELECT o_orderkey, r_name || '_' || strftime(w, '%Y-%m-%d') AS tournament_id, w AS tournament_date,
              r_name AS region, c_name AS player_name, substr(o_orderpriority, 1, 1) AS source,
              row_number() OVER (PARTITION BY w, r_name ORDER BY o_totalprice DESC, o_orderkey) AS place
       FROM (SELECT *, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders) o
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS slot FROM lineitem),
u AS (SELECT tournament_id, tournament_date, region, CAST(place AS INTEGER) AS place, player_name, p_brand AS blade,
             CASE WHEN l_partkey % 2 = 1 THEN 'H' ELSE '' END || CAST(p_size AS VARCHAR)
               || CASE WHEN p_size % 2 = 0 THEN '-60' ELSE '-80' END AS ratchet,
             p_type AS bit, CASE WHEN p_size > 40 THEN l_returnflag END AS assist,
             CASE WHEN p_size > 25 THEN l_linestatus END AS lock_chip,
             CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN 'first'
                  WHEN l_returnflag = 'A' THEN 'final' ELSE 'both' END AS stage,
             CASE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 3
                  WHEN 0 THEN 'BX' WHEN 1 THEN 'UX' ELSE 'CX' END AS series, source
      FROM ln JOIN part ON l_partkey = p_partkey JOIN pl ON l_orderkey = o_orderkey WHERE slot <= 3)"""
