"""Centroid clustering of vectors by a progressive search over Walsh-Hadamard coefficients.

Components become whole numbers, and vectors and centroids are transformed by the 64 x 64 Walsh-Hadamard matrix, whose rows are
in order of their sign changes. Its rows are orthogonal and of squared length 64, so the summed squared differences of all 64
coefficients are exactly 64 times the squared distance, and the sum of any of them can only be less. A vector's centroids are
therefore compared by coarse coefficients first: the one that is nearest by these is finished at once, every centroid whose
sum so far is strictly more than the best finished one goes, and the rest go on to 2, 4, ... and all 64 coefficients. Nothing is
estimated: those that finish have exact distances, and of equal ones the smaller number wins.

A round sends to the driver one sum of components for each centroid, whatever the number of vectors; the same is broadcast.

Edge cases: vectors that are null, have another length, or hold a null or a number that is not finite are left out; numbers so
large that whole-number arithmetic on 64 bits could overflow are worked out in unbounded numbers, and a distance over 2**63 - 1
or an inertia over it is null; repeated and null ids are vectors of their own (null ids never start a centroid while there are
others); fewer vectors than centroids give as many centroids as vectors; an empty table gives an empty result; columns besides
vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import read, written

SIZE = 64
#: Coefficients that are known after each step.
STEPS = (4, 8, 16, 32, 64)
#: Components below this leave all sums of squares of coefficients, and sums of components, within 64 bits.
SAFE, TOP = 1 << 23, (1 << 63) - 1


def hadamard() -> np.ndarray:
    """The Walsh-Hadamard matrix, rows by number of sign changes."""
    m = np.ones((1, 1), np.int64)
    while len(m) < SIZE:
        m = np.block([[m, m], [m, -m]])
    return m[np.argsort((np.diff(m, axis=1) != 0).sum(1), kind="stable")]


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of 64 finite components, as doubles."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") == SIZE)).filter(finite)


def whole(v: np.ndarray) -> np.ndarray:
    """floor(64 x); Python's unbounded numbers where 64 bits could overflow later."""
    x = np.floor(v * 64)
    if len(x) and np.abs(x).max() >= SAFE:
        return np.array([[int(e) if np.isfinite(e) else int(f) * 64 for e, f in zip(a, b)] for a, b in zip(x, v)], object)
    return x.astype(np.int64)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of whole numbers, by coefficients coarse to fine."""
    n, h = len(x), hadamard()
    c = np.array(centroids, object)
    if x.dtype != object and max((abs(int(e)) for e in c.ravel()), default=0) < SAFE:
        c = c.astype(np.int64)
    else:
        x, h = x.astype(object), h.astype(object)
    x, c = x @ h.T, c @ h.T
    total = np.zeros((n, len(c)), x.dtype)
    alive, best, known = np.ones((n, len(c)), bool), None, 0
    for upto in STEPS:
        row, number = np.nonzero(alive)
        gap = x[row, known:upto] - c[number, known:upto]
        total[row, number] += (gap * gap).sum(1)
        known = upto
        if best is None and upto < SIZE:  # finish the one that is nearest by the coarse coefficients
            first = total.argmin(1)
            gap = x[:, upto:] - c[first, upto:]
            best = total[np.arange(n), first] + (gap * gap).sum(1)
        alive &= total <= best[:, None]
    out = np.where(alive, total, total.max() + 1)
    number = out.argmin(1)
    return number, out[np.arange(n), number] // SIZE


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers), some thousand rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            yield some.column(0), whole(np.asarray(some.column(1).flatten()).reshape(-1, SIZE))


def seeds(vectors: DataFrame, k: int = 16, salt: str = "1:") -> list[list[int]]:
    """The first centroids: the vectors whose ids' salted hashes are smallest, in that order."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [[int(e) for e in whole(np.array([r["v"]]))[0]] for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of each one's vectors; one without any stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), SIZE), object)
        for _, x in _batches(batches):
            number, _ = nearest(x, centroids)
            count += np.bincount(number, minlength=len(centroids))
            for k in np.unique(number):
                total[k] += x[number == k].sum(0)
        for k in np.flatnonzero(count):
            yield pa.RecordBatch.from_pylist([{"k": int(k), "n": int(count[k]), "s": [str(e) for e in total[k]]}], schema)

    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.string()))])
    parts = vectors.mapInArrow(sums, "k int, n bigint, s array<string>").select("k", "n", F.posexplode("s").alias("i", "s"))
    rows = parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.expr("try_cast(s AS decimal(38,0))")).alias("s"),
                                       F.max(F.length("s")).alias("digits")).collect()
    if any(r["digits"] > 27 for r in rows):  # sums that decimals may not hold
        rows = parts.groupBy("k", "i").applyInArrow(_exact_sum, "k int, i int, n bigint, s string").collect()
    out = [list(c) for c in centroids]
    for r in rows:
        out[r["k"]][r["i"]] = int(r["s"]) // r["n"]
    return out


def _exact_sum(part: pa.Table) -> pa.Table:
    total, n = sum(map(int, part["s"].to_pylist())), sum(part["n"].to_pylist())
    return pa.table({"k": part["k"][:1], "i": part["i"][:1], "n": pa.array([n], pa.int64()), "s": [str(total)]})


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches):
            number, distance = nearest(x, centroids)
            exact = [int(d) if d <= TOP else None for d in distance]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(exact, pa.int64())], names=["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, salt: str = "1:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector after `rounds` rounds, and the final centroids."""
    vectors = kept(vectors)
    centroids = seeds(vectors, k, salt)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return assigned(vectors, centroids), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = written(rows, "centroids")
    sha = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(sha, "cluster int, centroid_sha256 string")
    # a row for each centroid at most: both are small whatever the number of vectors
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), exact).alias("s")).join(names, "cluster")
    total = sums.agg(F.when(F.count("*") == F.count("s"), F.sum("s")).alias("t"))
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    sums = sums.crossJoin(F.broadcast(total)).select(
        "cluster", long("s").alias("cluster_inertia"), long("t").alias("inertia"), "centroid_sha256"
    )
    return rows.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round_sql(r: int) -> str:
    """Assignment to the centroids c{r} and, from it, the next ones."""
    return f"""
a{r} AS MATERIALIZED (SELECT rid, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
        SELECT rid, v, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)])::BIGINT AS d FROM k, c{r})
      GROUP BY rid, v),
m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (
        SELECT cluster, i, (sum(v[i]) - ((sum(v[i]) % count(*) + count(*)) % count(*))) // count(*) AS m
        FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c::BIGINT[], c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster)),"""


SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY s) - 1)::INTEGER AS cluster, v AS c FROM (
  SELECT sha256('1:' || vec_id::VARCHAR) AS s, v FROM k ORDER BY s LIMIT 16)),
{"".join(map(_round_sql, range(4)))}
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT vec_id, a3.cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM i) AS inertia,
       sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN k USING (rid) JOIN i ON a3.cluster = i.cluster JOIN c3 ON a3.cluster = c3.cluster
"""
