"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class, and only classes are compared. Signatures are banded; in each bucket
the members are compared with two pivots, the member that shares most buckets with others (in a group of edited copies
that is the original) and one drawn anew for every band, so a bucket of n members gives at most 2n candidates. A
candidate's signatures are compared batch by batch, and it is pruned as soon as the posterior probability of reaching the
threshold (uniform prior, so a Beta posterior) falls under the chosen miss probability. Survivors are verified on their
full shingle sets. Components of the verified links then show which buckets still hold more than one component. Members
of different components are compared there in blocks: first signatures alone, by the same pruning, then the full sets of the
members that still have a partner. What two blocks return is only the links that join components, so no pair that shares a
bucket is left unsettled and none is written out twice.

With 28 bands of 5 rows a pair at similarity 0.85 shares no bucket with probability 1e-7 (1.5e-5 at 0.8).

A pivot or a bucket may hold a third of all rows: both sides of the joins that give a pivot's partners its signature and text
are dealt for that join alone, so adaptive execution can split a hot pivot, and the members of an open bucket are dealt to
blocks bounded in rows and in bytes of text.

Edge cases: null text and texts without words have no shingles and are linked with nothing; very long texts are read whole;
a text with fewer words than a shingle is one shingle; ids may be of any type that can be ordered; rows that share an id are
one document; a row with a null id links with nothing of its own; of equal texts the smallest id stays; an empty table gives
an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm import rolling as R
from podium.llm.common import small, small_batches, whole_text, written
from podium.llm.components import components

_U = np.uint64
BANDS, ROWS = 28, 5
SIZE = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**64, SIZE, dtype=_U) | _U(1)
_B = _rng.integers(0, 2**64, SIZE, dtype=_U)
BLOCK, BLOCK_BYTES = 2048, 16 << 20


def _sets(column, shingle: int):
    """(row, sorted distinct shingle hashes) for every text of an Arrow column of binary."""
    for first, offsets, data in R.batches(column, 500_000):
        data = R.lowered(data)
        start, end = R.word_bounds(data, offsets[:-1])
        words = R.word_hashes(data, start, end)
        cut = np.searchsorted(start, offsets)
        sums = R.prefix_sums(words, 1)
        at = np.arange(max(0, len(words) - shingle + 1))
        grams = R.mix(R.range_hash(sums, at, at + shingle, 1))
        for i in range(len(offsets) - 1):
            a, b = int(cut[i]), int(cut[i + 1])
            if b - a >= shingle:
                yield first + i, np.unique(grams[a : b - shingle + 1])
            elif b > a:
                whole = R.mix(R.range_hash(sums, np.array([a]), np.array([b]), 1) + _U(b - a))
                yield first + i, whole
            else:
                yield first + i, np.zeros(0, _U)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SIZE, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _A + _B
        out = np.minimum(out, (part.min(axis=0) >> _U(32)).astype(np.uint32))
    return out


def _row() -> Column:
    """The name of a row: its id and text."""
    return F.xxhash64(F.col("doc_id"), whole_text())


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, h1, h2, n_shingles, size, sig): the set's 128-bit name, its size, the text's bytes, MinHash values."""

    def sign(batches):
        for batch in batches:
            h1, h2, n, sig = [], [], [], []
            for _, s in _sets(batch.column(2), shingle):
                h1.append(int(s.sum(dtype=_U)))
                h2.append(int(R.mix(s ^ _U(0x94D049BB133111EB)).sum(dtype=_U)))
                n.append(len(s))
                sig.append(signature(s).tobytes())
            names = (pa.array(np.array(x, dtype=_U).view(np.int64)) for x in (h1, h2))
            size = pa.compute.binary_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *names, pa.array(n, pa.int64()), size, pa.array(sig, pa.binary())],
                names=["doc_id", "row", "h1", "h2", "n_shingles", "size", "sig"],
            )

    rows = docs.select("doc_id", _row().alias("row"), whole_text().cast("binary").alias("data"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, row long, h1 long, h2 long, n_shingles long, size long, sig binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, id) for every band of every class."""

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1)).astype(_U).reshape(-1, BANDS, ROWS)
            out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), sig.shape[:2]).copy()
            for r in range(ROWS):
                out = R.mix(out * _U(0xD1342543DE82EF95) + sig[:, :, r])
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(keys, "key long, id long")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIZE)


def least_matches(threshold: float, miss: float, batch: int = BANDS) -> list[tuple[int, int]]:
    """(n, fewest matches among n that keep a pair): the posterior of similarity >= threshold stays at `miss` or above."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= threshold
    out = []
    for n in range(batch, SIZE + 1, batch):
        for m in range(n + 1):
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[high].sum() / like.sum() >= miss:
                break
        out.append((n, m))
    return out


def _surviving(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers of pairs (rows of a and b) that no batch prunes."""
    left, same, at = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for n, least in limits:
        same = same + (a[left, at:n] == b[left, at:n]).sum(axis=1)
        keep = same >= least
        left, same, at = left[keep], same[keep], n
    return left


def _prune(pairs: DataFrame, classes: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) whose signatures pass every batch."""

    def keep(batches):
        for batch in batches:
            rows = _surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), limits)
            yield batch.select([0, 1]).take(pa.array(rows))

    sig = classes.select("id", "sig")
    joined = pairs.join(sig.toDF("b", "sb"), "b").join(sig.toDF("a", "sa"), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """(id, data) of the rows with the given names, once each; written, so that a join deals them anew and can split hot
    ids."""
    ids = written(ids.toDF("id").distinct(), "ids")
    texts = docs.select(_row().alias("id"), whole_text().cast("binary").alias("data"))
    texts = texts.join(small(ids, ids.count(), broadcast_ids), "id", "left_semi")
    return written(texts.dropDuplicates(["id"]), "texts")


def _verify(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, broadcast_ids: int) -> DataFrame:
    """The pairs whose full sets reach the similarity: 100 * intersection >= percent * union."""

    def exact(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for side in (0, 1):
                ids = batch.column(side).to_pylist()
                fresh = {x: i for i, x in enumerate(ids) if x not in held}
                rows = list(fresh.values())
                for k, s in _sets(batch.column(2 + side).take(pa.array(rows, pa.int64())), shingle):
                    held[ids[rows[k]]] = s
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = held[a], held[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if sum(map(len, held.values())) > 2_000_000:
                held.clear()

    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b"))), broadcast_ids)
    joined = pairs.join(texts.toDF("b", "db"), "b").join(texts.toDF("a", "da"), "a")
    return written(joined.select("a", "b", "da", "db").mapInArrow(exact, "a long, b long"), "links")


def shared_buckets(bands: DataFrame) -> DataFrame:
    """The band rows of buckets with two members or more."""
    many = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return bands.join(many, "key")


def _star_pairs(bands: DataFrame) -> DataFrame:
    """Each bucket's members paired with the most central one, and with one that differs from band to band."""
    central = bands.groupBy("id").agg(F.sum("n").alias("mates"))
    ranked = bands.join(central, "id")
    drawn = F.struct(F.xxhash64("id", "key").alias("d"), F.col("id").alias("p"))
    pivots = ranked.groupBy("key").agg(
        F.max(F.struct("mates", F.col("id").alias("p"))).alias("c"), F.min(drawn).alias("m")
    )
    both = bands.join(pivots.select("key", F.array_distinct(F.array("c.p", "m.p")).alias("ps")), "key")
    pairs = both.select("id", F.explode("ps").alias("p")).filter("id <> p")
    return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _open_buckets(bands: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, component, blocks) of buckets of three or more members that hold more than one component.

    Of buckets with the same members one is enough.
    """
    named = bands.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = (
        named.groupBy("key")
        .agg(
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.first("n").alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("s1"),
            F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2"),
        )
        .filter("n > 2 AND lo <> hi")
    )
    spread = spread.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"))
    rows = written(named.select("key", "id", "component").join(spread.select("key", "n"), "key"), "spread")
    sized = rows.join(classes.select("id", "size"), "id")
    blocks = F.ceil(F.greatest(F.max("n") / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int")
    return rows.join(sized.groupBy("key").agg(blocks.alias("blocks")), "key").select("key", "id", "component", "blocks")


def _dealt(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, x, y, id, component, own, sig): the members of open buckets, dealt to blocks by their id; every two blocks of a
    bucket meet once, as x and y."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("own", own).join(classes.select("id", "sig"), "id").withColumn("other", other)
    x, y = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    return dealt.select("key", x, y, "id", "component", "own", "sig")


def _partners(table, limits):
    """For each member of block x that has any: its place and the places of members of block y, in other components, that no
    batch of signatures prunes."""
    sig, own = _matrix(table["sig"].combine_chunks()), table["own"].to_numpy()
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    _, part = np.unique(table["component"].to_numpy(), return_inverse=True)
    right = np.flatnonzero(own == y)
    for i in np.flatnonzero(own == x).tolist():
        to = right[part[right] != part[i]]
        to = to if x != y else to[to > i]
        to = to[_surviving(np.broadcast_to(sig[i], (len(to), SIZE)), sig[to], limits)]
        if len(to):
            yield i, to[np.argsort(-(sig[to] == sig[i]).sum(axis=1), kind="stable")], part


def _partnered(dealt: DataFrame, limits) -> DataFrame:
    """The rows of two blocks that have a partner in them; only signatures are read."""

    def keep(table):
        held = np.zeros(table.num_rows, dtype=bool)
        for i, to, _ in _partners(table, limits):
            held[i] = True
            held[to] = True
        return table.filter(pa.array(held))

    return dealt.groupBy("key", "x", "y").applyInArrow(keep, dealt.schema)


def _open_links(partnered: DataFrame, texts: DataFrame, shingle: int, percent: int, limits) -> DataFrame:
    """Links (a, b) between different components of a bucket, verified on full sets; two blocks that meet return at most one
    fewer than their members."""
    dealt = partnered.join(texts, "id")

    def compare(table):
        ids, data = table["id"].to_pylist(), table["data"].combine_chunks()
        held: dict[int, np.ndarray] = {}

        def shingles(i):
            if i not in held:
                held[i] = next(_sets(data.slice(i, 1), shingle))[1]
            return held[i]

        a, b = [], []
        for i, to, part in _partners(table, limits):
            for j in to.tolist():
                if part[j] == part[i]:
                    continue
                p, q = shingles(i), shingles(j)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links (a, b); only components take part, so what is solved anew is small."""
    of = lambda c: F.coalesce(F.col(f"component_{c}"), F.col(c))
    for c in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}")), c, "left")
    roots = components(links.select(of("a").alias("a"), of("b").alias("b"))).withColumnsRenamed({"component": "root"})
    nodes = labels.select("id", "component").union(roots.select("id", F.col("id").alias("component"))).distinct()
    roots = roots.withColumnRenamed("id", "component")
    found = nodes.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return written(found.groupBy("id").agg(F.min("component").alias("component")), "labels")


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    threshold: float = 0.8,
    miss: float = 1e-6,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable) and kept (it is that id)."""
    small_batches(docs.sparkSession)
    percent = math.ceil(threshold * 100 - 1e-9)
    sigs = written(signatures(docs, shingle), "signatures")
    filled = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        filled.groupBy("h1", "h2").agg(
            F.min("row").alias("id"), F.min(F.struct("row", "sig", "size")).alias("one")
        ).select("h1", "h2", "id", "one.sig", "one.size"),
        "classes",
    )
    limits = least_matches(threshold, miss)
    bands = written(shared_buckets(band_rows(classes)), "bands")
    first = written(_prune(_star_pairs(bands), classes, limits), "pairs")
    links = _verify(first, docs, shingle, percent, broadcast_ids)
    labels = written(components(links), "labels")
    rows = written(_open_buckets(bands, labels, classes), "open")
    near = None if rows.isEmpty() else written(_partnered(_dealt(rows, classes), limits), "partnered")
    if near is not None and not near.isEmpty():
        texts = _texts(docs, near.select("id"), broadcast_ids)
        more = written(_open_links(near, texts, shingle, percent, limits), "links")
        if not more.isEmpty():
            labels = _joined(labels, more)
    # rows that share an id are one document, whatever sets they have
    member = classes.select("h1", "h2", F.col("id").alias("rep"))
    of_id = filled.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("n")).filter("n > 1")
    twice = filled.join(of_id.select("doc_id"), "doc_id").join(member, ["h1", "h2"])
    least = twice.groupBy("doc_id").agg(F.min("rep").alias("a"))
    shared = written(twice.join(least, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct(), "shared")
    final = labels if shared.isEmpty() else _joined(labels, shared)
    of_class = member.join(final, member["rep"] == final["id"], "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component")
    )
    # rows without a set or an id share no key with others, and take no part in the joins
    base, linked = sigs.select("doc_id", "h1", "h2", "n_shingles"), (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = base.filter(linked).join(of_class, ["h1", "h2"])
    smallest = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = out.join(smallest, "component").select("doc_id", "n_shingles", "component_id")
    out = out.union(base.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group, with all its columns (rows without an id all stay)."""
    found = near_duplicates(docs, shingle=shingle, threshold=threshold).filter(~F.col("kept"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, threshold=0.85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * m >= 85 * (na.n + nb.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
