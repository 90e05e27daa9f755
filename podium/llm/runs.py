"""Exact removal of long repeated windows (of bytes or of words), as runs of window starts refined round by round.

A window of `window` symbols is repeated if its content also starts anywhere else. A window belongs to a gram in it: the
leftmost of its `q`-grams with the smallest hash, so equal windows belong to equal grams at equal distances. The windows of
one gram are a run of starts, and a node is such a run or a piece of it.

* All nodes whose gram may occur again are grouped by their whole content. Nodes with the same content settle each other,
  and one of them stands for all from then on.
* A bucket (nodes with the same core, which is what all their windows share) goes on only if it holds two different nodes
  or more, one of them not settled. Its nodes are cut at fixed distances from their gram into runs of at most `widths[k]`
  starts. The core grows, and the new bucket identifier is made of the last one and of the names of what the core gains
  before and after it, so no round reads again what an earlier one has settled.
* The last round has runs of one start, whose core is the window.

Members are counted by partial aggregates and looked up by joins on identifiers, so no bucket meets in one task. What is
broadcast is counted first, and shuffled beyond `broadcast_nodes`. Each intermediate table is dropped once the next stands.
Content is compared by 128-bit names (what they are made of is up to the shape), and a document is named by 64 bits of its id and text beside its id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import rolling as R
from podium.llm import sketch
from podium.llm.common import Tables, ascii_words, small, small_batches, whole_text

_U = np.uint64
_HIGH, _LOW = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)
_NODE = "row long, code long, c long, h1 long, h2 long, w int"


@dataclass(frozen=True)
class Shape:
    """What a symbol is ("byte" or "word"), the window and the gram in symbols, and the longest run in each round."""

    unit: str
    window: int
    q: int
    widths: tuple[int, ...]

    @property
    def room(self) -> int:
        """The greatest distance of a window's start from its gram."""
        return self.window - self.q

    def text(self, offsets: np.ndarray, data: np.ndarray) -> Text:
        """What names the stretches of some documents."""
        return Text(self, offsets, data)

    def refine(self, ids: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Bucket identifiers refined by the names of what stands before and after."""
        before, after = R.mix(before ^ _U(0x2545F4914F6CDD1D)), R.mix(after * _U(0xD6E8FEB86659FD93))
        return R.mix(ids * _U(0x9FB21C651E98DF25) + before + after)


class Text:
    """The symbols of some documents; `name` gives 64 bits of any stretch, in two independent ways."""

    def __init__(self, shape: Shape, offsets: np.ndarray, data: np.ndarray):
        if shape.unit == "word":
            start, end = R.word_bounds(data, offsets[:-1])
            values, self.offsets = R.word_hashes(data, start, end), np.searchsorted(start, offsets)
        else:
            values, self.offsets = R.byte_values(data), offsets
        self.n = len(values)
        self.sums = (R.prefix_sums(values, 1), R.prefix_sums(values, 2))

    def name(self, start: np.ndarray, end: np.ndarray, half: int = 0) -> np.ndarray:
        size = (end - start).astype(_U) * _U(0x9E3779B97F4A7C15)
        return R.mix(R.range_hash(self.sums[half], start, end, 1 + half) + (size ^ _U(half)))

    def before(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of what stands before a core that starts at `end`."""
        return self.name(start, end)

    def after(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of what stands after a core that ends at `start`."""
        return self.name(start, end)


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A node in one integer: its gram's place, its distances lo to hi from it, and 1 for one place, 2 for more."""
    return (at << 30) | (lo << 16) | (hi << 2) | weight


def unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return code >> 30, (code >> 16) & 0x3FFF, (code >> 2) & 0x3FFF, code & 3


def _node_batch(row, code, c, h1, h2, w) -> pa.RecordBatch:
    signed = [pa.array(x.view(np.int64)) for x in (c, h1, h2)]
    return pa.RecordBatch.from_arrays(
        [pa.array(row), pa.array(code), *signed, pa.array(w.astype(np.int32))], names=["row", "code", "c", "h1", "h2", "w"]
    )


def _named(text: Text, shape: Shape, p, lo, hi, c, low, top) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of all bytes of nodes, whose core (of starts low to top) has the identifier c."""
    before = text.before(p - hi, p - low)
    after = text.after(p - top + shape.window, p - lo + shape.window)
    return shape.refine(c, before, after), text.name(p - hi, p - lo + shape.window, 1)


def _owned(text: Text, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of windows inside a document that belong to one gram: the gram's place, first and last start."""
    n = text.n - shape.window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = R.mix(R.rolling(text.sums[0], shape.q, 1))
    order = (grams & _HIGH) | np.arange(len(grams), dtype=_U)
    owner = (R.sliding_min(order, shape.room + 1) & _LOW).astype(np.int64)[:n]
    inside = np.ones(n + 1, dtype=bool)
    for a, b in zip(text.offsets[:-1].tolist(), text.offsets[1:].tolist(), strict=True):
        inside[max(a, b - shape.window + 1) : b] = False
    inside = inside[:n]
    edge = np.ones(n, dtype=bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n) - 1
    start, end = start[inside[start]], end[inside[start]]
    return owner[start], start, end


def _texts(shape: Shape, column: pa.Array):
    """The texts of an Arrow column of binary in runs of about 300 kB, with the row number of the first."""
    for first, offsets, data in R.batches(column, 300_000):
        yield first, shape.text(offsets, data)


def gram_sketch(rows: DataFrame, shape: Shape, bits: int) -> sketch.Bits:
    """Grams that own windows in two places or more, as far as a count-min sketch over all windows can tell."""

    def grams(batch):
        for _, text in _texts(shape, batch.column(1)):
            p, _, _ = _owned(text, shape)
            yield text.name(p, p + shape.q), 1

    return sketch.build(rows, grams, bits=bits, at_least=2)


def initial_nodes(rows: DataFrame, shape: Shape, likely=None) -> DataFrame:
    """The run of windows of every gram, c being the gram's name; only grams in the (broadcast) sketch where one is given."""

    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, text in _texts(shape, batch.column(1)):
                p, start, end = _owned(text, shape)
                c = text.name(p, p + shape.q)
                if likely is not None:
                    keep = likely.value.test(c)
                    p, start, end, c = p[keep], start[keep], end[keep], c[keep]
                if not len(p):
                    continue
                lo, hi = p - end, p - start
                h1, h2 = _named(text, shape, p, lo, hi, c, np.zeros_like(p), np.full_like(p, shape.room))
                doc = np.searchsorted(text.offsets, start, side="right") - 1
                one = np.ones_like(p)
                yield _node_batch(keys[first + doc], packed(p - text.offsets[doc], lo, hi, one), c, h1, h2, one)

    return rows.mapInArrow(scan, _NODE)


def refined_nodes(rows: DataFrame, shape: Shape, width: int, last: int) -> DataFrame:
    """The nodes of documents (row, data, nodes) cut into runs of `width` starts, with their refined identifiers.

    `last` is the width of the round before.
    """

    def cut(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            nodes = batch.column(2)
            for first, text in _texts(shape, batch.column(1)):
                offsets = text.offsets
                own = nodes.slice(first, len(offsets) - 1)
                counts = pa.compute.list_value_length(own).to_numpy(zero_copy_only=False)
                flat = own.flatten()
                doc = np.repeat(np.arange(len(offsets) - 1), counts)
                p, lo, hi, w = unpacked(flat.field("code").to_numpy(zero_copy_only=False))
                c = flat.field("c").to_numpy(zero_copy_only=False).view(_U)
                pieces = hi // width - lo // width + 1
                of = np.repeat(np.arange(len(p)), pieces)
                step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (lo // width)[of]
                doc, w, c, lo, hi = doc[of], w[of], c[of], lo[of], hi[of]
                p = p[of] + offsets[doc]
                low, top = step * width, np.minimum(step * width + width - 1, shape.room)
                lo, hi = np.maximum(lo, low), np.minimum(hi, top)
                # the core of the bucket in the round before, and what the refined core has beyond it
                was_low = lo // last * last
                was_top = np.minimum(was_low + last - 1, shape.room)
                before = text.before(p - low, p - was_low)
                c = shape.refine(c, before, text.after(p - was_top + shape.window, p - top + shape.window))
                h1, h2 = _named(text, shape, p, lo, hi, c, low, top)
                yield _node_batch(keys[first + doc], packed(p - offsets[doc], lo, hi, w), c, h1, h2, w)

    return rows.mapInArrow(cut, _NODE)


def classes_of(nodes: DataFrame) -> DataFrame:
    """Nodes with the same bytes: how many there are (two stand for more), and one of them."""
    return nodes.groupBy("h1", "h2").agg(
        F.sum("w").cast("long").alias("total"), F.min(F.struct("row", "code", "c")).alias("one")
    )


def settled_of(nodes: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """(row, code) of the nodes that are repeated as a whole."""
    many = classes.filter("total > 1").select("h1", "h2")
    return nodes.filter("w = 1").join(small(many, many.count(), limit), ["h1", "h2"], "left_semi").select("row", "code")


def open_of(classes: DataFrame, limit: int) -> DataFrame:
    """(row, code, c) of one node of each class, in buckets of two classes or more with one that is not settled."""
    flat = classes.select("one.row", "one.code", "one.c", F.least("total", F.lit(2)).alias("w"))
    buckets = flat.groupBy("c").agg(F.count("*").alias("n"), F.min("w").alias("least")).filter("n > 1 AND least = 1")
    kept = flat.join(small(buckets.select("c"), buckets.count(), limit), "c", "left_semi")
    return kept.select("row", (F.col("code").bitwiseAND(~3)).bitwiseOR(F.col("w")).alias("code"), "c")


def keyed(docs: DataFrame) -> DataFrame:
    """row, the key of a document (its id and text), and data, its bytes."""
    text = whole_text()
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("row"), text.cast("binary").alias("data"))


def _texts_of(rows: DataFrame, found: DataFrame, broadcast_ids: int) -> DataFrame:
    """row, data and the other column of `found` (one row a document); other texts are left out before the shuffle, where
    the documents found are few enough to be broadcast."""
    if found.count() <= broadcast_ids:
        rows = rows.join(F.broadcast(found.select("row")), "row", "left_semi")
    return rows.join(found, "row").select("row", "data", *found.columns[1:])


def repeated_spans(
    docs: DataFrame,
    shape: Shape,
    *,
    sketched: bool,
    per_item: int = 60,
    broadcast_nodes: int = 20_000,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """(row, spans): the runs of starts of repeated windows of each document, as packed nodes.

    What starts the rounds are grams that occur again: by a count-min sketch (`sketched`), of one cell a `per_item` / 6
    bytes of text up to a fixed size, or by exact counts. The sketch only saves work; a full one lets everything pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables, rows, limit = Tables(spark, "runs"), keyed(docs), broadcast_nodes
    if sketched:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        likely = gram_sketch(rows, shape, sketch.bits_for(size // per_item))
        nodes = tables.write(initial_nodes(rows, shape, spark.sparkContext.broadcast(likely)), "initial")
        held = ["initial"]
    else:
        everything = tables.write(initial_nodes(rows, shape), "initial")
        # only what starts with the same gram as another run is kept
        buckets = everything.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c")
        buckets = tables.write(buckets, "buckets")
        nodes = everything.join(small(buckets, buckets.count(), limit), "c", "left_semi")
        held = ["initial", "buckets"]
    last, settled = shape.room + 1, []
    for k, width in enumerate((*shape.widths, 0)):
        classes = tables.write(classes_of(nodes), f"classes{k}")
        settled.append(tables.write(settled_of(nodes, classes, limit), f"settled{k}"))
        if not width:
            tables.drop(*held, f"classes{k}")
            break
        left = tables.write(open_of(classes, limit), f"open{k}")
        tables.drop(*held, f"classes{k}")
        by_row = left.groupBy("row").agg(F.collect_list(F.struct("code", "c")).alias("nodes"))
        by_row = tables.write(by_row, f"rows{k}")
        nodes = tables.write(refined_nodes(_texts_of(rows, by_row, broadcast_ids), shape, width, last), f"nodes{k}")
        tables.drop(f"open{k}", f"rows{k}")
        last, held = width, [f"nodes{k}"]
    found = settled[0]
    for more in settled[1:]:
        found = found.union(more)
    spans = tables.write(found.groupBy("row").agg(F.collect_set("code").alias("spans")), "spans")
    tables.drop(*[x for x in tables.paths if x.startswith("settled")])
    return spans


def without_spans(rows: DataFrame, shape: Shape) -> DataFrame:
    """(row, n_removed, n_spans, kept_sha256, kept) of documents (row, data, spans); words are joined by one space."""
    schema = pa.schema(
        [("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    )

    def cut(batches):
        for batch in batches:
            out = []
            for key, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = raw.as_py()
                symbols = raw.split() if shape.unit == "word" else raw
                p, lo, hi, _ = unpacked(spans.values.to_numpy(zero_copy_only=False))
                cover = np.zeros(len(symbols) + 1, dtype=np.int32)
                np.add.at(cover, p - hi, 1)
                np.add.at(cover, p - lo + shape.window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                if shape.unit == "word":
                    kept = b" ".join(w for w, x in zip(symbols, gone.tolist(), strict=True) if not x)
                else:
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((key, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(cut, "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _cut(docs: DataFrame, shape: Shape, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """without_spans of the documents that have a repeated window, once for each id and text."""
    spans = repeated_spans(docs, shape, broadcast_ids=broadcast_ids, **options)
    return without_spans(_texts_of(keyed(docs), spans, broadcast_ids), shape).dropDuplicates(["row"])


def dedup(docs: DataFrame, shape: Shape, **options) -> DataFrame:
    """Per document: doc_id, n (symbols), n_removed, n_spans, kept_sha256; one row for each input row."""
    text = whole_text()
    if shape.unit == "word":
        words = ascii_words(text)
        n, plain = F.size(words), F.array_join(words, " ")
    else:
        n, plain = F.octet_length(text), text.cast("binary")
    base = docs.select(
        "doc_id",
        F.xxhash64(F.col("doc_id"), text).alias("row"),
        n.cast("long").alias("n"),
        F.sha2(plain, 256).alias("_plain"),
    )
    return base.join(_cut(docs, shape, **options).drop("kept"), "row", "left").select(
        "doc_id",
        "n",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_plain").alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, shape: Shape, **options) -> DataFrame:
    """doc_id and text: what is left of each document (bytes that are no longer UTF-8 are replaced)."""
    cut = _cut(docs, shape, **options).select("row", "kept")
    base = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), whole_text()).alias("row"))
    return base.join(cut, "row", "left").select(
        "doc_id", F.coalesce(F.expr("decode(kept, 'UTF-8')"), F.col("text")).alias("text")
    )
