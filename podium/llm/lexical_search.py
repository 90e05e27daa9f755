"""Ranked lexical search: the best documents for each item by summed term impacts, best interval first.

Documents are indexed where they are read: a segment is a run of documents with some million terms at most, one row of the index
table, with a posting list (documents ascending, occurrences) of every term. A search takes items in blocks; each segment is
searched for all items of a block in the task that holds it. The impacts of a posting list get a sparse table of range
maxima. Of an item, an interval of documents can score no more than the sum of its terms' largest impacts in it, which the
tables answer in constant time; intervals wait in a heap by that bound. The first one is split at the document of its largest
impact, which is scored exactly, and both sides come back with bounds of their own; one with few postings left is scored to the
end instead. A search stops when no interval can beat the item's worst kept document, of this segment or of those the task
searched before. So results are exact; each task returns `k` documents an item at most, and a window ranks them.

Documents are not shuffled. Counts of documents that hold a term go through the driver for the terms of a block only.

Edge cases: null texts and texts without terms hold nothing and are not counted; items without terms, or with terms that no
document holds, have no rows; rows that share a doc_id are documents of their own; of equal scores the smaller doc_id comes
first and null ids last; items are searched row by row, so repeated and null item_ids are kept apart; a text of any length is
indexed whole, in a segment of its own where it is longer than one; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from podium.llm.common import few_rows_a_batch, read, shared_dir, whole_text, written

#: Letters, digits and bytes of other characters make terms; capital letters count as small ones.
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
#: Bits for a posting's place beside its impact, which is below 2**20.
PLACE = 40
#: Postings that an interval may have left to be scored to the end.
LEAF = 512


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")


# -- the index ----------------------------------------------------------------------------------------------------


def build_index(docs: DataFrame, *, segment_terms: int = 1_000_000, segment_docs: int = 16_384) -> DataFrame:
    """One row a segment: doc_ids, their numbers of terms, the terms, and the posting lists one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                found = [t for t in terms_of(text.as_py()) if t]
                if not found:
                    continue
                if held and (size + len(found) > segment_terms or len(held) == segment_docs):
                    yield _segment(held, schema)
                    held, size = [], 0
                held.append((name.as_py(), found))
                size += len(found)
        if held:
            yield _segment(held, schema)

    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType
    columns = {"doc_ids": pa.list_(to_arrow_type(kind)), "lengths": pa.list_(pa.int64())}
    schema = pa.schema(columns | {c: pa.binary() for c in ("terms", "ends", "docs", "counts")})
    spark = docs.sparkSession
    with few_rows_a_batch(spark):
        binary = "terms binary, ends binary, docs binary, counts binary"
        index = rows.mapInArrow(run, f"doc_ids array<{kind.simpleString()}>, lengths array<bigint>, {binary}")
        return written(index, "lexical-index")


def _segment(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    held.sort(key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0))
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(t, len(number)) for _, found in held for t in found], np.int64)
    lengths = [len(found) for _, found in held]
    key, count = np.unique(flat * len(held) + np.repeat(np.arange(len(held)), lengths), return_counts=True)
    row = {
        "doc_ids": [name for name, _ in held],
        "lengths": lengths,
        "terms": b" ".join(number),
        "ends": np.cumsum(np.bincount(key // len(held))).astype("<u4").tobytes(),
        "docs": (key % len(held)).astype("<u4").tobytes(),
        "counts": count.astype("<u4").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema)


class Segment:
    """One row of the index, for the terms of a block of items: their posting lists, one after the other."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        self.doc_ids, self.lengths = row["doc_ids"], row["lengths"]
        ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        places = [(wanted[t], i) for i, t in enumerate(row["terms"].split(b" ")) if t in wanted]
        self.terms = np.array([t for t, _ in places], np.int64)
        at = np.array([i for _, i in places], np.int64)
        begin, self.df = np.where(at > 0, ends[at - 1], 0), np.diff(ends, prepend=0)[at]
        self.end = np.cumsum(self.df)
        self.begin = self.end - self.df
        take = np.repeat(begin - self.begin, self.df) + np.arange(self.df.sum())
        self.docs = np.frombuffer(row["docs"], "<u4").astype(np.int64)[take]
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)[take]

    def prepare(self, documents: int, all_terms: int) -> None:
        """The impacts, each list's sparse table of range maxima, and where each term's list is."""
        m = np.array([50 + 50 * n * documents // all_terms for n in self.lengths], np.int64)
        self.impact = 1_000_000_000 * self.counts // (1000 * self.counts + 20 * m[self.docs])
        # a level holds maxima of 1, 2, 4, ... postings; those that reach into the next list are never asked for
        self.levels = [self.impact << PLACE | np.arange(len(self.impact))]
        longest = int(self.df.max(initial=1))
        while 2 ** len(self.levels) <= longest:
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.maximum(last, np.append(last[half:], last[-half:])[: len(last)]))
        self.levels = np.stack(self.levels)
        self.log = np.array([0, *(n.bit_length() - 1 for n in range(1, longest + 1))])
        self.key = np.repeat(np.arange(len(self.terms)), self.df) * len(self.doc_ids) + self.docs
        self.slot = {int(t): i for i, t in enumerate(self.terms)}

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest impact, with its place, among the postings from a to b of one list each; 0 where there are none."""
        size = b - a
        level = self.log[size]
        left, right = self.levels[level, np.minimum(a, len(self.key) - 1)], self.levels[level, b - (1 << level)]
        return np.where(size > 0, np.maximum(left, right), 0)

    def search(self, terms: list[int], weights: list[int], best: "Best") -> None:
        """Offer `best` every document of the segment that may belong to an item's best ones."""
        own = [(self.slot[t], w) for t, w in zip(terms, weights) if t in self.slot]
        if not own:
            return
        slot, weight = (np.array(x, np.int64) for x in zip(*own))
        base = slot * len(self.doc_ids)
        heap: list[tuple] = []

        def push(spans: list[tuple[int, int]], a: np.ndarray, b: np.ndarray) -> None:
            top = self.maxima(a, b)
            gains = (top >> PLACE) * weight
            bounds, widest, left = gains.sum(1), gains.argmax(1), (b - a).sum(1)
            for i, (lo, hi) in enumerate(spans):
                if lo < hi and best.may_hold(bound := int(bounds[i]), self.doc_ids[lo]):
                    middle = self.docs[top[i, widest[i]] & ((1 << PLACE) - 1)]
                    heapq.heappush(heap, (-bound, lo, hi, int(middle), left[i] <= LEAF, a[i], b[i]))

        push([(0, len(self.doc_ids))], self.begin[slot][None], self.end[slot][None])
        while heap:
            bound, lo, hi, doc, leaf, a, b = heapq.heappop(heap)
            if not best.may_hold(-bound, self.doc_ids[lo]):
                continue
            if leaf:
                size = b - a
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                docs, where = np.unique(self.docs[at], return_inverse=True)
                scores = np.zeros(len(docs), np.int64)
                np.add.at(scores, where, self.impact[at] * np.repeat(weight, size))
                for i in np.flatnonzero(scores >= max(best.least, 1)):
                    best.offer(int(scores[i]), self.doc_ids[docs[i]])
                continue
            at = np.searchsorted(self.key, base + doc)
            has = self.key[np.minimum(at, len(self.key) - 1)] == base + doc
            score = int((self.impact[at[has]] * weight[has]).sum())
            best.offer(score, self.doc_ids[doc])
            push([(lo, doc), (doc + 1, hi)], np.stack([a, np.minimum(at + has, b)]), np.stack([at, b]))


class Best:
    """The k best documents of an item so far: larger scores first, of equal ones the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least, self.last = k, [], 0, None

    def may_hold(self, bound: int, doc_id) -> bool:
        """Whether a document with that score and that id or a larger one would be kept."""
        if bound <= 0 or len(self.rows) < self.k:
            return bound > 0
        return bound > self.least or bound == self.least and _order(doc_id) < self.last

    def offer(self, score: int, doc_id) -> None:
        if not self.may_hold(score, doc_id):
            return
        self.rows.append((-score, _order(doc_id), doc_id))
        if len(self.rows) >= self.k:
            self.rows.sort(key=lambda r: r[:2])
            del self.rows[self.k :]
            self.least, self.last = -self.rows[-1][0], self.rows[-1][1]


def _order(doc_id) -> tuple:
    return (doc_id is None, 0 if doc_id is None else doc_id)


# -- searches -----------------------------------------------------------------------------------------------------


def _counts(index: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """How many documents hold each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                size = np.diff(np.frombuffer(ends.as_py(), "<u4").astype(np.int64), prepend=0)
                found = [(wanted[t], i) for i, t in enumerate(terms.as_py().split(b" ")) if t in wanted]
                if found:
                    term, at = np.array(found).T
                    df[term] += size[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], names=["term", "df"])

    parts = index.select("terms", "ends").mapInArrow(run, "term bigint, df bigint")
    return {r["term"]: r["df"] for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _found(index: DataFrame, items: list[tuple[int, list[int], list[int]]], wanted, documents, all_terms, k) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task's segments."""
    kind = index.schema["doc_ids"].dataType.elementType
    own = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: Best(k) for number, _, _ in items}
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[i].as_py() for c in batch.schema.names}, wanted)
                if len(segment.terms):
                    segment.prepare(documents, all_terms)
                    for number, terms, weights in items:
                        segment.search(terms, weights, best[number])
        rows = [(number, r[2], -r[0]) for number, b in best.items() for r in sorted(b.rows, key=lambda r: r[:2])[:k]]
        columns = list(zip(*rows)) or [(), (), ()]
        types = (pa.int64(), own, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item bigint, doc_id {kind.simpleString()}, score bigint")


def search(index: DataFrame, items: DataFrame, *, k: int = 50, block_items: int = 1000) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `items` (item_id, text) its `k` documents of highest score above 0.

    `block_items` items at most are searched at once, so what a task is given is bounded whatever their number.
    """
    spark = index.sparkSession
    sums = index.agg(F.sum(F.size("lengths")).alias("n"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("l")).first()
    documents, all_terms = sums["n"] or 0, sums["l"] or 0
    kind = items.schema["item_id"].dataType.simpleString()
    out = f"{shared_dir(spark)}/lexical-found-{uuid.uuid4().hex}"
    schema = f"item_id {kind}, item bigint, doc_id {index.schema['doc_ids'].dataType.elementType.simpleString()}, score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    rows = enumerate(items.select("item_id", whole_text().alias("text")).toLocalIterator())
    for block in batched(rows, block_items):
        texts = {number: sorted({t for t in terms_of(row["text"]) if t}) for number, row in block}
        wanted = {t: i for i, t in enumerate(sorted({t for found in texts.values() for t in found}))}
        with few_rows_a_batch(spark, rows=2):
            df = _counts(index, wanted)
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [(number, [i for t in found if (i := wanted[t]) in weight]) for number, found in texts.items()]
        asked = [(number, terms, [weight[t] for t in terms]) for number, terms in asked if terms]
        names = spark.createDataFrame([(number, row["item_id"]) for number, row in block], f"item bigint, item_id {kind}")
        with few_rows_a_batch(spark, rows=2):
            found = _found(index, asked, wanted, documents, all_terms, k).join(F.broadcast(names), "item")
            found.select("item_id", "item", "doc_id", "score").write.mode("append").parquet(out)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
     l AS (SELECT rid, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
     s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM l),
     p AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) GROUP BY rid, t),
     q AS (SELECT DISTINCT iid, item_id, t FROM (SELECT iid, item_id, unnest(ts) AS t FROM (
             SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS ts FROM benchmark))),
     w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
           FROM p, s GROUP BY t, big_n),
     r AS (SELECT iid, item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))
             ::BIGINT AS score
           FROM q JOIN w USING (t) JOIN p USING (t) JOIN l USING (rid), s GROUP BY iid, item_id, doc_id, rid)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= 50
"""
