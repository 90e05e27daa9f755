"""Text quality by a factorisation machine.

Inputs are hashed words (weighted by the root of their share of the text), structure statistics (word and line lengths,
shares of capitals, digits, symbols and punctuation, repeated words and lines) and metadata (the stored length). Besides
a weight each input has a short vector; a pair of inputs interacts through the product of their vectors, and the sum over
all pairs costs linear time by the identity: half of (square of the sum minus sum of the squares), per dimension.

The machine is fitted by adaptive gradient steps on a bounded sample of whole labelled texts, chosen by a hash of the id:
about `fit_rows` of them, or as many as have about `fit_chars` characters together where that is fewer; texts of any length
are equally likely. Scoring covers every whole text.

Edge cases: null and empty texts have no words and are scored by what remains; very long texts are read whole; without both
classes among the labels every score is 0; repeated labels of one id count once (the lowest); null labels, and labels of a
null id, are left out, rows with a null id are scored; ties at the threshold are of label 1; a missing or null n_chars is
read as 0; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm import rolling as R
from podium.llm.common import held_out, small_batches, whole_text

_U = np.uint64
BITS = 15
RANK = 8
_CLASSES = ("upper", "digit", "symbol", "mark", "high", "space", "line")


def _byte_classes() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256), dtype=np.int64)
    out[0, 0x41:0x5B] = 1
    out[1, 0x30:0x3A] = 1
    out[2, [ord(c) for c in "#*$%&|<>{}[]=_~^\\/@+"]] = 1
    out[3, [ord(c) for c in ".,;:!?'\"()-"]] = 1
    out[4, 0xC0:] = 1
    out[5, [0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1
    out[6, 0x0A] = 1
    return out


_BYTES = _byte_classes()


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def inputs(offsets: np.ndarray, data: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cut, bucket, weight) of hashed words, sparse by text, and the dense statistics."""
    n_docs = len(offsets) - 1
    low = R.lowered(data)
    start, end = R.word_bounds(low, offsets[:-1])
    words = R.word_hashes(low, start, end) if len(start) else np.zeros(0, _U)
    cut = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(cut))
    n_words = np.diff(cut)
    key, count = np.unique((doc << BITS) | (words >> _U(64 - BITS)).astype(np.int64), return_counts=True)
    owner = key >> BITS
    weight = np.sqrt(count / np.maximum(n_words, 1)[owner])
    ends = np.searchsorted(owner, np.arange(n_docs + 1))
    some, size = np.maximum(n_words, 1), np.maximum(np.diff(offsets), 1)
    counts = [_per_doc(table[data], offsets) for table in _BYTES]
    again = np.zeros(len(words), dtype=np.int64)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    marked = np.isin(data[end - 1], np.frombuffer(b"!?", np.uint8)).astype(np.int64) if len(end) else np.zeros(0, np.int64)
    whole = np.zeros(len(words), dtype=np.int64)
    if len(words):
        caps = np.concatenate([[0], np.cumsum(_BYTES[0][data])])
        whole = (2 * (caps[end] - caps[start]) > end - start).astype(np.int64)
    distinct = np.bincount(owner, minlength=n_docs)
    letters = np.bincount(doc, weights=(end - start).astype(float), minlength=n_docs)
    dense = np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(np.maximum(n_chars, 0)),
            letters / some,
            distinct / some,
            distinct / np.sqrt(some),
            _per_doc(again, cut) / some,
            _per_doc(marked, cut) / some,
            _per_doc(whole, cut) / some,
            np.log1p(counts[6]),
            counts[6] / some,
            *[np.sqrt(c / size) for c in counts[:6]],
        ]
    )
    return ends, (key & ((1 << BITS) - 1)).astype(np.int32), weight.astype(np.float32), dense


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cut) - 1, values.shape[1]))
    some = np.diff(cut) > 0
    if some.any():
        out[some] = np.add.reduceat(values, cut[:-1][some], axis=0)
    return out


@dataclass
class Machine:
    constant: float
    w: np.ndarray  # words then statistics
    v: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.deviation, -6, 6)

    def margin(self, cut, bucket, weight, z) -> tuple[np.ndarray, np.ndarray]:
        """The decision values, and the per-dimension sums that the gradient needs too."""
        n = 1 << BITS
        x = weight[:, None]
        vx = self.v[bucket] * x
        total = _sums(vx, cut) + z @ self.v[n:]
        squares = _sums(vx * vx, cut) + (z * z) @ (self.v[n:] ** 2)
        linear = _sums(self.w[bucket, None] * x, cut)[:, 0] + z @ self.w[n:]
        return self.constant + linear + 0.5 * (total**2 - squares).sum(axis=1), total


def fit(rows: list[tuple], dense: np.ndarray, y: np.ndarray, *, epochs: int = 12, rate: float = 0.1, ridge: float = 1e-4) -> Machine:
    """Adaptive gradient steps on the log loss; `rows` are (buckets, weights) of each text."""
    rng = np.random.default_rng(3)
    n, m = 1 << BITS, dense.shape[1]
    machine = Machine(
        float(np.log(y.mean() / (1 - y.mean()))),
        np.zeros(n + m),
        rng.normal(0, 0.02, (n + m, RANK)),
        dense.mean(axis=0),
        dense.std(axis=0) + 1e-6,
    )
    z_all = machine.standard(dense)
    gw, gv = np.full(n + m, 1e-2), np.full((n + m, RANK), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 64):
            own = order[a : a + 64]
            bucket = np.concatenate([rows[i][0] for i in own])
            weight = np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            cut, z = np.concatenate([[0], np.cumsum(sizes)]), z_all[own]
            margin, total = machine.margin(cut, bucket, weight, z)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[own]) / len(own)
            doc = np.repeat(np.arange(len(own)), sizes)
            e = error[doc] * weight
            dw = np.concatenate([np.bincount(bucket, weights=e, minlength=n), error @ z])
            used = np.concatenate([np.unique(bucket), np.arange(n, n + m)])
            dv = np.zeros((n + m, RANK))
            part = e[:, None] * (total[doc] - machine.v[bucket] * weight[:, None])
            for f in range(RANK):
                dv[:n, f] = np.bincount(bucket, weights=part[:, f], minlength=n)
            dv[n:] = z.T @ (error[:, None] * total) - machine.v[n:] * ((z * z).T @ error)[:, None]
            dw[used] += ridge * machine.w[used]
            dv[used] += ridge * machine.v[used]
            gw[used] += dw[used] ** 2
            gv[used] += dv[used] ** 2
            machine.w[used] -= rate * dw[used] / np.sqrt(gw[used])
            machine.v[used] -= rate * dv[used] / np.sqrt(gv[used])
            machine.constant -= rate * float(error.sum())
    return machine


def _rows(docs: DataFrame, *others: Column) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select(*others, F.coalesce(chars, F.lit(0.0)).alias("_chars"), whole_text().cast("binary").alias("_data"))


def _inputs_of(batch: pa.RecordBatch):
    chars = batch.column(batch.schema.get_field_index("_chars")).to_numpy(zero_copy_only=False)
    for first, offsets, data in R.batches(batch.column(batch.schema.get_field_index("_data")), 300_000):
        yield inputs(offsets, data, chars[first : first + len(offsets) - 1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    keep: Column | None = None,
    fit_rows: int = 5_000,
    fit_chars: int = 60_000_000,
) -> Machine | None:
    """A machine from a bounded sample of the labelled documents that `keep` allows."""
    small_batches(docs.sparkSession)
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_y"))
    if keep is not None:
        own = own.filter(keep)
    some = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    sizes = docs.select("doc_id", F.length("text").alias("_n")).join(own, "doc_id")
    n, chars = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    share = min(1.0, fit_rows / max(1, n), fit_chars / max(1, chars))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    rows = docs.select(some).filter(draw).join(own.filter(draw), "doc_id")

    def prepare(batches):
        for batch in batches:
            label = batch.column(0)
            out, first = [], 0
            for cut, bucket, weight, dense in _inputs_of(batch):
                for i in range(len(cut) - 1):
                    own = slice(cut[i], cut[i + 1])
                    out.append((label[first + i].as_py(), bucket[own], weight[own], dense[i]))
                first += len(cut) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([x[1] for x in out], pa.list_(pa.int32())),
                    pa.array([x[2] for x in out], pa.list_(pa.float32())),
                    pa.array([x[3] for x in out], pa.list_(pa.float64())),
                ],
                names=["label", "bucket", "weight", "dense"],
            )

    schema = "label int, bucket array<int>, weight array<float>, dense array<double>"
    found = _rows(rows, F.col("_y")).mapInArrow(prepare, schema).toArrow()
    y = found["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    sparse = [(b.values.to_numpy(), w.values.to_numpy()) for b, w in zip(found["bucket"], found["weight"], strict=True)]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(sparse[i][0]), float(sparse[i][1].sum())))
    dense = np.array(found["dense"].to_pylist())
    return fit([sparse[i] for i in order], dense[order], y[order])


def score(docs: DataFrame, machine: Machine | None, *columns: str) -> DataFrame:
    """The named columns of `docs` and score, 0 to 1."""
    if machine is None:
        return docs.select(*columns, F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        machine = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for cut, bucket, weight, dense in _inputs_of(batch):
                margin, _ = machine.margin(cut, bucket, weight, machine.standard(dense))
                out.append(1 / (1 + np.exp(-np.clip(margin, -40, 40))))
            rest = batch.drop_columns(["_chars", "_data"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(np.concatenate(out))], names=[*rest.schema.names, "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return _rows(docs, *map(F.col, columns)).mapInArrow(run, f"{schema}, score double")


def op7_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=~held_out(1, 3))
    return score(docs, machine, "doc_id").select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
