"""Toxicity by class-conditional Kneser-Ney models over byte n-grams.

N-grams of the labelled texts are counted for each class over all of them. Both class models interpolate their
discounted counts with one shared lower-order distribution, made of continuation counts (in how many contexts a suffix
was seen) and itself interpolated with the next lower order, down to single bytes, so rare expressions cost both classes
alike. A text's evidence is the difference of the two log-likelihoods, divided by length: over the whole text, and over its
best stretches of 8 and 16 bytes, since a long text can hold one toxic phrase. A logistic calibration turns this into a
score. It is fitted to evidence from models that have not counted the text: labelled texts are dealt to two halves, and
each half is judged by the counts of the other. Evidence cannot speak against itself: its weights are 0 or more.

The n-gram statistics are Spark aggregates and grow with the corpus, and every n-gram keeps its own log ratio. Up to
`broadcast_grams` of them are broadcast for scoring as a hash table with whole keys, sized by their count (24 to 48 bytes
an entry); beyond that the distinct n-grams of each chunk of texts are joined to the ratios by shuffles, and the chunk's
texts are scored from what comes back. The calibration takes at most `fit_rows` texts.

Edge cases: null and empty texts are scored as empty; very long texts are counted and scored whole; ties at the threshold
are toxic; without both classes among the labels every score is 0; repeated
labels of one id count once (toxic if any is); null labels are left out; an empty table gives an empty result; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm import rolling as R
from podium.llm.common import held_out, shielded, small_batches, whole_text, written

_U = np.uint64
ORDER = 5
SPANS = (8, 16)
_SALT = _U(0xC2B2AE3D27D4EB4F)


def _grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams inside each padded text, and the texts' offsets in n-grams."""
    n = len(data) - ORDER + 1
    d = data.astype(_U)
    g = d[:n].copy()
    for k in range(1, ORDER):
        g = (g << _U(8)) | d[k : n + k]
    inside = np.ones(n, dtype=bool)
    for k in range(1, ORDER):
        at = offsets[1:-1] - k
        inside[at[at >= 0]] = False
    counts = np.maximum(np.diff(offsets) - ORDER + 1, 0)
    return g[inside], np.concatenate([[0], np.cumsum(counts)])


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" " * (ORDER - 1)), F.lower(text), F.lit(" ")).cast("binary")


#: The two halves of the labelled texts, each by class (ordinary, toxic).
GROUPS = range(4)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, n0 .. n3): counts in the texts of (text, label, half) rows by 2 * half + label, over all of them."""

    def count(batches):
        held: dict[int, list[np.ndarray]] = {k: [] for k in GROUPS}
        size = 0

        def send():
            found = {k: np.unique(np.concatenate(v or [np.zeros(0, _U)]), return_counts=True) for k, v in held.items()}
            grams = np.unique(np.concatenate([x for x, _ in found.values()]))
            columns = [pa.array(grams.view(np.int64))]
            for k in GROUPS:
                n = np.zeros(len(grams), dtype=np.int64)
                n[np.searchsorted(grams, found[k][0])] = found[k][1]
                columns.append(pa.array(n))
                held[k].clear()
            return pa.RecordBatch.from_arrays(columns, names=["gram", *(f"n{k}" for k in GROUPS)])

        for batch in batches:
            group = batch.column(1).to_numpy(zero_copy_only=False)
            for first, offsets, data in R.batches(batch.column(0), 500_000):
                grams, cut = _grams(offsets, data)
                own = np.repeat(group[first : first + len(offsets) - 1], np.diff(cut))
                for k in GROUPS:
                    held[k].append(grams[own == k])
                size += len(grams)
                if size > 4_000_000:
                    yield send()
                    size = 0
        if size:
            yield send()

    small_batches(labelled.sparkSession)
    rows = labelled.select(_padded(whole_text()).alias("data"), (2 * F.col("half") + F.col("label")).cast("int").alias("g"))
    parts = rows.mapInArrow(count, "gram long, " + ", ".join(f"n{k} long" for k in GROUPS))
    return parts.groupBy("gram").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in GROUPS])


def class_counts(counts: DataFrame, *halves: int) -> DataFrame:
    """(gram, t, o): counts in toxic and ordinary texts of the given halves."""
    of = lambda c: sum((F.col(f"n{2 * h + c}") for h in halves), F.lit(0))
    return counts.select("gram", of(1).alias("t"), of(0).alias("o")).filter("t + o > 0")


def shared_backoff(grams: DataFrame, order: int, discount: float = 0.75) -> DataFrame:
    """(gram, below): the shared probability of the last byte of grams (gram, left) of `order` bytes after the others.

    `left` is in how many contexts a gram was seen; what is discounted from it goes to the next lower order.
    """
    rows = grams.withColumn("context", F.expr("shiftright(gram, 8)"))
    per_context = rows.groupBy("context").agg(F.sum("left").alias("all"), F.count("*").alias("types"))
    rows = rows.join(per_context, "context")
    if order == 1:
        lower = F.lit(1 / 256)
    else:
        suffix = F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1)
        # written: each order reads its n-grams three times, so unwritten plans would double with every order
        shorter = written(grams.groupBy(suffix.alias("gram")).agg(F.count("*").alias("left")), "suffixes")
        shorter = shared_backoff(shorter, order - 1, discount).toDF("suffix", "lower")
        rows = rows.withColumn("suffix", suffix).join(shorter, "suffix")
        lower = F.col("lower")
    own = F.greatest(F.col("left") - discount, F.lit(0.0)) + discount * F.col("types") * lower
    return rows.select("gram", (own / F.col("all")).alias("below"))


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) and (context, ratio): log of the toxic over the ordinary probability.

    The second is for n-grams that neither class has seen: the shared lower order cancels, the backoff weights remain.
    """
    context, suffix = F.expr("shiftright(gram, 8)"), F.col("gram").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)
    n = counts.agg(
        *[F.sum((F.col(c) == k).cast("long")).alias(f"{c}{k}") for c in ("t", "o") for k in (1, 2)]
    ).first()
    discount = {c: max(0.1, (n[f"{c}1"] or 0) / max(1, (n[f"{c}1"] or 0) + 2 * (n[f"{c}2"] or 0))) for c in ("t", "o")}
    per_context = counts.groupBy(context.alias("context")).agg(
        F.sum("t").alias("ct"),
        F.sum("o").alias("co"),
        F.sum((F.col("t") > 0).cast("long")).alias("nt"),
        F.sum((F.col("o") > 0).cast("long")).alias("no"),
    )
    per_context = written(per_context, "contexts")
    per_suffix = written(counts.groupBy(suffix.alias("gram")).agg(F.count("*").alias("left")), "suffixes")
    shared = written(shared_backoff(per_suffix, ORDER - 1), "backoff").withColumnRenamed("gram", "suffix")

    def weight(c: str) -> Column:
        return F.when(F.col(f"c{c}") > 0, discount[c] * F.col(f"n{c}") / F.col(f"c{c}")).otherwise(F.lit(1.0))

    def probability(c: str) -> Column:
        own = F.greatest(F.col(c) - discount[c], F.lit(0.0)) / F.greatest(F.col(f"c{c}"), F.lit(1))
        return own + weight(c) * F.col("below")

    grams = (
        counts.withColumn("context", context)
        .withColumn("suffix", suffix)
        .join(per_context, "context")
        .join(shared, "suffix")
        .select("gram", F.log(probability("t") / probability("o")).cast("float").alias("ratio"))
    )
    contexts = per_context.select("context", F.log(weight("t") / weight("o")).cast("float").alias("ratio"))
    return grams, contexts


_FREE = _U(2**64 - 1)  # no packed n-gram


@dataclass
class Table:
    """Ratios by whole key: open addressing, laid out in the order of the keys' home places."""

    keys: np.ndarray
    ratios: np.ndarray
    bits: int

    @staticmethod
    def of(keys: np.ndarray, ratios: np.ndarray) -> Table:
        bits = max(1, int(2 * len(keys)).bit_length())
        home = _home(keys, bits)
        order = np.argsort(home, kind="stable")
        step = np.arange(len(keys))
        # each key at its home or behind the key before it
        at = step + np.maximum.accumulate(home[order] - step) if len(keys) else step
        size = max(1 << bits, int(at.max(initial=0)) + 1) + 1  # the last place stays free and ends every search
        out = Table(np.full(size, _FREE), np.zeros(size, np.float32), bits)
        out.keys[at], out.ratios[at] = keys[order], ratios[order]
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, 0 where there is none, and which of `x` are there."""
        at = _home(x, self.bits)
        here = self.keys[at]
        seen = here == x
        value = np.where(seen, self.ratios[at], np.float32(0))
        left = np.flatnonzero(~seen & (here != _FREE))
        while len(left):
            at[left] += 1
            here = self.keys[at[left]]
            hit = left[here == x[left]]
            seen[hit], value[hit] = True, self.ratios[at[hit]]
            left = left[(here != x[left]) & (here != _FREE)]
        return value, seen


def _home(x: np.ndarray, bits: int) -> np.ndarray:
    return (R.mix(x * _SALT) >> _U(64 - bits)).astype(np.int64)


def _table(df: DataFrame, key: str) -> Table:
    """Collect all keys with their ratios."""
    rows = df.select(key, "ratio").toArrow()
    return Table.of(rows[key].to_numpy().astype(np.int64).view(_U), rows["ratio"].to_numpy().astype(np.float32))


def _evidence(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(texts, 4) of the n-grams' log ratios: their mean, the best mean over each span, and the log length."""
    sizes = np.diff(cut)
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    mean = (sums[cut[1:]] - sums[cut[:-1]]) / sizes
    out = [mean]
    ends = np.repeat(cut[1:], sizes)
    for span in SPANS:
        best = np.full(len(value), -np.inf)
        if len(value) >= span:
            best[: len(value) - span + 1] = (sums[span:] - sums[:-span]) / span
            best[np.arange(len(value)) + span > ends] = -np.inf
        top = np.maximum.reduceat(best, cut[:-1])
        out.append(np.where(np.isfinite(top), top, mean))
    return np.column_stack([*out, np.log(sizes)])


@dataclass
class Model:
    grams: Table | DataFrame  # (gram, ratio), a frame beyond the broadcast bound
    contexts: Table | DataFrame  # (context, ratio)
    weights: np.ndarray | None = None  # of the evidence, the last one constant
    scale: np.ndarray | None = None  # means and deviations of the evidence

    def values(self, grams: np.ndarray) -> np.ndarray:
        value, seen = self.grams.find(grams)
        missing = np.flatnonzero(~seen)
        value[missing] = self.contexts.find(grams[missing] >> _U(8))[0]
        return value

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = ((evidence - self.scale[0]) / self.scale[1]) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, signed: int, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the first `signed` weights are kept at 0 or more, the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = (x[:, used] * (p * (1 - p))[:, None]).T @ x[:, used] + np.diag(penalty[used])
            step = np.linalg.solve(h, (x.T @ (y - p) - penalty * w)[used])
            w[used] += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        against = w[:signed] < 0
        if not against.any():
            return w
        used[int(w[:signed].argmin())] = False


def _column(found: list[np.ndarray], model: Model, as_score: bool) -> pa.Array:
    found = np.concatenate(found or [np.zeros((0, len(SPANS) + 2))])
    if as_score:
        return pa.array(model.score(found))
    new = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1])
    return new.cast(pa.list_(pa.float64()))


def _evidence_of(rows: DataFrame, model: Model, as_score: bool) -> tuple[DataFrame, Callable[[], None]]:
    """`rows` (with binary `_data`) and score, or the evidence as an array; and what frees the model once that is computed."""
    if isinstance(model.grams, DataFrame):
        return _joined_evidence(rows, model, as_score), lambda: None
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            where = batch.schema.get_field_index("_data")
            found = []
            for _, offsets, data in R.batches(batch.column(where), 500_000):
                grams, cut = _grams(offsets, data)
                found.append(_evidence(model.values(grams), cut))
            rest = batch.drop_columns(["_data"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, _column(found, model, as_score)], names=[*rest.schema.names, "_new"]
            )

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, _schema(rows, as_score)), shared.destroy


def _schema(rows: DataFrame, as_score: bool) -> str:
    fields = [f for f in rows.schema if f.name != "_data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return f"{schema}, _new {'double' if as_score else 'array<double>'}"


def _joined_evidence(rows: DataFrame, model: Model, as_score: bool, chunk: int = 4 << 20) -> DataFrame:
    """The same where the ratios stay distributed: each chunk's distinct n-grams are looked up by shuffled joins."""
    fitted = Model(None, None, model.weights, model.scale)

    def number(batches):
        part, k, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            size += batch.column(batch.schema.get_field_index("_data")).nbytes
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part + k))], names=[*batch.schema.names, "_chunk"]
            )
            if size >= chunk:
                k, size = k + 1, 0

    def distinct(batches):
        for batch in batches:
            for first, offsets, data in R.batches(batch.column(0), 500_000):
                grams, cut = _grams(offsets, data)
                own = np.repeat(batch.column(1).to_numpy()[first : first + len(offsets) - 1], np.diff(cut))
                for c in np.unique(own):
                    g = np.unique(grams[own == c])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), c)), pa.array(g.view(np.int64))], names=["_chunk", "gram"]
                    )

    def run(ratios, texts):
        table = Table.of(ratios["gram"].to_numpy().astype(np.int64).view(_U), ratios["value"].to_numpy())
        found = []
        for _, offsets, data in R.batches(texts["_data"].combine_chunks(), 500_000):
            grams, cut = _grams(offsets, data)
            found.append(_evidence(table.find(grams)[0], cut))
        new = _column(found, fitted, as_score)
        return texts.drop_columns(["_data", "_chunk"]).append_column("_new", new)

    small_batches(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # written, so that a text keeps its chunk
    texts = written(rows.mapInArrow(number, f"{fields}, _chunk long"), "chunks")
    needed = texts.select("_data", "_chunk").mapInArrow(distinct, "_chunk long, gram long").distinct()
    needed = needed.withColumn("context", F.expr("shiftright(gram, 8)"))
    found = needed.join(model.grams, "gram", "left").join(
        model.contexts.withColumnRenamed("ratio", "back"), "context", "left"
    )
    found = found.select("_chunk", "gram", F.coalesce("ratio", "back", F.lit(0.0).cast("float")).alias("value"))
    return found.groupBy("_chunk").cogroup(texts.groupBy("_chunk")).applyInArrow(run, _schema(rows, as_score))


def _model(counts: DataFrame, broadcast_grams: int) -> Model:
    grams, contexts = log_ratios(counts)
    if counts.count() <= broadcast_grams:
        return Model(_table(grams, "gram"), _table(contexts, "context"))
    return Model(written(grams, "ratios"), written(contexts, "backoffs"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    keep: Column | None = None,
    broadcast_grams: int = 2_000_000,
    fit_rows: int = 20_000,
    broadcast_labels: int = 2_000_000,
) -> Model | None:
    """A model from the labelled documents that `keep` allows: all are counted, about `fit_rows` of them calibrate."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    if keep is not None:
        own = own.filter(keep)
    own = own.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    own = written(own, "labels")
    labelled = own.count()
    few = F.broadcast(own) if labelled <= broadcast_labels else own
    text = docs.select("doc_id", whole_text().alias("text")).join(few, "doc_id")
    counts = written(gram_counts(text), "grams")
    present = counts.agg(*[F.coalesce(F.max(f"n{k}"), F.lit(0)) for k in GROUPS]).first()
    if not present[0] + present[2] or not present[1] + present[3]:
        return None
    share = min(1.0, fit_rows / max(1, labelled))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    rows = text.filter(drawn).select("label", "half", _padded(F.col("text")).alias("_data"))
    found, truth = [], []
    for half in (0, 1):
        if not present[2 * half] or not present[2 * half + 1]:
            continue  # a half without both classes judges nothing
        other = _model(class_counts(counts, half), broadcast_grams)
        judged, release = _evidence_of(rows.filter(F.col("half") == 1 - half).drop("half"), other, False)
        judged = judged.toArrow()
        release()  # the driver holds one model at a time
        del other
        found.append(np.array(judged["_new"].to_pylist()).reshape(-1, len(SPANS) + 2))
        truth.append(judged["label"].to_numpy().astype(float))
    if not found or not 0 < sum(y.sum() for y in truth) < sum(map(len, truth)):
        return None
    x, y = np.concatenate(found), np.concatenate(truth)
    model = _model(class_counts(counts, 0, 1), broadcast_grams)
    model.scale = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-9])
    model.weights = _logistic((x - model.scale[0]) / model.scale[1], y, len(SPANS) + 1)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` and score, 0 to 1."""
    held = [c for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*held, F.lit(0.0).alias("score"))
    docs, back = shielded(docs.select(held), "_data", "_new", "_chunk")
    rows = docs.withColumn("_data", _padded(whole_text()))
    return back(_evidence_of(rows, model, True)[0].withColumnRenamed("_new", "score"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=~held_out(1, 3))
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
