"""Language identification with a linear-chain conditional random field over the words of a text.

Every word has a score for each language: byte pairs and triples (with the word's edges, so short affixes too), its first
and last three bytes, and the word itself as a lexicon entry, all hashed into tables of a fixed size. Transition scores
between neighbouring words are learned with them. Forward-backward gives each word's language probabilities, so the words
of a code-switched text are labelled one by one (`label_words`); a text's language is the one with the largest share.

The tables are fitted by gradient ascent on the likelihood of a bounded sample: about `fit_rows` labelled documents of
each language, or as many as have about `fit_chars` characters together, chosen by a hash of the id among all of them; texts are
whole, and any length is equally likely. As labelled texts are in one language each, chains of two to four stretches of different texts
are added to them, one for every two texts, from which the switches are learned. Every other step covers all documents and
whole texts. A document is rejected for words that no language explains, not for holding several languages.
Forward-backward is exact for any length: chains are cut into pieces whose transfer matrices are multiplied first, so memory
is bounded by a batch.

Edge cases: null text and texts without a letter are `und` with score 0; very long texts are labelled whole; ties go to the
language that sorts first; languages outside the labels cannot be predicted; without any labelled row everything is `und`;
rows are scored one by one, so repeated and null ids and copies do not matter; an empty table gives an empty result;
columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm import rolling as R
from podium.llm.common import held_out, shielded, small_batches

_U = np.uint64
BITS = 16
PIECE = 32
#: Bytes that belong to words: lower-case letters and everything beyond ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_KINDS = ("pair", "triple", "start", "stop", "word")


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    return (R.mix(x + _U(salt)) >> _U(64 - BITS)).astype(np.int64)


@dataclass
class Words:
    """Feature buckets of the words of some texts; `pair` and `triple` are per byte, cut at `first`."""

    pair: np.ndarray
    triple: np.ndarray
    first: np.ndarray
    last: np.ndarray  # one beyond each word's last byte
    start: np.ndarray
    stop: np.ndarray
    word: np.ndarray
    cut: np.ndarray  # offsets of the texts in words


def features(offsets: np.ndarray, data: np.ndarray) -> Words:
    """The words of lower-cased texts, each of which ends with a space."""
    d = np.full(len(data) + 5, 0x20, dtype=np.uint8)
    d[1:-4] = np.where(_LETTER[data], data, 0x20)
    solid = d != 0x20
    s = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    e = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    n = len(d) - 4
    w = d.astype(_U)
    two = (w[:-1] << _U(8)) | w[1:]
    three = (two[:-1] << _U(8)) | w[2:]
    pair = np.where(two[:n] == 0x2020, 0, _bucket(two[:n], 11) | 1)
    triple = np.where(d[1 : n + 1] == 0x20, 0, _bucket(three[:n], 22) | 1)
    four = (three[:-1] << _U(8)) | w[3:]
    hashes = R.word_hashes(d, s, e) if len(s) else np.zeros(0, _U)
    return Words(
        pair,
        triple,
        s - 1,
        e - 1,
        _bucket(four[s - 1], 33),
        _bucket(four[np.maximum(e - 3, 0)], 44),
        _bucket(hashes, 55),
        np.searchsorted(s - 1, offsets),
    )


@dataclass
class Model:
    languages: list[str]
    tables: dict[str, np.ndarray]  # kind -> (buckets, languages)
    moves: np.ndarray  # (from, to)

    def scores(self, x: Words) -> np.ndarray:
        if not len(x.first):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        per_byte = self.tables["pair"][x.pair] + self.tables["triple"][x.triple]
        out = np.add.reduceat(per_byte, x.first, axis=0)
        for kind in _KINDS[2:]:
            out += self.tables[kind][getattr(x, kind)]
        return out


def marginals(scores: np.ndarray, cut: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (words, k) and the sum of pair marginals (k, k) by exact forward-backward over each text."""
    k = scores.shape[1]
    sizes = np.diff(cut)
    pieces = -(-sizes // PIECE)
    total = int(pieces.sum())
    if not total:
        return np.zeros((0, k)), np.zeros((k, k))
    text = np.repeat(np.arange(len(sizes)), pieces)
    order = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = cut[:-1][text] + order * PIECE
    size = np.minimum(PIECE, cut[1:][text] - begin)
    e = np.ones((PIECE, total, k))
    at = np.arange(PIECE)[:, None]
    there = at < size
    e[there] = np.exp(scores - scores.max(axis=1, keepdims=True))[(begin + at)[there]]
    t = np.exp(moves - moves.max())
    # transfer matrix of each piece: row = state before it, column = state of its last word
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for i in range(PIECE):
        step = (m.reshape(-1, k) @ t).reshape(total, k, k) * e[i][:, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        m = np.where(there[i][:, None, None], step, m)
    # a text starts from a uniform state before its first word, and ends freely
    into, out_of = np.full((total, k), 1.0 / k), np.ones((total, k))
    head = np.flatnonzero(order == 0)
    for i in range(int(pieces.max()) - 1):
        here = head[pieces[text[head]] > i + 1] + i
        v = np.einsum("pk,pkj->pj", into[here], m[here])
        into[here + 1] = v / v.sum(axis=1, keepdims=True)
        back = head[pieces[text[head]] > i + 1]
        last = back + pieces[text[back]] - 1 - i
        v = np.einsum("pkj,pj->pk", m[last], out_of[last])
        out_of[last - 1] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((PIECE, total, k))
    v = into
    for i in range(PIECE):
        nxt = (v @ t) * e[i]
        nxt /= nxt.sum(axis=1, keepdims=True)
        v = np.where(there[i][:, None], nxt, v)
        forward[i] = v
    out, pairs = np.empty((len(scores), k)), np.zeros((k, k))
    b = out_of
    for i in range(PIECE - 1, -1, -1):
        on = there[i]
        g = forward[i] * b
        g /= g.sum(axis=1, keepdims=True)
        out[(begin + i)[on]] = g[on]
        before = forward[i - 1] if i else into
        later = e[i] * b
        inner = on if i else on & (order > 0)
        z = np.einsum("pk,kj,pj->p", before[inner], t, later[inner])
        pairs += t * np.einsum("pk,pj->kj", before[inner] / z[:, None], later[inner])
        nxt = later @ t.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        b = np.where(on[:, None], nxt, b)
    return out, pairs


def spliced(samples: list[tuple[str, str]], seed: int = 9) -> list[list[tuple[str, str]]]:
    """The samples as chains of one stretch, and for every two of them a chain of stretches of several texts."""
    rng = np.random.default_rng(seed)
    chains = [[x] for x in samples]
    if len({lang for lang, _ in samples}) < 2:
        return chains
    for _ in range(len(samples) // 2):
        chain = []
        for i in rng.integers(0, len(samples), rng.integers(2, 5)).tolist():
            lang, text = samples[i]
            words = text.split()
            size = int(rng.integers(3, 25))
            at = int(rng.integers(0, max(1, len(words) - size + 1)))
            chain.append((lang, " ".join(words[at : at + size])))
        chains.append(chain)
    return chains


def fit(
    chains: list[list[tuple[str, str]]], languages: list[str], *, epochs: int = 3, rate: float = 0.4, seed: int = 5
) -> Model:
    """Adaptive gradient ascent on the likelihood of chains of (language, lower-cased text) stretches."""
    k = len(languages)
    tables = {kind: np.zeros((1 << BITS, k), dtype=np.float32) for kind in _KINDS}
    model = Model(languages, tables, np.zeros((k, k)))
    squares = {kind: np.full((1 << BITS, k), 1e-3) for kind in _KINDS}
    move_squares = np.full((k, k), 1e-3)
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for a in range(0, len(order), 64):
            part = [chains[i] for i in order[a : a + 64]]
            raw = [(x + " ").encode() for chain in part for _, x in chain]
            offsets = np.cumsum([0, *map(len, raw)])
            x = features(offsets, np.frombuffer(b"".join(raw), dtype=np.uint8))
            n = len(x.word)
            if not n:
                continue
            truth = np.repeat([number[y] for chain in part for y, _ in chain], np.diff(x.cut))
            cut = x.cut[np.cumsum([0, *map(len, part)])]
            found, pairs = marginals(model.scores(x), cut, model.moves)
            wrong = -found
            wrong[np.arange(n), truth] += 1
            per_byte = np.repeat(wrong, np.diff(np.append(x.first, len(x.pair))), axis=0)
            for kind in _KINDS:
                where, grad = getattr(x, kind), wrong
                if kind in ("pair", "triple"):
                    where, grad = where[x.first[0] :], per_byte
                for j in range(k):
                    g = np.bincount(where, weights=grad[:, j], minlength=1 << BITS)
                    g[0] = 0 if kind in ("pair", "triple") else g[0]
                    squares[kind][:, j] += g * g
                    tables[kind][:, j] += (rate * g / np.sqrt(squares[kind][:, j])).astype(np.float32) * 0.2
            inner = np.ones(n, dtype=bool)  # words that follow another one of their chain
            inner[cut[:-1][cut[:-1] < n]] = False
            at = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[at - 1], truth[at]), 1)
            g = seen - pairs - 0.5 * model.moves * n / 100
            move_squares += g * g
            model.moves += rate * g / np.sqrt(move_squares)
    return model


def train(docs: DataFrame, *, fit_rows: int = 250, fit_chars: int = 5_000_000, keep: Column | None = None) -> Model | None:
    """A model from whole labelled documents that `keep` allows: of each language about `fit_rows`, or as many as have about
    `fit_chars` characters together where that is fewer, and its shortest one in any case."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    if keep is not None:
        known = known.filter(keep)
    name = F.xxhash64("doc_id", "text", F.lit("fit"))
    shortest = F.min(F.struct(F.length("text").alias("n"), name.alias("name")))["name"]
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), shortest.alias("one"))
    counts = {r["lang"]: r for r in sizes.collect()}  # a row for each language
    if not counts:
        return None
    # the share of each language that gives about so many rows or characters, drawn by the id's hash
    table = lambda of: F.create_map(*[x for lang, r in counts.items() for x in (F.lit(lang), F.lit(of(r)))])[F.col("lang")]
    share = table(lambda r: min(1.0, fit_rows / r["n"], fit_chars / r["chars"]))
    draw = F.pmod(name, F.lit(1_000_003)) / 1_000_003
    rows = known.filter((draw < share) | (name == table(lambda r: r["one"]))).select("lang", F.lower("text").alias("text"))
    return fit(spliced(sorted((r["lang"], r["text"]) for r in rows.collect())), sorted(counts))


#: Columns that are made inside, whatever the documents' own are called.
_INNER = ("_lid", "_lang", "_score", "_sure")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs`, lang_pred and score (the share of the text's words in that language)."""
    docs, back = shielded(docs, *_INNER)
    return back(_predicted(docs, model).drop("_sure"))


def _predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """predict() and _sure: the mean, over the words, of the probability of each word's best language."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "_sure": F.lit(0.0)})
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            where = batch.schema.get_field_index("_lid")
            names, scores, sure = [], [], []
            for _, offsets, data in R.batches(batch.column(where), 300_000):
                x = features(offsets, data)
                found, _ = marginals(model.scores(x), x.cut, model.moves)
                sizes = np.diff(x.cut)
                share, best_word = np.zeros((len(sizes), len(model.languages))), np.zeros(len(sizes))
                some = sizes > 0
                if some.any():
                    share[some] = np.add.reduceat(found, x.cut[:-1][some], axis=0) / sizes[some][:, None]
                    best_word[some] = np.add.reduceat(found.max(axis=1), x.cut[:-1][some]) / sizes[some]
                best = share.argmax(axis=1)
                names += [model.languages[b] if s else "und" for b, s in zip(best, sizes, strict=True)]
                scores.append(np.clip(share[np.arange(len(best)), best], 0, 1))
                sure.append(best_word)
            rest = batch.drop_columns(["_lid"])
            yield pa.RecordBatch.from_arrays(
                [
                    *rest.columns,
                    pa.array(names, pa.string()),
                    *(pa.array(np.concatenate(v or [np.zeros(0)])) for v in (scores, sure)),
                ],
                names=[*rest.schema.names, "_lang", "_score", "_sure"],
            )

    held = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(held).schema)
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(*held, F.when(letter, F.concat(F.lower("text"), F.lit(" "))).cast("binary").alias("_lid"))
    found = rows.mapInArrow(score, f"{schema}, _lang string, _score double, _sure double")
    return found.withColumnsRenamed({"_lang": "lang_pred", "_score": "score"})


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` and word_langs: the lower-cased words of a text, each with its language and probability."""
    kind = "array<struct<word:string,lang:string,score:double>>"
    if model is None:
        return docs.withColumn("word_langs", F.array().cast(kind))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = shared.value
        for batch in batches:
            where, out = batch.schema.get_field_index("_lid"), []
            for _, offsets, data in R.batches(batch.column(where), 300_000):
                x = features(offsets, data)
                found, _ = marginals(model.scores(x), x.cut, model.moves)
                best, raw = found.argmax(axis=1), data.tobytes()
                for a, b in zip(x.cut[:-1].tolist(), x.cut[1:].tolist(), strict=True):
                    out.append(
                        [
                            {
                                "word": raw[x.first[i] : x.last[i]].decode("utf-8", "replace"),
                                "lang": model.languages[best[i]],
                                "score": float(found[i, best[i]]),
                            }
                            for i in range(a, b)
                        ]
                    )
            rest = batch.drop_columns(["_lid"])
            fields = pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(out, pa.list_(fields))], names=[*rest.schema.names, "word_langs"]
            )

    docs, back = shielded(docs, "_lid")
    held = [c for c in docs.columns if c != "word_langs"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(held).schema)
    rows = docs.select(*held, F.concat(F.lower("text"), F.lit(" ")).cast("binary").alias("_lid"))
    return back(rows.mapInArrow(label, f"{schema}, word_langs {kind}"))


def identify(docs: DataFrame, *, reject_below: float = 0.5, **training) -> DataFrame:
    """The documents whose words were recognised, in one language or several, with all their columns: no `und`, and no
    mean probability of the words' best languages under the limit."""
    own, back = shielded(docs, *_INNER, "lang_pred", "score")
    found = _predicted(own, train(docs, **training))
    found = found.filter((F.col("lang_pred") != "und") & (F.col("_sure") >= reject_below))
    return back(found.select(own.columns)).select(docs.columns)


def op9_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, keep=~held_out(2, 4))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
