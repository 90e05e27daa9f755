"""Byte-level substring deduplication by bucket-pointer refinement.

A window of `window` bytes is repeated if its content also starts anywhere else. Every suffix has a bucket identifier, and
two stretches are equal if and only if their suffixes end up with the same identifiers:

1. Initial buckets. The identifier of a suffix is the code of its first q bytes.
2. Refinement. A round pairs a suffix' identifier with the one that the suffix `depth` bytes later has from the same round,
   and both are written back as one, so buckets of 50 bytes become buckets of 100 and of 200; no round reads bytes. A
   stretch has the identifiers of the suffixes at its start and at its end less the greatest depth that fits.
3. Sampled suffixes (one in about 75, chosen by content, see `runs`) carry the windows near them as a run of starts. They
   are grouped over all documents: by their bucket of q bytes first, and what is alone in it goes; then by the identifiers
   of the whole run, which settles runs that are repeated as a whole.
4. Buckets that hold different runs go on: their runs are cut at fixed distances from their suffix, and the bucket
   identifier of the last round is refined by those of suffixes at earlier and later offsets, until a run is one window.

Identifiers are 128 bits made of the pairs (64 of them decide in buckets), not ranks of their sorted list: a rank would have
to be joined back to every suffix of every document in every round, a table of 16 times the input.

Edge cases: null or empty text and texts under a window lose nothing; very long texts are read whole, in one task each;
equal ids with equal texts are copies of one another, equal ids with different texts are different documents; removal may
cut a UTF-8 character, so kept bytes need not be text; ties do not arise (a window is repeated or it is not); an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import rolling as R
from podium.llm import runs

_U = np.uint64


def paired(ids: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers refined by those at a later offset."""
    return R.mix(ids * _U(0x9FB21C651E98DF25) + (later ^ (later >> _U(29))) * _U(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Suffixes(runs.Shape):
    """Windows of bytes whose names are bucket identifiers; `pair` refines identifiers by those at later offsets."""

    pair: Callable[[np.ndarray, np.ndarray], np.ndarray] = paired

    def text(self, offsets: np.ndarray, data: np.ndarray) -> Buckets:
        return Buckets(self, offsets, data)

    def refine(self, ids: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.pair(self.pair(ids, before), after)


class Buckets(runs.Text):
    """Bucket identifiers of all suffixes of some documents, in two independent ways."""

    def __init__(self, shape: Suffixes, offsets: np.ndarray, data: np.ndarray):
        super().__init__(shape, offsets, data)
        self.shape, self.rounds = shape, ([], [])

    def identifiers(self, depth: int, half: int) -> np.ndarray:
        """For every suffix the identifier of its bucket by q * 2**depth bytes, made once from the round before."""
        rounds, q = self.rounds[half], self.shape.q
        if not rounds:
            rounds.append(R.mix(R.rolling(self.sums[half], q, 1 + half)))
        while len(rounds) <= depth:
            last, later = rounds[-1], q << (len(rounds) - 1)
            rounds.append(self.shape.pair(last[:-later], last[later:]))
        return rounds[depth]

    def name(self, start: np.ndarray, end: np.ndarray, half: int = 0) -> np.ndarray:
        """Names of stretches of q bytes or more, by the identifiers of their first and last suffix of the depth that fits."""
        size, out = end - start, np.zeros(len(start), dtype=_U)
        depth = np.floor(np.log2(size / self.shape.q)).astype(np.int64)
        for k in np.unique(depth).tolist():
            of, ids = np.flatnonzero(depth == k), self.identifiers(k, half)
            first, last = ids[start[of]], ids[end[of] - (self.shape.q << k)]
            out[of] = np.where(size[of] == self.shape.q << k, first, self.shape.pair(first + size[of].astype(_U), last))
        return out

    def before(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.name(start, np.maximum(end, start + self.shape.q))

    def after(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.name(np.minimum(start, end - self.shape.q), end)


def shape(window: int = 200, q: int = 50, widths: tuple[int, ...] = (16, 1), **options) -> Suffixes:
    return Suffixes("byte", window, q, widths, **options)


def suffix_dedup(docs: DataFrame, *, window: int = 200, q: int = 50) -> DataFrame:
    """doc_id and text without bytes covered by repeated strings of `window` bytes."""
    return runs.cleaned(docs, shape(window, q), sketched=False)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = runs.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shape(), sketched=False)
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h
      FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
s AS (SELECT doc_id, i, i > lag(i) OVER w + 200 OR lag(i) OVER w IS NULL AS fresh
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, k),
cut AS (SELECT d.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS c, x
        FROM runs JOIN d ON runs.doc_id = d.doc_id),
left_ AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
                 string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(first(x), 2 * max(b) + 1) AS kept
          FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)
"""
