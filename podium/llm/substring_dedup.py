"""Substring deduplication over windows of words, with a count-min prefilter.

Every task sketches its windows through the gram they belong to; the merged sketch overestimates window counts, so windows
estimated to occur once are left out and none that repeats is. A second pass groups exactly what was estimated repeated:
first the run of windows of each gram, then shorter runs of those that were not settled, at last single windows (see
`runs`). Where a corpus is too large for the sketch it lets more pass, and the exact pass stays in proportion to the number
of runs. Words are compared as they stand.

Edge cases: null or empty text and texts shorter than a window lose nothing; very long texts are read whole, in one task
each; equal ids with equal texts are copies of one another, equal ids with different texts are different documents; a word
covered by several repeated windows is removed once; an empty table gives an empty result; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import runs


def shape(window: int = 35, gram: int = 12, widths: tuple[int, ...] = (4, 1)) -> runs.Shape:
    return runs.Shape("word", window, gram, widths)


def substring_dedup(docs: DataFrame, *, window: int = 35, gram: int = 12) -> DataFrame:
    """doc_id and text without words covered by repeated windows."""
    return runs.cleaned(docs, shape(window, gram), sketched=True)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = runs.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shape(), sketched=True)
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                      lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
left_ AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.k) AS kept
          FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM d) x
          ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.k = gone.k GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
