"""Quality rules over the lines of a corpus: boilerplate is what many documents of one host share.

Normalised lines are hashed together with their host, in two independent ways; a line's number of distinct documents is
counted per host; lines above the limits are removed, and a document that loses most of its words is rejected. Everything is
built-in column functions. Documents are split into lines once, into a table of hashes that both the counts and the removal
read. The counts are partial aggregates before their shuffle, so a line that a third of all documents hold is one row per
task.

Edge cases: null or empty text has no words and fails the base rule; very long texts are read whole; a null host is a host
of its own; documents are distinct ids (rows without an id are told apart by their texts); rows that share an id count as one
document, and each is judged by its own text; ties do not arise (limits are strict); an empty table gives an empty result;
columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import ascii_words, small, whole_text, written

SYMBOLS = "#*$%&|<>"


def _repeat_words(grams: str, n: int = 3) -> Column:
    """Words covered by windows that occur twice or more; `grams` is the sorted array of (h, i), hash and start."""
    g = F.col(grams)
    repeated = F.filter(
        F.transform(
            g,
            lambda x, k: F.when((F.get(g, k - 1)["h"] == x["h"]) | (F.get(g, k + 1)["h"] == x["h"]), x["i"]),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    return F.aggregate(
        F.sort_array(repeated),
        start,
        lambda a, p: F.struct(
            (a["covered"] + p + n - F.greatest(a["end"], p)).alias("covered"), (p + n).alias("end")
        ),
        lambda a: a["covered"],
    )


def base_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.col("_text")
    spread = docs.select("doc_id", _row(host).alias("row"), whole_text().alias("_text")).select(
        "doc_id",
        "row",
        ascii_words(text).alias("_w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("_lines"),
    )
    w = F.col("_w")
    counted = spread.select(
        "doc_id",
        "row",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.when(
                F.size(w) >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        ).alias("_g"),
    ).withColumn("n_repeat_words", _repeat_words("_g").cast("long"))
    return counted.drop("_g").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def normalised_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def _row(host: str) -> Column:
    """The name of a document: its id, text and host."""
    return F.xxhash64(F.col("doc_id"), whole_text(), F.col(host).cast("string"))


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64("host", line).alias("l1"), F.xxhash64(line, "host").alias("l2")]


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per line with a word: row, host, doc, l1 and l2 (128 bits of host and line), words."""
    line = F.col("_line")
    document = F.when(F.col("doc_id").isNull(), F.xxhash64(whole_text())).otherwise(F.xxhash64("doc_id"))
    # normalised_line of every line, the white space and case of the whole text at once
    flat = F.lower(F.regexp_replace(whole_text(), "[\\x20\\x09\\x0B-\\x0D]+", " "))
    return (
        docs.select(
            _row(host).alias("row"),
            F.xxhash64(F.col(host)).alias("host"),
            document.alias("doc"),
            F.explode(F.split(flat, "\n")).alias("_line"),
        )
        .select("row", "host", "doc", F.trim("_line").alias("_line"))
        .filter(line != "")
        .select(
            "row",
            "host",
            "doc",
            *_line_key(line),
            (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"),
        )
    )


def frequent_lines(lines: DataFrame, *, min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """Lines that more than `min_docs` distinct documents and more than `max_share` of their host's documents hold."""
    per_doc = lines.groupBy("host", "l1", "l2", "doc").agg(F.lit(1).alias("one"))
    per_line = per_doc.groupBy("host", "l1", "l2").agg(F.count("*").alias("n_docs"))
    per_line = per_line.filter(F.col("n_docs") > min_docs)
    hosts = lines.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return per_line.join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("l1", "l2")


def line_quality(
    docs: DataFrame,
    *,
    host: str = "source",
    min_docs: int = 20,
    max_share: float = 0.02,
    max_removed: float = 0.7,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """The base figures, removed_words (words of lines above the limits), depleted and kept, per document."""
    lines = written(document_lines(docs, host), "lines")
    frequent = written(frequent_lines(lines, min_docs=min_docs, max_share=max_share), "frequent")
    removed = (
        lines.join(small(frequent, frequent.count(), broadcast_rows), ["l1", "l2"], "left_semi")
        .groupBy("row", "doc")
        .agg(F.sum("words").cast("long").alias("removed_words"), F.count("*").alias("_n"))
    )
    # rows with the same id and text stand in one group; each has its share of the sum
    copies = docs.groupBy(_row(host).alias("row")).agg(F.count("*").alias("_copies")).filter("_copies > 1")
    removed = removed.join(copies, "row", "left").select(
        "row", (F.col("removed_words") / F.coalesce("_copies", F.lit(1))).cast("long").alias("removed_words")
    )
    out = base_features(docs, host).join(removed, "row", "left").drop("row")
    return (
        out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("depleted", F.col("removed_words") > max_removed * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def cleaned_texts(docs: DataFrame, *, host: str = "source", min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """doc_id and text without the lines above the limits (order of lines kept); a null text stays null."""
    frequent = frequent_lines(document_lines(docs, host), min_docs=min_docs, max_share=max_share)
    rows = docs.select("doc_id", "text", F.col(host).alias("_host")).distinct()
    lines = rows.select(
        _row("_host").alias("row"), F.xxhash64("_host").alias("host"), F.posexplode(F.split("text", "\n")).alias("pos", "raw")
    )
    lines = lines.select("row", "pos", "raw", *_line_key(normalised_line(F.col("raw"))))
    left = lines.join(frequent, ["l1", "l2"], "left_anti")
    texts = left.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("_l"))
    new = F.coalesce(F.array_join(F.col("_l.raw"), "\n"), F.when(F.col("text").isNotNull(), F.lit("")))
    return docs.select("doc_id", "text", _row(host).alias("row")).join(texts, "row", "left").select("doc_id", new.alias("text"))


def op4_line_quality(spark, sf_dir: str) -> DataFrame:
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, i + k AS p FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, source, text, line,
             lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM raw),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE norm <> '' GROUP BY doc_id),
freq AS (SELECT source, norm, count(DISTINCT doc_id) AS n_docs FROM l WHERE norm <> '' GROUP BY source, norm),
host AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM l WHERE norm <> '' GROUP BY source),
hot AS (SELECT f.source, f.norm FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source
        WHERE n_docs > 20 AND n_docs > 0.02 * host_docs),
rem AS (SELECT l.doc_id, sum(len(string_split(l.norm, ' '))) AS removed
        FROM l JOIN hot ON l.norm = hot.norm AND l.source IS NOT DISTINCT FROM hot.source GROUP BY l.doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(removed, 0) AS removed
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rem USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (removed > 0.7 * n_words) AS kept
FROM b
"""
