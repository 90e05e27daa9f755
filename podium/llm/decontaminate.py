"""Benchmark decontamination as a prefix-filtered set join.

An item's windows of 13 words are the sets to find; a document contains a window only if it holds every shingle of it,
so one shingle per window, the one rarest in the corpus, is a sufficient prefix (containment 1 needs a prefix of one).
Document positions meet prefixes on the shingle hash; positional bounds (the window must start and end inside the
document) drop what cannot fit, and the words themselves are compared before a match counts.

One pass over the documents keeps the places of benchmark shingles: (document, position, hash), never the text. The
shingles are broadcast while there are at most `broadcast_rows` of them; above that Spark shuffles both narrow sides.
Rarity is counted and prefixes are joined on what that pass kept. Texts are read again only for documents with a candidate.

Edge cases: null or empty text has no words and is never contaminated; very long texts are read whole; an item without
words has no window; an item shorter than a window is one window of its own length; repeated items and windows match once
per item id; ties of rarity are broken by the place in the window; an empty benchmark leaves every document clean; a
document is judged by its own text, so rows that share an id, or have a null one, are judged each by itself; columns besides
those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import small, whole_text, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are neither letters nor digits.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def item_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    plain = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _hash_at(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(n)])


def _row() -> Column:
    """The name of a document: its id and text."""
    return F.xxhash64(F.col("doc_id"), whole_text())


def windows_of(benchmark: DataFrame, *, window: int = 13) -> DataFrame:
    """One row per distinct (item_id, words) window: item_id, w, n."""
    items = benchmark.select("item_id", item_words(whole_text()).alias("_iw")).filter(F.size("_iw") > 0)
    size = F.size("_iw")
    return (
        items.select("item_id", "_iw", F.explode(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))).alias("_s"))
        .select("item_id", F.slice("_iw", F.col("_s") + 1, window).alias("w"))
        .distinct()
        .withColumn("n", F.size("w"))
    )


def _shingles(windows: DataFrame, width: int, shingle: int) -> DataFrame:
    """(w, n, width, off, h): the shingles of windows that are joined on `width` words."""
    own = windows.filter(F.col("n") >= width if width == shingle else F.col("n") == width)
    return (
        own.select("w", "n", F.lit(width).alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("off"))
        .withColumn("h", _hash_at(F.col("w"), F.col("off"), width))
    )


def _places(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(row, n_words, pos, h): every place in a document where a shingle of one of the widths starts."""
    words = docs.select(_row().alias("row"), item_words(whole_text()).alias("dw"))
    words = words.withColumn("n_words", F.size("dw")).filter(F.col("n_words") >= widths[0])
    at = words.select("row", "dw", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words") - widths[0])).alias("pos"))
    pos = F.col("pos")
    if len(widths) == 1:
        return at.select("row", "n_words", "pos", _hash_at(F.col("dw"), pos, widths[0]).alias("h"))
    hashes = [F.when(pos + k <= F.col("n_words"), _hash_at(F.col("dw"), pos, k)) for k in widths]
    out = at.select("row", "n_words", "pos", F.explode(F.array(*hashes)).alias("h"))
    return out.filter(F.col("h").isNotNull())


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    shingle: int = 5,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(row, item_id, start, n): every occurrence of an item's window in a document; row is xxhash64(doc_id, text)."""
    windows = written(windows_of(benchmark, window=window), "windows")
    widths = sorted(r["k"] for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect())
    if not widths:
        return docs.select(_row().alias("row")).limit(0).crossJoin(
            benchmark.select("item_id", F.lit(0).alias("start"), F.lit(0).alias("n")).limit(0)
        )
    distinct = windows.select("w", "n").distinct()
    parts = _shingles(distinct, widths[0], shingle)
    for width in widths[1:]:
        parts = parts.unionByName(_shingles(distinct, width, shingle))
    parts = written(parts, "shingles")
    wanted = written(parts.select("h").distinct(), "wanted")
    met = written(_places(docs, widths).join(small(wanted, wanted.count(), broadcast_rows), "h"), "places")
    rarity = met.groupBy("h").agg(F.count("*").alias("df"))
    # a window with a shingle that no document holds cannot occur: the inner join leaves it incomplete
    own = Window.partitionBy("w")
    prefix = (
        parts.join(rarity, "h")
        .withColumn("_k", F.row_number().over(own.orderBy("df", "off", "h")))
        .withColumn("_all", F.count("*").over(own))
        .filter((F.col("_k") == 1) & (F.col("_all") == F.col("n") - F.col("width") + 1))
        .select("w", "n", "h", "off")
    )
    prefix = written(prefix, "prefix")
    start = F.col("pos") - F.col("off")
    likely = (
        met.join(small(prefix, prefix.count(), broadcast_rows), "h")
        .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .select("row", F.struct(start.alias("start"), "n", "w").alias("c"))
        .distinct()
    )
    likely = written(likely.groupBy("row").agg(F.collect_list("c").alias("cs")), "likely")
    rows = likely.select("row")
    texts = docs.select(_row().alias("row"), whole_text().alias("text"))
    texts = texts.join(small(rows, rows.count(), broadcast_rows), "row", "left_semi").dropDuplicates(["row"])
    dw = texts.select("row", item_words(F.col("text")).alias("dw"))
    same = F.filter("cs", lambda c: F.slice(F.col("dw"), c["start"] + 1, c["n"]) == c["w"])
    hits = dw.join(likely, "row").select("row", F.explode(same).alias("c")).select("row", "c.*")
    return hits.join(windows.select("item_id", "w"), "w").select("row", "item_id", "start", "n")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, shingle: int = 5) -> DataFrame:
    """Per document: doc_id, row (xxhash64 of id and text), n_words, n_hit, n_items, items (sorted ids as strings) and
    contaminated (a twentieth or more hit)."""
    found = written(matches(docs, benchmark, window=window, shingle=shingle), "matches")
    order = Window.partitionBy("row").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    hit = (
        spans.withColumn("_from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.col("end") - F.col("_from"), F.lit(0))).alias("n_hit"))
    )
    items = (
        found.select("row", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    base = docs.select("doc_id", _row().alias("row"), F.size(item_words(whole_text())).cast("long").alias("n_words"))
    out = base.join(hit.join(items, "row"), "row", "left").select(
        "doc_id",
        "row",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, shingle: int = 5) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, window=window, shingle=shingle).filter("contaminated").select("row").distinct()
    return docs.join(bad, _row() == bad["row"], "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + 12] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
