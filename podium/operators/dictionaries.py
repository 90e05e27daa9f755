"""Dictionaries as tables: names by the way they are written, of any number and in any script.

A dictionary has a row for each (kind, source, written) with its name and a priority. Rows look their names up by a join that is
broadcast while the dictionary is counted small, so a plan has one join for each spelling that is tried, however many entries
there are; the first spelling that is found wins, a source's own entry before everyone's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions import catalog
from podium.operators.parts import words_of
from podium.sources.orders_adapter import USAGE_SQL, usage

#: Everyone's entries are those of this source.
ANY = ""
#: Entries up to which a dictionary is sent to every executor.
BROADCAST_ENTRIES = 200_000


@dataclass(frozen=True)
class Dictionary:
    """`rows` has each (kind, source, written) once; `entries` counts them."""

    rows: DataFrame
    entries: int

    def of(self, kind: str) -> DataFrame:
        rows = self.rows.filter(F.col("kind") == kind).select("source", "written", "name")
        return F.broadcast(rows) if self.entries <= BROADCAST_ENTRIES else rows


def dictionary(rows: DataFrame) -> Dictionary:
    """From rows (kind, written, name) and, where they have them, source and priority: of two names for the same the smaller
    priority wins, then the name that sorts first; entries without a text or a name are left out."""
    source = F.coalesce("source", F.lit(ANY)) if "source" in rows.columns else F.lit(ANY)
    priority = F.coalesce("priority", F.lit(0)) if "priority" in rows.columns else F.lit(0)
    rows = rows.select("kind", source.alias("source"), "written", "name", priority.alias("priority"))
    rows = rows.filter("kind IS NOT NULL AND written IS NOT NULL AND name IS NOT NULL")
    rows = rows.groupBy("kind", "source", "written").agg(F.min_by("name", F.struct("priority", "name")).alias("name"))
    return Dictionary(rows, rows.count())


def from_maps(spark: SparkSession, maps: dict[str, dict[str, str]], *, source: str = ANY) -> DataFrame:
    """Rows of small maps, one for each kind."""
    rows = [(kind, source, written, str(name), 0) for kind, own in maps.items() for written, name in own.items()]
    return spark.createDataFrame(rows, "kind string, source string, written string, name string, priority int")


def standard(spark: SparkSession) -> DataFrame:
    """The fixed values of the catalog: chips, assists, event and placement words in Japanese, and bits by source."""
    maps = {"chip": catalog.KANA_CHIPS, "assist": catalog.KANA_ASSISTS, "event": catalog.EVENT_WORDS, "place": catalog.PLACE_WORDS}
    rows = from_maps(spark, maps | {"bit": catalog.BITS})
    for source, bits in catalog.BITS_BY_SOURCE.items():
        rows = rows.union(from_maps(spark, {"bit": bits}, source=source))
    return rows


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that the rows do not have."""
    held = {c.lower() for c in rows.columns}
    while name.lower() in held:
        name += "_"
    return name


def lookup(
    rows: DataFrame, names: Dictionary, kind: str, tries: Sequence[Column | tuple[Column, Column]], into: str, otherwise: Column | None = None
) -> DataFrame:
    """`rows` with the column `into`: the name of the first of `tries` that is an entry of the kind, else `otherwise`.

    A try is what is written, or a pair of a source and what is written.
    """
    found = []
    for n, attempt in enumerate(tries):
        source, written = attempt if isinstance(attempt, tuple) else (F.lit(ANY), attempt)
        s, w, v = (fresh(rows, f"_{x}{n}") for x in ("source", "written", "name"))
        own = names.of(kind).select(F.col("source").alias(s), F.col("written").alias(w), F.col("name").alias(v))
        rows = rows.join(own, (F.col(s) == source) & (F.col(w) == written), "left").drop(s, w)
        found.append(v)
    value = F.coalesce(*[F.col(f"`{v}`") for v in found], *([otherwise] if otherwise is not None else []))
    held = fresh(rows, f"_{into}")
    return rows.withColumn(held, value).drop(into, *found).withColumnRenamed(held, into)


def unspaced(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\u3000]", "")


def translated_parts(
    rows: DataFrame, names: Dictionary, *, blade: str | None = "blade", bit: str | None = "bit", chip: str | None = None, assist: str | None = None
) -> DataFrame:
    """The named columns in the tables' names: blades as they stand and without spaces, the others as they stand; what is no
    entry stays."""
    if blade:
        rows = lookup(rows, names, "blade", [F.col(blade), unspaced(F.col(blade))], blade, F.col(blade))
    for kind, column in (("bit", bit), ("chip", chip), ("assist", assist)):
        if column:
            rows = lookup(rows, names, kind, [F.col(column)], column, F.col(column))
    return rows


def expanded_bits(rows: DataFrame, names: Dictionary, *, bit: str = "bit", source: str = "source") -> DataFrame:
    """`bit` under its name by the map of the row's source, which is the only one for a source that has its own; other sources
    read everyone's map. Sources of `catalog.UPPER_BITS` write it in any case: it stays in capitals where it is no entry."""
    plain = F.trim(F.col(bit))
    code = F.when(F.col(source).isin(catalog.UPPER_BITS), F.upper(plain)).otherwise(plain)
    own = names.of("bit").filter(F.col("source") != ANY).select("source").distinct()
    has, flag = fresh(rows, "_own"), fresh(rows, "_has_own")
    own = F.broadcast(own.select(F.col("source").alias(has), F.lit(True).alias(flag)))  # a row for each source with a map
    rows = rows.join(own, F.col(has) == F.col(source), "left").drop(has)
    by = F.when(F.col(f"`{flag}`"), F.col(source)).otherwise(F.lit(ANY))
    return lookup(rows, names, "bit", [(by, code)], bit, code).drop(flag)


def place_of(rows: DataFrame, names: Dictionary, written: str, into: str = "place") -> DataFrame:
    """The number of a placement word, null where it is none."""
    rows = lookup(rows, names, "place", [F.trim(F.col(written))], into)
    return rows.withColumn(into, F.col(into).cast("int"))


def replaced_words(rows: DataFrame, names: Dictionary, column: str, *, kind: str = "event", most: int = 24) -> DataFrame:
    """`column` with every entry that its text holds replaced, from left to right, the longest one at each place; entries of up
    to `most` characters are found. Each different text is worked out once: its pieces of every length are looked up by a join.
    """
    text = rows.select(F.col(column).alias("t")).filter("t IS NOT NULL").distinct()
    place = text.select("t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)))).alias("i"))
    size = F.least(F.lit(most), F.length("t") - F.col("i") + 1)
    piece = place.filter("length(t) > 0").select("t", "i", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    piece = piece.withColumn("w", F.substring("t", F.col("i"), F.col("n")))
    entry = names.of(kind).filter(F.col("source") == ANY).select(F.col("written").alias("w"), "name")
    hits = piece.join(entry, "w").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("n")).alias("n"), "name"))).alias("hits"))
    # the state: what has been written, and the place after what has been read
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, h: F.when(h["i"] < s["at"], s).otherwise(
        F.struct(F.concat(s["out"], F.substring(F.col("t"), s["at"], h["i"] - s["at"]), h["name"]).alias("out"), (h["i"] - h["n"]).alias("at"))
    )
    done = hits.select("t", F.aggregate("hits", start, step).alias("s"))
    done = done.select(F.col("t").alias("_t"), F.concat("s.out", F.substring(F.col("t"), F.col("s.at"), F.length("t"))).alias("_new"))
    key, new = fresh(rows, "_text"), fresh(rows, "_replaced")
    done = done.toDF(key, new)
    out = rows.join(done, F.col(column) == F.col(f"`{key}`"), "left")
    return out.withColumn(column, F.coalesce(F.col(f"`{new}`"), F.col(column))).drop(key, new)


# -- the normaliser -----------------------------------------------------------------------------------------------


def rewrites(rules: DataFrame, *, most: int = 1_000_000) -> Dictionary:
    """The ordered rules (kind, step, written, name) as one dictionary that has what all of them together make of a name: later
    rules see what earlier ones made. Rules of one kind follow each other by `step`; a text is rewritten by one rule of a step,
    the one whose name sorts first. Up to `most` rules are folded on the driver."""
    spark = rules.sparkSession
    rows = rules.groupBy("kind", "step", "written").agg(F.min("name").alias("name")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    made: dict[tuple[str, str], str] = {}
    steps: dict[tuple[str, int], list] = {}
    for r in rows:
        steps.setdefault((r["kind"], r["step"]), []).append(r)
    for _, own in sorted(steps.items(), reverse=True):  # the later steps are known
        new = {(r["kind"], r["written"]): made.get((r["kind"], r["name"]), r["name"]) for r in own}
        made.update(new)
    out = spark.createDataFrame([(k, w, n) for (k, w), n in made.items()], "kind string, written string, name string")
    return dictionary(out)


def normalised(rows: DataFrame, names: Dictionary, columns: dict[str, str]) -> DataFrame:
    """The rows with the columns rewritten by the rules of their kinds ({column: kind}), and `fixes`, how many of them changed."""
    before = {c: fresh(rows, f"_before_{c}") for c in columns}
    fixes = fresh(rows, "_fixes")
    out = rows.withColumns({held: F.col(c) for c, held in before.items()})
    for column, kind in columns.items():
        out = lookup(out, names, kind, [F.col(column)], column, F.col(column))
    changed = sum((F.when(~F.col(c).eqNullSafe(F.col(held)), 1).otherwise(0) for c, held in before.items()), F.lit(0))
    total = changed + (F.col("fixes") if "fixes" in rows.columns else F.lit(0))
    return out.withColumn(fixes, total).drop("fixes", *before.values()).withColumnRenamed(fixes, "fixes")


# -- series by the dimension of parts -----------------------------------------------------------------------------


def series_names(parts: DataFrame) -> Dictionary:
    """The lines of the blades in the dimension of parts."""
    blades = parts.filter("type = 'blade' AND series IS NOT NULL")
    return dictionary(blades.select(F.lit("series").alias("kind"), F.col("name").alias("written"), F.col("series").alias("name")))


def with_series(rows: DataFrame, series: Dictionary, *, blade: str = "blade", into: str = "series") -> DataFrame:
    """`rows` with the line of each blade: by its whole name, else by its last word, else by its first; null where none is one."""
    words = words_of(F.col(blade))
    return lookup(rows, series, "series", [F.col(blade), F.element_at(words, -1), F.get(words, F.lit(0))], into)


# -- queries ------------------------------------------------------------------------------------------------------

_LATIN, _KANA = "abcdefghijklmnopqrstuvwxyz0123456789", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤ"


def _kana_dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    """An entry for every part: its name and key in katakana; names of large parts are there twice, the second time too late."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat_ws(" ", "p_name", "p_partkey")
    written = F.translate(F.replace(name, F.lit(" "), F.lit("")), _LATIN, _KANA)
    rows = part.select(F.lit("blade").alias("kind"), written.alias("written"), name.alias("name"), F.lit(0).alias("priority"), "p_size")
    late = rows.filter("p_size > 25").withColumns({"name": F.lit("A wrong name"), "priority": F.lit(1)})
    bits = from_maps(spark, {"bit": {"フラット": "Flat", "ハイニードル": "High Needle", "ボール": "Ball"}}).drop("source")
    own = rows.union(late).drop("p_size").unionByName(bits).withColumn("source", F.lit(ANY))
    return dictionary(own.unionByName(standard(spark)))


def _translated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line's part in katakana, whole, with a space in it, or unknown; with a bit, a chip and an assist."""
    names = _kana_dictionary(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("p"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    kana = F.translate(F.replace("p", F.lit(" "), F.lit("")), _LATIN, _KANA)
    how = F.col("l_orderkey") % 4
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.when(how == 1, F.concat(F.substring(kana, 1, 2), F.lit("　"), F.substring(kana, 3, 99)))
        .when(how == 2, F.concat(kana, F.lit("々")))
        .otherwise(kana)
        .alias("blade"),
        pick(["フラット", "ハイニードル", "ボール", "QQ", None], F.col("l_linenumber")).alias("bit"),
        pick([*catalog.KANA_CHIPS, "ドラ"], F.col("l_partkey")).alias("chip"),
        pick([*catalog.KANA_ASSISTS, "X"], F.col("l_orderkey")).alias("assist"),
    )
    out = translated_parts(rows, names, chip="chip", assist="assist")
    return out.groupBy("blade", "bit", "chip", "assist").agg(F.count("*").alias("n"))


def _event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tournament's name in Japanese words, and its placement word, translated."""
    names = dictionary(standard(spark))
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(k, F.lit(len(xs))) + 1).cast("int"))
    days = F.datediff("tournament_date", F.lit("1970-01-01").cast("date"))
    rows = usage(spark, sf_dir).select("tournament_id", "tournament_date", "region", "place").distinct()
    words = [*catalog.EVENT_WORDS]
    title = F.concat(
        F.col("region"), F.lit(" "), pick(words[6:16], F.floor(days / 7)), pick(words[:6], F.floor(days / 70)),
        F.when(F.floor(days / 7) % 2 == 0, F.lit("(準決勝)")).otherwise("・決勝戦"),
    )
    rows = rows.select("tournament_id", "place", title.alias("title"), pick([*catalog.PLACE_WORDS, "4位"], F.col("place")).alias("word"))
    out = place_of(replaced_words(rows, names, "title"), names, "word", "read")
    return out.select("tournament_id", "title", "word", "read").distinct()


def _source_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code of any source's map, read as each source reads it, counted over the order lines that draw it."""
    codes = sorted({*catalog.BITS, *[x for own in catalog.BITS_BY_SOURCE.values() for x in own], "zz", "fb"})
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        pick(codes, F.col("l_partkey")).alias("code"), pick(["de", "jp", "en"], F.col("l_orderkey")).alias("source")
    )
    out = expanded_bits(rows.withColumn("bit", F.concat(F.lit(" "), "code")), dictionary(standard(spark)))
    return out.groupBy("source", "code", "bit").agg(F.count("*").alias("n"))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage rewritten by chains of rules: a brand becomes the next one up to a multiple of five; of two rules for bits the
    second is too early to see what the first made."""
    rows = usage(spark, sf_dir)
    number = F.regexp_extract("blade", r"(\d+)", 1).cast("int")
    brands = rows.select("blade", number.alias("step")).distinct().filter("step % 5 <> 0")
    rules = brands.select(F.lit("blade").alias("kind"), "step", F.col("blade").alias("written"), F.concat(F.lit("Brand#"), F.col("step") + 1).alias("name"))
    bits = spark.createDataFrame([("bit", 2, "ECONOMY", "SMALL"), ("bit", 1, "SMALL", "LARGE"), ("bit", 3, "MEDIUM", None)], rules.schema)
    out = normalised(rows, rewrites(rules.union(bits)), {"blade": "blade", "bit": "bit", "lock_chip": "chip"})
    return out.groupBy("blade", "bit", "fixes").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ing_translate_tables": _translated_lines,
    "ing_translate_words": _event_words,
    "ing_bit_by_source": _source_bits,
    "ing_normalise_tables": _normalised,
}


def _texts(xs: Sequence[str | None]) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


def _case(column: str, table: dict, otherwise: str) -> str:
    return f"CASE {column}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


def _replace(text: str, table: dict[str, str]) -> str:
    for written in sorted(table, key=len, reverse=True):
        text = f"replace({text}, '{written}', '{table[written]}')"
    return text


_CODES = sorted({*catalog.BITS, *[x for own in catalog.BITS_BY_SOURCE.values() for x in own], "zz", "fb"})
ORACLE_SQL: dict[str, str] = {
    "ing_translate_tables": f"""WITH l AS (SELECT l_orderkey % 4 AS how, p_name || ' ' || p_partkey AS name, p_size,
  translate(replace(p_name, ' ', '') || p_partkey, '{_LATIN}', '{_KANA}') AS kana,
  ['Flat', 'High Needle', 'Ball', 'QQ', NULL][l_linenumber % 5 + 1] AS bit,
  {_texts([*catalog.KANA_CHIPS.values(), "ドラ"])}[l_partkey % 13 + 1] AS chip,
  {_texts([*catalog.KANA_ASSISTS.values(), "X"])}[l_orderkey % {len(catalog.KANA_ASSISTS) + 1} + 1] AS assist
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CASE how WHEN 2 THEN kana || '々' ELSE name END AS blade, bit, chip, assist, count(*) AS n FROM l GROUP BY ALL""",
    "ing_translate_words": f"""WITH {USAGE_SQL}, d AS (SELECT DISTINCT tournament_id, region, place, date_diff('day', DATE '1970-01-01', tournament_date) AS days FROM u),
t AS (SELECT tournament_id, region || ' ' || {_texts([*catalog.EVENT_WORDS.values()][6:16])}[days // 7 % 10 + 1] || {_texts([*catalog.EVENT_WORDS.values()][:6])}[days // 70 % 6 + 1]
  || CASE WHEN days // 7 % 2 = 0 THEN '(Semi-Finals)' ELSE '・Finals戦' END AS title, {_texts([*catalog.PLACE_WORDS, "4位"])}[place % 7 + 1] AS word,
  [{", ".join(map(str, catalog.PLACE_WORDS.values()))}, NULL][place % 7 + 1] AS read FROM d)
SELECT DISTINCT tournament_id, title, word, CAST(read AS INTEGER) AS read FROM t""",
    "ing_bit_by_source": f"""WITH l AS (SELECT {_texts(_CODES)}[l_partkey % {len(_CODES)} + 1] AS code, ['de', 'jp', 'en'][l_orderkey % 3 + 1] AS source FROM lineitem)
SELECT source, code, CASE source WHEN 'de' THEN {_case('upper(code)', catalog.BITS_BY_SOURCE['de'], 'upper(code)')}
  WHEN 'jp' THEN {_case('code', catalog.BITS_BY_SOURCE['jp'], 'code')} ELSE {_case('code', catalog.BITS, 'code')} END AS bit, count(*) AS n FROM l GROUP BY ALL""",
    "ing_normalise_tables": f"""WITH {USAGE_SQL}, b AS (SELECT blade, CAST(regexp_extract(blade, '[0-9]+') AS INTEGER) AS k FROM (SELECT DISTINCT blade FROM u)),
-- the chain from a brand goes on while the next one is there too
c AS (SELECT blade, k, (SELECT min(y.k) FROM b y WHERE y.k >= b.k AND (y.k % 5 = 0 OR NOT EXISTS (SELECT 1 FROM b z WHERE z.k = y.k + 1))) AS e FROM b),
n AS (SELECT blade, CASE WHEN e % 5 = 0 THEN 'Brand#' || e ELSE 'Brand#' || (e + 1) END AS new FROM c),
r AS (SELECT new AS blade, CASE bit WHEN 'ECONOMY' THEN 'SMALL' WHEN 'SMALL' THEN 'LARGE' ELSE bit END AS bit,
      CASE WHEN new <> u.blade THEN 1 ELSE 0 END + CASE WHEN bit IN ('ECONOMY', 'SMALL') THEN 1 ELSE 0 END AS fixes FROM u JOIN n ON n.blade = u.blade)
SELECT blade, bit, fixes, count(*) AS n FROM r GROUP BY ALL""",
}
