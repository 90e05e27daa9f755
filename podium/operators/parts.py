"""Names of parts as they are written, to the names of the tables: all column functions over a catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import catalog
from podium.sources import commits
from podium.sources.orders_adapter import USAGE_SQL, usage


def table_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def found_in(values: dict[str, str], key: Column) -> Column:
    """The key's value, null where it has none."""
    return F.try_element_at(table_of(values), key) if values else F.lit(None).cast("string")


def title_case(text: Column) -> Column:
    """Every letter that follows no letter in upper case, the others in lower case."""
    letters = F.split(text, "")
    cased = F.transform(
        letters, lambda c, i: F.when((i > 0) & F.get(letters, i - 1).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))
    )
    return F.array_join(cased, "")


def squeezed(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.trim(text), r"\s+"), "")


# -- compound blades ----------------------------------------------------------------------------------------------


def compound(blade: Column, chips: list[str] = catalog.LOCK_CHIPS, mains: list[str] = catalog.MAIN_BLADES) -> Column:
    """(lock_chip, blade) of a compound blade in either order, with or without a space and a variant letter; of any other
    name the chip is null and the name stays."""
    name = F.trim(blade)
    name = F.when(name.rlike(r"^.+ [WSAFHTJ]$"), F.substring(name, F.lit(1), F.length(name) - 2)).otherwise(name)
    low = F.lower(name)
    together = F.regexp_replace(low, " ", "")
    one, two = "|".join(c.lower() for c in chips), "|".join(m.lower() for m in mains)
    pair = lambda a, b: F.struct(a.alias("lock_chip"), b.alias("blade"))
    part = lambda pattern, i: F.initcap(F.regexp_extract(together, pattern, i))
    out = None
    for whole, (chip, main) in catalog.COMPOUND_EXCEPTIONS.items():
        hit = low == whole.lower()
        out = F.when(hit, pair(F.lit(chip), F.lit(main))) if out is None else out.when(hit, pair(F.lit(chip), F.lit(main)))
    forward, backward = f"^({one})({two})", f"^({two})({one})"
    return (
        out.when(together.rlike(forward), pair(part(forward, 1), part(forward, 2)))
        .when(together.rlike(backward), pair(part(backward, 2), part(backward, 1)))
        .otherwise(pair(F.lit(None).cast("string"), blade))
    )


def compound_flags(
    blade: Column,
    lock_chip: Column,
    rewrites: dict[str, str] | None = None,
    mains: list[str] = catalog.MAIN_BLADES,
    default_chips: dict[str, str] = catalog.DEFAULT_CHIPS,
) -> Column:
    """(incomplete, impossible, repaired): a main blade without a chip; two main blades; the name put right."""
    parts = words_of(blade)
    low = [m.lower() for m in mains]
    impossible = (F.size(parts) == 2) & F.lower(F.get(parts, F.lit(0))).isin(low) & F.lower(F.get(parts, F.lit(1))).isin(low)
    main = F.initcap(F.get(parts, F.lit(0)))
    chip = found_in(default_chips, main)
    repaired = F.coalesce(found_in(rewrites or {}, blade), F.when(impossible, F.concat_ws(" ", chip, main)), blade)
    return F.struct(
        F.coalesce(blade.isin(mains) & lock_chip.isNull(), F.lit(False)).alias("incomplete"),
        F.coalesce(impossible, F.lit(False)).alias("impossible"),
        repaired.alias("repaired"),
    )


# -- blades, assists, bits ----------------------------------------------------------------------------------------


def blade_keys(blades: list[str], spellings: dict[str, str]) -> dict[str, str]:
    """Lower-case names without spaces, in both word orders, and the proper name of each; later blades win."""
    out = {}
    for name in blades:
        out[name.lower().replace(" ", "")] = name
        words = name.split()
        if len(words) == 2:
            out[f"{words[1]}{words[0]}".lower()] = name
    return out | spellings


def canonical_blade(
    blade: Column, blades: list[str] = catalog.BLADES, spellings: dict[str, str] = catalog.BLADE_SPELLINGS
) -> Column:
    """The proper name of a blade: by its letters, by swapped words, by the words of a name in camel case; else in title
    case where it has several words."""
    plain = F.trim(F.regexp_replace(F.trim(blade), "^-+", ""))
    camel = F.regexp_replace(plain, "([a-z])([A-Z])", "$1 $2")
    keys = table_of(blade_keys(blades, spellings))

    def swapped(text: Column) -> Column:
        parts = words_of(text)
        return F.when(F.size(parts) == 2, F.lower(F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))))

    tries = [F.try_element_at(keys, k) for k in (squeezed(plain), swapped(plain), swapped(camel))]
    return F.coalesce(*tries, F.when(camel.contains(" "), title_case(camel)), plain)


def split_assist(text: Column, assists: dict[str, str] = catalog.ASSISTS) -> Column:
    """(blade, assist): a last word that is an assist, its abbreviation, or one or two capitals."""
    parts = words_of(text)
    last = F.element_at(parts, -1)
    names = [a.lower() for a in assists.values()]
    is_assist = (F.size(parts) > 1) & (
        last.isin(list(assists)) | F.lower(last).isin(names) | ((F.length(last) <= 2) & last.rlike("^[^a-z]*[A-Z][^a-z]*$"))
    )
    rest = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.struct(
        canonical_blade(F.when(is_assist, rest).otherwise(F.trim(text))).alias("blade"),
        F.when(is_assist, F.coalesce(found_in(assists, last), last)).alias("assist"),
    )


def expanded_bit(bit: Column, bits: dict[str, str] = catalog.BITS, spaced: list[str] = catalog.SPACED_BITS) -> Column:
    """The bit's full name from an abbreviation or a name written as one word."""
    table = bits | {name.replace(" ", ""): name for name in spaced}
    plain = F.trim(bit)
    return F.coalesce(found_in(table, plain), plain)


# -- other scripts ------------------------------------------------------------------------------------------------


def is_japanese(text: Column) -> Column:
    return text.rlike("[\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FFF]")


def translated(name: Column, names: dict[str, str], *, squeeze: bool = False) -> Column:
    """The name's translation, tried as it stands and, with `squeeze`, without spaces; the name itself where it has none."""
    tries = [found_in(names, name)]
    if squeeze:
        tries.append(found_in(names, F.regexp_replace(name, "[ \\u3000]", "")))
    return F.coalesce(*tries, name)


def translated_combo(text: Column, blades: dict[str, str], bits: dict[str, str]) -> Column:
    """(blade, ratchet, bit) of a whole combo in katakana, in parts where the pattern does not match."""
    plain, pattern = F.trim(text), r"^(.+?)\s+(\d{1,2}-\d{2,3})([A-Za-zァ-ヶー]+)$"
    parts = words_of(plain)
    at = lambda i: F.get(parts, F.lit(i))
    make = lambda a, b, c: F.struct(a.alias("blade"), b.alias("ratchet"), c.alias("bit"))
    blade = lambda x: translated(x, blades, squeeze=True)
    group = lambda i: F.regexp_extract(plain, pattern, i)
    return (
        F.when(plain.rlike(pattern), make(blade(F.trim(group(1))), group(2), translated(group(3), bits)))
        .when(F.size(parts) >= 3, make(blade(at(0)), at(1), translated(at(2), bits)))
        .when(F.size(parts) == 2, make(blade(at(0)), at(1), F.lit("")))
        .otherwise(make(text, F.lit(""), F.lit("")))
    )


# -- the dimension of parts ---------------------------------------------------------------------------------------


def parts_dimension(rows: DataFrame) -> DataFrame:
    """(name, type, spin_direction, series, notes), ordered by type and name; a name twice in a type is an error."""
    twice = rows.groupBy("type", "name").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("a part stands twice in the table")
    return rows.select("name", "type", "spin_direction", "series", "notes").orderBy("type", "name")


def load_parts(rows: DataFrame, path: str) -> int:
    """Put the dimension in the place of the one stored at `path`, by one commit; how many parts it has."""
    rows = parts_dimension(rows).withColumn("source", F.lit("parts"))
    spark = rows.sparkSession
    _, added = commits.add_files(rows.coalesce(1), path)
    commits.update(spark, path, lambda at: replace(at, schema=rows.schema.json(), batches=tuple(added)))
    return sum(b.rows for b in added)


def stored_parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, spin_direction, series, notes) of the stored dimension."""
    return commits.read(spark, path).drop("source")


def series_of(blade: Column, series: dict[str, str]) -> Column:
    """The line of a blade: by its whole name, else by its last word, else by its first."""
    parts = words_of(blade)
    return F.coalesce(
        found_in(series, blade), found_in(series, F.element_at(parts, -1)), found_in(series, F.get(parts, F.lit(0)))
    )


# -- queries: the names of the tables' parts written in the ways that reports write them -----------------------------


def written_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, name): a chip and a main blade drawn by the part's key, in eight spellings."""
    key = F.col("p_partkey")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    chip, main = pick(catalog.LOCK_CHIPS, key), pick(catalog.MAIN_BLADES, F.floor(key / 7))
    other = pick(catalog.MAIN_BLADES, F.floor(key / 3) + 1)
    text = F.element_at(
        F.array(
            F.concat_ws(" ", chip, main),
            F.concat_ws(" ", main, chip),
            F.concat(chip, main),
            F.lower(F.concat_ws(" ", chip, main)),
            F.concat_ws(" ", chip, main, pick(["W", "S", "A", "J"], key)),
            F.concat_ws(" ", main, other),
            F.concat_ws(" ", F.col("p_brand"), F.col("p_type")),
            main,
        ),
        (key % 8 + 1).cast("int"),
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("name"))


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written_names(spark, sf_dir).select("p_partkey", "name", compound(F.col("name")).alias("c"))
    return rows.select("p_partkey", "name", "c.lock_chip", "c.blade")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written_names(spark, sf_dir).withColumn("c", compound(F.col("name")))
    flags = compound_flags(F.col("name"), F.col("c.lock_chip"), {"Might Blast": "Emperor Might"})
    return rows.select("p_partkey", flags.alias("f")).select("p_partkey", "f.*")


def _blades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blades drawn by the part's key, written in six ways with an assist in some."""
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(b) for b in catalog.BLADES]), (key % len(catalog.BLADES) + 1).cast("int"))
    parts = F.split(name, " ")
    swapped = F.concat_ws(" ", parts[1], parts[0])
    assist = F.element_at(F.array(*[F.lit(x) for x in ("S", "Jaggy", "wheel", "XY")]), (F.floor(key / 6) % 4 + 1).cast("int"))
    text = F.element_at(
        F.array(
            name,
            F.replace(name, F.lit(" "), F.lit("")),
            swapped,
            F.concat(F.lit("- "), F.lower(name)),
            F.concat_ws(" ", name, assist),
            F.concat_ws(" ", F.lower("p_brand"), F.lower(F.substring("p_type", 1, 4))),
        ),
        (F.floor(key / 2) % 6 + 1).cast("int"),
    )
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("text"))
    out = rows.withColumn("s", split_assist(F.col("text")))
    return out.select("p_partkey", "text", canonical_blade(F.col("text")).alias("canonical"), "s.blade", "s.assist")


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    codes = [*catalog.BITS, *[x.replace(" ", "") for x in catalog.SPACED_BITS], "Other", "High Needle"]
    code = F.element_at(F.array(*[F.lit(x) for x in codes]), (key % len(codes) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", code.alias("code"))
    return rows.select("p_partkey", "code", expanded_bit(F.concat(F.lit(" "), "code")).alias("bit"))


#: What the translation query reads brands and types as (the tables hold no katakana).
KANA_BLADES = {"ドランソード": "Dran Sword", "ヘルズサイズ": "Hells Scythe", "ペガサスブラスト": "Pegasus Blast"}
KANA_BITS = {"フラット": "Flat", "ハイニードル": "High Needle"}


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    blade = pick([*KANA_BLADES, "ドラン ソード", "Brand"], key)
    bit = pick([*KANA_BITS, "F"], F.floor(key / 5))
    ratchet = F.concat((size % 9 + 1).cast("string"), F.lit("-60"))
    text = F.concat(blade, F.lit(" "), ratchet, F.when(key % 4 == 0, " ").otherwise(""), bit)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("text"))
    out = rows.withColumn("c", translated_combo(F.col("text"), KANA_BLADES, KANA_BITS))
    return out.select("p_partkey", "text", "c.blade", "c.ratchet", "c.bit", is_japanese(F.col("text")).alias("japanese"))


def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that were used, as a dimension: blades carry their line."""
    kinds = "stack(3, 'blade', blade, series, 'ratchet', ratchet, NULL, 'bit', bit, NULL) AS (type, name, series)"
    rows = usage(spark, sf_dir).select(F.expr(kinds)).distinct()
    spin = F.when(F.col("type") == "blade", F.when(F.col("name").endswith("5"), "left").otherwise("right"))
    return parts_dimension(rows.withColumns({"spin_direction": spin, "notes": F.lit(None).cast("string")}))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ing_cx_parse": _compounds,
    "ing_cx_flags": _flags,
    "ing_blade_canon": _blades,
    "ing_bit_expand": _bits,
    "ing_translate": _translated,
    "src_parts": _dimension,
}


def _values(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _case(column: str, table: dict[str, str], otherwise: str) -> str:
    return "CASE " + column + " ".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


_NAMES = f"""n AS (SELECT p_partkey, k, c, m, o, CASE k WHEN 0 THEN c || ' ' || m WHEN 1 THEN m || ' ' || c WHEN 2 THEN c || m
  WHEN 3 THEN lower(c || ' ' || m) WHEN 4 THEN c || ' ' || m || ' ' || v WHEN 5 THEN m || ' ' || o
  WHEN 6 THEN p_brand || ' ' || p_type ELSE m END AS name
FROM (SELECT *, p_partkey % 8 AS k, {_values(catalog.LOCK_CHIPS)}[p_partkey % 18 + 1] AS c,
  {_values(catalog.MAIN_BLADES)}[(p_partkey // 7) % 16 + 1] AS m, {_values(catalog.MAIN_BLADES)}[(p_partkey // 3 + 1) % 16 + 1] AS o,
  ['W', 'S', 'A', 'J'][p_partkey % 4 + 1] AS v FROM part))"""
#: What the names were made of: nothing else may be read from them.
_TRUE_MAIN = "CASE WHEN c = 'Pegasus' AND m = 'Flame' AND k IN (0, 3, 4) THEN 'Flare' ELSE m END"
ORACLE_SQL: dict[str, str] = {
    "ing_cx_parse": f"""WITH {_NAMES} SELECT p_partkey, name, CASE WHEN k < 5 THEN c END AS lock_chip,
CASE WHEN k < 5 THEN {_TRUE_MAIN} ELSE name END AS blade FROM n""",
    "ing_cx_flags": f"""WITH {_NAMES} SELECT p_partkey, k = 7 AS incomplete, k = 5 AS impossible,
CASE WHEN k = 5 AND name = 'Might Blast' THEN 'Emperor Might' WHEN k = 5 THEN coalesce({_case('m', catalog.DEFAULT_CHIPS, 'NULL')} || ' ', '') || m
     ELSE name END AS repaired FROM n""",
    "ing_blade_canon": f"""WITH b AS (SELECT p_partkey, p_brand, p_type, (p_partkey // 2) % 6 AS k, {_values(catalog.BLADES)}[p_partkey % {len(catalog.BLADES)} + 1] AS name,
  ['S', 'Jaggy', 'wheel', 'XY'][(p_partkey // 6) % 4 + 1] AS a FROM part),
t AS (SELECT *, CASE k WHEN 0 THEN name WHEN 1 THEN replace(name, ' ', '') WHEN 2 THEN split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1)
  WHEN 3 THEN '- ' || lower(name) WHEN 4 THEN name || ' ' || a ELSE lower(p_brand) || ' ' || lower(substr(p_type, 1, 4)) END AS text,
  CASE name WHEN 'Unicorn Sting' THEN 'Sting Unicorn' ELSE name END AS proper,
  upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) || ' ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2, 3)) AS titled FROM b)
SELECT p_partkey, text, CASE WHEN k < 4 THEN proper WHEN k = 4 THEN name || ' ' || upper(a[1]) || lower(a[2:]) ELSE titled END AS canonical,
CASE WHEN name = 'Driger Slash' AND k = 0 THEN 'Driger' WHEN name = 'Driger Slash' AND k = 3 THEN 'driger' WHEN k = 5 THEN titled ELSE proper END AS blade,
CASE WHEN name = 'Driger Slash' AND k = 0 THEN 'Slash' WHEN name = 'Driger Slash' AND k = 3 THEN 'slash' WHEN k = 4 THEN CASE a WHEN 'S' THEN 'Slash' ELSE a END END AS assist FROM t""",
    "ing_bit_expand": f"""WITH c AS (SELECT p_partkey, {_values([*catalog.BITS, *[x.replace(' ', '') for x in catalog.SPACED_BITS], 'Other', 'High Needle'])}[p_partkey % {len(catalog.BITS) + len(catalog.SPACED_BITS) + 2} + 1] AS code FROM part)
SELECT p_partkey, code, {_case('code', catalog.BITS | {x.replace(' ', ''): x for x in catalog.SPACED_BITS}, 'code')} AS bit FROM c""",
    "ing_translate": """WITH t AS (SELECT p_partkey, ['ドランソード', 'ヘルズサイズ', 'ペガサスブラスト', 'ドラン ソード', 'Brand'][p_partkey % 5 + 1] AS b,
  ['フラット', 'ハイニードル', 'F'][(p_partkey // 5) % 3 + 1] AS f, (p_size % 9 + 1) || '-60' AS r, p_partkey % 4 = 0 AS apart FROM part),
e AS (SELECT *, CASE b WHEN 'ドランソード' THEN 'Dran Sword' WHEN 'ヘルズサイズ' THEN 'Hells Scythe' WHEN 'ペガサスブラスト' THEN 'Pegasus Blast'
  WHEN 'ドラン ソード' THEN 'Dran Sword' ELSE b END AS eb, CASE f WHEN 'フラット' THEN 'Flat' WHEN 'ハイニードル' THEN 'High Needle' ELSE f END AS ef FROM t)
SELECT p_partkey, b || ' ' || r || CASE WHEN apart THEN ' ' ELSE '' END || f AS text,
CASE WHEN apart AND b = 'ドラン ソード' THEN 'ドラン' ELSE eb END AS blade, CASE WHEN apart AND b = 'ドラン ソード' THEN 'ソード' ELSE r END AS ratchet,
CASE WHEN apart AND b = 'ドラン ソード' THEN r ELSE ef END AS bit, b <> 'Brand' OR f <> 'F' AS japanese FROM e""",
    "src_parts": f"""WITH {USAGE_SQL} SELECT DISTINCT name, type, CASE WHEN type = 'blade' THEN CASE WHEN name LIKE '%5' THEN 'left' ELSE 'right' END END AS spin_direction,
series, CAST(NULL AS VARCHAR) AS notes FROM (SELECT blade AS name, 'blade' AS type, series FROM u UNION ALL SELECT ratchet, 'ratchet', NULL FROM u UNION ALL SELECT bit, 'bit', NULL FROM u)""",
}
