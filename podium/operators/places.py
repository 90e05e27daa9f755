"""Regions of events from what their reports say of the place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import catalog
from podium.operators.dictionaries import ANY, BROADCAST_ENTRIES, Dictionary, lookup
from podium.operators.parts import found_in
from podium.sources.orders_adapter import USAGE_SQL, usage
from podium.sources.tables import stored


def _pairs(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(name, region) for region, names in groups.items() for name in names]


def _first_contained(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The region of the first name, in the order given, that the text holds."""
    names = F.filter(F.array(*[F.lit(name) for name, _ in pairs]), lambda name: text.contains(name))
    return found_in({name: region for name, region in reversed(pairs)}, F.get(names, F.lit(0)))


def _whole_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")


def region_of_text(
    text: Column,
    *,
    countries: dict[str, list[str]] = catalog.COUNTRIES,
    states: list[str] = catalog.STATES,
    provinces: list[str] = catalog.PROVINCES,
    cities: dict[str, list[str]] = catalog.CITIES,
) -> Column:
    """The region a text speaks of: an exact country, a state or province as a word, a city, a country anywhere."""
    low = F.trim(F.lower(text))
    return F.coalesce(
        found_in(dict(_pairs(countries)), low),
        F.when(_whole_word(low, [*states, *provinces]), F.lit("NA")),
        _first_contained(low, _pairs(cities)),
        _first_contained(low, [(name, region) for name, region in _pairs(countries) if len(name) > 2]),
    )


def region_of_event(name: Column, city: Column, state: Column, country: Column) -> Column:
    """The first region that country, state, city and name give, in this order."""
    return F.coalesce(*[region_of_text(c) for c in (country, state, city, name)])


def region_rules(spark: SparkSession) -> DataFrame:
    """The rules of the catalog as rows (kind, pattern, region, priority): exact countries, states and provinces as words,
    cities and countries of more than two letters anywhere; the smallest priority of those that fit wins."""
    rules = [("exact", name, region) for name, region in dict(_pairs(catalog.COUNTRIES)).items()]
    rules += [("word", name, "NA") for name in [*catalog.STATES, *catalog.PROVINCES]]
    rules += [("part", name, region) for name, region in _pairs(catalog.CITIES)]
    rules += [("part", name, region) for name, region in _pairs(catalog.COUNTRIES) if len(name) > 2]
    rows = [(*rule, priority) for priority, rule in enumerate(rules)]
    return spark.createDataFrame(rows, "kind string, pattern string, region string, priority int")


def rules_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Rules from CSV files with the header kind, pattern, region, priority; patterns are in lower case."""
    rows = spark.read.schema("kind string, pattern string, region string, priority int").csv(path, header=True, mode="FAILFAST")
    return rows.withColumn("pattern", F.lower(F.trim("pattern")))


def resolved(texts: DataFrame, rules: DataFrame, *, longest: int = 64) -> DataFrame:
    """(text, region) of the different texts (one column, in lower case) that a rule fits.

    Every piece of a text that is as long as some pattern, up to `longest` characters, is looked up among the patterns by an
    equi-join, so neither the plan nor a row's work grows with the number of rules.
    """
    sizes = [r[0] for r in rules.select(F.length("pattern").alias("n")).filter(f"n BETWEEN 1 AND {longest}").distinct().collect()]
    texts = texts.toDF("text").filter("text <> ''").distinct()
    place = texts.select("text", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)]) if sizes else F.array().cast("array<int>")).alias("n"))
    place = place.filter("n <= length(text)").select("text", "n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("i"))
    place = place.withColumn("pattern", F.substring("text", F.col("i"), F.col("n")))
    hits = place.join(F.broadcast(rules) if rules.count() <= BROADCAST_ENTRIES else rules, "pattern")
    letter = r"[\p{L}\p{N}_]"
    free = ~F.substring("text", F.col("i") + F.col("n"), F.lit(1)).rlike(letter)
    free &= (F.col("i") == 1) | ~F.substring("text", F.col("i") - 1, F.lit(1)).rlike(letter)
    fits = F.when(F.col("kind") == "exact", F.col("n") == F.length("text")).when(F.col("kind") == "word", free).otherwise(F.col("kind") == "part")
    return hits.filter(fits).groupBy("text").agg(F.min_by("region", "priority").alias("region"))


def with_regions(
    rows: DataFrame, rules: DataFrame, *, fields: tuple[str, ...] = ("country", "state", "city", "name"), into: str = "region"
) -> DataFrame:
    """`rows` with the first region that the fields give by the rules, in the order of the fields. Each different text is
    resolved once."""
    low = lambda c: F.trim(F.lower(F.col(c)))
    texts = rows.select(F.explode(F.array(*[low(c) for c in fields])).alias("text"))
    names = resolved(texts, rules).select(F.lit("region").alias("kind"), F.lit(ANY).alias("source"), F.col("text").alias("written"), F.col("region").alias("name"))
    names = stored(names, "regions")
    return lookup(rows, Dictionary(names, names.count()), "region", [low(c) for c in fields], into)


def region_or_default(region: Column, source: Column, fixed: dict[str, str], fallback: str = "NA") -> Column:
    """The fixed region of a source; else what was found; else, for the source without a prefix, the fallback."""
    return F.coalesce(found_in(fixed, source), region, F.when(F.coalesce(source, F.lit("")) == "", F.lit(fallback)))


def _written_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the usage with places written in nine ways, by the event's key."""
    rows = usage(spark, sf_dir).groupBy("tournament_id", "tournament_date").agg(F.min("source").alias("source"))
    week = F.floor(F.datediff("tournament_date", F.lit("1970-01-01").cast("date")) / 7)
    rows = rows.withColumn("k", ((week + F.length("tournament_id")) % 9).cast("int"))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("k") + 1)
    return rows.select(
        "tournament_id",
        F.when(F.col("source") == "1", "").otherwise(F.col("source")).alias("source"),
        pick("Cup", "Cup", "Winning Cup", "Cup", "Osaka Cup", "Cup", "Cup of Greater Poland", "Cup", "Cup").alias("name"),
        pick("Town", "Austin", None, "Lower Munich area", None, "Town", None, "Town", "").alias("city"),
        pick(None, "TX", "Ontario", None, None, "hereabouts", None, "ON", None).alias("state"),
        pick("Germany", None, None, None, "", "new zealand ", None, "Peru", None).alias("country"),
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written_places(spark, sf_dir)
    found = region_of_event(*map(F.col, ("name", "city", "state", "country")))
    return rows.select("tournament_id", found.alias("region"), region_or_default(found, F.col("source"), {"2": "JAPAN"}).alias("stored"))


_PATTERNS = sorted({*[x for xs in catalog.COUNTRIES.values() for x in xs], *catalog.STATES, *catalog.PROVINCES, *[x for xs in catalog.CITIES.values() for x in xs]})


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern of the rules in six surroundings, in one of four fields, by the keys of the orders."""
    key, n = F.col("o_orderkey"), len(_PATTERNS)
    pattern = F.element_at(F.array(*[F.lit(x) for x in _PATTERNS]), (key % n + 1).cast("int"))
    ways = [pattern, F.concat(F.lit("Upper "), pattern, F.lit(" area")), F.concat(F.lit("x"), pattern, F.lit("x")),
            F.concat(F.lit(" "), F.upper(pattern), F.lit(", hall 4")), F.concat(pattern, F.lit("ville (near "), F.reverse(pattern), F.lit(")")), F.lit(None)]
    way, field = F.floor(key / n) % 6, F.floor(key / (6 * n)) % 4
    text = F.element_at(F.array(*ways), (way + 1).cast("int"))
    put = lambda k, other: F.when(field == k, text).otherwise(F.lit(other))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", put(0, "Nowhere").alias("country"), put(1, None).alias("state"), put(2, "").alias("city"), put(3, "Cup in Peru").alias("name")
    )
    out = with_regions(rows, region_rules(spark))
    return out.groupBy("country", "state", "city", "name", "region").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ing_region": _regions, "ing_region_rules": _ruled}


def _texts(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _rules_sql() -> str:
    rules = [("exact", k, v) for k, v in dict(_pairs(catalog.COUNTRIES)).items()]
    rules += [("word", k, "NA") for k in [*catalog.STATES, *catalog.PROVINCES]] + [("part", k, v) for k, v in _pairs(catalog.CITIES)]
    rules += [("part", k, v) for k, v in _pairs(catalog.COUNTRIES) if len(k) > 2]
    return ", ".join(f"('{kind}', '{k}', '{v}', {i})" for i, (kind, k, v) in enumerate(rules))


ORACLE_SQL: dict[str, str] = {
    "ing_region": f"""WITH {USAGE_SQL}, e AS (SELECT tournament_id, min(source) AS source,
  (date_diff('day', DATE '1970-01-01', tournament_date) // 7 + length(tournament_id)) % 9 AS k FROM u GROUP BY tournament_id, tournament_date),
r AS (SELECT *, ['EU', 'NA', 'NA', 'EU', 'JAPAN', 'OCEANIA', 'EU', 'SA', NULL][k + 1] AS region FROM e)
SELECT tournament_id, region, CASE WHEN source = '2' THEN 'JAPAN' WHEN region IS NOT NULL THEN region WHEN source = '1' THEN 'NA' END AS stored FROM r""",
    # every rule tried on every text
    "ing_region_rules": rf"""WITH r(kind, pattern, region, priority) AS (VALUES {_rules_sql()}),
o AS (SELECT o_orderkey, {_texts(_PATTERNS)}[o_orderkey % {len(_PATTERNS)} + 1] AS p, o_orderkey // {len(_PATTERNS)} % 6 AS way,
      o_orderkey // {6 * len(_PATTERNS)} % 4 AS field FROM orders),
t AS (SELECT field, CASE way WHEN 0 THEN p WHEN 1 THEN 'Upper ' || p || ' area' WHEN 2 THEN 'x' || p || 'x' WHEN 3 THEN ' ' || upper(p) || ', hall 4'
      WHEN 4 THEN p || 'ville (near ' || reverse(p) || ')' END AS text FROM o),
f AS (SELECT CASE WHEN field = 0 THEN text ELSE 'Nowhere' END AS country, CASE WHEN field = 1 THEN text END AS state,
      CASE WHEN field = 2 THEN text ELSE '' END AS city, CASE WHEN field = 3 THEN text ELSE 'Cup in Peru' END AS name FROM t),
x AS (SELECT text, ' ' || regexp_replace(text, '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ' AS padded FROM (
      SELECT DISTINCT trim(lower(unnest([country, state, city, name]))) AS text FROM f)),
m AS (SELECT text, arg_min(region, priority) AS region FROM x JOIN r ON CASE kind WHEN 'exact' THEN text = pattern
      WHEN 'word' THEN contains(padded, ' ' || pattern || ' ') ELSE contains(text, pattern) END GROUP BY text)
SELECT country, state, city, name, coalesce(a.region, b.region, c.region, d.region) AS region, count(*) AS n FROM f
LEFT JOIN m a ON a.text = trim(lower(country)) LEFT JOIN m b ON b.text = trim(lower(state)) LEFT JOIN m c ON c.text = trim(lower(city))
LEFT JOIN m d ON d.text = trim(lower(name)) GROUP BY ALL""",
}
