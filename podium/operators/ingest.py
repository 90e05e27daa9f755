"""Tournament reports to rows: lines become rows, a parser's state becomes a window over them.

Everything but HTML is built-in column functions. Parsers return structs whose fields are null where nothing was found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions import catalog
from podium.functions.names import display_ratchet
from podium.operators import parts
from podium.sources.orders_adapter import USAGE_SQL, usage
from podium.sources.reports import page_rows
from podium.sources.tables import stored

#: Fixed patterns: a ratchet, placement lines of podiums and of any place, and dates.
RATCHET = r"\d-\d{2}"
PLACE = r"^(1st|2nd|3rd)\s*(?:Place)?[:\s-]*(.*)$"
ANY_PLACE = r"^(\d+(?:st|nd|rd|th))\s*(?:Place)?[:\s-]*(.*)$"
SLASH_DATE, WORD_DATE = r"\d{1,2}/\d{1,2}/\d{2,4}", r"[A-Z][a-z]+ \d{1,2},? \d{4}"
#: What marks a line as a note and not as a player's name.
NOISE = [
    "!", "(click to view)", "winning combos", "top 3 photo", "top 3 deck combos", "both stages", "first stage",
    "final stage", "finals only", "first stage only", "3on3 match finals only", "3on3 finals only", "match finals only",
]
#: Notes among the first lines, and countries that make a line a location.
HEAD_NOISE = ["winning combos", "top 3 photo", "(click to view)", "top 3 deck combos", "!"]
HEAD_COUNTRY = r"(?i),\s*(Canada|USA|US|UK|Japan|Australia|Germany|France)"
#: Words of a location line that are not places.
FORMAT_WORDS = ["X Format", "Ranked", "Unranked", "1on1", "3on3", "1v1", "3v3", "Experimental"]
#: Patterns of other game generations, and of the wanted one.
OTHER_GAMES = [
    r"(?i)\b\d{2,3}(RF|WD|RB|MB|CS|B:D|SF|RSF|MF)\b",
    r"(?i)\bMF-[FLH]\b",
    r"(?i)\b(L-Drago|Pegasis|Leone|Sagittario)\b",
]
WANTED_GAME = [r"\b\d{1,2}-\d{2,3}[A-Z]", r"(?i)X\s*Format"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's match, null where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


# -- dates, places, formats ---------------------------------------------------------------------------------------


def _try_date(year: Column, month: Column, day: Column) -> Column:
    iso = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd"))


def date_en(text: Column, as_of: Column, least_year: int = 2023) -> Column:
    """The first M/D/Y or `Month D, Y`, from `least_year` on and not after the reference date."""
    slash = r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
    year = found(text, slash, 3).cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    numeric = _try_date(year, found(text, slash, 1), found(text, slash, 2))
    words = found(text, r"([A-Z][a-z]+ \d{1,2},? \d{4})")
    plain = F.regexp_replace(words, ",", "")
    named = F.coalesce(F.try_to_date(plain, "MMMM d yyyy"), F.try_to_date(plain, "MMM d yyyy"))
    allowed = lambda d: F.when((F.year(d) >= least_year) & (d <= as_of), d)
    return F.coalesce(allowed(numeric), allowed(named))


def date_ja(text: Column, url: Column) -> Column:
    """ISO, year-month-day with ideographs, or Y/M/D; else January 1 of a year in the address."""
    out = []
    for pattern in (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})/(\d{1,2})/(\d{1,2})"):
        out.append(_try_date(*[found(text, pattern, k) for k in (1, 2, 3)]))
    year = found(url, r"(20\d{2})")
    return F.coalesce(*out, _try_date(year, F.lit("1"), F.lit("1")))


def date_de(text: Column, posted: Column) -> Column:
    """DD.MM.YYYY or ISO; else the day it was posted."""
    german, iso = r"(\d{1,2})\.(\d{1,2})\.(\d{4})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
    return F.coalesce(
        _try_date(*[found(text, german, k) for k in (3, 2, 1)]), _try_date(*[found(text, iso, k) for k in (1, 2, 3)]), posted
    )


def location(text: Column, game_names: tuple[str, ...] = ()) -> Column:
    """(city, state, country) of a comma or bar separated line; format words and the game's names are no places."""
    drop = r"(?i)\b(" + "|".join([*game_names, *FORMAT_WORDS]) + r")\b"
    plain = F.regexp_replace(F.replace(text, F.lit("|"), F.lit(",")), drop, "")
    parts = F.filter(F.transform(F.split(plain, ","), lambda x: F.regexp_replace(x, r"^[ -]+|[ -]+$", "")), lambda x: x != "")
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    city = F.when((n > 1) | (F.length(at(0)) > 1), at(0))
    return F.struct(
        city.alias("city"),
        F.when(n >= 3, at(1)).alias("state"),
        F.when(n >= 3, at(2)).when(n == 2, at(1)).alias("country"),
    )


def event_format(text: Column) -> Column:
    """(format, ranked); unranked is looked for first, since it holds the other word."""
    low = F.lower(text)
    has = lambda *words: low.rlike("|".join(words))
    return F.struct(
        F.when(has("1on1", "1v1"), "1on1").when(has("3on3", "3v3"), "3on3").alias("format"),
        F.when(has("unranked"), F.lit(False)).when(has("ranked"), F.lit(True)).alias("ranked"),
    )


def title(text: Column) -> Column:
    """An event's title: cut after a bar, without bracketed tags and dates."""
    out = F.regexp_replace(text, r"\s*[|｜].*$", "")
    out = F.regexp_replace(out, r"【[^】]*】|\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(out, r"\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d{1,2}-\d{1,2}", ""))


# -- combos -------------------------------------------------------------------------------------------------------


def stage_note(text: Column) -> Column:
    """both, final or first, from a note in parentheses."""
    note = F.lower(found(text, r"(?i)\(([^)]*(?:Stage|Finals)[^)]*)\)"))
    return (
        F.when(note.contains("both") | (note.contains("first") & note.contains("final")), "both")
        .when(note.contains("final"), "final")
        .when(note.contains("first"), "first")
    )


def _combo(text: Column, patterns: list[tuple[str, list[str]]]) -> Column:
    """The struct of the first pattern that matches; fields it does not name are null."""
    tries = []
    for pattern, names in patterns:
        fields = {n: F.trim(F.regexp_extract(text, pattern, i + 1)) for i, n in enumerate(names)}
        struct = F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in ("blade", "assist", "ratchet", "bit")])
        tries.append(F.when(text.rlike(pattern), struct))
    return F.coalesce(*tries)


#: Fixed patterns: combos in each language.
EN_COMBOS = [
    (r"^(.+?)\s+(\d{1,2}-\d{2,3})\s+([A-Za-z][A-Za-z\s]*)$", ["blade", "ratchet", "bit"]),
    (r"^(.+?)\s+(\d{1,2}-\d{2,3})([A-Z][A-Za-z\s]*)$", ["blade", "ratchet", "bit"]),
    (r"^(.+?)\s+([A-Za-z]+)(\d{1,2}-\d{2,3})([A-Z][A-Za-z\s]*)$", ["blade", "assist", "ratchet", "bit"]),
]
KANA = "ァ-ヶー"
JA_ASSIST = (
    rf"^(.+?)\s+([{KANA}]+|[A-Z][a-z]+)\s+(\d{{1,2}}-\d{{2,3}})([A-Za-z{KANA}]+)$",
    ["blade", "assist", "ratchet", "bit"],
)
JA_COMBOS = [
    (rf"^(.+?)\s+(\d{{1,2}}-\d{{2,3}})([A-Za-z{KANA}]+)$", ["blade", "ratchet", "bit"]),
    (rf"^(.+?)\s+(\d{{1,2}}-\d{{2,3}})\s+([A-Za-z{KANA}]+)$", ["blade", "ratchet", "bit"]),
]
DE_COMBO = (r"(?i)^(.+?)\s+([A-Z]?\d{1,2}-\d{2,3})([A-Z]{1,2})$", ["blade", "ratchet", "bit"])


def combo_en(text: Column) -> Column:
    """(blade, assist, ratchet, bit) of an English line; bullets, a name before a colon and stage notes are dropped."""
    plain = F.regexp_replace(text, r"^[\s\-•*]+", "")
    plain = F.regexp_replace(plain, r"^[^:]*:\s*([A-Za-z].+)$", "$1")
    plain = F.trim(F.regexp_replace(plain, r"(?i)\s*\([^)]*(?:Stage|Finals|Only|Match|Type)[^)]*\)", ""))
    return _combo(plain, EN_COMBOS)


def combo_ja(text: Column, blades: tuple[str, ...] = ()) -> Column:
    """(blade, assist, ratchet, bit) of a katakana line; a word before the ratchet is no assist where it is in Latin letters
    or makes one of `blades` (in katakana) with the word before it."""
    plain = F.trim(text)
    with_assist = _combo(plain, [JA_ASSIST])
    joined = F.concat(with_assist["blade"], with_assist["assist"])
    one_name = joined.isin(list(blades)) if blades else F.lit(False)
    return F.coalesce(F.when(parts.is_japanese(with_assist["assist"]) & ~one_name, with_assist), _combo(plain, JA_COMBOS))


def combo_de(text: Column) -> Column:
    """(blade, assist, ratchet, bit) of a German line; the bit's letters are upper case."""
    out = _combo(F.trim(text), [DE_COMBO])
    return out.withField("bit", F.upper(out["bit"]))


def with_names(rows: DataFrame, combo: str = "combo") -> DataFrame:
    """The rows with their parsed combo under the names of the tables: (lock_chip, blade, assist, ratchet, bit).

    Each step is a column of its own, so that none is worked out again for every place that uses it.
    """
    c = F.col(combo)
    rows = rows.withColumn("_split", parts.split_assist(c["blade"]))
    rows = rows.withColumn("_whole", parts.compound(F.col("_split.blade")))
    named = F.struct(
        F.col("_whole.lock_chip").alias("lock_chip"),
        F.col("_whole.blade").alias("blade"),
        F.coalesce(parts.found_in(catalog.ASSISTS, c["assist"]), c["assist"], F.col("_split.assist")).alias("assist"),
        c["ratchet"].alias("ratchet"),
        parts.expanded_bit(c["bit"]).alias("bit"),
    )
    return rows.withColumn(combo, F.when(c.isNotNull(), named)).drop("_split", "_whole")


def folded(rules: dict[str, str]) -> dict[str, str]:
    """One map for an ordered list of rewrites: later rules see what earlier ones made."""
    out: dict[str, str] = {}
    for key, value in reversed(list(rules.items())):  # what is known so far are the rules that come later
        out[key] = out.get(value, value)
    return out


def normalised(rows: DataFrame, columns: list[str], rules: dict[str, str]) -> DataFrame:
    """The rows with the rewrites applied to the columns, and `fixes`, how many of them changed."""
    table = folded(rules)
    new = {c: F.coalesce(parts.found_in(table, F.col(c)), F.col(c)) for c in columns}
    changed = sum((F.when(~F.col(c).eqNullSafe(v), 1).otherwise(0) for c, v in new.items()), F.lit(0))
    before = F.col("fixes") if "fixes" in rows.columns else F.lit(0)
    return rows.withColumn("fixes", before + changed).withColumns(new)


def normalised_combos(
    rows: DataFrame,
    blade_rewrites: dict[str, str] | None = None,
    *,
    bit_rewrites: dict[str, str] = catalog.BIT_REWRITES,
    ratchet_rewrites: dict[str, str] = catalog.RATCHET_REWRITES,
    compounds: list[str] = catalog.COMPOUND_BLADES,
    mains: list[str] = catalog.MAIN_BLADES,
) -> DataFrame:
    """Combo rows put right, and `fixes`: names are rewritten (assists by the rewrites of blades), chips are taken out of
    compound blades that have none, and a chip that is a main blade is removed."""
    rows = normalised(rows, ["blade", "assist"], blade_rewrites or {})
    rows = normalised(normalised(rows, ["bit"], bit_rewrites), ["ratchet"], ratchet_rewrites)
    fused = F.col("lock_chip").isNull() & F.col("blade").isin(compounds)
    apart = parts.compound(F.col("blade"))
    rows = rows.withColumns(
        {
            "fixes": F.col("fixes") + F.when(fused, 1).otherwise(0),
            "lock_chip": F.when(fused, apart["lock_chip"]).otherwise(F.col("lock_chip")),
            "blade": F.when(fused, apart["blade"]).otherwise(F.col("blade")),
        }
    )
    wrong = F.coalesce(F.col("lock_chip").isin(mains), F.lit(False))
    return rows.withColumns(
        {"fixes": F.col("fixes") + F.when(wrong, 1).otherwise(0), "lock_chip": F.when(~wrong, F.col("lock_chip"))}
    )


def fixed_blades(rows: DataFrame, columns: list[str], fixes: dict[str, str] = catalog.BLADE_FIXES) -> DataFrame:
    """The rows with the short list of misspelt blades put right, and `fixes`."""
    return normalised(rows, columns, fixes)


def distinct_blades(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All blades of wide rows, sorted."""
    names = rows.select(F.explode(F.array(*columns)).alias("blade")).filter("blade IS NOT NULL")
    return names.distinct().orderBy("blade")


# -- posts --------------------------------------------------------------------------------------------------------


def wanted_posts(posts: DataFrame, game_names: tuple[str, ...] = ()) -> DataFrame:
    """Posts (post_id, text) whose first 30 lines speak of the wanted game, blocked pages left out.

    The game's own names are patterns that the caller adds to those of its part codes.
    """
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 30), " ")
    other = head.rlike("|".join(OTHER_GAMES))
    return posts.filter(~F.col("text").contains("Just a moment") & ~other & head.rlike("|".join([*WANTED_GAME, *game_names])))


def lines(posts: DataFrame) -> DataFrame:
    """(post_id, line_no, line) of the lines that are not blank."""
    rows = posts.select("post_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def with_event(rows: DataFrame) -> DataFrame:
    """event 0, 1, ... within a post: a line that is only a date, or starts with a dash and has one, opens another once a
    placement line has been read."""
    date = f"{SLASH_DATE}|{WORD_DATE}"
    header = F.col("line").rlike(rf"^(-.*({date}).*|{date})$")
    order = Window.partitionBy("post_id").orderBy("line_no")
    placed = F.max(F.col("line").rlike(f"(?i){ANY_PLACE}")).over(order)
    return rows.withColumn("event", F.sum(F.when(header & placed, 1).otherwise(0)).over(order))


def headers(
    rows: DataFrame, as_of: Column, least_year: int = 2023, game_names: tuple[str, ...] = ()
) -> DataFrame:
    """Per post and event: name, date, city, state, country, format and ranked, out of the first six lines.

    Lines that are only a date, a format word or a note are passed over, and a placement line ends the search. A line with a
    known country after a comma, or with a date and a comma, is the location; the first other line is the name, which loses
    the format words at its end. Date and format are looked for in all six lines together.
    """
    key = ["post_id", "event"]
    order = Window.partitionBy(*key).orderBy("line_no")
    clean = F.trim(F.regexp_replace(F.trim(F.col("line")), "^-+", ""))
    top = rows.withColumn("_n", F.row_number().over(order)).filter("_n <= 6").withColumn("_c", clean)
    line = F.col("_c")
    placed = F.max(line.rlike("(?i)^(1st|2nd|3rd)")).over(order)
    date = f"{SLASH_DATE}|{WORD_DATE}"
    formats = "|".join([*game_names, "X Format", "Ranked", "Unranked", "1on1", "3on3"])
    passed = (
        (line == "")
        | line.rlike(r"^[\d/]+$")
        | line.rlike(f"^{WORD_DATE}$")
        | line.rlike(f"(?i)^({formats})$")
        | F.lower(line).isin(HEAD_NOISE)
    )
    where = line.rlike(HEAD_COUNTRY) | (line.rlike(date) & line.contains(","))
    place = location(F.regexp_replace(F.regexp_replace(line, SLASH_DATE, ""), WORD_DATE, ""), game_names)
    name = F.regexp_replace(line, r"(?i)\s*[-|]\s*(X Format|Ranked|Unranked|1on1|3on3).*$", "")
    name = F.trim(F.regexp_replace(name, r"\s*\|\s*$", ""))
    used = ~passed & ~F.col("_placed")
    top = top.withColumns({"_placed": placed, "_where": place, "_name": name})
    pick = lambda value, when: F.min_by(value, F.when(when, F.col("line_no")))
    located = used & where & (F.col("_where.city").isNotNull() | F.col("_where.country").isNotNull())
    out = top.groupBy(*key).agg(
        pick(F.col("_name"), used & ~where & (F.length(line) > 3) & (F.length("_name") > 2)).alias("name"),
        pick(F.col("_where"), located).alias("_where"),
        F.array_join(F.array_sort(F.collect_list(F.struct("_n", "line")))["line"], " ").alias("_all"),
    )
    info = event_format(F.col("_all"))
    return out.select(
        *key, "name", date_en(F.col("_all"), as_of, least_year).alias("date"), "_where.*", info["format"].alias("format"),
        info["ranked"].alias("ranked"),
    )


def placements(rows: DataFrame, *, place: str = PLACE, named: bool = False) -> DataFrame:
    """(post_id, event, place, player, line_no, blade, assist, ratchet, bit, stage): a row for every combo line.

    A placement line (of the podium, or of any place with `ANY_PLACE`) opens a section; its player stands on that line, or
    on the next short line that is no note. With `named`, parts are under the names of the tables, and lock_chip is added.
    """
    line, key = F.col("line"), ["post_id", "event"]
    order = Window.partitionBy(*key).orderBy("line_no")
    opened = F.lower(found(line, f"(?i){place}"))
    rest = F.trim(found(line, f"(?i){place}", 2))
    rows = rows.withColumn("_place", opened).withColumn(
        "_same", F.when(opened.isNotNull() & (rest != "") & ~rest.rlike(RATCHET), rest)
    )
    rows = rows.withColumn("section", F.count("_place").over(order)).filter("section > 0")
    low = F.lower(line)
    noise = F.lit(False)
    for x in NOISE:
        noise = noise | low.contains(x)
    short = F.col("_place").isNull() & ~line.rlike(RATCHET) & ~noise & ~line.startswith("(") & F.length(line).between(2, 49)
    whole = Window.partitionBy(*key, "section")
    rows = rows.withColumn("combo", combo_en(line))
    rows = (with_names(rows) if named else rows).withColumns(
        {
            "place": F.max(F.when(F.col("_place").isNotNull(), F.regexp_extract("_place", r"\d+", 0).cast("int"))).over(whole),
            "player": F.coalesce(
                F.max("_same").over(whole), F.min_by(line, F.when(short, F.col("line_no"))).over(whole)
            ),
        }
    )
    found_rows = rows.filter(F.col("combo").isNotNull() & F.col("player").isNotNull())
    return found_rows.select(*key, "place", "player", "line_no", "combo.*", stage_note(line).alias("stage"))


def packed(rows: DataFrame, k: int = 3) -> DataFrame:
    """One row per placement with its first k combos as wide columns; further ones are dropped."""
    fields = ["blade", "ratchet", "bit", "assist", "stage"]
    deck = F.sort_array(F.collect_list(F.struct("line_no", *fields)))
    out = rows.groupBy("post_id", "event", "place", "player").agg(F.slice(deck, 1, k).alias("deck"))
    wide = [F.get("deck", F.lit(i))[f].alias(f"{f}_{i + 1}") for i in range(k) for f in fields]
    return out.select("post_id", "event", "place", "player", *wide)


def first_wins(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The first row of each key by arrival."""
    order = Window.partitionBy(*key).orderBy(arrival)
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def not_loaded(rows: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the loaded ones."""
    return rows.join(loaded.select(key).distinct(), key, "left_anti")


def not_in_other_source(rows: DataFrame, other: DataFrame, keywords: list[str]) -> DataFrame:
    """Events (date, name) that no other source has under the same date and name, or date and shared keyword."""
    hits = F.filter(F.array(*[F.when(F.lower("name").contains(k.lower()), k) for k in keywords]), lambda x: x.isNotNull())
    keyed = lambda df: df.select("date", F.explode(hits).alias("_w")).distinct()
    rows = rows.join(other.select("date", "name").distinct(), ["date", "name"], "left_anti")
    same_day = rows.select("date", "name", F.explode(hits).alias("_w")).join(keyed(other), ["date", "_w"], "left_semi")
    return rows.join(same_day.select("date", "name").distinct(), ["date", "name"], "left_anti")


def offset_places(rows: DataFrame, key: str, arrival: str, step: int = 100) -> DataFrame:
    """Places of records that hold several events: each time a place comes again, it and those after it move by `step`.

    A record's places are one array, so its rows meet in one aggregate; records are as long as a report.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(arrival).alias("at"), F.col("place").alias("place"))))
    state = "struct<seen:array<int>,shift:int,out:array<struct<at:bigint,place:int,moved:int>>>"
    start = F.struct(
        F.array().cast("array<int>").alias("seen"),
        F.lit(0).alias("shift"),
        F.array().cast("array<struct<at:bigint,place:int,moved:int>>").alias("out"),
    ).cast(state)

    def step_of(a: Column, x: Column) -> Column:
        again = F.array_contains(a["seen"], x["place"])
        shift = a["shift"] + F.when(again, step).otherwise(0)
        new = F.struct(x["at"].cast("bigint").alias("at"), x["place"].cast("int").alias("place"), (x["place"] + shift).cast("int").alias("moved"))
        seen = F.when(again, F.array(x["place"].cast("int"))).otherwise(F.array_append(a["seen"], x["place"].cast("int")))
        return F.struct(seen.alias("seen"), shift.alias("shift"), F.array_append(a["out"], new).alias("out")).cast(state)

    moved = rows.groupBy(key).agg(F.aggregate(ordered, start, step_of)["out"].alias("_o"))
    flat = moved.select(key, F.explode("_o").alias("_o")).select(key, F.col("_o.at").alias(arrival), F.col("_o.moved").alias("_moved"))
    flat = flat.withColumn(arrival, F.col(arrival).cast(rows.schema[arrival].dataType))
    return rows.join(flat, [key, arrival]).withColumn("place", F.col("_moved")).drop("_moved")


# -- match tables, prose results, captions --------------------------------------------------------------------------


def match_placements(
    cells: DataFrame, blades: dict[str, str] | None = None, bits: dict[str, str] | None = None, k: int = 3
) -> DataFrame:
    """(page, place, player, n, lock_chip, blade, ratchet, bit) of match tables.

    `cells` are (page, t, r, c, head, text): table, row and cell numbers from 0. The first row names the two players, the
    cells below are their combos. Players are placed in the order in which they first appear, and each keeps the first k of
    the different combos.
    """
    text = F.trim("text")
    first = F.min("r").over(Window.partitionBy("page", "t"))
    rows = cells.withColumn("_r0", first)
    player = F.regexp_replace(F.trim(F.regexp_extract(text, r"(?s)^(.+?)(?:使用ベイ|$)", 1)), "さん$", "")
    heads = rows.filter((F.col("r") == F.col("_r0")) & (F.col("c") < 2)).groupBy("page", "t").agg(
        F.max(F.when(F.col("c") == 0, player)).alias("p0"),
        F.max(F.when(F.col("c") == 1, player)).alias("p1"),
        F.max(F.when(F.col("c") == 0, text)).alias("_t0"),
    )
    heads = heads.filter("p0 <> '' AND p1 <> ''").filter(~F.col("_t0").rlike("勝ち方|ポイント"))
    order = Window.partitionBy("page", "player")
    players = heads.select("page", "t", F.posexplode(F.array("p0", "p1")).alias("c", "player"))
    at = F.struct("t", "c")
    seen = players.groupBy("page", "player").agg(F.min(at).alias("first"))
    seen = seen.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("first")))
    body = rows.filter((F.col("r") > F.col("_r0")) & ~F.col("head"))
    body = body.withColumn("c", F.row_number().over(Window.partitionBy("page", "t", "r").orderBy("c")) - 1)
    full = body.withColumn("_m", F.count("*").over(Window.partitionBy("page", "t", "r"))).filter("_m >= 2 AND c < 2")
    plain = F.regexp_replace(F.regexp_replace(text, r"[_*]", ""), "\n", "")
    pattern = r"^(.+?)(\d{1,2}-\d{2,3})\s*([A-Za-z]*)$"
    blade = parts.translated(F.trim(found(plain, pattern)), blades or {}, squeeze=True)
    bit = F.regexp_extract(plain, pattern, 3)
    full = full.filter(plain.rlike(pattern)).withColumns(
        {"w": parts.compound(blade), "ratchet": F.regexp_extract(plain, pattern, 2), "bit": parts.expanded_bit(parts.translated(bit, bits or {}), catalog.BITS_BY_SOURCE["jp"], [])}
    )
    own = full.join(players, ["page", "t", "c"]).select("page", "player", F.struct("t", "r", "c").alias("at"), "w.*", "ratchet", "bit")
    own = own.groupBy("page", "player", "blade", "ratchet", "bit").agg(F.min(F.struct("at", "lock_chip")).alias("f"))
    own = own.withColumn("n", F.row_number().over(order.orderBy("f.at"))).filter(F.col("n") <= k)
    return own.join(seen, ["page", "player"]).select("page", "place", "player", "n", "f.lock_chip", "blade", "ratchet", "bit")


def prose_placements(rows: DataFrame, blades: dict[str, str] | None = None, bits: dict[str, str] | None = None, k: int = 3) -> DataFrame:
    """(post_id, place, player, n, lock_chip, blade, assist, ratchet, bit) of winner and runner-up blocks in prose lines.

    A bracket line opens a block; blocks with combos are placed in their order through the page; the player's name carries
    the city of the last section heading before the next block.
    """
    line = F.col("line")
    winner = found(line, r"【(?:優勝者|準優勝者)[：:](.+?)(?:選手)?(?:の3on3デッキ)?】")
    city = F.when(line.rlike("G1|予選|大会結果"), found(line, "(" + "|".join(catalog.SECTION_CITIES) + ")"))
    order = Window.partitionBy("post_id").orderBy("line_no")
    rows = rows.withColumns({"_w": F.trim(winner), "_city": F.last(city, ignorenulls=True).over(order)})
    rows = rows.withColumn("block", F.count("_w").over(order))
    # the city that holds at the line that opens the next block, or at the end of the page
    opened = rows.filter(F.col("_w").isNotNull())
    closing = opened.select("post_id", (F.col("block") - 1).alias("block"), F.struct(F.col("_city").alias("city")).alias("_next"))
    ending = rows.groupBy("post_id").agg(F.max_by("_city", "line_no").alias("_end"))
    combo = combo_ja(line, tuple(blades or {}))
    out = rows.filter("block > 0 AND _w IS NULL").withColumn("combo", combo).filter("combo IS NOT NULL")
    heads = opened.select("post_id", "block", F.col("_w").alias("player"))
    out = out.join(heads, ["post_id", "block"]).join(closing, ["post_id", "block"], "left").join(ending, "post_id")
    tag = F.when(F.col("_next").isNotNull(), F.col("_next.city")).otherwise(F.col("_end"))
    player = F.when(tag.isNotNull(), F.concat("player", F.lit(" ("), tag, F.lit(")"))).otherwise(F.col("player"))
    whole = parts.compound(parts.translated(F.col("combo.blade"), blades or {}, squeeze=True))
    own = Window.partitionBy("post_id", "block").orderBy("line_no")
    place = F.dense_rank().over(Window.partitionBy("post_id").orderBy("block"))
    return (
        out.withColumns({"n": F.row_number().over(own), "place": place})
        .filter(F.col("n") <= k)
        .select(
            "post_id", "place", player.alias("player"), "n", whole["lock_chip"].alias("lock_chip"),
            whole["blade"].alias("blade"), "combo.assist", "combo.ratchet",
            parts.expanded_bit(parts.translated(F.col("combo.bit"), bits or {}), catalog.BITS_BY_SOURCE["jp"], []).alias("bit"),
        )
    )


def match_pages(pages: DataFrame, blades: dict[str, str] | None = None, bits: dict[str, str] | None = None, *, prefix: str = "", k: int = 3) -> DataFrame:
    """(post_id, url, name, date, country, place, player, n, lock_chip, blade, assist, ratchet, bit) of match pages (url, html).

    A page with tables is read by them, one without by the prose of its entry. The title is that of the first heading; the date
    is that of a time element, else the first in the text, else January 1 of a year in the address.
    """
    rows = stored(page_rows(pages.select(F.col("url").alias("page"), "html").distinct()), "pages")
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    heads = rows.filter("kind <> 'cell'").groupBy("page").agg(*[one(x).alias(x) for x in ("title", "time", "whole", "content", "tables")])
    none, slug = F.lit(""), F.element_at(F.split(F.regexp_replace("page", "/+$", ""), "/"), -1)
    written = found(F.col("whole"), r"(\d{4}年\d{1,2}月\d{1,2}日)")
    date = F.coalesce(date_ja(F.trim("time"), none), date_ja(written, none), date_ja(none, found(F.col("page"), "(202[0-9])")))
    name = title(F.coalesce(F.trim("title"), F.lit("Unknown Tournament")))
    head = heads.select("page", F.concat(F.lit(prefix), slug).alias("post_id"), name.alias("name"), date.alias("date"), F.lit("Japan").alias("country"))
    by_table = match_placements(rows.filter("kind = 'cell'"), blades, bits, k).withColumn("assist", F.lit(None).cast("string"))
    prose = heads.filter("tables = '0'").select(F.col("page").alias("post_id"), F.col("content").alias("text"))
    by_prose = prose_placements(lines(prose), blades, bits, k).withColumnRenamed("post_id", "page")
    return head.join(by_table.unionByName(by_prose), "page").select(
        "post_id", F.col("page").alias("url"), "name", "date", "country", "place", "player", "n", "lock_chip", "blade", "assist", "ratchet", "bit"
    )


def caption_placements(captions: DataFrame, *, prefix: str = "", game_name: str = "", cities: list[str] = catalog.CAPTION_CITIES, skip: tuple[str, ...] = ("#", "Lizenz"), k: int = 3) -> DataFrame:
    """(post_id, name, date, city, country, place, player, n, lock_chip, blade, ratchet, bit) of captions (source_id, text,
    posted_at); compound blades are parted, and bits read by the German map."""
    wanted = captions.filter(F.lower("text").contains("winning combos"))
    rows = wanted.select(F.concat(F.lit(prefix), "source_id").alias("post_id"), "posted_at", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter("line <> ''")
    order = Window.partitionBy("post_id").orderBy("line_no")
    line = F.col("line")
    rows = rows.withColumn("_k", F.row_number().over(order))
    first = rf"(?i)^Winning Combos\s*[–-]\s*(?:{game_name}\s*)?(.+)$"
    whole = F.trim(F.coalesce(found(line, first), line))
    name = F.trim(F.regexp_replace(whole, r"\s*\d{1,2}\.\d{1,2}\.\d{4}\s*", " "))
    city = None
    for c in cities:
        hit = F.lower(F.col("name")).contains(c.lower())
        city = F.when(hit, c) if city is None else city.when(hit, c)
    head = rows.filter("_k = 1").select("post_id", name.alias("name"), date_de(whole, F.to_date("posted_at")).alias("date"))
    head = head.withColumns({"city": city, "country": F.lit("Germany")})
    medals = [(1, "🥇"), (2, "🥈"), (3, "🥉")]
    pattern = lambda i, m: rf"(?i)^(?:{m}\s*)?{i}\.?\s*Platz\s*\|?\s*(.+)"
    place = F.coalesce(*[F.when(line.rlike(pattern(i, m)), i) for i, m in medals])
    player = F.coalesce(*[F.trim(found(line, pattern(i, m))) for i, m in medals])
    body = rows.filter("_k > 1").withColumns({"_p": place, "_player": player})
    body = body.withColumn("block", F.count("_p").over(order))
    noted = F.lit(False)
    for x in skip:
        noted = noted | line.startswith(x)
    combos = body.filter(F.col("_p").isNull() & ~noted & (F.col("block") > 0)).withColumn("combo", combo_de(line))
    combos = combos.filter(F.col("combo.blade").isNotNull())
    heads = body.filter("_p IS NOT NULL").select("post_id", "block", F.col("_p").alias("place"), F.col("_player").alias("player"))
    out = combos.join(heads, ["post_id", "block"]).withColumn(
        "n", F.row_number().over(Window.partitionBy("post_id", "block").orderBy("line_no"))
    )
    out = out.filter(F.col("n") <= k).withColumn("whole", parts.compound(F.col("combo.blade")))
    bit = parts.expanded_bit(F.col("combo.bit"), catalog.BITS_BY_SOURCE["de"], [])
    out = out.select("post_id", "place", "player", "n", "whole.lock_chip", "whole.blade", "combo.ratchet", bit.alias("bit"))
    return out.join(head, "post_id").select(
        "post_id", "name", "date", "city", "country", "place", "player", "n", "lock_chip", "blade", "ratchet", "bit"
    )


# -- rendering, so that the parsers can be checked on tables of any size --------------------------------------------


#: Weeks since 1970, which number events and choose how they are written.
WEEK = "CAST(floor(datediff(tournament_date, DATE'1970-01-01') / 7) AS INT)"


def _combo_text(*between: str) -> Column:
    return F.concat("blade", F.lit(between[0]), display_ratchet(F.col("ratchet")), F.lit(between[1]), "bit")


def _ordinal(place: Column) -> Column:
    return F.concat(place.cast("string"), F.when(place == 1, "st").when(place == 2, "nd").when(place == 3, "rd").otherwise("th"))


def rendered_posts(rows: DataFrame) -> DataFrame:
    """Usage written as forum posts, up to two tournaments a post, in four kinds of headers and two of placements: what the
    parsers above read back."""
    note = F.when(F.col("stage") == "both", " (Both Stages)").when(F.col("stage") == "final", " (Final Stage)").when(
        F.col("stage") == "first", " (First Stage)"
    ).otherwise("")
    rows = rows.withColumn("week", F.expr(WEEK))
    combo = F.when(F.col("place") % 2 == 1, _combo_text(" ", "")).otherwise(_combo_text(" ", " "))
    block = rows.groupBy("tournament_id", "tournament_date", "region", "week", "place", "player_name").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(combo, note))), "\n").alias("combos")
    )
    opening = F.concat(_ordinal(F.col("place")), F.when((F.col("week") + F.col("place")) % 2 == 0, " Place: ").otherwise(" Place\n"))
    block = block.withColumn("text", F.concat(opening, "player_name", F.lit("\n"), "combos"))
    events = block.groupBy("tournament_id", "tournament_date", "region", "week").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", "text")))["text"], "\n\n").alias("body")
    )
    pair = F.floor(F.col("week") / 2).cast("int")
    event = F.row_number().over(Window.partitionBy("region", pair).orderBy("tournament_date")) - 1
    events = events.withColumns({"pair": pair, "event": event})
    name, slash = F.concat(F.lit("Cup "), "tournament_id"), F.date_format("tournament_date", "M/d/yyyy")
    words = F.date_format("tournament_date", "MMMM d, yyyy")
    kind = (F.col("week") + F.length("tournament_id")) % 4
    head = (
        F.when(F.col("event") > 0, F.concat(F.lit("- "), slash, F.lit("\n"), name, F.lit("\nTown, ST, Canada - Unranked 3on3")))
        .when(kind == 0, F.concat(name, F.lit("\n- "), slash, F.lit("\nTown, ST, Canada - X Format - Unranked 3on3")))
        .when(kind == 1, F.concat(name, F.lit(" | X Format (Unranked)\nTown, Canada | "), words))
        .when(kind == 2, F.concat(slash, F.lit("\nTown, ST, Canada - X Format - Ranked 1on1\n"), name))
        .otherwise(F.concat(name, F.lit("\n"), words, F.lit("\nTown, ST, Canada - X Format")))
    )
    events = events.withColumn("text", F.concat(head, F.lit("\n\n"), "body"))
    return events.groupBy(F.concat_ws("_", "region", "pair").alias("post_id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("event", "text")))["text"], "\n\n").alias("text")
    )


def _parsed(spark: SparkSession, sf_dir: str, places: str = "place <= 3") -> DataFrame:
    return with_event(lines(wanted_posts(rendered_posts(usage(spark, sf_dir).filter(places)))))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = headers(_parsed(spark, sf_dir), F.to_date(F.lit("2030-01-01")), 1990)
    return out.withColumn("event", F.col("event").cast("int"))


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(_parsed(spark, sf_dir)).drop("line_no", "assist").withColumn("event", F.col("event").cast("int"))


def _any_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placements(_parsed(spark, sf_dir, "place <= 24"), place=ANY_PLACE)
    rows = rows.groupBy("post_id", "event", "place", "player").agg(F.count("*").alias("combos"))
    return rows.withColumn("event", F.col("event").cast("int"))


def _deck_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = packed(placements(_parsed(spark, sf_dir)))
    size = sum((F.when(F.col(f"blade_{i}").isNotNull(), 1).otherwise(0) for i in (1, 2, 3)), F.lit(0))
    return wide.select("post_id", F.col("event").cast("int").alias("event"), "place", "player", size.cast("bigint").alias("combos"), "blade_1")


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"Brand#1": "Brand#01", "Brand#2": "Brand#1x", "Brand#1x": "Brand#02"}
    out = normalised(usage(spark, sf_dir), ["blade"], rules)
    return out.groupBy("blade").agg(F.sum("fixes").cast("bigint").alias("fixes"), F.count("*").alias("uses"))


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combos with spellings that the normaliser knows, drawn by the part's key."""
    key = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (key % len(xs) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey",
        pick([*catalog.COMPOUND_BLADES, "Wizard Rod", "Wizrd Rod"]).alias("blade"),
        pick(["5-50", "9-60"]).alias("ratchet"),
        pick([*catalog.BIT_REWRITES, "Ball"]).alias("bit"),
        pick(["Wizrd Rod", None, "Heavy"]).alias("assist"),
        pick([None, "Dark", "Dran", None, None]).alias("lock_chip"),
    )


def _normalised_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_combos(_spelt(spark, sf_dir), {"Wizrd Rod": "Wizard Rod"})


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, names = F.col("p_partkey"), [*catalog.BLADE_FIXES, "Wizard Rod"]
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name(key).alias("blade_1"), name(key + 5).alias("blade_2"))
    return fixed_blades(rows, ["blade_1", "blade_2"])


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a region as records: the podiums of its tournaments in their order."""
    rows = usage(spark, sf_dir).filter("place <= 3").select("tournament_id", "tournament_date", "region", "place").distinct()
    whole = rows.groupBy("tournament_id").agg(F.count("*").alias("n")).filter("n = 3").select("tournament_id")
    rows = rows.join(whole, "tournament_id")
    record = F.concat_ws("_", "region", F.date_format("tournament_date", "yyyy-MM"))
    rows = rows.withColumn("record", record)
    at = F.row_number().over(Window.partitionBy("record").orderBy("tournament_date", "place"))
    return offset_places(rows.withColumn("at", at), "record", "at").select("record", "at", "tournament_id", "place")


def _match_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and runners-up of each tournament as the two columns of a match table."""
    rows = usage(spark, sf_dir).filter("place <= 2").withColumn("text", _combo_text(" ", ""))
    order = Window.partitionBy("tournament_id", "place").orderBy("text")
    body = rows.select(F.col("tournament_id").alias("page"), F.row_number().over(order).alias("r"), (F.col("place") - 1).alias("c"), F.lit(False).alias("head"), "text")
    head = rows.select(
        F.col("tournament_id").alias("page"), F.lit(0).alias("r"), (F.col("place") - 1).alias("c"), F.lit(True).alias("head"),
        F.concat("player_name", F.lit("さん使用ベイ")).alias("text"),
    ).distinct()
    return head.union(body).withColumn("t", F.lit(0))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_placements(_match_cells(spark, sf_dir)).drop("lock_chip")


def _prose_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and runners-up of each tournament as blocks of prose, in odd weeks with a second city between them."""
    rows = usage(spark, sf_dir).filter("place <= 2").withColumn("week", F.expr(WEEK))
    block = rows.groupBy("tournament_id", "week", "place", "player_name").agg(
        F.sort_array(F.collect_list(_combo_text(" ", ""))).alias("combos")
    )
    opened = F.when(F.col("place") == 1, F.concat(F.lit("【優勝者："), "player_name", F.lit("選手】"))).otherwise(
        F.concat(F.lit("【準優勝者:"), "player_name", F.lit("の3on3デッキ】"))
    )
    city = F.when(F.col("place") == 1, "大阪 G1 大会結果").when(F.col("week") % 2 == 1, "東京 予選").otherwise("次は福岡")
    text = F.concat(city, F.lit("\n"), opened, F.lit("\n"), F.array_join("combos", "\n"))
    posts = block.withColumn("text", text).groupBy(F.col("tournament_id").alias("post_id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", "text")))["text"], "\n").alias("text")
    )
    return posts


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_placements(lines(_prose_posts(spark, sf_dir))).drop("lock_chip", "assist")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and runners-up of each tournament as pages: in tables, or in prose where week and name add up to an odd number."""
    rows = usage(spark, sf_dir).filter("place <= 2").withColumn("week", F.expr(WEEK))
    days = rows.select("tournament_id", "tournament_date", "region", "week").distinct()
    cells = _match_cells(spark, sf_dir).withColumnRenamed("page", "tournament_id")
    tag = F.when(F.col("head"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), F.regexp_replace("text", " ", " <br>"), F.lit("</"), tag, F.lit(">"))
    line = cells.groupBy("tournament_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", cell.alias("x"))))["x"].alias("x"))
    line = line.withColumn("x", F.concat(F.lit("<tr>"), F.array_join("x", ""), F.lit("</tr>")))
    table = line.groupBy("tournament_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", "x")))["x"], "").alias("table"))
    prose = _prose_posts(spark, sf_dir).select(F.col("post_id").alias("tournament_id"), F.col("text").alias("prose"))
    out = days.join(table, "tournament_id").join(prose, "tournament_id")
    day, kind = F.col("tournament_date"), F.col("week") % 3
    dated = F.when(kind == 0, F.concat(F.lit('<time>x</time><time datetime="'), day.cast("string"), F.lit('">1.1.</time>'))).when(
        kind == 1, F.concat(F.lit("<p>開催"), F.date_format(day, "yyyy年M月d日"), F.lit("</p>"))
    ).otherwise("<time datetime='soon'></time>")
    body = F.when(
        (F.col("week") + F.length("tournament_id")) % 2 == 0, F.concat(F.lit("<table>"), "table", F.lit("</table><p>【優勝者：nobody】\nBrand 1-60F</p>"))
    ).otherwise(F.concat(F.lit("<div>\n"), "prose", F.lit("\n</div>")))
    html = F.concat(
        F.lit("<html><head><title>Site</title><style>p {}</style></head><body><h1>【結果】Cup "), "region", F.lit("<b>!</b> | Site</h1>"), dated,
        F.lit('<div class="x entry-content">'), body, F.lit("</div>\n【優勝者：outside】\nBrand 1-60F</body></html>"),
    )
    url = F.concat(F.lit("https://example.org/202"), (F.col("week") % 10).cast("string"), F.lit("/"), "tournament_id", F.lit("/"))
    return match_pages(out.select(url.alias("url"), html.alias("html")), prefix="jp_").drop("lock_chip", "assist")


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Podiums of each tournament as captions; bits are written by a code, and some blades are compound ones."""
    rows = usage(spark, sf_dir).filter("place <= 3").withColumn("week", F.expr(WEEK))
    code = F.when(F.col("place") == 1, F.substring("bit", 1, 1)).when(F.col("place") == 2, "FB").otherwise("ra")
    blade = F.when(F.col("blade").endswith("3"), "Pegasus Blast").when(F.col("blade").endswith("4"), "Brave Emperor").otherwise(F.col("blade"))
    combo = F.concat(blade, F.lit(" "), display_ratchet(F.col("ratchet")), code)
    block = rows.groupBy("tournament_id", "tournament_date", "week", "place", "player_name").agg(
        F.array_join(F.sort_array(F.collect_list(combo)), "\n").alias("combos")
    )
    medal = F.element_at(F.array(F.lit("🥇 "), F.lit("🥈 "), F.lit("🥉 ")), F.col("place"))
    start = F.when(F.col("week") % 2 == 0, medal).otherwise("")
    text = F.concat(start, F.col("place").cast("string"), F.lit(". Platz | "), "player_name", F.lit("\n#tag 1-60A\n"), "combos")
    posts = block.withColumn("text", text).groupBy("tournament_id", "tournament_date", "week").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", "text")))["text"], "\n").alias("body")
    )
    dated = F.when(F.col("week") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.date_format("tournament_date", "d.M.yyyy")))
    title_line = F.concat(F.lit("Winning Combos – Cup Berlin"), dated)
    captions = posts.select(
        F.col("tournament_id").alias("source_id"),
        F.concat(title_line, F.lit("\n"), "body").alias("text"),
        F.col("tournament_date").cast("timestamp").alias("posted_at"),
    )
    return caption_placements(captions, prefix="de_")


def page_links(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(page_id, link): distinct link targets, by keyword."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    low = F.lower("link")
    for words, wanted in ((include, True), (exclude, False)):
        if words:
            hit = F.lit(False)
            for word in words:
                hit = hit | low.contains(word.lower())
            rows = rows.filter(hit if wanted else ~hit)
    return rows.distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ing_header": _headers,
    "ing_placement_fill": _placements,
    "ing_placement_nth": _any_placements,
    "ing_deck_pack": _deck_sizes,
    "ing_normalise": _normalised,
    "ing_normalise_combos": _normalised_combos,
    "ing_fix_typos": _fixed,
    "ing_place_offset": _offsets,
    "ing_match_tables": _matches,
    "ing_prose_results": _prose,
    "ing_captions": _captions,
    "ing_match_pages": _pages,
    "src_link_list": lambda spark, sf_dir: page_links(
        spark.read.parquet(f"{sf_dir}/pages.parquet"), ["the", "page"], ["ref"]
    ),
}

_RATCHET_SQL = r"regexp_replace(ratchet, '^[A-Za-z]*(\d+-\d+)$', '\1')"
_WEEK_SQL = "(date_diff('day', DATE '1970-01-01', tournament_date) // 7)"


def _events_sql(most: int) -> str:
    return f"""WITH {USAGE_SQL}, f AS (SELECT *, {_WEEK_SQL} AS week, {_RATCHET_SQL} AS r FROM u WHERE place <= {most}),
ev AS (SELECT *, region || '_' || week // 2 AS post_id, CAST(row_number() OVER (PARTITION BY region, week // 2 ORDER BY tournament_date) - 1 AS INTEGER) AS event,
       (week + length(tournament_id)) % 4 AS kind FROM (SELECT DISTINCT tournament_id, tournament_date, region, week FROM f))"""


def _pick_sql(xs: list[str | None], key: str = "p_partkey") -> str:
    values = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in xs)
    return f"[{values}][{key} % {len(xs)} + 1]"


def _case_sql(column: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {column}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


_TWO = f"""WITH {USAGE_SQL}, f AS (SELECT *, {_WEEK_SQL} AS week, {_RATCHET_SQL} AS r, blade || ' ' || {_RATCHET_SQL} || bit AS txt FROM u WHERE place <= 2)"""
_CHIPS = {x: x.split(" ")[0] for x in catalog.COMPOUND_BLADES}
_MAINS = {x: x.split(" ")[1] for x in catalog.COMPOUND_BLADES} | {"Pegasus Flame": "Flare"}
_FIXED_NAMES = [*catalog.BLADE_FIXES, "Wizard Rod"]
ORACLE_SQL: dict[str, str] = {
    "ing_header": _events_sql(3) + """ SELECT post_id, event, 'Cup ' || tournament_id AS name, tournament_date AS date, 'Town' AS city,
CASE WHEN event = 0 AND kind = 1 THEN NULL ELSE 'ST' END AS state, 'Canada' AS country,
CASE WHEN event > 0 THEN '3on3' ELSE ['3on3', NULL, '1on1', NULL][kind + 1] END AS format,
CASE WHEN event > 0 THEN false ELSE [false, false, true, NULL][kind + 1] END AS ranked FROM ev""",
    "ing_placement_fill": _events_sql(3) + """ SELECT post_id, event, place, player_name AS player, blade, r AS ratchet, bit, stage
FROM f JOIN ev USING (tournament_id)""",
    "ing_placement_nth": _events_sql(24) + """ SELECT post_id, event, place, player_name AS player, count(*) AS combos
FROM f JOIN ev USING (tournament_id) GROUP BY ALL""",
    "ing_deck_pack": _events_sql(3) + """ SELECT post_id, event, place, player_name AS player, count(*) AS combos,
arg_min(blade, blade || ' ' || r || ' ' || bit) AS blade_1 FROM f JOIN ev USING (tournament_id) GROUP BY ALL""",
    "ing_normalise": f"""WITH {USAGE_SQL} SELECT CASE blade WHEN 'Brand#1' THEN 'Brand#01' WHEN 'Brand#2' THEN 'Brand#02' ELSE blade END AS blade,
CAST(sum(CASE WHEN blade IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END) AS BIGINT) AS fixes, count(*) AS uses FROM u GROUP BY 1""",
    "ing_normalise_combos": f"""WITH p AS (SELECT p_partkey, {_pick_sql([*catalog.COMPOUND_BLADES, 'Wizard Rod', 'Wizrd Rod'])} AS b, {_pick_sql(['5-50', '9-60'])} AS r,
  {_pick_sql([*catalog.BIT_REWRITES, 'Ball'])} AS t, {_pick_sql(['Wizrd Rod', None, 'Heavy'])} AS a, {_pick_sql([None, 'Dark', 'Dran', None, None])} AS l FROM part)
SELECT p_partkey, CASE WHEN b = 'Wizrd Rod' THEN 'Wizard Rod' WHEN l IS NULL THEN {_case_sql('b', _MAINS, 'b')} ELSE b END AS blade,
CASE r WHEN '5-50' THEN '4-50' ELSE r END AS ratchet, {_case_sql('t', catalog.BIT_REWRITES, 't')} AS bit,
CASE a WHEN 'Wizrd Rod' THEN 'Wizard Rod' ELSE a END AS assist, CASE WHEN l = 'Dark' THEN NULL WHEN l IS NULL THEN {_case_sql('b', _CHIPS, 'NULL')} ELSE l END AS lock_chip,
CAST((b = 'Wizrd Rod') AS INTEGER) + CAST(coalesce(a = 'Wizrd Rod', false) AS INTEGER) + CAST((r = '5-50') AS INTEGER) + CAST((t <> 'Ball') AS INTEGER)
  + CAST((l IS NULL AND b NOT IN ('Wizard Rod', 'Wizrd Rod')) AS INTEGER) + CAST(coalesce(l = 'Dark', false) AS INTEGER) AS fixes FROM p""",
    "ing_fix_typos": f"""WITH p AS (SELECT p_partkey, {_pick_sql(_FIXED_NAMES)} AS a, {_pick_sql(_FIXED_NAMES, '(p_partkey + 5)')} AS b FROM part)
SELECT p_partkey, {_case_sql('a', catalog.BLADE_FIXES, 'a')} AS blade_1, {_case_sql('b', catalog.BLADE_FIXES, 'b')} AS blade_2,
CAST((a <> 'Wizard Rod') AS INTEGER) + CAST((b <> 'Wizard Rod') AS INTEGER) AS fixes FROM p""",
    "ing_place_offset": f"""WITH {USAGE_SQL}, f AS (SELECT DISTINCT tournament_id, tournament_date, region, place FROM u WHERE place <= 3),
w AS (SELECT *, region || '_' || strftime(tournament_date, '%Y-%m') AS record FROM f WHERE tournament_id IN (SELECT tournament_id FROM f GROUP BY 1 HAVING count(*) = 3))
SELECT record, CAST(row_number() OVER (PARTITION BY record ORDER BY tournament_date, place) AS INTEGER) AS at, tournament_id,
CAST(place + 100 * (dense_rank() OVER (PARTITION BY record ORDER BY tournament_date) - 1) AS INTEGER) AS place FROM w""",
    "ing_match_tables": _TWO + """, c AS (SELECT *, row_number() OVER (PARTITION BY tournament_id, place ORDER BY txt) AS k FROM f),
b AS (SELECT *, count(*) OVER (PARTITION BY tournament_id, k) AS cells FROM c),
h AS (SELECT tournament_id FROM c WHERE k = 1 GROUP BY 1 HAVING count(*) = 2),
ply AS (SELECT tournament_id, player_name, row_number() OVER (PARTITION BY tournament_id ORDER BY min(place)) AS pos FROM c WHERE k = 1 GROUP BY 1, 2),
d AS (SELECT tournament_id, player_name, blade, r, bit, min(10 * k + place) AS first FROM b WHERE cells = 2 AND tournament_id IN (SELECT tournament_id FROM h) GROUP BY ALL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY tournament_id, player_name ORDER BY first) AS INTEGER) AS n FROM d)
SELECT tournament_id AS page, CAST(pos AS INTEGER) AS place, player_name AS player, n, blade, r AS ratchet, bit
FROM n JOIN ply USING (tournament_id, player_name) WHERE n <= 3""",
    "ing_prose_results": _TWO + """, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY tournament_id, place ORDER BY txt) AS INTEGER) AS n,
  max(place) OVER (PARTITION BY tournament_id) AS most, min(place) OVER (PARTITION BY tournament_id) AS least FROM f)
SELECT tournament_id AS post_id, CAST(place - least + 1 AS INTEGER) AS place, player_name || CASE WHEN most = 2 AND week % 2 = 1 THEN ' (東京)'
  WHEN least = 1 THEN ' (大阪)' ELSE '' END AS player, n, blade, r AS ratchet, bit FROM o""",
    "ing_captions": f"""WITH {USAGE_SQL}, f AS (SELECT *, {_RATCHET_SQL} AS r, CASE place WHEN 1 THEN substr(bit, 1, 1) WHEN 2 THEN 'FB' ELSE 'ra' END AS code,
  CASE WHEN blade LIKE '%3' THEN 'Pegasus Blast' WHEN blade LIKE '%4' THEN 'Brave Emperor' ELSE blade END AS b FROM u WHERE place <= 3)
SELECT 'de_' || tournament_id AS post_id, 'Cup Berlin' AS name, tournament_date AS date, 'Berlin' AS city, 'Germany' AS country, place, player_name AS player,
CAST(row_number() OVER (PARTITION BY tournament_id, place ORDER BY b || ' ' || r || code) AS INTEGER) AS n,
CASE b WHEN 'Pegasus Blast' THEN 'Pegasus' WHEN 'Brave Emperor' THEN 'Emperor' END AS lock_chip,
CASE b WHEN 'Pegasus Blast' THEN 'Blast' WHEN 'Brave Emperor' THEN 'Brave' ELSE b END AS blade, r AS ratchet,
CASE WHEN place = 2 THEN 'Free Ball' WHEN place = 3 THEN 'Rush Accel'
     ELSE CASE code WHEN 'E' THEN 'Elevate' WHEN 'L' THEN 'Level' WHEN 'P' THEN 'Point' WHEN 'S' THEN 'Spike' ELSE code END END AS bit FROM f""",
    "src_link_list": """SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
WHERE (lower(link) LIKE '%the%' OR lower(link) LIKE '%page%') AND NOT lower(link) LIKE '%ref%'""",
}
_BY_PAGE = """SELECT 'jp_' || d.tournament_id AS post_id, 'https://example.org/202' || week % 10 || '/' || d.tournament_id || '/' AS url, 'Cup ' || region || '!' AS name,
CASE week % 3 WHEN 2 THEN make_date(2020 + week % 10, 1, 1) ELSE tournament_date END AS date, 'Japan' AS country, place, player, n, blade, ratchet, bit
FROM ({rows}) m JOIN (""" + _TWO + """ SELECT DISTINCT tournament_id, tournament_date, region, week FROM f) d ON d.tournament_id = m.{key}
WHERE (week + length(d.tournament_id)) % 2 = {odd}"""
ORACLE_SQL["ing_match_pages"] = (
    _BY_PAGE.replace("{rows}", ORACLE_SQL["ing_match_tables"]).replace("{key}", "page").replace("{odd}", "0")
    + " UNION ALL "
    + _BY_PAGE.replace("{rows}", ORACLE_SQL["ing_prose_results"]).replace("{key}", "post_id").replace("{odd}", "1")
)
