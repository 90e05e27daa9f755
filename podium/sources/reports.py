"""Sources of tournament reports: page dumps, page folders, nested JSON, and posts inside pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broken file is an error, not an empty one.
STRICT = {"mode": "FAILFAST"}
EVENTS = """array<struct<wbo_post_id: string, name: string, date: string, placements: array<struct<place: int,
player: string, combos: array<struct<blade: string, lock_chip: string, ratchet: string, bit: string, assist: string>>>>>>"""
CHAMPIONSHIPS = """tournaments array<struct<id: string, name: string, date: string, location: string, region: string,
format: string, class: string, placements: array<struct<place: int, player: string, player_region: string,
combos: array<struct<blade: string, ratchet: string, bit: string, lock_chip: string>>>>>>"""


def page_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, html) of JSON objects that map page numbers to HTML."""
    text = spark.read.text(path, wholetext=True)
    pages = text.select(F.explode(F.from_json("value", "map<string,string>", STRICT)).alias("page_no", "html"))
    return pages.select(F.col("page_no").cast("int").alias("page_no"), "html")


def page_folder(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, html) of files named by page number."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="page_*.html")
    number = F.regexp_extract(F.input_file_name(), r"page_(\d+)\.html", 1).cast("int")
    return text.select(number.alias("page_no"), F.col("value").alias("html"))


def event_json(spark: SparkSession, path: str, default_date: str = "2024-01-01") -> DataFrame:
    """(post_id, name, date, place, player, combos) of arrays of events; a missing date is the default."""
    text = spark.read.text(path, wholetext=True)
    events = text.select(F.explode(F.from_json("value", EVENTS, STRICT)).alias("e")).select("e.*")
    rows = events.withColumn("p", F.explode_outer("placements"))
    date = F.coalesce(F.try_to_date(F.col("date")), F.to_date(F.lit(default_date)))
    return rows.select(F.col("wbo_post_id").alias("post_id"), "name", date.alias("date"), "p.*")


def championship_json(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, name, date, region, place, player, combos); placements without combos are left out."""
    text = spark.read.text(path, wholetext=True)
    events = text.select(F.explode(F.from_json("value", CHAMPIONSHIPS, STRICT)["tournaments"]).alias("e")).select("e.*")
    rows = events.withColumn("p", F.explode("placements")).filter(F.size("p.combos") > 0)
    return rows.select(
        F.concat(F.lit("champ_"), "id").alias("post_id"),
        "name",
        F.try_to_date(F.col("date")).alias("date"),
        F.coalesce("region", F.lit("JAPAN")).alias("region"),
        "p.place",
        "p.player",
        "p.combos",
    )


class _Tables(HTMLParser):
    """Collects (table, row, cell, is a header cell, text) of the tables of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, int, bool, str]] = []
        self.table, self.row, self.cell, self.text = -1, -1, -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.cell = self.row + 1, -1
        elif tag in ("td", "th") and self.table >= 0:
            self.cell, self.text, self.head = self.cell + 1, [], tag == "th"
        elif tag == "br" and self.text is not None:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            self.found.append((self.table, self.row, self.cell, self.head, "".join(self.text).strip()))
            self.text = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


class _Page(_Tables):
    """Collects, beside the tables, the first heading and title, the first time that has a date, all text, and the text of the
    first entry or article."""

    def __init__(self) -> None:
        super().__init__()
        self.texts: dict[str, list[str]] = {"all": []}
        self.open: dict[str, int] = {}  # parts being read, by how many elements of their tag are open inside
        self.time, self.silent = None, 0

    def _part(self, tag: str, kinds: list[str]) -> str | None:
        if tag == "div":
            return "entry" if "entry-content" in kinds else None
        return tag if tag in ("h1", "title", "article") else None

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        own = dict(attrs)
        self.silent += tag in ("script", "style")
        if tag == "time" and self.time is None and own.get("datetime") is not None:
            self.time = own["datetime"]
        same = {"entry": "div"}
        for part in self.open:
            self.open[part] += same.get(part, part) == tag
        part = self._part(tag, (own.get("class") or "").split())
        if part and part not in self.texts:
            self.texts[part], self.open[part] = [], 1

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self.silent -= tag in ("script", "style") and self.silent > 0
        same = {"entry": "div"}
        for part in [p for p in self.open if same.get(p, p) == tag]:
            self.open[part] -= 1
            if not self.open[part]:
                del self.open[part]

    def handle_data(self, data):
        super().handle_data(data)
        if not self.silent:
            for part in ("all", *self.open):
                self.texts[part].append(data)

    def rows(self) -> Iterator[tuple]:
        """(kind, t, r, c, head, text): title, time, whole (all text), content (what holds the report), tables (how many), cell."""
        text = {part: "".join(found) for part, found in self.texts.items()}
        once = [("title", text.get("h1", text.get("title"))), ("time", self.time), ("whole", text["all"]),
                ("content", text.get("entry", text.get("article", text["all"]))), ("tables", str(self.table + 1))]
        yield from ((kind, None, None, None, None, value) for kind, value in once if value is not None)
        yield from (("cell", *cell) for cell in self.found)


def page_rows(pages: DataFrame) -> DataFrame:
    """(page, kind, t, r, c, head, text): everything that match pages (page, html) are read from, by one pass over their HTML."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parser = _Page()
                parser.feed(html.as_py() or "")
                out += [(page, *x) for x in parser.rows()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["page", "kind", "t", "r", "c", "head", "text"]
            )

    rows = pages.select(F.col("page").cast("string"), "html")
    return rows.mapInArrow(parse, "page string, kind string, t int, r int, c int, head boolean, text string")


def table_cells(pages: DataFrame) -> DataFrame:
    """(page, t, r, c, head, text): the cells of all tables in pages (page, html)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parser = _Tables()
                parser.feed(html.as_py() or "")
                out += [(page, *x) for x in parser.found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["page", "t", "r", "c", "head", "text"]
            )

    rows = pages.select(F.col("page").cast("string"), "html")
    return rows.mapInArrow(parse, "page string, t int, r int, c int, head boolean, text string")


class _Posts(HTMLParser):
    """Collects (id, text) of post divisions; the body's pieces of text are joined by newlines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.depth = self.post_at = self.body_at = 0
        self.post, self.text = "", []

    def handle_starttag(self, tag, attrs):
        if tag != "div":
            return
        self.depth += 1
        own = dict(attrs)
        kinds = (own.get("class") or "").split()
        if not self.post_at and "post" in kinds and (own.get("id") or "").startswith("pid"):
            self.post_at, self.post = self.depth, own["id"]
        elif self.post_at and not self.body_at and "post_body" in kinds:
            self.body_at, self.text = self.depth, []

    def handle_endtag(self, tag):
        if tag != "div":
            return
        if self.depth == self.body_at:
            lines = [x.strip() for piece in self.text for x in piece.split("\n")]
            self.found.append((self.post.removeprefix("pid"), "\n".join(x for x in lines if x)))
            self.body_at = 0
        if self.depth == self.post_at:
            self.post_at = 0
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.body_at:
            self.text.append(data)


def posts(pages: DataFrame) -> DataFrame:
    """(post_id, text) of every post in the pages' HTML, blocked pages left out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for html in batch.column(0):
                parser = _Posts()
                parser.feed(html.as_py() or "")
                out += parser.found
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["post_id", "text"]
            )

    ready = pages.filter(~F.coalesce(F.col("html"), F.lit("")).contains("Just a moment")).select("html")
    return ready.mapInArrow(parse, "post_id string, text string")
