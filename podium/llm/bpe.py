"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two symbols that stand next to each other inside some vocabulary token. Byte pairs that occur in no
token are therefore certain cuts: a word is split there, the fragments are encoded on their own, and the ids are
concatenated. Fragments recur far more often than words, so most work is a lookup; a fragment's merges run over a heap of
neighbouring pairs, so a very long one costs n log n.

The vocabulary file is a parameter and is read where the tasks run, once per worker. Texts are encoded whole; documents
are independent, so a lost executor only repeats its own partitions.

Letters and digits are those of the installed Unicode tables; characters that newer tables added may be split otherwise
than by a library with older ones.

Edge cases: null text is read as empty and has no ids; a special token's string in a text becomes its id, as the
tokenizers library does; very long words and texts are encoded whole; rows are encoded one by one, so repeated and null
ids do not matter; an empty table gives an empty result; columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import shielded, small_batches, whole_text

END = "</w>"
#: White space of Unicode, which the vocabulary's normaliser folds and its word pattern leaves out (fixed values).
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordBPE:
    """A vocabulary with word ends, as read from a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder"):
            raise ValueError("a BPE vocabulary with word ends and without a decoder is needed")
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a vocabulary that normalises by NFC, white space and lower case is needed")
        self.ids: dict[str, int] = model["vocab"]
        #: Rank of a pair of ids (as one number), and the id that each rank merges into.
        self.ranks: dict[int, int] = {}
        self.into: list[int] = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(self.ids[a] << 32 | self.ids[b], len(self.into))
            self.into.append(self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        inside, at_end = set(), set()
        for token in self.ids:
            body = token.removesuffix(END)
            inside.update([body[i : i + 2] for i in range(len(body) - 1)])
            if token.endswith(END) and len(body) > 1:
                at_end.add(body[-2:])
        #: Pairs that some token holds before its end, and pairs that end a token with a word end.
        self.inside, self.at_end = inside, at_end
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace("\\s", SPACE))
        self.space = regex.compile(f"[{SPACE}]+")
        #: What all special tokens begin with, and a pattern that cuts them out.
        self.mark = os.path.commonprefix(list(self.special)) if self.special else None
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len)[::-1])) + ")")
        self.limit = cache
        self.seen: dict[str, tuple[bytes, str]] = {}
        self.fragments: dict[str, list[int]] = {}

    def chunks(self, text: str) -> list[str]:
        """The lower-cased runs between white space; no token crosses them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to the vocabulary
            return [x for x in self.space.split(text) if x]
        return text.split()

    def split(self, word: str) -> list[str]:
        """Fragments between certain cuts."""
        inside, last = self.inside, len(word) - 2
        cuts = [i + 1 for i in range(last + 1) if word[i : i + 2] not in inside]
        if cuts and cuts[-1] == last + 1 and word[last:] in self.at_end:
            cuts.pop()
        if not cuts:
            return [word]
        cuts = [0, *cuts, len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, fragment: str, final: bool) -> list[int]:
        """Ids of a fragment; `final` fragments carry the word end."""
        ids = [self.ids[c] for c in fragment]
        if final:
            ids[-1] = self.ids[fragment[-1] + END]
        n, rank, into = len(ids), self.ranks.get, self.into
        none = len(into)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        if n > 100:
            return self._merge_long(ids, ranks)
        while ranks and (best := min(ranks)) < none:  # a scan of so few ranks is cheaper than a heap
            i = ranks.index(best)
            ids[i] = new = into[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, none)
        return ids

    def _merge_long(self, ids: list[int], first: list[int]) -> list[int]:
        """The same merges over a heap of neighbouring pairs."""
        n, rank, into = len(ids), self.ranks.get, self.into
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i, r in enumerate(first) if r < len(into)]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = into[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank(ids[i] << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := rank(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, p))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of one word: fragments between certain cuts, encoded one by one."""
        if not (word.isascii() and word.isalpha()):
            letters = self.letters
            word = "".join([letters[b] for b in word.encode()])
        *pieces, last = self.split(word)
        if not pieces:
            return self.merge(last, True)
        out: list[int] = []
        for piece in pieces:
            ids = self.fragments.get(piece)
            if ids is None:
                ids = self.merge(piece, False)
                if len(piece) <= 64:
                    if len(self.fragments) >= self.limit:
                        self.fragments.clear()
                    self.fragments[piece] = ids
            out += ids
        return out + self.merge(last, True)

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids (as bytes of 32-bit integers) and tokens of a run without white space."""
        if chunk.isalpha():
            ids = self.word(chunk)
        else:
            ids = [i for w in self.words.findall(chunk) for i in self.word(w)]
        found = array("i", ids).tobytes(), " ".join([self.strings[i] for i in ids])
        if len(chunk) <= 64:
            if len(self.seen) >= self.limit:
                self.seen.clear()
            self.seen[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (as bytes of 32-bit integers) and the tokens joined by spaces."""
        found: list[tuple[bytes, str]] = []
        special = self.mark is not None and self.mark in text
        for i, part in enumerate(self.cut_special.split(text) if special else [text]):
            if i % 2:
                found.append((array("i", [self.special[part]]).tobytes(), part))
            else:
                seen, chunk = self.seen, self.chunk
                found += [seen.get(x) or chunk(x) for x in self.chunks(part)]
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found])

    def decode(self, ids) -> str:
        """The tokens joined by spaces, special tokens included."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


@functools.cache
def vocabulary(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns of `docs` and its rows, with ids (array of int) and decoded (text) added."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_bpe_text"))
            rest = batch.drop_columns(["_bpe_text"])
            first = 0
            while first < batch.num_rows:
                sizes, flat, decoded, room, i = [0], [], [], 1_000_000, first
                while i < batch.num_rows and room > 0:
                    raw = texts[i].as_py()
                    ids, tokens = bpe.encode(raw)
                    flat.append(ids)
                    sizes.append(sizes[-1] + len(ids) // 4)
                    decoded.append(tokens)
                    room -= len(raw)
                    i += 1
                values = pa.array(np.frombuffer(b"".join(flat), dtype=np.int32))
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                own = rest.slice(first, i - first)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, ids, pa.array(decoded, pa.string())], names=[*own.schema.names, "ids", "decoded"]
                )
                first = i

    small_batches(docs.sparkSession)
    docs, back = shielded(docs, "_bpe_text")
    held = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(held).schema)
    rows = docs.select(*held, F.coalesce(F.col(text), F.lit("")).alias("_bpe_text"))
    return back(rows.mapInArrow(run, f"{schema}, ids array<int>, decoded string"))


def decode(df: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """`df` with the column `text` made from its ids."""

    @F.pandas_udf("string")
    def tokens(column):
        bpe = vocabulary(path)
        return column.map(lambda x: None if x is None else bpe.decode(x))

    return df.withColumn("text", tokens(F.col(ids)))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", whole_text().alias("text"))
    return encode(docs, vocabulary_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
