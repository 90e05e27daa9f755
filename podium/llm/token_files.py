"""Token ids in files: texts are encoded, written as checksummed blocks in ascending order of their ids, and read back.

Rows are dealt by ranges of doc_id, then of a hash of the text and of the row, so that ids held by very many rows are divided
too; each range is sorted and becomes one shard. A shard is a sequence of blocks (`id_coder`), which need not begin or end with
a document; each block's row also holds which pieces of which documents are in it, so that a lost task repeats its own shard
and a reader decodes any block without the others. The files are Parquet with one row a block, since that is what executors can
write to any store.

Encoding takes the tokenizers library's ids. Byte-level pieces never reach across a space that follows something else than
white space, so texts are cut there, and each different unit of some 24 MB of text is cut further where a piece certainly ends: after
a letter before a sign, and after a single line end. The library encodes each different part once; the first ones stay known.

Edge cases: null text is read as empty, and an empty one has the end id only; texts of any length are cut into as many blocks as
they need; rows with one id, null ids (which come first) and equal rows are documents of their own, in the order of the hash of
their text; an empty table gives an empty result; columns besides doc_id and text are ignored. A block that is not what was
written raises an error.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import id_coder
from podium.llm.bpe import byte_letters
from podium.llm.common import few_rows_a_batch, read, shared_dir, whole_text

#: A space after something that is not white space: pieces end there.
CUT = re.compile(r"(?<=\S)(?= )")
#: White space before a space, where that may not be so; Arrow's expressions know white space of ASCII only.
UNSURE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Further certain ends of pieces: after a letter before a sign, and after one line end between signs or letters.
LETTER, SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
ENDS = (f"([0-9{LETTER}{SIGN}]\n)([0-9{LETTER}{SIGN}])", f"([{LETTER}])([{SIGN}\n])")
#: One piece, which the vocabulary's model can merge without looking for pieces.
PIECE = re.compile(f" ?[{LETTER}]+")


class Units:
    """A byte-level vocabulary of the tokenizers library; ids of a text are looked up by what stands between certain ends of
    pieces, each different one of a call once.

    The first `most` that a worker meets stay known; frequent ones are among them.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.library, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ends, ids = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if texts else []

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text end, and those of all texts one after the other."""
        units, of_text, at = self.units(texts)
        pieces, of_unit, own = self.pieces(units)
        lists = self.ids(pieces.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        ids = np.frombuffer(b"".join(lists), np.uint32)
        lengths, ids = _gathered(lengths, ids, of_unit, own)
        lengths, ids = _gathered(lengths, ids, of_text, at)
        return np.cumsum(lengths), ids

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different units, how many each text has, and their numbers in the order of the texts."""
        unsure = np.flatnonzero(pc.match_substring_regex(texts, UNSURE).to_numpy(zero_copy_only=False))
        sure = texts
        if len(unsure):
            mask = np.zeros(len(texts), bool)
            mask[unsure] = True
            sure = pc.if_else(pa.array(mask), "", texts)
        split = pc.split_pattern(sure, " ")
        words = split.flatten().dictionary_encode()
        at, n_units = words.indices.to_numpy().astype(np.int64), pc.list_value_length(split).to_numpy().astype(np.int64)
        # the first of a text has no space before it; all units of unsure texts are cut by the expression
        first = np.cumsum(n_units) - n_units
        own, heads = pc.list_element(split, 0).to_pylist(), np.ones(len(texts), np.int64)
        for i in unsure[::-1].tolist():
            own[i : i + 1] = cut = CUT.split(texts[i].as_py())
            heads[i] = len(cut)
        if len(unsure):
            times = np.ones(len(at), np.int64)
            times[first] = heads
            at = np.repeat(at, times)
            first = np.repeat(np.cumsum(n_units - 1 + heads) - (n_units - 1 + heads), heads)
            first += np.arange(len(own)) - np.repeat(np.cumsum(heads) - heads, heads)
        at[first] = len(words.dictionary) + np.arange(len(own))
        spaced = pc.binary_join_element_wise("", words.dictionary, " ")
        return pa.concat_arrays([spaced, pa.array(own, pa.string())]), n_units - 1 + heads, at

    def pieces(self, units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The same of units: they are cut at further certain ends, but for those with a special token in them."""
        codes = (c for c in range(1, 0xD800) if c != ord("\\") and not chr(c).isspace())
        mark = next((chr(c) for c in codes if not pc.any(pc.match_substring(units, chr(c))).as_py()), None)
        if mark is None:  # every character is in these texts
            whole = np.arange(len(units))
            return units, np.ones(len(units), np.int64), whole
        cut = units
        for ends in ENDS:
            cut = pc.replace_substring_regex(cut, ends, rf"\1{mark}\2")
        for token in self.special:
            cut = pc.if_else(pc.match_substring(units, token), units, cut)
        split = pc.split_pattern(cut, mark)
        pieces = split.flatten().dictionary_encode()
        return pieces.dictionary, pc.list_value_length(split).to_numpy().astype(np.int64), pieces.indices.to_numpy()

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each, as bytes; those not known by the library."""
        found = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        plain = [i for i in new if not PIECE.fullmatch(pieces[i])]
        for i, ids in zip(plain, self.library.encode_batch_fast([pieces[i] for i in plain], add_special_tokens=False)):
            found[i] = array("I", ids.ids).tobytes()
        single = [i for i in new if found[i] is None]
        spelled = "\n".join([pieces[i] for i in single]).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        merged = self.library.model.tokenize
        for i, name in zip(single, spelled):
            found[i] = array("I", [token.id for token in merged(name)]).tobytes()
        self.known.update([(pieces[i], found[i]) for i in new[: max(self.most - len(self.known), 0)]])
        return found


def _gathered(lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids, given by lengths, in the order `at`, and joined by as many of them as `counts` says."""
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), pa.array(ids))
    ends = np.concatenate([[0], np.cumsum(lengths[at])])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(ends), lists.take(pa.array(at)).flatten().to_numpy()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Units:
    return Units(path)


class _Shard:
    """Cuts documents, as they come, into groups of blocks."""

    def __init__(self, block_ids: int, at_once: int):
        self.block_ids, self.group = block_ids, block_ids * at_once
        self.held, self.total, self.first, self.row = [], 0, 0, 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[dict]]:
        self.held.append([doc_id, self.row, 0, ids])
        self.row += 1
        self.total += len(ids)
        while self.total >= self.group:
            yield self.cut(self.group)

    def cut(self, size: int) -> list[dict]:
        """The next `size` ids as blocks of nearly one length."""
        blocks = -(-size // self.block_ids)
        lengths = np.full(blocks, size // blocks)
        lengths[: size % blocks] += 1
        ids, pieces, at = np.zeros((blocks, lengths[0]), np.uint32), [], 0
        for block, n in enumerate(lengths):
            own, filled = [], 0
            while filled < n:
                doc = self.held[at]
                doc_id, row, piece, left = doc
                now = left[: n - filled]
                ids[block, filled : filled + len(now)] = now
                filled += len(now)
                own.append({"doc_id": doc_id, "row": row, "piece": piece, "n": len(now)})
                doc[2:] = piece + 1, left[len(now) :]
                at += not len(doc[3])
            pieces.append(own)
        self.held, self.total = self.held[at:], self.total - size
        coded = id_coder.encode(ids, lengths)
        out = []
        for n, own, data in zip(lengths, pieces, coded):
            out.append({"first": self.first, "n": int(n), "pieces": own, "data": data})
            self.first += int(n)
        return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of batches, as many together as have about `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            held, total = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary_file: str,
    *,
    end_id: int = 2,
    block_ids: int = 2048,
    at_once: int = 4096,
    text_bytes: int = 24 << 20,
) -> None:
    """Write the ids of each text of `docs` and `end_id` after them, in ascending order of doc_id, as blocks to `path`.

    `block_ids` ids a block at most; `at_once` blocks are coded in step and texts of about `text_bytes` together encoded at once,
    which bounds what a task holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, shard, number = vocabulary(vocabulary_file), _Shard(block_ids, at_once), TaskContext.get().partitionId()

        def rows(blocks: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": number} | b for b in blocks], schema)

        for names, texts in _chunks(batches, text_bytes):
            ends, ids = units.encode_flat(texts)
            pa.default_memory_pool().release_unused()
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends += np.arange(1, len(ends) + 1)
            start = 0
            for doc_id, end in zip(names.to_pylist(), ends.tolist()):
                for blocks in shard.add(doc_id, ids[start:end]):
                    yield rows(blocks)
                start = end
        if shard.total:
            yield rows(shard.cut(shard.total))

    rows = docs.select("doc_id", whole_text().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    schema = _arrow_schema(rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = f"array<struct<doc_id:{kind},row:bigint,piece:int,n:int>>"
    with few_rows_a_batch(docs.sparkSession):
        coded = dealt.mapInArrow(run, f"shard int, first bigint, n int, pieces {pieces}, data binary")
        coded.write.option("compression", "zstd").parquet(path)


def _arrow_schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    piece = pa.struct([("doc_id", kind), ("row", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())])
    fields = [("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("pieces", pa.list_(piece)), ("data", pa.binary())]
    return pa.schema(fields)


def _pieces(spark: SparkSession, path: str, at_once: int, what: str, fold) -> DataFrame:
    """(doc_id, shard, row, piece, at, n, <what>) of every piece of a document in the files: `at` counts ids of the shard before
    it, and `fold` makes a value of its ids."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = -(-batch.num_rows // at_once)
            step = -(-batch.num_rows // max(groups, 1))
            for start in range(0, batch.num_rows, max(step, 1)):
                rows = batch.slice(start, step).to_pylist()
                out = []
                for block, ids in zip(rows, id_coder.decode([b["data"] for b in rows])):
                    at = 0
                    for p in block["pieces"]:
                        value = fold(ids[at : at + p["n"]])
                        out.append((p["doc_id"], block["shard"], p["row"], p["piece"], block["first"] + at, p["n"], value))
                        at += p["n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = spark.createDataFrame([], f"doc_id {kind}, shard int, row bigint, piece int, at bigint, n int, {what}")
    schema = to_arrow_schema(empty.schema)
    names, types = schema.names, schema.types
    return blocks.mapInArrow(run, empty.schema)


def _with_start(pieces: DataFrame, path: str) -> DataFrame:
    """The column `at` counted from the first shard on; one row a shard goes through the driver."""
    spark = pieces.sparkSession
    totals = spark.read.parquet(path).groupBy("shard").agg(F.max(F.col("first") + F.col("n")).alias("n")).collect()
    before, bases = 0, []
    for shard, n in sorted(tuple(r) for r in totals):
        bases.append((shard, before))
        before += n
    bases = spark.createDataFrame(bases, "shard int, base bigint")
    return pieces.join(F.broadcast(bases), "shard").withColumn("at", F.col("at") + F.col("base"))


def read_ids(spark: SparkSession, path: str, *, at_once: int = 4096) -> DataFrame:
    """(doc_id, start, ids) of every document in the files, its end id included."""
    pieces = _with_start(_pieces(spark, path, at_once, "ids array<bigint>", lambda ids: ids.tolist()), path)
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    whole = pieces.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("start"), parts.alias("parts"))
    return whole.select("doc_id", "start", F.flatten("parts.ids").alias("ids"))


def digests(spark: SparkSession, path: str, *, at_once: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; no ids leave the tasks that decode them."""
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    pieces = _with_start(_pieces(spark, path, at_once, "crc bigint", crc), path)
    parts = F.array_sort(F.collect_list(F.struct("piece", "n", "crc")))
    whole = pieces.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("start"), F.sum("n").alias("n_tokens"), parts.alias("parts")
    )

    @F.pandas_udf("bigint")
    def joined(parts):
        return parts.map(lambda x: None if x is None else functools.reduce(_joined, ((p["crc"], 4 * p["n"]) for p in x))[0])

    several = joined(F.when(F.size("parts") > 1, F.col("parts")))
    return whole.select("doc_id", "start", "n_tokens", F.coalesce(several, F.col("parts")[0]["crc"]).alias("ids_crc32"))


#: The polynomial of crc32, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return product


@functools.lru_cache(maxsize=1 << 16)
def _zeros(n: int) -> int:
    """What `n` bytes of zeros multiply a checksum by: x to the 8 n."""
    power, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return power


def _joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """(crc32, length) of two byte strings one after the other, from theirs."""
    return _times(_zeros(b[1]), a[0]) ^ b[0], a[1] + b[1]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), path, vocabulary_path())
    return digests(spark, path)
