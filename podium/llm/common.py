"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in most contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where unset, a fresh temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Let Arrow batches hold at most `rows` rows and about `size` bytes, so that tasks stay small on long texts."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(re.sub(r"\D+$", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> Iterator[None]:
    """`small_batches` for what runs inside; the session's own settings come back afterwards."""
    keys = [f"spark.sql.execution.arrow.{key}" for key in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    own = [spark.conf.get(key) for key in keys]
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for key, value in zip(keys, own):
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among `columns`."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with columns of these names, which an operator uses inside, called otherwise, and what names them back."""
    taken = {c for c in df.columns if c.lower() in names}
    moved = {c: fresh([*df.columns, *names], f"_own_{c}") for c in taken}
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({new: c for c, new in moved.items()})


class Tables:
    """Intermediate tables of one run, in the shared folder; each can be dropped once no later plan reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = f"{shared_dir(self.spark)}/{self.name}-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """`df`, which has `rows` rows, to be broadcast up to `limit` of them and shuffled beyond."""
    return F.broadcast(df) if rows <= limit else df


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; one single-character split, so no regular expression runs."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def held_out(remainder: int, modulus: int, col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves `remainder` on division by `modulus`."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus == remainder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
