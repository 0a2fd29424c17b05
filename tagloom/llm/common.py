"""Pieces that several operators share: word splitting, Arrow batches, checkpoints, column folds."""

from __future__ import annotations

import ctypes
import math
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give free memory back to the system, as idle workers share an executor's memory with the JVM stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, done: Callable[[], None] = lambda: None) -> DataFrame:
    """Narrow Arrow map, at most BATCH_ROWS rows a call so that long texts stay within memory.

    fn is called with one record batch and returns a dict of columns in the order of schema; done is called when a task ends.
    """
    from pyspark.sql.types import StructType

    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_ROWS):
                    out = fn(whole.slice(at, BATCH_ROWS))
                    yield pa.record_batch([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            done()
            release()

    return df.mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def table(schema: str, **columns) -> pa.Table:
    """Arrow table with the columns of a flat "name type, ..." schema; usable where there is no Spark session."""
    fields = [pa.field(*(x if k == 0 else _ARROW[x] for k, x in enumerate(f.split()))) for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema(fields))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, not decoded."""
    return column.cast(pa.binary()).to_pylist()


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def crc_mod_py(value, mod: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % mod


def native_words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, as in tests."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tagloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, so a lost executor loses none of them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_round(df: DataFrame) -> DataFrame:
    """As cut, for tables that loops join again and again: the size estimate of a join is the product of its sides', and a
    checkpoint keeps it, so that after a few rounds the planner would multiply numbers of millions of digits. Here it starts anew.
    """
    rows = cut(df)
    session = df.sparkSession
    fresh = session._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False)
    return DataFrame(fresh, session)


def text_volume(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and code points of a text column, from one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars")).first()
    return int(row["n"]), int(row["chars"] or 0)


def hash_bucket(n: int, *columns: str) -> Column:
    """Bucket by all the columns given, so that rows which share an id, or have none, are dealt by their text too."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def bucket_count(chars: int, target_chars: int = 8_000_000, least: int = 64) -> int:
    """Number of buckets, and of hash shards, for a text volume; never so few that a cluster would idle.

    Buckets ask every shard, so messages grow with the square of this number. Buckets therefore hold target_chars of text at 64
    of them and grow with the cube root of the volume beyond: 9 million messages at 30 GB of text, 93 million of 7 kB at
    1 TB (101 million code points a bucket), where buckets of a fixed size would take 15 billion.
    """
    base = least * target_chars
    return least if chars <= base else math.ceil(least * (chars / base) ** (2 / 3))


def spans_by_bytes(texts: list[bytes | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most about so many bytes, so that word lists stay bounded."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= most):
            size += len(texts[end] or b"")
            end += 1
        yield at, end
        at = end
