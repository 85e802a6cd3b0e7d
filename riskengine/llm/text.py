"""Small text expressions that several operators share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_ROWS = 1000
ROW = "_row"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers ``BATCH_ROWS`` at a time, which bounds what a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return what this process has freed, but its allocators keep, to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` for mapInArrow; its worker process, which Spark keeps for later tasks, then gives back its memory.

    Otherwise idle workers hold the most that any task took while later stages run in the JVM beside them.
    """
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()
    return run


def whole(c: Column | str) -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; all other letters stay."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_row(df: DataFrame) -> DataFrame:
    """A number for each input row, given before any explode: repeated rows stay apart."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


FILTER_BITS = 24  # 2 MB, whatever the tables' size


def key_of(key: str, text: str) -> Column:
    """A row's content as one number: rows of equal key and text share it."""
    return F.xxhash64(F.col(key), F.col(text))


def maybe_in(df: DataFrame, number: str, wanted: DataFrame, flag: str = "_may", bits: int = FILTER_BITS) -> DataFrame:
    """Add ``flag``: false only if ``number`` (a long) surely is not in ``wanted`` (its first column).

    A bitmap of fixed size goes to the tasks by a broadcast join on its buckets of 2^15 bits, so that
    an exact join only has to deal out the rows that can have a partner. When a very large ``wanted``
    fills the bitmap, the filter lets all rows pass and the exact join does the work.
    """
    slot = lambda c: F.col(c).bitwiseAND((1 << bits) - 1) + 1
    source = wanted.select(F.col(wanted.columns[0]).alias("_w")).where("_w is not null")
    maps = source.groupBy(F.bitmap_bucket_number(slot("_w")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot("_w"))).alias("_bits"))  # at most 2^bits / 2^15 rows of 4 KB
    place = df.withColumn("_bucket", F.bitmap_bucket_number(slot(number))).withColumn("_bit", F.bitmap_bit_position(slot(number)))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return place.join(F.broadcast(maps), "_bucket", "left").withColumn(flag, held).drop("_bucket", "_bit", "_bits")


def without(df: DataFrame, key: str, text: str, banned: DataFrame) -> DataFrame:
    """The rows whose :func:`key_of` is not in ``banned`` (its first column); most rows are never dealt out."""
    columns = df.columns
    flagged = maybe_in(df.withColumn("_key", key_of(key, text)), "_key", banned)
    gone = banned.select(F.col(banned.columns[0]).alias("_key")).distinct()
    safe = flagged.where("not _may").select(*columns)
    return safe.unionByName(flagged.where("_may").join(gone, "_key", "left_anti").select(*columns))
