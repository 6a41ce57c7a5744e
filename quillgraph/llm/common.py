"""What the operators of this subpackage share: words, scratch tables, bounded key filters, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import components  # noqa: F401
from ..scratch import scratch_root, table  # noqa: F401

#: A word is a run of anything but ASCII white space.
WHITE = "\\x20\\x09-\\x0D"


#: Rows of an Arrow batch where they are texts: a batch of the usual 10,000 would fill tens of MB in the JVM and in Python.
BATCH_ROWS = 1_000


def for_texts(spark: SparkSession) -> None:
    """Make Arrow batches of this session small, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver's, as it is: nulls are left to the operators."""
    for_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    cut = F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+")
    return F.array_remove(cut, "")


def lower_ascii(text: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that a worker holds the Python objects of a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bits of the filter in among(): 2**23 are 1 MB, whatever the input.
FILTER_BITS = 23


def _bitmap(df: DataFrame, key: str, keys: DataFrame, bits: int) -> DataFrame:
    """df with `__hit`: false where a row's key is surely not among keys, by a bitmap of at most 2**(bits-6) rows."""
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    word, bit = F.expr("__at div 64"), F.expr("shiftleft(1L, cast(__at % 64 as int))")
    bitmap = keys.withColumn("__at", at).groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    marked = df.withColumn("__at", at).withColumn("__word", word).join(F.broadcast(bitmap), "__word", "left")
    return marked.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__at", "__word", "__bits")


def among(df: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose key is in keys (one column of that name, any size).

    The broadcast bitmap drops most other rows before the exact join shuffles the rest, so wide rows that no key wants
    don't move.
    """
    return _bitmap(df, key, keys, bits).filter("__hit").drop("__hit").join(keys.select(key).distinct(), key)


def without(df: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose key is not in keys; only those that the bitmap can't tell are shuffled."""
    marked = _bitmap(df, key, keys, bits)
    unsure = marked.filter("__hit").drop("__hit").join(keys.select(key).distinct(), key, "left_anti")
    return marked.filter("not __hit").drop("__hit").unionByName(unsure)
