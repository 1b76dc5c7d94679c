"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegraph.session import prepare, scratch_path

__all__ = ["WORD", "asked", "bitmaps", "delete", "fresh", "held_out", "hash60", "land", "least_rows", "noting", "prepare", "scratch_path", "table", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"  # fixed: a word is a maximal run without ASCII white space


_notes: ContextVar[list[str] | None] = ContextVar("notes", default=None)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back. Inside ``noting`` its path is noted."""
    spark = df.sparkSession
    target = scratch_path(spark, name)
    if (noted := _notes.get()) is not None:
        noted.append(target)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


@contextmanager
def noting(paths: list[str]):
    """Note the tables that are landed inside, so that ``delete`` can remove them once their readers are done."""
    token = _notes.set(paths)
    try:
        yield
    finally:
        _notes.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete noted tables and clear the list."""
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    while paths:
        target = hadoop.Path(paths.pop())
        target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


BITS = 32768  # of a bitmap, as bitmap_construct_agg makes them


def bitmaps(df: DataFrame, row: str, **where: Column) -> DataFrame:
    """Bitmaps of the numbers in ``row`` for which each condition holds, one line for every ``BITS`` numbers.

    At one bit a number and condition they can be broadcast where a table of the numbers could not; so wide rows that are asked for
    their number are not shuffled. Numbers must be dense apart from gaps between files.
    """
    place = F.col(row).bitwiseAND(F.lit(BITS - 1))
    flags = df.select(F.shiftright(row, 15).alias("block"), *[F.when(c, place).alias(n) for n, c in where.items()]).repartition("block")
    return flags.groupBy("block").agg(*[F.bitmap_construct_agg(n).alias(n) for n in where])


def asked(rows: DataFrame, row: str, bits: DataFrame) -> DataFrame:
    """``rows`` with a boolean column for every bitmap in ``bits``: whether it holds the number in ``row``. Its names must be free in ``rows``."""
    block = fresh([*rows.columns, *bits.columns], "_block")
    names = [c for c in bits.columns if c != "block"]
    place = F.col(row).bitwiseAND(F.lit(BITS - 1))
    byte = lambda n: F.conv(F.hex(F.substring(F.col(n), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn(block, F.shiftright(row, 15)).join(F.broadcast(bits.withColumnRenamed("block", block)), block, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns],
                      *[F.coalesce(F.getbit(byte(n), place.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)).alias(n) for n in names])


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash60(*parts: Column) -> Column:
    """A non-negative integer below 2^60 from the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def least_rows(df: DataFrame, key: str, rows: int, bins: int = 4096, near: int = 65536) -> DataFrame:
    """The rows of ``df`` up to a bound on the integer ``key`` that lets through at least ``rows`` of them (all, if there are fewer).

    The bound is narrowed by counts over equal ranges of the key until its last range holds at most ``near`` rows or one value,
    so that a limit on the rest takes little more than it needs. At most ``bins`` counts a step reach the driver. Null keys are left out.
    """
    keys = df.select(F.col(key).cast("bigint").alias("k")).filter("k IS NOT NULL")
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    if low is None:
        return df.filter(F.col(key).isNotNull())
    before = 0
    while True:
        width = max(1, -(-(high - low + 1) // bins))
        cell = F.expr(f"(k - CAST({low} AS DECIMAL(20, 0))) div {width}")
        counts = dict(map(tuple, keys.filter(F.col("k").between(low, high)).groupBy(cell.cast("int").alias("cell")).count().collect()))
        for at in sorted(counts):
            if before + counts[at] >= rows:
                break
            before += counts[at]
        else:
            return df.filter(F.col(key) <= high)
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
        if width == 1 or counts[at] <= near:
            return df.filter(F.col(key) <= high)
