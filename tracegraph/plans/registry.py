"""Registry of named queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracegraph.sources.adapter import Tables

NUDGE = 3e-9  # moves exact decimal ties off the edge, so that every engine rounds them alike
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def present(df: DataFrame) -> DataFrame:
    """Uniform output types: integers as BIGINT, flags as 0/1, doubles to six digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + NUDGE, 6)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


STORES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Trace tables of a folder: derived and landed once per application, then read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in STORES:
        STORES[key] = Tables(spark, sf_dir)
    return STORES[key]


def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(tables(spark, sf_dir)))

    return run


def load() -> None:
    from tracegraph.plans import catalog  # noqa: F401  (registers everything)
