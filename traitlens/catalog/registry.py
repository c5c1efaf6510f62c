"""Names, callables and SQL twins of the checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.sampledata import SampleData

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the sample tables and, where one exists, its SQL twin."""

    def add(build: Callable[[SampleData], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(SampleData(spark, folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def with_sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(c.strip() for c in ctes)} {body.strip()}"


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(col(name), 6).alias(alias or name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c) if c in names else col(c) for c in df.columns])


# Ratios of small counts often end in an exact 5 at the seventh digit, where the
# two engines round differently; this much moves them off the edge in both.
NUDGE = 1e-10


def rounded_ratios(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(col(c) + NUDGE, 6).alias(c) if c in names else col(c) for c in df.columns])
