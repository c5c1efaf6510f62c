"""Wide to long, long to wide, splitting names, relabelled copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str] | None = None, name: str = "Feature", value: str = "Value") -> DataFrame:
    """One row per key and feature; NULL values keep their rows.

    Name the features wanted: choosing them here prunes the scan, while a filter
    on the long form would come after the expansion.
    """
    features = list(features) if features is not None else [c for c in df.columns if c not in keys]
    return df.select(*[col(k) for k in keys], *[col(f) for f in features]).unpivot(
        [col(k) for k in keys], [col(f) for f in features], name, value
    )


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, levels: Sequence[str]) -> DataFrame:
    """One column per level; the levels are given, so no pass looks for them."""
    return df.groupBy(*[col(k) for k in keys]).pivot(name, list(levels)).agg(F.first(col(value), ignorenulls=True))


def identifier_parts(df: DataFrame, source: str = "SeqName", into: Sequence[str] = ("Gene", "Transcript"), sep: str = r"\|") -> DataFrame:
    """Split an identifier, without its leading ``>``, into named columns."""
    pieces = F.split(F.regexp_replace(col(source), "^>", ""), sep)
    parts = [F.get(pieces, i).alias(n) for i, n in enumerate(into)]
    return df.select(*parts, *[col(c) for c in df.columns if c != source and c not in into])


def resample_parts(df: DataFrame, source: str = "Resample") -> DataFrame:
    """``Fold1.Rep01`` to Fold and Replicate."""
    pieces = F.split(col(source), r"\.")
    return df.withColumns({"Fold": F.get(pieces, 0), "Replicate": F.get(pieces, 1)}).drop(source)


def relabelled_copy(df: DataFrame, column: str, value: str, copy: str) -> DataFrame:
    """Rows with ``value`` appear a second time under ``copy``; one scan."""
    labels = F.when(col(column) == value, F.array(F.lit(value), F.lit(copy))).otherwise(F.array(col(column)))
    return df.withColumn(column, F.explode(labels))


def exploded_array(df: DataFrame, keys: Sequence[str], array: Column, name: str) -> DataFrame:
    return df.select(*[col(k) for k in keys], F.explode(array).alias(name))
