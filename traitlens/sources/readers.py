"""Delimited inputs: ragged tab files, multi-host sets, all-string CSV."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitlens.functions.names import check_case_collisions, col
from traitlens.functions.recode import numeric_or_null

_PAD = "__pad"


def _first_lines(spark: SparkSession, path: str) -> list[str]:
    """The header and one data line; reads two lines, not the file."""
    return [r.value for r in spark.read.text(path).limit(2).collect()]


def read_ragged_tsv(spark: SparkSession, path: str, string_columns: Sequence[str] = ("Gene", "SeqName")) -> DataFrame:
    """Tab-separated file whose data lines may end in a tab that the header lacks.

    Columns outside ``string_columns`` are read as numbers with ``NA`` as
    missing.  The schema is explicit, so no inference pass is needed.
    """
    lines = _first_lines(spark, path)
    header = lines[0].split("\t")
    padded = len(lines) > 1 and lines[1].endswith("\t") and not lines[0].endswith("\t")
    if padded:
        header = header + [_PAD]
    names = [name if name else f"{_PAD}{i}" for i, name in enumerate(header)]
    check_case_collisions(names)
    schema = T.StructType(
        [T.StructField(n, T.StringType() if n in string_columns or n.startswith(_PAD) else T.DoubleType()) for n in names]
    )
    df = spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=schema, enforceSchema=True, mode="FAILFAST")
    return df.select(*[col(n) for n in names if not n.startswith(_PAD)])


def read_hosts(spark: SparkSession, hosts: Sequence[str], suffix: str, directory: str, string_columns: Sequence[str] = ("Gene", "SeqName")) -> DataFrame:
    """One frame for many hosts' files, tagged with HOST.

    Headers may differ between hosts; a column missing for a host is NULL there.
    """
    parts = [
        read_ragged_tsv(spark, f"{directory.rstrip('/')}/{host}{suffix}", string_columns).select(F.lit(host).alias("HOST"), "*")
        for host in hosts
    ]
    return union_ragged(*parts)


def union_ragged(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames by column name, with the source's name in ``tag``."""
    return union_ragged(*[df.select(F.lit(name).alias(tag), "*") for name, df in parts.items()])


def read_strings_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with every column a string; an empty cell is NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def typed_nulls(df: DataFrame, numbers: Sequence[str], tokens: Sequence[str] = ("NA", "-", "")) -> DataFrame:
    """Give the named string columns a numeric type, reading the tokens as missing."""
    return df.withColumns({c: numeric_or_null(col(c), tokens) for c in numbers})
