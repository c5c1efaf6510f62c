"""Quantile sketches as stored columns, merged in two stages.

Each map task sketches its own rows; sketches then meet by a salt, some tens in each
task, and only one sketch per salt reaches the last merge.  So no task merges more
than about the square root of the number of map tasks, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col

#: Accuracy parameter of the sketches: ranks are right to about one part in 200.
ACCURACY = 400


def stages(df: DataFrame) -> int:
    """Salts of the first merge: the square root of the number of map tasks."""
    return max(1, math.isqrt(max(1, df.rdd.getNumPartitions())))


def sketched(df: DataFrame, groups: Sequence[str], values: Sequence[str], salts: int | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with a binary sketch of each value column, NULL and NaN left out; ``values`` names are kept."""
    salts = salts or stages(df)
    known = df.select(*[col(g) for g in groups], *[F.expr(f"nullif(CAST(`{v}` AS DOUBLE), DOUBLE('NaN'))").alias(v) for v in values])
    by_salt = known.groupBy(*groups, (F.spark_partition_id() % salts).alias("__salt")).agg(*[F.kll_sketch_agg_double(v, F.lit(accuracy)).alias(v) for v in values])
    return by_salt.groupBy(*groups).agg(*[F.kll_merge_agg_double(v, F.lit(accuracy)).alias(v) for v in values])


def quantile_table(df: DataFrame, values: Sequence[str], shares: Sequence[float], salts: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles of each column over all rows; a column without values has none."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    row = sketched(df, [], values, salts).select(
        *[F.when(F.kll_sketch_get_n_double(v) > 0, F.kll_sketch_get_quantile_double(v, wanted)).alias(v) for v in values]
    ).first()
    return {v: [] if row is None or row[v] is None else list(row[v]) for v in values}
