"""Report tables of a finished run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.recode import ordinal, restricted
from traitlens.operators.distribution import box_stats, density
from traitlens.operators.reshape import to_long

# Display order of the classes.
CLASS_ORDER = ("Stimulated", "NonDE", "Repressed")


_PANEL_KEYS = ("Panel", "Feature", "ExpressionCategory")


def _panels(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One long table for both panels: each value is counted under its host and under ``all``."""
    known = rows.withColumn("ExpressionCategory", restricted(F.col("ExpressionCategory"), CLASS_ORDER)).where(F.col("ExpressionCategory").isNotNull())
    long = to_long(known, ["HOST", "ExpressionCategory"], features)
    return long.withColumn("Panel", F.explode(F.array(F.lit("all"), F.col("HOST"))))


def feature_distribution(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Box statistics of raw features by class, pooled (Panel ``all``) and per host."""
    table = box_stats(_panels(rows, features), _PANEL_KEYS, "Value")
    return table.withColumn("level", ordinal(F.col("ExpressionCategory"), CLASS_ORDER))


def feature_density(rows: DataFrame, features: Sequence[str], grid: int = 512) -> DataFrame:
    """Kernel densities of raw features by class, pooled and per host."""
    return density(_panels(rows, features), _PANEL_KEYS, "Value", grid=grid)
