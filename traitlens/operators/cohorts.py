"""Cohorts and classification tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.functions.recode import hash_order, ordinal, selected_class
from traitlens.operators.merging import listed_cohort
from traitlens.operators.ordering import top_with_ties

# The tasks, each with its class levels; the first level is the
# positive class of a two-class task and the baseline of the three-class one.
TASKS = {
    "3Class": ("NonDE", "Stimulated", "Repressed"),
    "ISGvsIRG": ("Stimulated", "Repressed"),
    "ISGvsRandom": ("Stimulated", "NonDE"),
    "IRGvsRandom": ("Repressed", "NonDE"),
}

# Columns of the merged input that are never features.
NOT_FEATURES = ("HOST", "Gene", "Log2FC", "FDR", "ExpressionCategory")


def observed_rows(merged: DataFrame) -> DataFrame:
    """Every row with an effect size and a class."""
    return merged.where(F.col("Log2FC").isNotNull() & F.col("ExpressionCategory").isNotNull())


def selected_rows(merged: DataFrame, listed: DataFrame, strict: bool = False) -> DataFrame:
    """Rows on the selected lists (HOST, Gene, Class), labelled by the list."""
    labels = listed.select("HOST", "Gene", selected_class(F.col("Class"), strict).alias("ExpressionCategory"))
    return listed_cohort(merged, labels, ["HOST", "Gene"], ["ExpressionCategory"])


def task_rows(cohort: DataFrame, tasks: dict[str, tuple[str, ...]] = TASKS) -> DataFrame:
    """One row per task that a row belongs to, with the ordinal of its class.

    All tasks come from a single scan.
    """
    options = [
        F.when(col("ExpressionCategory").isin(list(levels)), F.struct(F.lit(name).alias("Task"), ordinal(col("ExpressionCategory"), levels).alias("Level")))
        for name, levels in tasks.items()
    ]
    exploded = cohort.withColumn("__task", F.explode(F.array_compact(F.array(*options))))
    return exploded.select(F.col("__task.Task").alias("Task"), F.col("__task.Level").alias("Level"), *[col(c) for c in cohort.columns])


def task_data(cohort: DataFrame, task: str, strict: bool = True) -> DataFrame:
    """The rows of one task; a class outside its levels drops out."""
    if task not in TASKS and strict:
        raise ValueError(f"unknown task {task!r}; choose from {sorted(TASKS)}")
    return task_rows(cohort, {task: TASKS[task]}).drop("Task")


def cohort_profile(df: DataFrame) -> DataFrame:
    """Row count, host count and host names in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("HOST").alias("n_hosts"),
        F.array_join(F.array_sort(F.collect_set("HOST")), ", ").alias("hosts"),
    )


def best_per_key(df: DataFrame, key: str, value: str, how: str = "max", name: str = "MaxChange") -> DataFrame:
    """One value per key over repeated measurements."""
    return df.groupBy(col(key)).agg((F.max if how == "max" else F.min)(col(value)).alias(name))


def holdout_extremes(df: DataFrame, key: str, value: str, n: int = 50, bottom_by: str = "max") -> DataFrame:
    """Top and bottom n unique keys with ties, labelled Stimulated and Repressed.

    The bottom list is also ranked by each key's largest value unless
    ``bottom_by='min'`` is given.
    """
    top = top_with_ties(best_per_key(df, key, value), "MaxChange", n).select(col(key), F.lit("Stimulated").alias("Label"))
    low = top_with_ties(best_per_key(df, key, value, bottom_by, "MinChange"), "MinChange", n, bottom=True)
    return top.unionByName(low.select(col(key), F.lit("Repressed").alias("Label")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """A reproducible sample of n rows: the first n in hash order of the key.

    Each task keeps n rows and the merge is over those, so nothing is sorted whole.
    """
    return df.withColumn("__h", hash_order(key, seed=seed)).orderBy("__h", col(key)).limit(n).drop("__h")


def list_category(label: Column) -> Column:
    """Display names of the selected-list classes; anything else is NULL."""
    return F.when(label == "IRG", "Top 50 IRGs").when(label == "ISG", "Top 50 ISGs").when(label == "Random", "Random")
