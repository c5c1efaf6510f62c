"""Repeated stratified folds and in-fold down-sampling, as tables.

Both rest on a position within (repeat, class) in md5 order, computed without
putting a class in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.functions.recode import hash_order
from traitlens.operators.ordering import hashed_position
from traitlens.sources.store import join_small, settle

# Folds and repeats of the full procedure.
FOLDS = 5
REPEATS = 50


def repeated_folds(rows: DataFrame, row_id: str = "rowIndex", label: str = "obs", folds: int = FOLDS, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """(row, label, Rep, Fold): every row in exactly one fold of each repeat.

    Within a repeat each class is dealt over the folds in hash order, so class
    sizes per fold differ by one at most.
    """
    keyed = rows.select(col(row_id), col(label)).withColumn("Rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    placed = hashed_position(keyed, ["Rep", label], hash_order(row_id, "Rep", seed=seed), "__p")
    return placed.select(col(row_id), col(label), "Rep", ((F.col("__p") - 1) % folds + 1).cast("int").alias("Fold"))


def training_rows(folds_table: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(row, label, Rep, Fold) where Fold is the fold held out, i.e. not the row's own."""
    columns = [c for c in folds_table.columns if c != "Fold"]
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f != F.col("Fold"))
    return folds_table.select(*[col(c) for c in columns], F.explode(others).alias("Fold"))


def downsample(training: DataFrame, row_id: str = "rowIndex", label: str = "obs", seed: int = 1) -> DataFrame:
    """Cut every class of each (Rep, Fold) training split to its smallest class.

    This is the balancing the procedure asks for; held-out rows are not touched.
    """
    sizes = training.groupBy("Rep", "Fold", col(label)).agg(F.count("*").alias("__n"))
    smallest = settle(sizes.groupBy("Rep", "Fold").agg(F.min("__n").alias("__keep")))
    placed = hashed_position(training, ["Rep", "Fold", label], hash_order(row_id, "Rep", "Fold", seed=f"down{seed}"), "__p")
    return join_small(placed, smallest, ["Rep", "Fold"]).where(F.col("__p") <= F.col("__keep")).drop("__p", "__keep")


def resample_name(fold: str = "Fold", rep: str = "Rep"):
    """``Fold1.Rep01``."""
    return F.concat(F.lit("Fold"), col(fold).cast("string"), F.lit(".Rep"), F.lpad(col(rep).cast("string"), 2, "0"))
