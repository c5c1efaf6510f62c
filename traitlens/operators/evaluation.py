"""Accuracy, intervals, outliers, log-loss and exports of held-out predictions.

Input is a prediction table (rowIndex, obs, pred, Resample) next to the data it
refers to.  All accuracies are one partial aggregation; the tables after it
have one row per class, host or replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators.merging import enrich
from traitlens.operators.ordering import exact_quantiles, rank_within, sliding_mean
from traitlens.operators.reshape import resample_parts
from traitlens.sources.store import join_small, settle


def hit(pred: str = "pred", obs: str = "obs") -> Column:
    """1 when the prediction is right, 0 when wrong, NULL when the truth is unknown."""
    return (col(pred) == col(obs)).cast("double")


def accuracy(df: DataFrame, keys: Sequence[str], pred: str = "pred", obs: str = "obs", name: str = "Accuracy") -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(F.avg(hit(pred, obs)).alias(name))


def accuracy_at_grains(df: DataFrame, grains: Sequence[Sequence[str]], pred: str = "pred", obs: str = "obs") -> DataFrame:
    """Accuracy at several grains in one pass; Grain names the columns in force."""
    keys = list(dict.fromkeys(k for grain in grains for k in grain))
    grain_name = F.concat_ws(",", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    return df.groupingSets([[col(k) for k in grain] for grain in grains], *[col(k) for k in keys]).agg(
        grain_name.alias("Grain"), F.count("*").alias("n"), F.avg(hit(pred, obs)).alias("Accuracy")
    )


def accuracy_interval(preds: DataFrame, by: Sequence[str] = (), coverage: float = 0.95) -> DataFrame:
    """Accuracy per replicate, then mean and interval over replicates, per class.

    ``preds`` has obs, pred, Replicate and the columns in ``by``.  A group of the
    second step holds one value per replicate, so the exact percentile is bounded.
    """
    per_replicate = accuracy(preds, ["obs", "Replicate", *by])
    tail = (1 - coverage) / 2
    quantiles = F.percentile("Accuracy", [tail, 1 - tail])
    return (
        per_replicate.groupBy("obs", *[col(b) for b in by])
        .agg(F.avg("Accuracy").alias("MeanAccuracy"), quantiles.alias("__q"))
        .select("obs", *[col(b) for b in by], "MeanAccuracy", F.col("__q")[0].alias("LwrAccuracy"), F.col("__q")[1].alias("UprAccuracy"))
    )


def accuracy_mean_resample(preds: DataFrame) -> DataFrame:
    """Mean over resamples of the per-class accuracy."""
    return accuracy(preds, ["Resample", "obs"]).groupBy("obs").agg(F.avg("Accuracy").alias("MeanAccuracy"))


def flag_outliers(df: DataFrame, value: str = "Accuracy") -> DataFrame:
    """Tukey flags against the quartiles of the whole table, found by value ranges."""
    quartiles = settle(exact_quantiles(df.select(col(value)), [], value, [0.25, 0.75])).select("q")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    high = quartiles.select(q3 + 1.5 * (q3 - q1)).scalar()
    low = quartiles.select(q1 - 1.5 * (q3 - q1)).scalar()
    flagged = df.withColumns({"OutlierHigh": col(value) > high, "OutlierLow": col(value) < low})
    return flagged.withColumn("OutlierShape", F.when(F.col("OutlierHigh") | F.col("OutlierLow"), F.lit("A")))


def log_loss(df: DataFrame, keys: Sequence[str], p_observed: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability given to the observed class."""
    p = F.least(F.greatest(col(p_observed), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n"), F.avg(-F.log(p)).alias("logLoss"))


def prediction_export(preds: DataFrame, data: DataFrame) -> DataFrame:
    """Held-out predictions with entity and host, resample split into its parts."""
    joined = enrich(preds, data.select("rowIndex", "Gene", "Host"), ["rowIndex"])
    return resample_parts(joined).select(
        "Gene", F.col("Host").alias("Species"), F.col("obs").alias("Observed"), "Fold", "Replicate", F.col("pred").alias("Prediction")
    )


def sorted_export(df: DataFrame) -> DataFrame:
    """The order a written export has; sorting belongs at the sink only."""
    return df.orderBy("Fold", "Replicate", "Species", "Gene")


def gene_accuracy(preds: DataFrame, data: DataFrame) -> DataFrame:
    """Each row of the data with its accuracy over all resamples, NULL if never held out."""
    return enrich(data, accuracy(preds, ["rowIndex"]), ["rowIndex"])


def accuracy_by_effect(genes: DataFrame, width: int = 100, keys: Sequence[str] = ("Host", "ExpressionCategory")) -> DataFrame:
    """Sliding mean accuracy along the rank of effect size, without the ragged end."""
    ranked = rank_within(settle(genes), keys, F.abs("Log2FC"), position="__position", tiebreak="rowIndex")
    slid = sliding_mean(ranked, keys, "__position", "Accuracy", width, "SlidingAccuracy")
    last = settle(ranked.groupBy(*[col(k) for k in keys]).agg(F.max("Rank").alias("__last")))
    kept = join_small(slid, last, keys).where(F.col("Rank") <= F.col("__last") - width)
    return kept.drop("__last", "__position")
