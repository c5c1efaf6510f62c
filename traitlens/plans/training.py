"""Tuning and training: repeated folds, random search, held-out predictions, refit."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.functions.recode import ordinal
from traitlens.operators.boosting import BoostParams, Ensemble, candidate_row, encode, fit_dart, fit_encoded
from traitlens.operators.evaluation import log_loss
from traitlens.operators.resampling import FOLDS, REPEATS, downsample, repeated_folds, resample_name, training_rows
from traitlens.sources.store import settle


@dataclass
class Tuning:
    """What a search leaves behind; only hyper-parameters and trees live on the driver."""

    candidates: DataFrame
    metrics: DataFrame
    best: int
    best_params: BoostParams
    models: dict[tuple[int, int], Ensemble]
    assigned: DataFrame


def run_concurrently(spark: SparkSession, tasks: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Launch Spark jobs from a few threads; the scheduler interleaves their stages."""
    if parallelism <= 1:
        return [task() for task in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks))


def _held_out(assigned: DataFrame, models: dict[tuple[int, int], Ensemble], row_id: str, label: str) -> DataFrame:
    """Every fold scored by the model that did not see it.

    ``assigned`` holds each row once per repeat, stored by (Rep, Fold), so each
    model reads the files of its own fold only.
    """
    parts = []
    for (rep, fold), model in models.items():
        scored = model.score(assigned.where((F.col("Rep") == rep) & (F.col("Fold") == fold)))
        truth = ordinal(col(label), model.levels).cast("int")
        parts.append(
            scored.select(
                col(row_id),
                col(label).alias("obs"),
                F.col("PredictedLabel").alias("pred"),
                "probability",
                F.get("probability", truth - 1).alias("p_observed"),
                "Rep",
                "Fold",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def search(
    rows: DataFrame,
    features: Sequence[str],
    levels: Sequence[str],
    candidates: Sequence[BoostParams],
    *,
    label: str = "obs",
    row_id: str = "rowIndex",
    folds: int = FOLDS,
    repeats: int = REPEATS,
    seed: int = 1,
    parallelism: int = 4,
) -> Tuning:
    """Random search by repeated cross-validation with balanced training splits.

    Folds are shared by all candidates.  Every resample's log-loss is kept; the
    candidate with the lowest mean wins.
    """
    spark = rows.sparkSession
    rows = settle(rows.select(col(row_id), col(label), *[col(f) for f in features]))
    fold_table = settle(repeated_folds(rows, row_id, label, folds, repeats, seed))
    training = settle(downsample(training_rows(fold_table, folds), row_id, label, seed).drop(label), ["Rep", "Fold"])
    assigned = settle(rows.join(fold_table.drop(label), row_id), ["Rep", "Fold"])

    encoded = encode(rows, features, label, levels, row_id)

    def fit_one(params: BoostParams, rep: int, fold: int) -> Callable[[], Ensemble]:
        def task() -> Ensemble:
            mine = training.where((F.col("Rep") == rep) & (F.col("Fold") == fold)).select(col(row_id).alias("__id"))
            return fit_encoded(encoded, params, mine)

        return task

    resamples = [(rep, fold) for rep in range(1, repeats + 1) for fold in range(1, folds + 1)]
    jobs = [(number, params, rep, fold) for number, params in enumerate(candidates, 1) for rep, fold in resamples]
    fitted = run_concurrently(spark, [fit_one(params, rep, fold) for _, params, rep, fold in jobs], parallelism)
    models: dict[int, dict[tuple[int, int], Ensemble]] = {}
    for (number, _, rep, fold), model in zip(jobs, fitted):
        models.setdefault(number, {})[(rep, fold)] = model

    def measure(number: int) -> Callable[[], DataFrame]:
        def task() -> DataFrame:
            scored = _held_out(assigned, models[number], row_id, label)
            return settle(log_loss(scored, ["Rep", "Fold"], "p_observed").withColumn("Candidate", F.lit(number)))

        return task

    metrics = reduce(DataFrame.unionByName, run_concurrently(spark, [measure(n) for n in models], parallelism))
    means = metrics.groupBy("Candidate").agg(F.avg("logLoss").alias("logLoss"))
    best = means.orderBy("logLoss", "Candidate").first()["Candidate"]
    table = spark.createDataFrame([candidate_row(n, p) for n, p in enumerate(candidates, 1)])
    return Tuning(table.join(means, "Candidate"), metrics, best, candidates[best - 1], models[best], assigned)


def held_out_predictions(tuning: Tuning, label: str = "obs", row_id: str = "rowIndex") -> DataFrame:
    """Held-out predictions of the best candidate with their resample names."""
    scored = _held_out(tuning.assigned, tuning.models, row_id, label)
    return scored.withColumn("Resample", resample_name())


def refit(rows: DataFrame, features: Sequence[str], levels: Sequence[str], params: BoostParams, path: str, label: str = "obs", row_id: str = "rowIndex") -> Ensemble:
    """Fit on all rows, then write model, training snapshot and settings under ``path``."""
    spark = rows.sparkSession
    snapshot = f"{path.rstrip('/')}/data"
    rows.select(col(row_id), col(label), *[col(f) for f in features]).write.parquet(snapshot)
    model = fit_dart(spark.read.parquet(snapshot), features, label, levels, params, row_id)
    model.save(spark, f"{path.rstrip('/')}/model")
    spark.createDataFrame([(json.dumps(asdict(params)),)], "params string").write.json(f"{path.rstrip('/')}/settings")
    return model
