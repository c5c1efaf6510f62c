"""Random search over repeated resamples, all fits grown together, resumable; the winner refitted and stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators.boosting import BoostParams, Ensemble, candidate_row
from traitlens.operators.histograms import Binned, Fit, bin_rows, fit_histogram, groups_of_fits, grow_all, held_out_losses, held_out_rows
from traitlens.operators.resampling import FOLDS, REPEATS, downsample, repeated_folds, resample_name, training_rows
from traitlens.sources.models import ModelStore, ResampleLedger
from traitlens.sources.store import new_shared_folder, settle


@dataclass
class Search:
    """The outcome: a loss per candidate and resample, the winner, and where its fits are kept."""

    candidates: DataFrame
    metrics: DataFrame
    best: int
    best_params: BoostParams
    binned: Binned
    ledger: ResampleLedger
    folds: int


def resample_bits(rows: DataFrame, label: str, row_id: str, folds: int, repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(row, resamples) of the balanced training splits and of the folds held out; resample = (Rep - 1) * folds + Fold - 1."""
    number = ((F.col("Rep") - 1) * folds + F.col("Fold") - 1).cast("int")
    fold_table = settle(repeated_folds(rows, row_id, label, folds, repeats, seed))
    listed = lambda df: df.groupBy(col(row_id)).agg(F.collect_list(number).alias("resamples"))
    return listed(downsample(training_rows(fold_table, folds), row_id, label, seed)), listed(fold_table)


def search(
    rows: DataFrame, features: Sequence[str], levels: Sequence[str], candidates: Sequence[BoostParams], *,
    label: str = "obs", row_id: str = "rowIndex", folds: int = FOLDS, repeats: int = REPEATS, seed: int = 1,
    ledger: ResampleLedger | None = None, after_group: Callable[[list[Fit]], None] | None = None,
) -> Search:
    """Every candidate over every resample; what the ledger holds is not fitted again.

    ``row_id`` names each row.  All fits share one binned table, so candidates share ``max_bins``.  Fits go in
    groups that a task's memory can hold; a group is committed when it ends, and ``after_group`` is told.
    """
    if len({c.max_bins for c in candidates}) != 1:
        raise ValueError("candidates share one number of bins")
    spark = rows.sparkSession
    ledger = ledger or ResampleLedger(spark, new_shared_folder(spark, "search"), "search")

    def build() -> Binned:
        own = settle(rows.select(col(row_id), col(label), *[col(f) for f in features]))
        trains, held = resample_bits(own, label, row_id, folds, repeats, seed)
        return bin_rows(own, features, label, levels, candidates[0].max_bins, row_id, trains, held, folds * repeats)

    binned, known = ledger.binned(build), ledger.finished()
    waiting = [Fit(params, resample) for params in candidates for resample in range(folds * repeats) if (ledger.key(params), resample) not in known]
    for numbers in groups_of_fits(binned, waiting):
        group = [waiting[n] for n in numbers]
        state = grow_all(binned, group)
        ledger.commit(group, {r.fit: (r.loss, r.n) for r in held_out_losses(state, group).collect()})
        if after_group is not None:
            after_group(group)
    table = spark.createDataFrame([candidate_row(n, p) | {"key": ledger.key(p)} for n, p in enumerate(candidates, 1)])
    done = settle(ledger.done().join(F.broadcast(table.select(F.col("key").alias("settings"), "Candidate")), "settings"))
    metrics = done.select("Candidate", (F.floor(F.col("resample") / folds) + 1).cast("int").alias("Rep"), (F.col("resample") % folds + 1).alias("Fold"), "n", (F.col("loss") / F.col("n")).alias("logLoss"))
    means = metrics.groupBy("Candidate").agg(F.avg("logLoss").alias("logLoss"))
    best = means.orderBy("logLoss", "Candidate").first()["Candidate"]
    return Search(table.drop("key").join(means, "Candidate"), metrics, best, candidates[best - 1], binned, ledger, folds)


def held_out_predictions(found: Search, row_id: str = "rowIndex") -> DataFrame:
    """Held-out predictions of the best candidate with their resample names, in one pass over the rows."""
    scored = held_out_rows(found.binned, found.ledger.fits(found.best_params), row_id)
    placed = scored.withColumns({"Rep": (F.floor(F.col("part") / found.folds) + 1).cast("int"), "Fold": F.col("part") % found.folds + 1})
    return placed.withColumn("Resample", resample_name()).drop("part")


def refit_best(found: Search, rows: DataFrame, store: ModelStore, kind: str, run: str, host: str, label: str = "obs", row_id: str = "rowIndex") -> Ensemble:
    """Fit the winner on all rows and store it with rows and settings under its address."""
    features, levels = found.binned.features, found.binned.levels
    kept = settle(rows.select(col(row_id), col(label), *[col(f) for f in features]))
    model = fit_histogram(kept, features, label, levels, found.best_params, row_id)
    store.save(kind, run, host, model, kept, asdict(found.best_params))
    return model
