"""Whole jobs over landed files: prepare, train, explain, report, hold out.

Each is a stage (:mod:`traitlens.sources.stages`): it takes the stages before it, writes
its tables with their checks, and is skipped while nothing it reads has changed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.functions.recode import SPECIES_TO_HOST
from traitlens.operators import attribution, evaluation
from traitlens.operators.boosting import BoostParams, Ensemble
from traitlens.operators.cohorts import NOT_FEATURES, TASKS, observed_rows, selected_rows, task_data
from traitlens.operators.distribution import box_stats
from traitlens.operators.histograms import fit_histogram
from traitlens.operators.merging import enrich
from traitlens.operators.ordering import stable_row_id
from traitlens.operators.reshape import resample_parts, to_long
from traitlens.operators.resampling import FOLDS, REPEATS
from traitlens.operators.shap import shap_contributions
from traitlens.plans import tuning
from traitlens.plans.holdout import holdout_accuracy, holdout_features, holdout_labels
from traitlens.plans.prepare import PART_ONE_CODING, PART_ONE_GENE, PART_TWO, merged_files
from traitlens.sources.models import ModelStore, ResampleLedger
from traitlens.sources.readers import read_ragged_tsv, union_tagged
from traitlens.sources.stages import Checked, Stage, Stages
from traitlens.sources.store import settle

# File name ending and columns of the selected-gene lists.
LISTED, LISTED_GENE, LISTED_CLASS = "_Top50_Formatted.csv", "Ensembl gene ID", "Class"
ROW_COLUMNS = ("rowIndex", "Host", "Gene", "ExpressionCategory", "Log2FC")


def prepare(
    stages: Stages, hosts: Sequence[str], part_one_dir: str, part_two_dir: str, identity_path: str, *,
    species: Mapping[str, str] = SPECIES_TO_HOST, unique_on: Sequence[str] = ("Gene",),
) -> Stage:
    """Table ``merged``: one row per host and gene, written by host; keys must be unique and no row may lack them."""
    hosts = sorted(hosts)
    files = [f"{d.rstrip('/')}/{h}{ending}" for h in hosts for d, ending in ((part_one_dir, PART_ONE_CODING), (part_one_dir, PART_ONE_GENE), (part_two_dir, PART_TWO))]

    def build(_):
        merged = merged_files(stages.spark, hosts, part_one_dir, part_two_dir, identity_path, dict(species))
        unnamed = F.col("Gene").isNull() | F.col("HOST").isNull()
        return {"merged": Checked(merged, never={"rows without a key": unnamed}, unique=unique_on, partition_by=("HOST",))}, {}

    return stages.run("prepare", build, files=[*files, identity_path], settings={"species": dict(species), "unique_on": list(unique_on)})


def selection(stages: Stages, hosts: Sequence[str], directory: str) -> Stage:
    """Table ``listed``: the hosts' selected genes with their list's class."""
    paths = {h: f"{directory.rstrip('/')}/{h}{LISTED}" for h in sorted(hosts)}

    def build(_):
        read = lambda path: stages.spark.read.csv(path, header=True).select(col(LISTED_GENE).alias("Gene"), LISTED_CLASS)
        return {"listed": Checked(union_tagged({h: read(p) for h, p in paths.items()}, "HOST"), unique=("HOST", "Gene"))}, {}

    return stages.run("selection", build, files=list(paths.values()))


def train(
    stages: Stages, models: ModelStore, prepared: Stage, task: str, run: str, candidates: Sequence[BoostParams], *,
    listed: Stage | None = None, host: str = "AllHosts", folds: int = FOLDS, repeats: int = REPEATS, seed: int = 1,
) -> Stage:
    """Search and refit one task; the model is stored under (task, run, host).

    Rows are all with a class and an effect, or those on the selected lists, every one of
    which must be found.  Tables: ``data`` (rows with their features), ``metrics``,
    ``candidates``, ``predictions`` (of the fits that did not see the row).  A run that
    was cut short goes on from its ledger of finished resamples.
    """
    features = [c for c in prepared["merged"].columns if c not in NOT_FEATURES]

    def build(scratch):
        merged = prepared["merged"]
        cohort = observed_rows(merged) if listed is None else selected_rows(merged, listed["listed"], strict=True)
        if listed is not None:
            cohort = settle(cohort)
            found = cohort.count()
            if found != listed.rows["listed"]:
                raise ValueError(f"{listed.rows['listed']} listed genes, {found} of them in the prepared rows")
        chosen = settle(task_data(cohort, task).drop("Level", "FDR").withColumnRenamed("HOST", "Host"))
        data = settle(stable_row_id(chosen, ["Host", "Gene"]).select(*ROW_COLUMNS, *[col(f) for f in features]))
        rows = data.select("rowIndex", F.col("ExpressionCategory").alias("obs"), *[col(f) for f in features])
        ledger = ResampleLedger(stages.spark, scratch, task)
        found = tuning.search(rows, features, TASKS[task], candidates, folds=folds, repeats=repeats, seed=seed, ledger=ledger)
        model = fit_histogram(rows, features, "obs", TASKS[task], found.best_params)
        version = models.save(task, run, host, model, rows, asdict(found.best_params))
        tables = {"data": Checked(data, unique=("rowIndex",)), "metrics": found.metrics, "candidates": found.candidates, "predictions": tuning.held_out_predictions(found)}
        return tables, {"task": task, "run": run, "host": host, "version": version, "best": found.best, "features": features}

    settings = {"task": task, "run": run, "host": host, "candidates": [asdict(c) for c in candidates], "folds": folds, "repeats": repeats, "seed": seed, "models": models.root}
    return stages.run("train", build, after=[prepared, *([listed] if listed else [])], settings=settings)


def model_of(models: ModelStore, trained: Stage) -> Ensemble:
    """The version that the stage stored, whatever was stored under its address since."""
    at = trained.notes
    return models.model(at["task"], at["run"], at["host"], at["version"])


def explain(stages: Stages, models: ModelStore, trained: Stage) -> Stage:
    """Table ``contributions``: RowID, Label, Feature, SHAP of every training row."""
    return stages.run("explain", lambda _: ({"contributions": shap_contributions(trained["data"], model_of(models, trained))}, {}), after=[trained])


def report(stages: Stages, trained: Stage, explained: Stage, *, reference: str, wanted: str = "CpG", n: int = 50, width: int = 100) -> Stage:
    """The tables behind the figures of a run over several hosts.

    ``accuracy`` by host and class, ``predictions``, ``genes``, ``accuracy_by_effect``, ``importance``,
    ``importance_by_host``, ``class_rank``, ``correlations`` of the top features with ``reference``, ``effects`` of
    the features of the class ``wanted``, and ``boxes`` of their raw values by class, pooled and per host.
    """

    def build(_):
        data, held, contributions = trained["data"], trained["predictions"], explained["contributions"]
        rows = data.select(*ROW_COLUMNS)
        judged = enrich(resample_parts(held), rows.select("rowIndex", "Host"), ["rowIndex"])
        genes = evaluation.gene_accuracy(held, rows)
        by_host = settle(attribution.importance_by_host(contributions, rows))
        own = [r.Feature for r in by_host.where(F.col("FeatureClass") == wanted).select("Feature").distinct().collect()]  # at most the features
        raw = to_long(data, ["Host", "ExpressionCategory"], own) if own else None
        tables = {
            "accuracy": evaluation.accuracy_interval(judged, ["Host"]),
            "predictions": evaluation.prediction_export(held, rows),
            "genes": genes,
            "accuracy_by_effect": evaluation.accuracy_by_effect(genes, width),
            "importance": attribution.importance(contributions),
            "importance_by_host": by_host,
            "class_rank": attribution.class_rank(contributions, rows, wanted),
            "correlations": attribution.top_feature_correlations(data, by_host, reference, n),
        }
        if raw is not None:
            panels = raw.withColumn("Panel", F.explode(F.array(F.lit("all"), F.col("Host"))))
            tables["effects"] = attribution.feature_effects(contributions, data, own)
            tables["boxes"] = box_stats(panels, ["Panel", "Feature", "ExpressionCategory"], "Value")
        return tables, {"features": own}

    return stages.run("report", build, after=[trained, explained], settings={"reference": reference, "wanted": wanted, "n": n, "width": width})


def hold_out(
    stages: Stages, models: ModelStore, trained: Stage, measured_path: str, key: str, change: str,
    coding_path: str, coding_extra_path: str, gene_path: str, *, n: int = 50, bottom_by: str = "max",
) -> Stage:
    """An independent population: its extreme genes, features, predictions and accuracy.

    Tables: ``labels``, ``features`` (one row per gene), ``predictions``, ``accuracy``.
    """

    def build(_):
        measured: DataFrame = stages.spark.read.csv(measured_path, header=True, nullValue="NA")
        measured = settle(measured.select(col(key), F.nullif(col(change), F.lit("-")).cast("double").alias(change)))
        labels = settle(holdout_labels(measured, key, change, n, bottom_by))
        read = lambda path: read_ragged_tsv(stages.spark, path)
        features = settle(holdout_features(read(coding_path), read(coding_extra_path), read(gene_path), check=False))
        predicted = model_of(models, trained).score(features).select("Gene", "PredictedLabel")
        export, accuracy = holdout_accuracy(predicted, labels, key)
        tables = {"labels": Checked(labels, unique=(key,)), "features": Checked(features, unique=("Gene",)), "predictions": export, "accuracy": accuracy}
        return tables, {}

    settings = {"key": key, "change": change, "n": n, "bottom_by": bottom_by}
    return stages.run("hold_out", build, files=[measured_path, coding_path, coding_extra_path, gene_path], after=[trained], settings=settings)
