"""Cohorts of perturbation experiments next to scores and class attributions.

Each cohort is a short list of entities; ``scores`` (EnsemblID, predicted_prob)
and ``effects`` (EnsemblID, SHAP, ...) cover all entities and are joined on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.recode import labelled_treatment, restricted
from traitlens.operators.cohorts import list_category, seeded_sample
from traitlens.operators.merging import enrich, require_contained, require_disjoint
from traitlens.sources.readers import union_ragged

# Category order of the exogenous experiment, sheet labels of the
# knock-out experiment, sample size and seed of the random holdout.
EXOGENOUS_ORDER = ("TOP50 UP", "Random50", "Holdout Random", "TOP50 DOWN")
STIMULATED_RANK, REPRESSED_RANK = "a-Top50-ISGs", "c-Top50-IRGs"
HOLDOUT_SIZE, HOLDOUT_SEED = 50, 2342147
HOLDOUT_NAME = "Holdout Random"


def _scored(df: DataFrame, effects: DataFrame, scores: DataFrame) -> DataFrame:
    return enrich(enrich(df, effects, ["EnsemblID"]), scores, ["EnsemblID"])


def _export(df: DataFrame, *drop: str) -> DataFrame:
    """Result columns: internals dropped, the attribution under its public name."""
    prefixes = ("ExpressionCategory",)
    names = [c for c in df.columns if c not in {"FeatureClass", "Log2FC", "RowID", *drop} and not c.startswith(prefixes)]
    return df.select(*names).withColumnRenamed("SHAP", "cpg_effect")


def random_holdout(pool: DataFrame, names: DataFrame, n: int = HOLDOUT_SIZE, seed: int = HOLDOUT_SEED) -> DataFrame:
    """A seeded sample of entities outside training, with gene names."""
    sample = seeded_sample(pool.select("EnsemblID"), "EnsemblID", n, seed).withColumn("Category", F.lit(HOLDOUT_NAME))
    return enrich(sample, names, ["EnsemblID"])


def overview(top: DataFrame, holdout: DataFrame, effects: DataFrame, scores: DataFrame, check: bool = True) -> DataFrame:
    """Listed genes by class and the random holdout, scored."""
    if check:
        require_disjoint(holdout, top, ["EnsemblID"])
    listed = top.withColumn("Category", list_category(F.col("ExpressionCategory")))
    return _scored(union_ragged(listed, holdout), effects, scores)


def consistent(listed: DataFrame, baseline: DataFrame, effects: DataFrame, scores: DataFrame, experiment: str = "ko_experiment", check: bool = True) -> DataFrame:
    """Genes consistent over experiments next to the overview cohort."""
    chosen = listed.select(F.col("gene").alias("Gene"), F.col("ensemble_id").alias("EnsemblID"), F.col(experiment).alias("Category"))
    if check:
        require_contained(chosen, effects, ["EnsemblID"])
        require_contained(chosen, scores, ["EnsemblID"])
    return _export(union_ragged(_scored(chosen, effects, scores), baseline))


def overexpression(listed: DataFrame, baseline: DataFrame, effects: DataFrame, scores: DataFrame) -> DataFrame:
    """As :func:`consistent`, for genes that took part in the exogenous experiment."""
    present = listed.where(F.col("exogenous_zap_experiment").isNotNull())
    return consistent(present, baseline, effects, scores, "exogenous_zap_experiment", check=False)


def knockout(control: DataFrame, knocked: DataFrame, holdout: DataFrame, names: DataFrame, effects: DataFrame, scores: DataFrame) -> DataFrame:
    """Control and knock-out sheets with composed labels, plus the random holdout.

    Control rows keep missing ids; knock-out rows without an id are left out.
    """
    real_id = F.col("EnsemblID").isNotNull() & (F.col("EnsemblID") != "NA")
    sheets = union_ragged(
        control.select("EnsemblID", F.lit("no guide").alias("Treatment"), F.col("Rank").alias("label")),
        knocked.where(real_id).select("EnsemblID", F.lit("KO").alias("Treatment"), F.col("Rank").alias("label")),
    )
    category = F.when(F.col("label") == STIMULATED_RANK, "ISG").when(F.col("label") == REPRESSED_RANK, "IRG")
    sheets = sheets.withColumn("Category", category)
    sheets = sheets.select("EnsemblID", "Treatment", "Category", labelled_treatment(F.col("Category"), F.col("Treatment")).alias("Group"))
    random = holdout.withColumn("Group", F.col("Category"))
    rows = union_ragged(enrich(sheets, names, ["EnsemblID"]), random)
    return _export(_scored(rows, effects, scores)).withColumnRenamed("Group", "Label")


def exogenous(listed: DataFrame, holdout: DataFrame, effects: DataFrame, scores: DataFrame) -> DataFrame:
    """Exogenous-expression list and holdout; categories outside the order become NULL."""
    chosen = listed.select(F.col("Gene_Name").alias("Gene"), "EnsemblID", F.col("Rank").alias("Category"))
    rows = union_ragged(chosen, holdout)
    rows = rows.withColumn("Category", restricted(F.col("Category"), EXOGENOUS_ORDER))
    return _export(_scored(rows, effects, scores))
