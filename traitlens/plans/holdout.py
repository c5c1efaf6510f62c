"""Independent holdout: extreme genes, merged features, scored and evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import PART_ONE_FAMILIES, PART_TWO_FAMILIES, add_suffix, harmonise, select_families
from traitlens.operators.cohorts import holdout_extremes
from traitlens.operators.evaluation import hit
from traitlens.operators.merging import enrich, merge_outer, require_disjoint, require_unique
from traitlens.operators.reshape import identifier_parts

# Families taken from each of the three holdout files.
CODING_FAMILIES = ("dinucleotide_bias", *PART_TWO_FAMILIES)
CODING_EXTRA_FAMILIES = ("nucleotide_content", "dinucleotide_percent")


def holdout_labels(measured: DataFrame, key: str, change: str, n: int = 50, bottom_by: str = "max", check: bool = True) -> DataFrame:
    """Top and bottom n unique genes; fails when a gene is on both ends."""
    labels = holdout_extremes(measured, key, change, n, bottom_by)
    if check:
        require_disjoint(labels.where(F.col("Label") == "Stimulated"), labels.where(F.col("Label") == "Repressed"), [key])
    return labels


def holdout_features(coding: DataFrame, coding_extra: DataFrame, gene: DataFrame, check: bool = True) -> DataFrame:
    """One row per gene from the coding, extra coding and whole-gene files.

    Files may hold repeated rows; the coding file names genes by sequence name
    and spells four pairs with U.
    """
    keys = ["Gene"]
    coding = harmonise(select_families(identifier_parts(coding.distinct()), keys, CODING_FAMILIES))
    extra = select_families(coding_extra.distinct(), keys, CODING_EXTRA_FAMILIES)
    whole = select_families(gene.distinct(), keys, PART_ONE_FAMILIES)
    merged = merge_outer([add_suffix(coding, keys, "_Coding"), add_suffix(extra, keys, "_Coding"), add_suffix(whole, keys, "_EntireGene")], keys)
    if check:
        require_unique(merged, keys)
    return merged


def holdout_accuracy(predicted: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Predictions next to known labels, and accuracy per label.

    Rows without a known label form their own group with NULL accuracy.
    """
    table = enrich(predicted, labels.distinct(), {"Gene": key})
    accuracy = table.groupBy("Label").agg(
        F.sum(hit("PredictedLabel", "Label")).alias("Accuracy"),
        F.count("*").alias("n"),
        F.avg(hit("PredictedLabel", "Label")).alias("Proportion_accurate"),
    )
    export = table.select("Gene", F.col("Label").alias("ActualLabel"), "PredictedLabel")
    return export, accuracy
