"""Contribution tables reduced to importances, ranks, correlations and effects.

A contribution table is long: RowID, Label, Feature, SHAP.  Everything except
the per-row joins reduces it with map-side partial aggregation to feature
level, a few hundred rows, before any ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitlens.functions.names import col, feature_class
from traitlens.operators.merging import enrich
from traitlens.operators.ordering import rank_groups, rank_within
from traitlens.operators.reshape import to_long
from traitlens.sources.store import join_small, settle


def collapse(contributions: DataFrame, keep: Sequence[str] = (), only: str | None = None) -> DataFrame:
    """Sum contributions to one value per row, feature class and label."""
    df = contributions.withColumn("FeatureClass", feature_class(F.col("Feature")))
    if only is not None:
        df = df.where(F.col("FeatureClass") == only)
    return df.groupBy("RowID", "FeatureClass", *[k for k in ("Label", *keep) if k in df.columns]).agg(F.sum("SHAP").alias("SHAP"))


def _as_features(contributions: DataFrame, collapsed: bool) -> DataFrame:
    if not collapsed:
        return contributions
    return collapse(contributions).withColumnRenamed("FeatureClass", "Feature")


def _size(signed: bool) -> Column:
    return F.col("SHAP") if signed else F.abs("SHAP")


def _small_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank over feature-level tables only; those hold a few hundred rows."""
    order = F.col(value).desc_nulls_last()
    window = W.partitionBy(*[col(b) for b in by]).orderBy(order) if by else W.orderBy(order)
    return F.rank().over(window).cast("long")


def importance(contributions: DataFrame, collapsed: bool = False, signed: bool = False) -> DataFrame:
    """Mean contribution size per feature and label, ranked."""
    means = _as_features(contributions, collapsed).groupBy("Feature", "Label").agg(F.avg(_size(signed)).alias("MeanSHAP"))
    named = means.withColumn("FeatureClass", feature_class(F.col("Feature")))
    return named.withColumns({"IsCpG": F.col("FeatureClass") == "CpG", "Rank": _small_rank("MeanSHAP")})


def importance_by_host(contributions: DataFrame, data: DataFrame, collapsed: bool = False, signed: bool = False) -> DataFrame:
    """Host means next to overall means, each host's share of the total, overall rank.

    Sums and counts are taken once per host; the overall mean is built from
    those, so the contributions are read and shuffled once.
    """
    rows = enrich(_as_features(contributions, collapsed), data.select(F.col("rowIndex").alias("RowID"), "Host"), ["RowID"])
    per_host = rows.groupBy("Host", "Feature", "Label").agg(F.sum(_size(signed)).alias("__sum"), F.count("SHAP").alias("__n"))
    overall = W.partitionBy("Feature", "Label")
    table = per_host.select(
        "Host",
        "Feature",
        "Label",
        F.try_divide("__sum", "__n").alias("HostMeanSHAP"),
        F.try_divide(F.sum("__sum").over(overall), F.sum("__n").over(overall)).alias("OverallMeanSHAP"),
    )
    share = F.col("OverallMeanSHAP") * F.try_divide("HostMeanSHAP", "OverallMeanSHAP")
    table = table.withColumn("__share", share)
    table = settle(table.withColumn("FeatureClass", feature_class(F.col("Feature"))))
    total = table.agg(F.sum("__share")).scalar()
    # One ranking per label: a table of several labels keeps one row per host, feature and label.
    within = W.partitionBy("Label").orderBy(F.col("OverallMeanSHAP").desc_nulls_last())
    ranks = table.select("Feature", "Label", "OverallMeanSHAP").distinct().select("Feature", "Label", F.rank().over(within).cast("long").alias("Rank"))
    return (
        table.withColumn("HostContribution", F.try_divide(F.col("__share"), total))
        .withColumn("IsCpG", F.col("FeatureClass") == "CpG")
        .drop("__share")
        .join(ranks, ["Feature", "Label"], "left")
    )


def importance_export(table: DataFrame) -> DataFrame:
    """The host importances under their published column names, missing shares as 0."""
    return table.select(
        F.col("Host").alias("Species"),
        "Feature",
        F.col("OverallMeanSHAP").alias("FeatureImportance_AllSpecies"),
        F.col("HostMeanSHAP").alias("FeatureImportance_ThisSpecies"),
        F.coalesce("HostContribution", F.lit(0.0)).alias("RelativeImportance_ThisSpecies"),
    )


def top_features(table: DataFrame, n: int) -> DataFrame:
    """Rows of a ranked table down to rank n (sort at the sink)."""
    return table.where(F.col("Rank") <= n)


def importance_stacked(table: DataFrame, n: int = 50, normalise: bool = True, rescale: bool = False) -> DataFrame:
    """Importance across hosts: relative to each host's largest, totalled, top n kept."""
    size = F.col("HostMeanSHAP")
    if normalise:
        size = F.try_divide(size, F.max("HostMeanSHAP").over(W.partitionBy("Host")))
    table = table.withColumn("RelativeImportance", size).drop("Rank")
    totals = table.groupBy("Feature").agg(F.sum("RelativeImportance").alias("TotalImportance")).withColumn("Rank", _small_rank("TotalImportance"))
    top = top_features(table.join(totals, "Feature"), n)
    if rescale:
        top = settle(top)
        top = top.withColumn("RelativeImportance", F.try_divide("RelativeImportance", top.agg(F.sum("RelativeImportance")).scalar()))
    return top


def absent_hosts(stacked: DataFrame) -> DataFrame:
    """Hosts in which a top feature has no importance at all."""
    return stacked.where(F.col("RelativeImportance") == 0).select("Feature", "Host").distinct()


def class_rank(contributions: DataFrame, data: DataFrame, wanted: str = "CpG") -> DataFrame:
    """Rank of one feature class among all classes within each entity.

    A group is one entity's feature classes, small unless an entity repeats.
    An unused class (contribution exactly 0) has no place and gets infinity.
    """
    rows = enrich(collapse(contributions), data.withColumnRenamed("rowIndex", "RowID"), ["RowID"])
    rows = settle(rows.select("RowID", "Host", "Gene", "ExpressionCategory", "FeatureClass", "SHAP"))
    ranked = rank_groups(rows, ["Host", "Gene"], F.abs("SHAP"), descending=True).where(F.col("FeatureClass") == wanted)
    rank = F.when(F.col("SHAP") == 0, F.lit(float("inf"))).otherwise(F.col("Rank").cast("double"))
    return ranked.select("RowID", "Host", "Gene", "ExpressionCategory", "SHAP", rank.alias("Rank"))


def top_flag(data: DataFrame, top: int = 50) -> DataFrame:
    """Rank by effect size within class, and a flag for the extreme end.

    The two ends keep their historical edges: the upper one counts from
    ``max - top`` inclusive, the lower one to ``top``.
    """
    ranked = rank_within(settle(data), ["ExpressionCategory"], F.col("Log2FC"), rank="GeneRank")
    ends = settle(ranked.groupBy("ExpressionCategory").agg(F.max("GeneRank").alias("__max")))
    flag = (
        F.when(F.col("ExpressionCategory") == "Stimulated", F.col("GeneRank") >= F.col("__max") - top)
        .when(F.col("ExpressionCategory") == "Repressed", F.col("GeneRank") <= top)
        .when(F.col("ExpressionCategory").isNotNull(), F.lit(False))
    )
    return join_small(ranked, ends, ["ExpressionCategory"]).withColumn("Top50", flag).drop("__max")


def class_rank_by_effect(contributions: DataFrame, data: DataFrame, wanted: str = "CpG", top: int = 50) -> DataFrame:
    """Class rank within each row, next to the row's effect-size rank and flag."""
    within = W.partitionBy("RowID", "Label").orderBy(F.abs("SHAP").desc_nulls_last())
    ranked = collapse(contributions).withColumn("Rank", F.rank().over(within).cast("double"))
    ranked = ranked.where(F.col("FeatureClass") == wanted)
    ranked = ranked.withColumn("Rank", F.when(F.col("SHAP") == 0, F.lit(float("inf"))).otherwise(F.col("Rank")))
    return enrich(ranked, top_flag(data, top).withColumnRenamed("rowIndex", "RowID"), ["RowID"])


def spearman_with(data: DataFrame, features: Sequence[str], reference: str) -> DataFrame:
    """Spearman correlation of each feature with a reference, pairwise complete, average ties.

    The reference rides along on each row before the table turns long, so no
    positional alignment is involved; both rankings split hot groups by value.
    A feature of one value, or of one row, has no correlation: NULL.
    """
    wide = data.select(*[col(f) for f in features], col(reference).alias("__ref"))
    wide = settle(wide)  # the few columns in play, read by every pass of both rankings
    long = to_long(wide, ["__ref"], features).where(F.col("Value").isNotNull() & F.col("__ref").isNotNull())
    # Settled in between: the second ranking reads its input several times.
    ranked = settle(rank_within(long, ["Feature"], F.col("Value"), rank=None, average="__x").drop("Value"))
    ranked = rank_within(ranked, ["Feature"], F.col("__ref"), rank=None, average="__y")
    correlation = F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y"))
    return ranked.groupBy("Feature").agg(F.count("*").alias("n"), correlation.alias("Correlation"))


def top_feature_correlations(data: DataFrame, ranked: DataFrame, reference: str, n: int = 50) -> DataFrame:
    """Correlation of every top feature with the reference; a top feature that the
    data lacks keeps its row with NULL."""
    top = settle(top_features(ranked, n).select("Feature", "IsCpG", "OverallMeanSHAP", "Rank").distinct())
    listed = {r.Feature for r in top.select("Feature").distinct().collect()}  # at most n names
    present = [c for c in data.columns if c in listed]
    correlations = spearman_with(data, present, reference)
    return correlations.join(top, "Feature", "right")


def feature_effects(contributions: DataFrame, data: DataFrame, features: Sequence[str], keep: Sequence[str] = ("Host", "Gene", "ExpressionCategory")) -> DataFrame:
    """Contribution next to feature value, for the named features only.

    Both sides are cut to the features first: the contributions by a filter the
    scan can use, the data by its projection.
    """
    wanted = contributions.where(F.col("Feature").isin(list(features)))
    values = to_long(data, ["rowIndex", *keep], [f for f in features if f in data.columns])
    return enrich(wanted, values, {"RowID": "rowIndex", "Feature": "Feature"})


def broadcast_statistic(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Group statistics on every row: aggregate, then join back.

    Unlike a window this pre-aggregates before its shuffle and leaves the rows
    where they are when the groups are few.
    """
    table = settle(df.groupBy(*[col(k) for k in keys]).agg(*[c.alias(n) for n, c in stats.items()]))
    return join_small(df, table, keys)
