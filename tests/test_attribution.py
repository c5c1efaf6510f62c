import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from traitlens.operators import attribution


def contributions(spark):
    rows = []
    for i in range(1, 7):
        rows += [(i, "S", "CpG_Coding", 0.3 * i if i > 2 else 0.0), (i, "S", "CG%_EntireGene", -0.1 * i if i > 2 else 0.0), (i, "S", "TA%_Coding", 0.2), (i, "S", "unused", 0.0)]
    return spark.createDataFrame(rows, "RowID long, Label string, Feature string, SHAP double")


def data(spark):
    rows = [(i, f"h{i % 2}", f"g{i}", "Stimulated" if i % 3 else "Repressed", 0.5 * i) for i in range(1, 7)]
    return spark.createDataFrame(rows, "rowIndex long, Host string, Gene string, ExpressionCategory string, Log2FC double")


def test_collapse_sums_signed_values_per_class(spark):
    got = {(r.RowID, r.FeatureClass): r.SHAP for r in attribution.collapse(contributions(spark)).collect()}
    assert math.isclose(got[(5, "CpG")], 1.5 - 0.5) and got[(1, "CpG")] == 0.0
    only = attribution.collapse(contributions(spark), only="CpG")
    assert only.select("FeatureClass").distinct().count() == 1 and only.count() == 6


def test_importance_size_direction_and_rank(spark):
    plain = {r.Feature: r for r in attribution.importance(contributions(spark)).collect()}
    signed = {r.Feature: r for r in attribution.importance(contributions(spark), signed=True).collect()}
    assert plain["CpG_Coding"].Rank == 1 and plain["CpG_Coding"].IsCpG and not plain["TA%_Coding"].IsCpG
    assert math.isclose(signed["CG%_EntireGene"].MeanSHAP, -plain["CG%_EntireGene"].MeanSHAP)


def test_host_shares_sum_to_one_and_unused_features_stay_null(spark):
    out = attribution.importance_by_host(contributions(spark), data(spark)).toPandas()
    assert math.isclose(out.HostContribution.sum(), 1.0)
    unused = out[out.Feature == "unused"]
    assert unused.HostContribution.isna().all() and (unused.OverallMeanSHAP == 0).all()
    exported = attribution.importance_export(attribution.importance_by_host(contributions(spark), data(spark))).toPandas()
    assert (exported[exported.Feature == "unused"].RelativeImportance_ThisSpecies == 0).all()


def test_overall_mean_is_over_rows_not_over_hosts(spark):
    rows = spark.createDataFrame([(1, "S", "f", 1.0), (2, "S", "f", 1.0), (3, "S", "f", 4.0)], "RowID long, Label string, Feature string, SHAP double")
    info = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "rowIndex long, Host string")
    assert {r.OverallMeanSHAP for r in attribution.importance_by_host(rows, info).collect()} == {2.0}


def test_stacked_normalises_by_host_and_rescales(spark):
    table = spark.createDataFrame([("a", "f", 2.0, 1), ("a", "g", 1.0, 2), ("b", "f", 0.0, 1), ("b", "g", 5.0, 2)], "Host string, Feature string, HostMeanSHAP double, Rank int")
    got = {(r.Host, r.Feature): (r.RelativeImportance, r.TotalImportance, r.Rank) for r in attribution.importance_stacked(table).collect()}
    assert got[("a", "g")] == (0.5, 1.5, 1) and got[("a", "f")] == (1.0, 1.0, 2)
    scaled = attribution.importance_stacked(table, rescale=True).toPandas()
    assert math.isclose(scaled.RelativeImportance.sum(), 1.0)
    assert [tuple(r) for r in attribution.absent_hosts(attribution.importance_stacked(table)).collect()] == [("f", "b")]
    plain = attribution.importance_stacked(table, n=1, normalise=False).toPandas()
    assert set(plain.Feature) == {"g"}


def test_class_rank_is_taken_before_filtering_and_unused_is_infinite(spark):
    got = {r.RowID: r.Rank for r in attribution.class_rank(contributions(spark), data(spark)).collect()}
    assert got[1] == math.inf and got[3] == 1.0 and got[6] == 1.0
    flat = spark.createDataFrame([(1, "S", "TA%_C", 0.9), (1, "S", "CpG_C", 0.1), (1, "S", "GC_C", -0.5)], "RowID long, Label string, Feature string, SHAP double")
    assert attribution.class_rank(flat, data(spark)).first().Rank == 3.0


def test_top_flag_edges(spark):
    rows = [(i, c, float(i)) for c in ("Stimulated", "Repressed", "NonDE") for i in range(1, 11)] + [(99, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, ExpressionCategory string, Log2FC double")
    out = attribution.top_flag(df, top=3).toPandas()
    chosen = lambda c: sorted(out[(out.ExpressionCategory == c) & (out.Top50 == True)].GeneRank)  # noqa: E712
    assert chosen("Stimulated") == [7, 8, 9, 10]  # counts from max - top, so one more
    assert chosen("Repressed") == [1, 2, 3]
    assert chosen("NonDE") == []
    assert out[out.ExpressionCategory.isna()].Top50.isna().all()


def test_class_rank_by_effect_joins_flags(spark):
    out = {r.RowID: r for r in attribution.class_rank_by_effect(contributions(spark), data(spark), top=1).collect()}
    assert out[1].Rank == math.inf and out[6].Rank == 1.0 and out[6].GeneRank == 2 and out[3].Top50


def test_spearman_is_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ref": np.round(rng.normal(size=200), 1), "x%": np.round(rng.normal(size=200), 1), "y": rng.normal(size=200)})
    pdf.loc[::7, "x%"] = np.nan
    pdf.loc[::11, "ref"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in pdf.columns])
    got = {r.Feature: r for r in attribution.spearman_with(df, ["x%", "y"], "ref").collect()}
    for f in ("x%", "y"):
        part = pdf[[f, "ref"]].dropna().rank()
        assert math.isclose(got[f].Correlation, part[f].corr(part.ref), abs_tol=1e-9) and got[f].n == len(part)
    listed = spark.createDataFrame([("y", False, 0.5, 1), ("gone", True, 0.4, 2), ("x%", False, 0.1, 9)], "Feature string, IsCpG boolean, OverallMeanSHAP double, Rank int")
    top = {r.Feature: r.Correlation for r in attribution.top_feature_correlations(df, listed, "ref", n=2).collect()}
    assert set(top) == {"y", "gone"} and top["gone"] is None


def test_feature_effects_keep_contributions_without_value(spark):
    wide = data(spark).withColumn("CpG_Coding", F.col("rowIndex") * 1.0).where("rowIndex < 6")
    out = attribution.feature_effects(contributions(spark), wide, ["CpG_Coding"]).toPandas()
    assert len(out) == 6 and out[out.RowID == 6].Value.isna().all() and out[out.RowID == 2].Value.item() == 2.0


def test_group_statistics_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    out = attribution.broadcast_statistic(df, ["g"], {"top": F.max("v")}).toPandas()
    assert len(out) == 3 and out[out.g.isna()].top.item() == 5.0


def test_importance_by_host_keeps_one_row_per_label(spark):
    """Three labels, two hosts, two features: ranks stay within a label and shares sum to one."""
    rows = [(r, label, f, float(v + r)) for r in range(4) for label, v in (("A", 1), ("B", 10), ("C", 3)) for f, v in (("CpG_Coding", v), ("TpA_Coding", 7 - v))]
    shap = spark.createDataFrame(rows, "RowID long, Label string, Feature string, SHAP double")
    data = spark.createDataFrame([(r, "h" + str(r % 2)) for r in range(4)], "rowIndex long, Host string")
    out = attribution.importance_by_host(shap, data).toPandas()
    assert len(out) == 12 and not out.duplicated(["Host", "Feature", "Label"]).any()
    assert abs(out.HostContribution.sum() - 1) < 1e-9
    for _, one in out.groupby("Label"):
        ranked = one.drop_duplicates("Feature").sort_values("OverallMeanSHAP", ascending=False)
        assert ranked.Rank.tolist() == [1, 2]
