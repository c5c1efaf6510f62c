"""Contribution tables reduced over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitlens.catalog.registry import query, rounded, with_sql
from traitlens.catalog.statistics import FEATURE_SQL, LABELLED_SQL, feature_rows
from traitlens.operators import attribution
from traitlens.sampledata import CONTRIBUTIONS_SQL, GENE_SQL, METADATA_SQL, part_one_sql

P1 = part_one_sql("s")
_CLASS_SQL = """CASE Feature WHEN 'CpG_Coding' THEN 'CpG' WHEN 'brCpG_Coding' THEN 'CpG' WHEN 'CG%_EntireGene' THEN 'CpG' WHEN 'TA%_Coding' THEN 'TpA'
  WHEN 'TpA_EntireGene' THEN 'TpA' WHEN 'GCcont_Coding' THEN 'GCcont' WHEN 'S-Bias_Coding' THEN 'S-Bias' ELSE Feature END"""


@query("collapse_contributions", with_sql(CONTRIBUTIONS_SQL, body="SELECT RowID, Label, FeatureClass, round(SHAP, 6) AS SHAP FROM collapsed"))
def collapse_contributions(data):
    return rounded(attribution.collapse(data.contributions()), "SHAP")


def _importance_sql(size: str) -> str:
    return with_sql(CONTRIBUTIONS_SQL, f"m AS (SELECT Feature, Label, avg({size}) AS v FROM contributions GROUP BY ALL)",
        body=f"SELECT Feature, Label, round(v, 6) AS MeanSHAP, {_CLASS_SQL} AS FeatureClass, {_CLASS_SQL} = 'CpG' AS IsCpG, rank() OVER (ORDER BY v DESC) AS Rank FROM m")


@query("importance_global", _importance_sql("abs(SHAP)"))
def importance_global(data):
    return rounded(attribution.importance(data.contributions()), "MeanSHAP")


@query("importance_signed", _importance_sql("SHAP"))
def importance_signed(data):
    return rounded(attribution.importance(data.contributions(), signed=True), "MeanSHAP")


def _by_host_ctes(source: str, feature: str, size: str) -> tuple[str, ...]:
    return (
        CONTRIBUTIONS_SQL,
        f"rows_ AS (SELECT c.{feature} AS Feature, Label, {size} AS v, Host FROM {source} c LEFT JOIN contribution_data d ON c.RowID = d.rowIndex)",
        "o AS (SELECT Feature, Label, avg(v) AS om FROM rows_ GROUP BY ALL)",
        "h AS (SELECT Host, Feature, Label, avg(v) AS hm FROM rows_ GROUP BY ALL)",
        f"""t AS (SELECT Host, Feature, Label, hm, om, om * (hm / nullif(om, 0)) AS share, {_CLASS_SQL} AS FeatureClass FROM h JOIN o USING (Feature, Label))""",
        "k AS (SELECT Feature, rank() OVER (ORDER BY om DESC) AS Rank FROM o)",
    )


@query("importance_by_host", with_sql(*_by_host_ctes("collapsed", "FeatureClass", "abs(SHAP)"), body="""
    SELECT Host, Feature, Label, round(hm, 6) AS HostMeanSHAP, round(om, 6) AS OverallMeanSHAP, FeatureClass, FeatureClass = 'CpG' AS IsCpG,
      round(share / sum(share) OVER (), 6) AS HostContribution, Rank FROM t JOIN k USING (Feature)"""))
def importance_by_host(data):
    out = attribution.importance_by_host(data.contributions(), data.contribution_data(), collapsed=True)
    return rounded(out, "HostMeanSHAP", "OverallMeanSHAP", "HostContribution")


@query("importance_export", with_sql(*_by_host_ctes("contributions", "Feature", "SHAP"), body="""
    SELECT Host AS Species, Feature, round(om, 6) AS "FeatureImportance_AllSpecies", round(hm, 6) AS "FeatureImportance_ThisSpecies",
      coalesce(round(share / sum(share) OVER (), 6), 0) AS "RelativeImportance_ThisSpecies" FROM t"""))
def importance_export(data):
    out = attribution.importance_export(attribution.importance_by_host(data.contributions(), data.contribution_data(), signed=True))
    return rounded(out, *out.columns[2:])


_STACK_CTES = (
    *_by_host_ctes("contributions", "Feature", "abs(SHAP)"),
    "rel AS (SELECT Host, Feature, hm / nullif(max(hm) OVER (PARTITION BY Host), 0) AS ri FROM t)",
    "tot AS (SELECT Feature, sum(ri) AS ti, rank() OVER (ORDER BY sum(ri) DESC) AS Rank FROM rel GROUP BY Feature)",
)


@query("importance_stacked", with_sql(*_STACK_CTES, body="""SELECT Host, Feature, round(ri / sum(ri) OVER (), 6) AS RelativeImportance,
    round(ti, 6) AS TotalImportance, Rank FROM rel JOIN tot USING (Feature) WHERE Rank <= 5"""))
def importance_stacked(data):
    table = attribution.importance_by_host(data.contributions(), data.contribution_data())
    out = attribution.importance_stacked(table, 5, rescale=True).select("Host", "Feature", "RelativeImportance", "TotalImportance", "Rank")
    return rounded(out, "RelativeImportance", "TotalImportance")




@query("importance_absent_hosts", with_sql(CONTRIBUTIONS_SQL,
    "rows_ AS (SELECT Feature, Host, CASE WHEN Host LIKE '%1' AND Feature = 'CpG_Coding' THEN 0.0 ELSE abs(SHAP) END AS v FROM contributions c LEFT JOIN contribution_data d ON c.RowID = d.rowIndex)",
    body="SELECT Feature, Host FROM rows_ GROUP BY ALL HAVING avg(v) = 0"))
def importance_absent_hosts(data):
    hosts = data.contribution_data().select(F.col("rowIndex").alias("RowID"), F.col("Host").alias("h"))
    unused = F.col("h").endswith("1") & (F.col("Feature") == "CpG_Coding")
    contributions = data.contributions().join(hosts, "RowID").withColumn("SHAP", F.when(unused, F.lit(0.0)).otherwise(F.col("SHAP"))).drop("h")
    table = attribution.importance_by_host(contributions, data.contribution_data())
    return attribution.absent_hosts(attribution.importance_stacked(table, 50))


@query("top_features", with_sql(CONTRIBUTIONS_SQL, "m AS (SELECT Feature, Label, avg(abs(SHAP)) AS v FROM contributions GROUP BY ALL)",
    body="SELECT Feature, round(v, 6) AS MeanSHAP, rank() OVER (ORDER BY v DESC) AS Rank FROM m QUALIFY Rank <= 3"))
def top_features(data):
    out = attribution.top_features(attribution.importance(data.contributions()), 3).orderBy("Rank")
    return rounded(out.select("Feature", "MeanSHAP", "Rank"), "MeanSHAP")


@query("class_rank_per_gene", with_sql(CONTRIBUTIONS_SQL, """r AS (SELECT RowID, Host, Gene, ExpressionCategory, FeatureClass, SHAP,
      rank() OVER (PARTITION BY Host, Gene ORDER BY abs(SHAP) DESC) AS k FROM collapsed c LEFT JOIN contribution_data d ON c.RowID = d.rowIndex)""",
    body="""SELECT RowID, Host, Gene, ExpressionCategory, round(SHAP, 6) AS SHAP, CASE WHEN SHAP = 0 THEN 'Infinity'::DOUBLE ELSE k::DOUBLE END AS Rank
      FROM r WHERE FeatureClass = 'CpG'"""))
def class_rank_per_gene(data):
    return rounded(attribution.class_rank(data.contributions(), data.contribution_data()), "SHAP")


@query("class_rank_by_effect", with_sql(CONTRIBUTIONS_SQL,
    "r AS (SELECT *, rank() OVER (PARTITION BY RowID, Label ORDER BY abs(SHAP) DESC) AS k FROM collapsed)",
    "e AS (SELECT *, rank() OVER (PARTITION BY ExpressionCategory ORDER BY Log2FC NULLS LAST) AS GeneRank FROM contribution_data)",
    """f AS (SELECT *, CASE ExpressionCategory WHEN 'Stimulated' THEN GeneRank >= max(GeneRank) OVER (PARTITION BY ExpressionCategory) - 50
          WHEN 'Repressed' THEN GeneRank <= 50 ELSE false END AS Top50 FROM e)""",
    body="""SELECT RowID, CASE WHEN SHAP = 0 THEN 'Infinity'::DOUBLE ELSE k::DOUBLE END AS Rank, GeneRank, Top50, ExpressionCategory
      FROM r LEFT JOIN f ON r.RowID = f.rowIndex WHERE FeatureClass = 'CpG'"""))
def class_rank_by_effect(data):
    out = attribution.class_rank_by_effect(data.contributions(), data.contribution_data())
    return out.select("RowID", "Rank", "GeneRank", "Top50", "ExpressionCategory")


@query("spearman_vs_reference", with_sql(GENE_SQL, METADATA_SQL, LABELLED_SQL, FEATURE_SQL, """
    pairs AS (SELECT 'CG%' AS Feature, CGp AS x, CpG AS y FROM feature_rows WHERE CGp IS NOT NULL AND CpG IS NOT NULL
      UNION ALL SELECT 'GCcont', GC, CpG FROM feature_rows WHERE GC IS NOT NULL AND CpG IS NOT NULL),
    ranked AS (SELECT Feature, rank() OVER (PARTITION BY Feature ORDER BY x) + (count(*) OVER (PARTITION BY Feature, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY Feature ORDER BY y) + (count(*) OVER (PARTITION BY Feature, y) - 1) / 2.0 AS ry FROM pairs),
    c AS (SELECT Feature, count(*) AS n, corr(rx, ry) AS v FROM ranked GROUP BY Feature)""",
    body="""SELECT t.Feature, n, round(v, 6) AS Correlation, t.Rank FROM (VALUES ('CG%', 1), ('GCcont', 2), ('not_there', 3)) t(Feature, Rank) LEFT JOIN c USING (Feature)"""))
def spearman_vs_reference(data):
    """Top features against CpG; a listed feature the data lacks keeps its row."""
    rows = feature_rows(data, "CpG", "CG%", "GCcont")
    listed = data.table("documents").agg(F.count("*").alias("rows")).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("Feature"), F.lit(k).alias("Rank")) for k, f in enumerate(("CG%", "GCcont", "not_there"), 1)])).alias("t"), (F.col("rows") * 0.0).alias("OverallMeanSHAP")
    ).select("t.Feature", "t.Rank", "OverallMeanSHAP", F.lit(False).alias("IsCpG"))
    out = attribution.top_feature_correlations(rows, listed, "CpG")
    return out.select("Feature", "n", F.round("Correlation", 6).alias("Correlation"), "Rank")


@query("feature_effects", with_sql(CONTRIBUTIONS_SQL, """vals AS (SELECT l_partkey AS rowIndex, 'CpG_Coding' AS Feature, round(avg(l_quantity), 6) AS Value FROM lineitem GROUP BY ALL
      UNION ALL SELECT l_partkey, 'TA%_Coding', max(l_quantity) FROM lineitem GROUP BY ALL)""",
    body="""SELECT c.RowID, c.Feature, round(c.SHAP, 6) AS SHAP, v.Value, d.ExpressionCategory FROM contributions c
      LEFT JOIN vals v ON c.RowID = v.rowIndex AND c.Feature = v.Feature LEFT JOIN contribution_data d ON c.RowID = d.rowIndex
      WHERE c.Feature IN ('CpG_Coding', 'TA%_Coding')"""))
def feature_effects(data):
    values = data.table("lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("CpG_Coding"), F.max("l_quantity").alias("TA%_Coding"))
    wide = data.contribution_data().join(values.withColumnRenamed("l_partkey", "rowIndex"), "rowIndex")
    out = attribution.feature_effects(data.contributions(), wide, ["CpG_Coding", "TA%_Coding"], ["ExpressionCategory"])
    return rounded(out.select("RowID", "Feature", "SHAP", "Value", "ExpressionCategory"), "SHAP")
