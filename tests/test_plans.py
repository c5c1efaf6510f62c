import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from traitlens import catalog
from traitlens.plans import holdout, perturbation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_holdout_labels_must_not_overlap(spark):
    df = frame(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)], "id string, fc double")
    assert holdout.holdout_labels(df, "id", "fc", 1).count() == 2
    with pytest.raises(ValueError):
        holdout.holdout_labels(df, "id", "fc", 2)


def test_holdout_features_merge_and_harmonise(spark):
    coding = frame(spark, [(">A|T", 1.0, 2.0, 3.0)] * 2, "SeqName string, UpU double, UpA double, `S-Bias` double")
    extra = frame(spark, [("A", 50.0, 7.0, 1.0)], "Gene string, GCcont double, `CG%` double, UpU double")
    gene = frame(spark, [("A", 40.0), ("nc", 1.0)], "Gene string, GCcont double")
    out = holdout.holdout_features(coding, extra, gene)
    assert set(out.columns) == {"Gene", "UpT_Coding", "UpA_Coding", "S-Bias_Coding", "GCcont_Coding", "CG%_Coding", "GCcont_EntireGene"}
    assert out.count() == 2
    with pytest.raises(ValueError):
        holdout.holdout_features(coding, extra.union(extra.withColumn("GCcont", F.lit(1.0))), gene)


def test_holdout_accuracy_keeps_unknown_labels(spark):
    predicted = frame(spark, [("a", "S"), ("b", "R"), ("c", "S")], "Gene string, PredictedLabel string")
    labels = frame(spark, [("a", "S"), ("b", "S")], "id string, Label string")
    export, accuracy = holdout.holdout_accuracy(predicted, labels, "id")
    assert export.columns == ["Gene", "ActualLabel", "PredictedLabel"] and export.count() == 3
    got = {r.Label: (r.Accuracy, r.n, r.Proportion_accurate) for r in accuracy.collect()}
    assert got == {"S": (1.0, 2, 0.5), None: (None, 1, None)}


@pytest.fixture(scope="module")
def experiment(spark):
    effects = frame(spark, [(i, f"E{i}", 0.1 * i, "NonDE", 0.5) for i in range(1, 9)], "RowID long, EnsemblID string, SHAP double, ExpressionCategory string, Log2FC double")
    scores = frame(spark, [(f"E{i}", i / 10) for i in range(1, 9)], "EnsemblID string, predicted_prob double")
    names = frame(spark, [(f"E{i}", f"N{i}") for i in range(1, 9)], "EnsemblID string, Gene string")
    top = frame(spark, [("E1", "IRG", "N1"), ("E2", "ISG", "N2"), ("E3", "odd", "N3")], "EnsemblID string, ExpressionCategory string, Gene string")
    random = perturbation.random_holdout(frame(spark, [("E4",), ("E5",)], "EnsemblID string"), names, n=1)
    return dict(effects=effects, scores=scores, names=names, top=top, random=random, baseline=perturbation.overview(top, random, effects, scores))


def test_overview_categories(experiment):
    got = {r.EnsemblID: r.Category for r in experiment["baseline"].collect()}
    assert got["E1"] == "Top 50 IRGs" and got["E2"] == "Top 50 ISGs" and got["E3"] is None and "Holdout Random" in got.values() and len(got) == 4
    with pytest.raises(ValueError):
        perturbation.overview(experiment["top"], experiment["top"], experiment["effects"], experiment["scores"])


def test_consistent_and_overexpression(spark, experiment):
    listed = frame(spark, [("N6", "E6", "ZAP-IN", None), ("N7", "E7", "ZAP-DEP", "ZAP-IN")], "gene string, ensemble_id string, ko_experiment string, exogenous_zap_experiment string")
    e = experiment
    ko = perturbation.consistent(listed, e["baseline"], e["effects"], e["scores"])
    assert set(ko.columns) == {"Gene", "EnsemblID", "Category", "cpg_effect", "predicted_prob"} and ko.count() == 6
    over = perturbation.overexpression(listed, e["baseline"], e["effects"], e["scores"])
    assert over.count() == 5 and {r.EnsemblID: r.Category for r in over.collect()}["E7"] == "ZAP-IN"
    unknown = frame(spark, [("N", "E99", "ZAP-IN", None)], listed.schema)
    with pytest.raises(ValueError):
        perturbation.consistent(unknown, e["baseline"], e["effects"], e["scores"])


def test_knockout_keeps_null_controls_and_drops_null_knockouts(spark, experiment):
    e = experiment
    control = frame(spark, [("E1", "a-Top50-ISGs"), (None, "c-Top50-IRGs"), ("NA", "b")], "EnsemblID string, Rank string")
    knocked = frame(spark, [("E2", "c-Top50-IRGs"), (None, "a-Top50-ISGs"), ("NA", "a-Top50-ISGs")], "EnsemblID string, Rank string")
    out = perturbation.knockout(control, knocked, e["random"], e["names"], e["effects"], e["scores"])
    labels = sorted(r.Label for r in out.collect())
    assert labels == ["Holdout Random", "IRG (KO)", "IRG (no guide)", "ISG (no guide)", "NA (no guide)"]
    assert [r.cpg_effect for r in out.where("EnsemblID is null").collect()] == [None]


def test_exogenous_categories_outside_the_order_become_null(spark, experiment):
    e = experiment
    listed = frame(spark, [("N6", "E6", "TOP50 UP"), ("N7", "E7", "else")], "Gene_Name string, EnsemblID string, Rank string")
    got = {r.EnsemblID: r.Category for r in perturbation.exogenous(listed, e["random"], e["effects"], e["scores"]).collect()}
    assert got["E6"] == "TOP50 UP" and got["E7"] is None


# ---- catalogue --------------------------------------------------------------------------------


def test_every_query_is_registered_with_a_known_twin():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(catalog.QUERIES) >= 75
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"train_score_dart", "train_score_gbt", "shap_contributions"}


def test_entry_returns_a_frame(spark):
    df = entry.entry(spark)
    assert df.columns == ["HOST", "ExpressionCategory", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["accuracy_interval", "rank_min_ties", "merge_null_safe", "spearman_vs_reference", "class_rank_per_gene", "train_dart_stumps", "shap_stump"])
def test_some_twins_on_the_smallest_tables(spark, name):
    import glob
    import os

    import duckdb

    from check_queries import rows_of

    folder = entry.SMOKE_DIR
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, folder)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cursor.fetchall(), [d[0] for d in cursor.description])
