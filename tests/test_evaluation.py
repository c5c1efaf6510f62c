import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitlens.operators import distribution, evaluation, pairs, resampling


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_accuracy_with_unknown_truth_is_null(spark):
    df = frame(spark, [("A", "A"), ("A", "B"), (None, "A")], "obs string, pred string")
    got = {r.obs: r.Accuracy for r in evaluation.accuracy(df, ["obs"]).collect()}
    assert got == {"A": 0.5, None: None}


def test_grains_agree_with_separate_aggregations(spark):
    df = frame(spark, [("A", "A", "x"), ("A", "B", "y"), ("B", "B", "x")], "obs string, pred string, Host string")
    out = evaluation.accuracy_at_grains(df, [["obs"], ["obs", "Host"]]).toPandas()
    assert set(out.Grain) == {"obs", "obs,Host"}
    assert out[(out.Grain == "obs") & (out.obs == "A")].Accuracy.item() == 0.5
    assert out[(out.Grain == "obs,Host") & (out.Host == "y")].Accuracy.item() == 0.0


def test_interval_uses_type_seven_quantiles(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame([(f"Rep{r:02d}", "A", "A" if rng.random() < 0.6 else "B") for r in range(7) for _ in range(9)], columns=["Replicate", "obs", "pred"])
    got = evaluation.accuracy_interval(spark.createDataFrame(data)).first()
    per = (data.obs == data.pred).groupby(data.Replicate).mean()
    assert np.allclose([got.MeanAccuracy, got.LwrAccuracy, got.UprAccuracy], [per.mean(), per.quantile(0.025), per.quantile(0.975)])


def test_mean_of_resample_accuracies_is_not_pooled(spark):
    df = frame(spark, [("r1", "A", "A"), ("r2", "A", "B"), ("r2", "A", "B"), ("r2", "A", "B")], "Resample string, obs string, pred string")
    assert evaluation.accuracy_mean_resample(df).first().MeanAccuracy == 0.5


def test_outliers_use_the_whole_table(spark):
    values = [0.5] * 10 + [0.55] * 10 + [0.0, 1.0]
    df = frame(spark, [(i, "A" if i % 2 else "B", v) for i, v in enumerate(values)], "id int, obs string, Accuracy double")
    out = evaluation.flag_outliers(df).toPandas().sort_values("id")
    assert list(out.OutlierLow) == [v == 0.0 for v in values]
    assert list(out.OutlierHigh) == [v == 1.0 for v in values]
    assert [s == "A" for s in out.OutlierShape] == [v in (0.0, 1.0) for v in values]


def test_log_loss_is_clipped(spark):
    df = frame(spark, [("a", 0.0), ("a", 1.0), ("b", 0.25)], "k string, p double")
    got = {r.k: r.logLoss for r in evaluation.log_loss(df, ["k"], "p").collect()}
    assert math.isclose(got["b"], -math.log(0.25)) and got["a"] > 17 and math.isfinite(got["a"])


def test_gene_accuracy_keeps_rows_never_held_out(spark):
    data = frame(spark, [(1, "g1"), (2, "g2")], "rowIndex long, Gene string")
    preds = frame(spark, [(1, "A", "A"), (1, "A", "B")], "rowIndex long, obs string, pred string")
    assert {r.rowIndex: r.Accuracy for r in evaluation.gene_accuracy(preds, data).collect()} == {1: 0.5, 2: None}


def test_accuracy_by_effect_trims_the_ragged_end(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"rowIndex": np.arange(60), "Host": "h", "ExpressionCategory": "A", "Log2FC": np.round(rng.normal(size=60), 1), "Accuracy": rng.random(60)})
    got = evaluation.accuracy_by_effect(spark.createDataFrame(pdf), width=10).toPandas().sort_values("rowIndex")
    pdf["Rank"] = pdf.Log2FC.abs().rank(method="min")
    ordered = pdf.sort_values(["Rank", "rowIndex"]).reset_index(drop=True)
    ordered["m"] = [ordered.Accuracy[max(0, i - 4) : i + 6].mean() for i in range(60)]
    want = ordered[ordered.Rank <= ordered.Rank.max() - 10].sort_values("rowIndex")
    assert list(got.rowIndex) == list(want.rowIndex)
    assert np.allclose(got.SlidingAccuracy, want.m) and list(got.Rank) == list(want.Rank)


def test_folds_partition_every_repeat_and_are_stratified(spark):
    rows = spark.range(203).select(F.col("id").alias("rowIndex"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("obs"))
    out = resampling.repeated_folds(rows, folds=5, repeats=3).toPandas()
    assert len(out) == 203 * 3 and not out.duplicated(["rowIndex", "Rep"]).any()
    sizes = out.groupby(["Rep", "obs", "Fold"]).size().unstack()
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()
    assert len({tuple(out[out.Rep == r].sort_values("rowIndex").Fold) for r in (1, 2, 3)}) == 3
    again = resampling.repeated_folds(rows.repartition(7), folds=5, repeats=3).toPandas()
    assert out.sort_values(["Rep", "rowIndex"]).Fold.tolist() == again.sort_values(["Rep", "rowIndex"]).Fold.tolist()


def test_downsampling_balances_training_only(spark):
    rows = spark.range(100).select(F.col("id").alias("rowIndex"), F.when(F.col("id") < 20, "A").otherwise("B").alias("obs"))
    folds = resampling.repeated_folds(rows, folds=4, repeats=2)
    out = resampling.downsample(resampling.training_rows(folds, 4)).toPandas()
    assert (out.groupby(["Rep", "Fold", "obs"]).size() == 15).all()
    own = folds.toPandas().set_index(["Rep", "rowIndex"]).Fold
    assert all(own[(r.Rep, r.rowIndex)] != r.Fold for r in out.itertuples())


def test_resample_names(spark):
    df = frame(spark, [(1, 2)], "Fold int, Rep int")
    assert df.select(resampling.resample_name()).first()[0] == "Fold1.Rep02"


def test_box_stats_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400, p=[0.9, 0.1]), "v": np.round(rng.standard_t(2, 400), 2)})
    got = {r.g: r for r in distribution.box_stats(spark.createDataFrame(pdf), ["g"], "v").collect()}
    for g, x in pdf.groupby("g").v:
        q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        r = got[g]
        assert np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, med, q3, inside.min(), inside.max()])
        assert (r.n, r.n_outliers) == (len(x), len(x) - len(inside))


def test_density_integrates_to_most_of_one_and_tracks_the_direct_sum(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=500)
    out = distribution.density(spark.createDataFrame([("a", float(v)) for v in x], "g string, v double"), ["g"], "v", grid=128).toPandas().sort_values("GridIndex")
    bw = 0.9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * 500**-0.2
    direct = np.exp(-0.5 * ((out.x.to_numpy()[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (500 * bw * np.sqrt(2 * np.pi))
    assert np.allclose(out.Density, direct, atol=2e-3)


def test_density_of_a_constant_group(spark):
    out = distribution.density(spark.createDataFrame([("a", 2.0)] * 3, "g string, v double"), ["g"], "v", grid=8).toPandas()
    assert len(out) == 8 and np.isfinite(out.Density).all()


@pytest.mark.parametrize("mode", ["within", "between"])
def test_pair_distances_match_all_pairs(spark, mode):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 60), "c": rng.choice(["S", "R"], 60), "v": np.round(rng.normal(size=60), 1)})
    got = {r.g: r for r in distribution.pair_distances(spark.createDataFrame(pdf), ["g"], "c", "v", mode).collect()}
    for g, part in pdf.groupby("g"):
        rows = list(part.itertuples())
        same = mode == "within"
        d = np.array([abs(a.v - b.v) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a.c == b.c) == same]) * (math.sqrt(2) if same else 1)
        r = got[g]
        assert r.n_pairs == len(d)
        assert np.allclose([r.MeanDist, r.RmsDist, r.MaxDist], [d.mean(), np.sqrt((d**2).mean()), d.max()])


@pytest.mark.parametrize("mode", ["within", "between"])
def test_pair_distance_boxes_match_all_pairs(spark, mode):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": ["a"] * 50 + ["b"] * 12 + ["c"], "c": rng.choice(["S", "R"], 63), "v": np.round(rng.normal(size=63), 1)})
    df = spark.createDataFrame(pdf)
    got = {r.g: r for r in pairs.pair_distance_boxes(df, ["g"], "c", "v", mode, cuts=63, ranges=8).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        rows = list(pdf[pdf.g == g].itertuples())
        d = [abs(a.v - b.v) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a.c == b.c) == (mode == "within")]
        assert got[g].n_pairs == len(d)
        assert np.allclose(got[g].q, np.quantile(d, [0.25, 0.5, 0.75]) * (math.sqrt(2) if mode == "within" else 1), atol=1e-8)
