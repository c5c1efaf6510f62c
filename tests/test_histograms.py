"""Histogram trees, resumable searches, the model store and mergeable sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitlens.operators import histograms, sketches
from traitlens.operators.boosting import BoostParams
from traitlens.plans import tuning
from traitlens.sources.models import ModelStore, ResampleLedger

FEATURES, LEVELS = ["f-0", "f%1", "f2", "f3"], ["up", "down"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = np.round(rng.normal(size=(n, 4)), 1)
    score = x[:, 0] + 0.5 * x[:, 1] ** 2 - 0.5
    gone = rng.random(n) < 0.2
    rows = [
        (i, "up" if (score[i] > 0) != gone[i] else "down", ["a", "b", "c"][int(np.digitize(score[i], [-0.4, 0.6]))], None if gone[i] else float(x[i, 0]), *map(float, x[i, 1:]))
        for i in range(n)
    ]
    rows += [(n, "neither", "a", 1.0, 1.0, 1.0, 1.0), (n + 1, None, None, None, None, None, float("nan"))]
    return spark.createDataFrame(rows, "rowIndex long, obs string, kind string, `f-0` double, `f%1` double, f2 double, f3 double").repartition(3)


def plain_split(x, g, h, params):
    """(gain, feature, cut, missing left) of the best split by trying every one."""
    best = None
    score = lambda a, b: a * a / (b + params.reg_lambda)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f][~np.isnan(x[:, f])])
        for k, v in enumerate(values):
            for missing_left in (True, False):
                left = np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= v)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if min(hl, hr) < params.min_child_weight or not left.any() or left.all():
                    continue
                gain = (score(gl, hl) + score(gr, hr) - score(g.sum(), h.sum())) / 2 - params.gamma
                key = (round(gain, 9), -f, -k, missing_left)
                if gain > 0 and (best is None or key > best[0]):
                    best = key, f, (v + values[k + 1]) / 2 if k + 1 < len(values) else 1e308, missing_left, left
    return best


def plain_tree(x, g, h, params, depth=0):
    found = plain_split(x, g, h, params) if depth < params.max_depth else None
    if found is None:
        return -g.sum() / (h.sum() + params.reg_lambda)
    _, f, cut, missing_left, left = found
    return f, cut, missing_left, plain_tree(x[left], g[left], h[left], params, depth + 1), plain_tree(x[~left], g[~left], h[~left], params, depth + 1)


def shape(tree, features, i=0):
    n = tree.nodes[i]
    if n.feature is None:
        return n.value
    return features.index(n.feature), n.threshold, n.missing_left, shape(tree, features, n.left), shape(tree, features, n.right)


def alike(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and a[2] == b[2] and math.isclose(a[1], b[1]) and alike(a[3], b[3]) and alike(a[4], b[4])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("params", [
    BoostParams(rounds=1, max_depth=3, max_bins=200), BoostParams(rounds=1, max_depth=3, max_bins=200, gamma=1.0, reg_lambda=3.0), BoostParams(rounds=1, max_depth=2, max_bins=200, min_child_weight=12.0),
])
def test_a_tree_takes_the_best_split_at_every_node(table, params):
    rows = table.where(F.col("obs").isin(LEVELS)).toPandas()
    x, y = rows[FEATURES].to_numpy(float), (rows.obs == "up").to_numpy()
    model = histograms.fit_histogram(table, FEATURES, "obs", LEVELS, params)
    assert alike(shape(model.trees[0], FEATURES), plain_tree(x, 0.5 - y, np.full(len(y), 0.25), params))


def test_margins_kept_with_the_rows_are_those_of_the_model(table):
    """Dropout, drawn rows and features, three classes, margins written after every tree or never."""
    params = BoostParams(rounds=5, max_depth=3, rate_drop=0.5, skip_drop=0.2, colsample=0.5, subsample=0.7, max_bins=16)
    binned = histograms.bin_rows(table, FEATURES, "kind", ["a", "b", "c"], 16, held=table.select("rowIndex", F.array(F.lit(0)).alias("resamples")))
    often, never = [histograms.Fit(params)], [histograms.Fit(params)]
    histograms.grow_all(binned, often, settle_trees=1)
    state = histograms.grow_all(binned, never, settle_trees=1000)
    one, two = often[0].ensemble(binned), never[0].ensemble(binned)
    assert [[(n.feature, n.threshold, n.left) for n in t.nodes] for t in one.trees] == [[(n.feature, n.threshold, n.left) for n in t.nodes] for t in two.trees]
    assert np.allclose([t.weight for t in one.trees], [t.weight for t in two.trees]) and len({t.weight for t in one.trees}) > 1
    scored = one.score(table.where("kind is not null")).select("kind", "probability").collect()
    mean = -np.mean([math.log(r.probability["abc".index(r.kind)]) for r in scored])
    found = histograms.held_out_losses(state, never).first()
    assert found.n == len(scored) and math.isclose(found.loss / found.n, mean, rel_tol=1e-9)


def test_more_rounds_lower_the_loss_with_one_missing_bin_per_feature(table):
    binned = histograms.bin_rows(table, FEATURES, "obs", LEVELS, 32)
    assert binned.bins <= 34 and len(binned.cuts) == len(FEATURES)
    fits = [histograms.Fit(BoostParams(rounds=r, max_depth=3, rate_drop=0.0)) for r in (1, 6)]
    histograms.grow_all(binned, fits)
    few, many = (f.ensemble(binned).score(table.where(F.col("obs").isin(LEVELS))).select("obs", "probability").collect() for f in fits)
    loss = lambda rows: -np.mean([math.log(r.probability[LEVELS.index(r.obs)]) for r in rows])
    assert loss(many) < loss(few) < math.log(2)


def test_empty_and_constant_inputs(spark, table):
    none = histograms.fit_histogram(table.limit(0), FEATURES, "obs", LEVELS, BoostParams(rounds=2, max_depth=2))
    assert [len(t.nodes) for t in none.trees] == [1, 1]
    flat = spark.createDataFrame([(i, LEVELS[i % 2], 1.0, None) for i in range(20)], "rowIndex long, obs string, a double, b double")
    model = histograms.fit_histogram(flat, ["a", "b"], "obs", LEVELS, BoostParams(rounds=1, max_depth=3))
    assert len(model.trees[0].nodes) == 1 and abs(model.trees[0].nodes[0].value) < 1e-12


def test_passes_do_not_grow_with_the_fits(table, monkeypatch):
    calls = []
    real = histograms.best_splits
    monkeypatch.setattr(histograms, "best_splits", lambda cells: calls.append(1) or real(cells))
    binned = histograms.bin_rows(table, FEATURES, "obs", LEVELS, 16)
    histograms.grow_all(binned, [histograms.Fit(BoostParams(rounds=2, max_depth=2, seed=s)) for s in range(12)])
    assert len(calls) <= 4


# ---- searches ---------------------------------------------------------------------------------

CANDIDATES = [BoostParams(rounds=1, max_depth=d, max_bins=16, reg_lambda=lam) for d, lam in ((1, 1.0), (2, 1.0), (2, 5.0))]


class Stop(Exception):
    pass


def test_a_stopped_search_fits_only_what_is_absent(spark, table, tmp_path, monkeypatch):
    rows = table.where(F.col("obs").isin(LEVELS))
    options = dict(folds=3, repeats=2)
    whole = tuning.search(rows, FEATURES, LEVELS, CANDIDATES, **options)
    # Groups of four fits, as if a task's memory held no more.
    monkeypatch.setattr(tuning, "groups_of_fits", lambda binned, fits: [list(range(a, min(a + 4, len(fits)))) for a in range(0, len(fits), 4)])
    ledger, fitted = ResampleLedger(spark, str(tmp_path), "two"), []

    def stop(group):
        fitted.append(len(group))
        if len(fitted) == 2:
            raise Stop

    with pytest.raises(Stop):
        tuning.search(rows, FEATURES, LEVELS, CANDIDATES, ledger=ledger, after_group=stop, **options)
    assert ledger.done().count() == 8
    # A group whose trees were written but never committed does not count.
    spark.read.parquet(f"{ledger.root}/trees").drop("batch").withColumn("resample", F.lit(5)).write.parquet(f"{ledger.root}/trees/batch=dead")
    again = ResampleLedger(spark, str(tmp_path), "two")
    found = tuning.search(rows, FEATURES, LEVELS, CANDIDATES, ledger=again, after_group=lambda group: fitted.append(len(group)), **options)
    assert sum(fitted) == 18 and again.done().count() == 18
    as_rows = lambda s: {(r.Candidate, r.Rep, r.Fold): (r.n, round(r.logLoss, 9)) for r in s.metrics.collect()}
    assert as_rows(found) == as_rows(whole) and found.best == whole.best
    third = tuning.search(rows, FEATURES, LEVELS, CANDIDATES, ledger=again, after_group=lambda group: fitted.append(99), **options)
    assert 99 not in fitted and third.best == found.best


def test_held_out_rows_and_stored_winner(spark, table, tmp_path):
    rows = table.where(F.col("obs").isin(LEVELS))
    found = tuning.search(rows, FEATURES, LEVELS, CANDIDATES[:2], folds=3, repeats=2)
    out = tuning.held_out_predictions(found).toPandas()
    assert len(out) == 2 * rows.count() and out.groupby("rowIndex").Rep.nunique().eq(2).all()
    losses = {(r.Rep, r.Fold): r.logLoss for r in found.metrics.where(F.col("Candidate") == found.best).collect()}
    for key, part in out.groupby(["Rep", "Fold"]):
        assert math.isclose(-np.log(part.p_observed).mean(), losses[key], rel_tol=1e-9)
    store = ModelStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.model("two", "r1", "ALL")
    model = tuning.refit_best(found, rows, store, "two", "r1", "ALL")
    first = store.versions("two", "r1", "ALL")
    assert store.model("two", "r1", "ALL") == model and store.rows("two", "r1", "ALL").count() == rows.count()
    assert BoostParams(**store.settings("two", "r1", "ALL")) == found.best_params
    # A version that was never committed is not seen; a later one wins, the earlier stays.
    store.spark.range(1).write.parquet(f"{tmp_path}/kind=two/run=r1/host=ALL/versions/dead/data")
    second = store.save("two", "r1", "ALL", model, rows.limit(5), {"rounds": 1})
    assert store.versions("two", "r1", "ALL") == [*first, second]
    assert store.rows("two", "r1", "ALL").count() == 5 and store.rows("two", "r1", "ALL", first[0]).count() == rows.count()
    assert store.versions("two", "r2", "ALL") == []
    with pytest.raises(ValueError):
        store.save("two", "../r1", "ALL", model, rows, {})


# ---- sketches ---------------------------------------------------------------------------------


def test_sketches_merge_to_the_quantiles_of_all_rows(spark):
    rows = spark.range(0, 40_000, numPartitions=20).selectExpr("id % 3 AS g", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN DOUBLE('NaN') ELSE CAST(id AS DOUBLE) END AS x", "CAST(NULL AS DOUBLE) AS none")
    assert sketches.stages(rows) == 4
    for salts in (1, 4, 20):
        points = sketches.quantile_table(rows, ["x", "none"], [0.1, 0.5, 0.9], salts)
        assert points["none"] == [] and np.allclose(points["x"], [4_000, 20_000, 36_000], atol=800)
    by_group = sketches.sketched(rows, ["g"], ["x"]).select("g", F.kll_sketch_get_n_double("x").alias("n")).collect()
    assert sum(r.n for r in by_group) == 32_000 and len(by_group) == 3
