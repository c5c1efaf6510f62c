import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitlens.operators import boosting, shap
from traitlens.operators.boosting import BoostParams, Ensemble, Node, Tree
from traitlens.plans import training


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 4))
    score = x[:, 0] + 0.5 * x[:, 1] ** 2 - 0.5
    gone = rng.random(n) < 0.2
    rows = [
        (i, "up" if (score[i] > 0) != gone[i] else "down", ["a", "b", "c"][int(np.digitize(score[i], [-0.4, 0.6]))], None if gone[i] else float(x[i, 0]), *map(float, x[i, 1:]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "rowIndex long, obs string, kind string, `f-0` double, `f%1` double, f2 double, f3 double").repartition(3)


FEATURES = ["f-0", "f%1", "f2", "f3"]
LEVELS = ["up", "down"]


def loss(model, df, label="obs"):
    rows = model.score(df).select(label, "probability").collect()
    return -np.mean([math.log(r.probability[model.levels.index(r[label])]) for r in rows])


def test_boosting_lowers_the_loss_and_learns_where_gaps_go(table):
    losses = [loss(boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=r, max_depth=3, rate_drop=0.0)), table) for r in (1, 4)]
    assert losses[1] < losses[0] < math.log(2)
    model = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=2, max_depth=3))
    assert any(n.feature == "f-0" for t in model.trees for n in t.nodes)


def test_leaf_values_are_newton_steps(table):
    """One tree, checked against sums of gradients over the rows of each leaf."""
    params = BoostParams(rounds=1, max_depth=2, reg_lambda=1.5, min_child_weight=0.0)
    model = boosting.fit_dart(table, FEATURES, "obs", LEVELS, params)
    scored = model.score(table).select("obs", F.col("margin")[0].alias("m")).toPandas()
    for m, part in scored.groupby("m"):
        g = (0.5 - (part.obs == "up")).sum()
        h = 0.25 * len(part)
        assert math.isclose(m, -params.learning_rate * g / (h + params.reg_lambda), rel_tol=1e-9)


def test_without_dropout_skip_has_no_effect_and_weights_stay(table):
    a = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=3, max_depth=2, rate_drop=0.0, skip_drop=0.0))
    b = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=3, max_depth=2, rate_drop=0.9, skip_drop=1.0))
    assert a == b and all(t.weight == 0.3 for t in a.trees)


def test_dropout_rescales_dropped_and_new_trees(table):
    model = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=2, max_depth=2, rate_drop=1.0, skip_drop=0.0))
    assert [round(t.weight, 9) for t in model.trees] == [round(0.3 * 1 / 1.3, 9), round(0.3 / 1.3, 9)]


def test_rewriting_the_state_changes_nothing(table, monkeypatch):
    params = BoostParams(rounds=3, max_depth=2, rate_drop=0.5, skip_drop=0.2, colsample=0.5, subsample=0.7)
    plain = boosting.fit_dart(table, FEATURES, "obs", LEVELS, params)
    monkeypatch.setattr(boosting, "_SETTLE_EVERY", 1)
    again = boosting.fit_dart(table, FEATURES, "obs", LEVELS, params)
    assert [[(n.feature, n.left, n.right) for n in t.nodes] for t in plain.trees] == [[(n.feature, n.left, n.right) for n in t.nodes] for t in again.trees]
    assert np.allclose([n.value for t in plain.trees for n in t.nodes], [n.value for t in again.trees for n in t.nodes])


def test_gain_and_child_weight_prune(table):
    stump = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=1, max_depth=3, gamma=1e6))
    assert len(stump.trees[0].nodes) == 1
    heavy = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=1, max_depth=3, min_child_weight=15.0))
    assert all(n.cover >= 15.0 for n in heavy.trees[0].nodes)


def test_three_classes_give_a_softmax(table):
    model = boosting.fit_dart(table, FEATURES, "kind", ["a", "b", "c"], BoostParams(rounds=2, max_depth=2))
    rows = model.score(table).select("kind", "margin", "probability", "PredictedLabel").collect()
    for r in rows[:20]:
        e = np.exp(r.margin)
        assert np.allclose(r.probability, e / e.sum())
        assert r.PredictedLabel == model.levels[int(np.argmax(r.margin))]
    assert np.mean([r.kind == r.PredictedLabel for r in rows]) > 0.5


def test_save_load_and_missing_columns(spark, table, tmp_path):
    model = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=2, max_depth=2))
    model.save(spark, str(tmp_path / "m"))
    assert Ensemble.load(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError):
        model.score(table.drop("f2"))


def test_baseline_probability_is_of_the_first_level(table):
    score = boosting.fit_gbt(table, FEATURES, "obs", LEVELS, BoostParams(rounds=3, max_depth=3))
    out = score(table).select("obs", "PredictedLabel", F.col("probability")[0].alias("p"), F.col("margin")[0].alias("m")).toPandas()
    assert (out.p[out.obs == "up"].mean() > out.p[out.obs == "down"].mean()) and ((out.obs == out.PredictedLabel).mean() > 0.6)
    assert np.allclose(out.m, np.log(out.p / (1 - out.p)))


def test_route_missing_keeps_gaps_outside_the_range(spark, table):
    nullable = boosting.nullable_features(table, FEATURES)
    assert nullable == {"f-0"}
    encoded, names, origin = boosting.route_missing(table, FEATURES, nullable)
    assert origin[:2] == [("f-0", True), ("f-0", False)] and len(names) == len(origin) == 5
    got = encoded.toPandas()
    gone = got["f-0__low"] != got["f-0__high"]
    assert gone.sum() == table.where("`f-0` is null").count()
    known = got["f-0__low"][~gone]
    assert (got["f-0__low"][gone] < known.min()).all() and (got["f-0__high"][gone] > known.max()).all()
    nan = spark.createDataFrame([(1, float("nan"), 1.0), (2, 1.0, 1.0)], "rowIndex long, a double, b double")
    assert boosting.nullable_features(nan, ["a", "b"]) == {"a"}


# ---- attributions -----------------------------------------------------------------------------


def brute_force(tree, row, features):
    """Shapley values by definition, absent features following cover shares."""

    def value(known, i=0):
        n = tree.nodes[i]
        if n.feature is None:
            return n.value * tree.weight
        if n.feature in known:
            x = row[n.feature]
            left = n.missing_left if x is None or math.isnan(x) else x <= n.threshold
            return value(known, n.left if left else n.right)
        return sum(tree.nodes[c].cover / n.cover * value(known, c) for c in (n.left, n.right))

    m = len(features)
    out = {}
    for f in features:
        rest = [g for g in features if g != f]
        out[f] = sum(
            math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m) * (value({*s, f}) - value(set(s)))
            for k in range(m)
            for s in itertools.combinations(rest, k)
        )
    return out


def test_shap_matches_brute_force(table):
    model = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=3, max_depth=4, rate_drop=0.5, skip_drop=0.2))
    rows = {r.rowIndex: r.asDict() for r in table.limit(12).collect()}
    some = table.where(F.col("rowIndex").isin(list(rows)))
    got = {(r.RowID, r.Feature): r.SHAP for r in shap.shap_contributions(some, model).collect()}
    assert len(got) == len(rows) * len(FEATURES)
    for i, row in rows.items():
        want = [brute_force(t, row, FEATURES) for t in model.trees]
        for f in FEATURES:
            assert math.isclose(got[(i, f)], sum(w[f] for w in want), abs_tol=1e-9)


def test_repeated_feature_on_a_path_and_unused_features(spark):
    """A path that splits twice on one feature counts it once."""
    nodes = [Node("a", 1.0, True, 1, 2, 0, 10.0), Node("a", 0.0, False, 3, 4, 0, 6.0), Node(None, 0, True, -1, -1, 5.0, 4.0), Node("b", 0.0, True, 5, 6, 0, 4.0), Node(None, 0, True, -1, -1, 2.0, 2.0), Node(None, 0, True, -1, -1, -1.0, 1.0), Node(None, 0, True, -1, -1, 3.0, 3.0)]
    model = Ensemble(["a", "b", "idle"], ["x", "y"], [Tree(nodes, 0, 0.7)])
    data = [(1, -1.0, -1.0, 0.0), (2, 0.5, 1.0, 0.0), (3, None, 1.0, None), (4, 2.0, None, 0.0)]
    df = spark.createDataFrame(data, "rowIndex long, a double, b double, idle double")
    got = {(r.RowID, r.Feature): r.SHAP for r in shap.shap_contributions(df, model).collect()}
    for i, a, b, _ in data:
        want = brute_force(model.trees[0], {"a": a, "b": b}, ["a", "b"])
        assert math.isclose(got[(i, "a")], want["a"], abs_tol=1e-12) and math.isclose(got[(i, "b")], want["b"], abs_tol=1e-12)
        assert got[(i, "idle")] == 0.0
    assert shap.additivity(df, model).agg(F.max("Gap")).first()[0] < 1e-12


def random_tree(rng, depth, features, repeats=True):
    """A full tree with random splits and covers, some of them 0."""
    nodes = []

    def grow(level, cover):
        i = len(nodes)
        nodes.append(None)
        if level == depth:
            nodes[i] = Node(None, 0.0, True, -1, -1, rng.gauss(0, 1), cover)
            return i
        part = cover * rng.choice([0.0, 0.1, 0.5, 0.7]) if repeats else cover * rng.uniform(0.2, 0.8)
        feature = rng.choice(features) if repeats else features[level]
        threshold, missing_left = rng.uniform(-1, 1), rng.random() < 0.5
        left, right = grow(level + 1, part), grow(level + 1, cover - part)
        nodes[i] = Node(feature, threshold, missing_left, left, right, 0.0, cover)
        return i

    grow(0, 64.0)
    return Tree(nodes, 0, rng.uniform(0.2, 1.0))


def test_shared_prefixes_give_shapley_values_of_deep_trees(monkeypatch):
    """Depth 7, features repeated on paths, covers of 0, gaps; blocks and slices of any size agree."""
    rng = random.Random(5)
    features = ["a", "b", "c", "d", "e"]
    position = {f: i for i, f in enumerate(features)}
    trees = [random_tree(rng, depth, features) for depth in (0, 1, 3, 7, 7)]
    x = np.array([[rng.uniform(-1, 1) if rng.random() < 0.8 else np.nan for _ in range(9)] for _ in features])

    def value(tree, row, known, i=0):
        n = tree.nodes[i]
        if n.feature is None:
            return n.value * tree.weight
        if n.feature in known:
            left = n.missing_left if math.isnan(row[n.feature]) else row[n.feature] <= n.threshold
            return value(tree, row, known, n.left if left else n.right)
        return sum(tree.nodes[c].cover / n.cover * value(tree, row, known, c) for c in (n.left, n.right)) if n.cover else 0.0

    whole = shap.batch_contributions(shap.tree_blocks(trees, position), x)
    for r in range(x.shape[1]):
        row = {f: x[position[f], r] for f in features}
        for f in features:
            rest = [g for g in features if g != f]
            want = sum(
                math.factorial(k) * math.factorial(4 - k) / math.factorial(5) * sum(value(t, row, {*s, f}) - value(t, row, set(s)) for t in trees)
                for k in range(5) for s in itertools.combinations(rest, k)
            )
            assert math.isclose(whole[position[f], r], want, abs_tol=1e-9)
    monkeypatch.setattr(shap, "_BLOCK_NODES", 1)
    monkeypatch.setattr(shap, "_BLOCK_BYTES", 1)
    assert np.allclose(shap.batch_contributions(shap.tree_blocks(trees, position), x), whole, atol=1e-12)


def test_attribution_work_follows_edges():
    """Time per tree stays flat from 50 to 500 trees of depth 8, and products fit the bytes a task may hold."""
    rng = random.Random(6)
    features = [f"f{i}" for i in range(8)]
    position = {f: i for i, f in enumerate(features)}
    trees = [random_tree(rng, 8, features, repeats=False) for _ in range(500)]
    x = np.random.default_rng(1).uniform(-1, 1, (8, 64))
    seconds = {}
    for n in (50, 500):
        blocks = shap.tree_blocks(trees[:n], position)
        assert sum(len(b) - 1 for b in blocks) == n * 510 and max(len(b) for b in blocks) <= shap._BLOCK_NODES
        start = time.perf_counter()
        shap.batch_contributions(blocks, x)
        seconds[n] = (time.perf_counter() - start) / n
    assert seconds[500] < 3 * seconds[50]


def test_multiclass_contributions_share_row_ids(table):
    model = boosting.fit_dart(table, FEATURES, "kind", ["a", "b", "c"], BoostParams(rounds=1, max_depth=2))
    out = shap.shap_contributions(table, model)
    assert out.select("RowID").distinct().count() == 300 and out.select("Label").distinct().count() == 3
    assert out.count() == 300 * 3 * 4
    assert shap.additivity(table, model).agg(F.max("Gap")).first()[0] < 1e-9


def test_two_class_label_is_the_first_level(table):
    model = boosting.fit_dart(table, FEATURES, "obs", LEVELS, BoostParams(rounds=1, max_depth=1))
    assert {r.Label for r in shap.shap_contributions(table, model).select("Label").distinct().collect()} == {"up"}


# ---- tuning -----------------------------------------------------------------------------------


def test_search_holds_rows_out_once_per_repeat(spark, table, tmp_path):
    candidates = [BoostParams(rounds=1, max_depth=1), BoostParams(rounds=3, max_depth=3)]
    tuning = training.search(table, FEATURES, LEVELS, candidates, folds=2, repeats=1, parallelism=2)
    assert tuning.metrics.count() == 4 and tuning.candidates.count() == 2
    means = {r.Candidate: r.logLoss for r in tuning.candidates.collect()}
    assert means[tuning.best] == min(means.values())
    oof = training.held_out_predictions(tuning).toPandas()
    assert sorted(oof.rowIndex) == list(range(300)) and set(oof.Resample) == {"Fold1.Rep01", "Fold2.Rep01"}
    model = training.refit(table, FEATURES, LEVELS, tuning.best_params, str(tmp_path / "fit"))
    assert Ensemble.load(spark, str(tmp_path / "fit" / "model")) == model
    assert spark.read.parquet(str(tmp_path / "fit" / "data")).count() == 300


def test_candidates_repeat_with_the_seed():
    a, b = boosting.random_candidates(5, seed=3), boosting.random_candidates(5, seed=3)
    assert a == b and a != boosting.random_candidates(5, seed=4) and len(boosting.random_candidates()) == 100


def test_scoring_walks_the_node_table_like_the_sql_tree(table):
    """Deep and many trees: the Arrow pass gives the SQL expression's margins, NULL features included."""
    df = table
    model = boosting.fit_dart(df, FEATURES, "obs", LEVELS, BoostParams(rounds=6, max_depth=5, max_bins=16))
    both = model.score(df).withColumn("by_sql", model.margin()).select((F.col("margin")[0] - F.col("by_sql")).alias("gap"))
    assert both.agg(F.max(F.abs("gap"))).first()[0] < 1e-12
    many = boosting.Ensemble(model.features, model.levels, model.trees * 100)
    tenfold = many.score(df).select((F.col("margin")[0] - F.lit(100.0) * F.lit(1.0) * model.margin()).alias("gap"))
    assert tenfold.agg(F.max(F.abs("gap"))).first()[0] < 1e-9
