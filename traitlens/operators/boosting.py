"""Boosted trees with dropout (DART) on MLlib regression trees.

Each round turns the current margins into gradients and hessians as columns and
fits one MLlib ``DecisionTreeRegressor`` on -g/h with weight h: the Newton step
of the logistic (or softmax) loss.  MLlib keeps the sums of h and of g in every
node, so regularised leaf values, gain pruning and node covers need no further
job.  Missing values are routed by encoding (see :func:`route_missing`).  While
training, a new tree is a SQL expression on the raw columns; a finished model is
scored from one broadcast node table in an Arrow pass.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.functions.names import col, quoted
from traitlens.sources.store import settle, settle_for_passes

_SETTLE_EVERY = 8
_LOW, _HIGH = "__low", "__high"


@dataclass(frozen=True)
class BoostParams:
    """Hyper-parameters of one fit."""

    rounds: int = 100
    max_depth: int = 4
    learning_rate: float = 0.3
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    rate_drop: float = 0.1
    skip_drop: float = 0.5
    max_bins: int = 64
    seed: int = 1


@dataclass(frozen=True)
class Node:
    """One tree node; a leaf has no feature."""

    feature: str | None
    threshold: float
    missing_left: bool
    left: int
    right: int
    value: float
    cover: float


@dataclass
class Tree:
    """Nodes with the root at 0, the class it adds to, and its weight."""

    nodes: list[Node]
    klass: int = 0
    weight: float = 1.0

    def sql(self) -> str:
        """The tree as a CASE expression over the raw feature columns."""

        def walk(i: int) -> str:
            n = self.nodes[i]
            if n.feature is None:
                return f"{n.value!r}D"
            test = f"coalesce({quoted(n.feature)} <= {n.threshold!r}D, {str(n.missing_left).lower()})"
            return f"CASE WHEN {test} THEN {walk(n.left)} ELSE {walk(n.right)} END"

        return walk(0)


@dataclass
class Ensemble:
    """A fitted model: features, class levels, weighted trees."""

    features: list[str]
    levels: list[str]
    trees: list[Tree] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return 1 if len(self.levels) == 2 else len(self.levels)

    def _require(self, df: DataFrame) -> None:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"features missing from the input: {missing[:5]}")

    def margin(self, klass: int = 0) -> Column:
        """Weighted sum of the trees of one class; log-odds of the first level when there are two."""
        terms = [f"{t.weight!r}D * ({t.sql()})" for t in self.trees if t.klass == klass]
        if not terms:
            return F.lit(0.0)
        return F.expr(f"aggregate(array({', '.join(terms)}), 0D, (s, v) -> s + v)")

    def arrays(self) -> dict[str, np.ndarray]:
        """All trees as one node table: a node's feature is -1 at a leaf, its children are places in the table."""
        place = {f: i for i, f in enumerate(self.features)}
        rows, roots = [], []
        for tree in self.trees:
            base = len(rows)
            roots.append(base)
            for n in tree.nodes:
                leaf = n.feature is None
                rows.append((-1 if leaf else place[n.feature], n.threshold or 0.0, bool(n.missing_left), base + (n.left or 0), base + (n.right or 0), n.value))
        names = ("feature", "threshold", "missing_left", "left", "right", "value")
        columns = dict(zip(names, zip(*rows))) if rows else {n: () for n in names}
        kinds = (np.int32, float, bool, np.int32, np.int32, float)
        table = {n: np.asarray(columns[n], k) for n, k in zip(names, kinds)}
        return table | {"root": np.asarray(roots, np.int32), "klass": np.asarray([t.klass for t in self.trees], int), "weight": np.asarray([t.weight for t in self.trees], float)}

    def margins(self, spark: SparkSession) -> Column:
        """Weighted sums of the trees of each class, in one Arrow pass over the features.

        The node table is broadcast and walked level by level for all rows of a
        batch, so the cost of a tree is its depth, however many trees there are.
        """
        shared, outputs, used = spark.sparkContext.broadcast(self.arrays()), self.outputs, self.features

        @F.pandas_udf("array<double>")
        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            t = shared.value
            for batch in batches:
                x = batch.to_numpy(dtype=float, na_value=np.nan)
                rows, sums = np.arange(len(x)), np.zeros((len(x), outputs))
                for root, klass, weight in zip(t["root"], t["klass"], t["weight"]):
                    at = np.full(len(x), root)
                    while True:
                        feature = t["feature"][at]
                        inner = feature >= 0
                        if not inner.any():
                            break
                        value = x[rows, np.maximum(feature, 0)]
                        goes_left = np.where(np.isnan(value), t["missing_left"][at], value <= t["threshold"][at])
                        at = np.where(inner, np.where(goes_left, t["left"][at], t["right"][at]), at)
                    sums[:, klass] += weight * t["value"][at]
                yield pd.Series(list(sums))

        return walk(F.struct(*[col(f).cast("double").alias(f"f{i}") for i, f in enumerate(used)]))

    def score(self, df: DataFrame, margin: str = "margin", probability: str = "probability", label: str = "PredictedLabel") -> DataFrame:
        """Add margins, class probabilities (arrays in level order) and the likeliest level."""
        self._require(df)
        df = df.withColumn(margin, self.margins(df.sparkSession))
        levels = F.array(*[F.lit(v) for v in self.levels])
        if self.outputs == 1:
            p = 1 / (1 + F.exp(-F.col(margin)[0]))
            df = df.withColumn(probability, F.array(p, 1 - p))
        else:
            top = F.array_max(margin)
            shifted = F.transform(margin, lambda m: F.exp(m - top))
            total = F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v)
            df = df.withColumn(probability, F.transform(shifted, lambda v: v / total))
        best = F.array_position(F.col(probability), F.array_max(probability)).cast("int")
        return df.withColumn(label, F.element_at(levels, best))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a node table; its size depends on the hyper-parameters only."""
        head = json.dumps({"features": self.features, "levels": self.levels})
        rows = [
            (head, t, tree.klass, tree.weight, i, n.feature, n.threshold, n.missing_left, n.left, n.right, n.value, n.cover)
            for t, tree in enumerate(self.trees)
            for i, n in enumerate(tree.nodes)
        ]
        schema = (
            "head string, tree int, klass int, weight double, node int, feature string, threshold double, "
            "missing_left boolean, left int, right int, value double, cover double"
        )
        spark.createDataFrame(rows, schema).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.tree, r.node))
        head = json.loads(rows[0].head)
        trees: dict[int, Tree] = {}
        for r in rows:
            tree = trees.setdefault(r.tree, Tree([], r.klass, r.weight))
            tree.nodes.append(Node(r.feature, r.threshold, r.missing_left, r.left, r.right, r.value, r.cover))
        return cls(head["features"], head["levels"], [trees[t] for t in sorted(trees)])


# ---- missing values ---------------------------------------------------------------------------

# Stand-ins for a missing value, beyond any measured one and still finite, so
# that the midpoint to a real value is finite too.
_BELOW, _ABOVE = -1e308, 1e308


def _known(feature: str) -> str:
    """SQL for a feature as a number, NaN counted as missing."""
    return f"nullif(CAST({quoted(feature)} AS DOUBLE), DOUBLE('NaN'))"


def nullable_features(df: DataFrame, features: Sequence[str]) -> set[str]:
    """Features that are missing in some row.

    Each row names its own gaps, so the aggregation has one expression however
    wide the table is, and complete rows add nothing to it.
    """
    gaps = ", ".join(f"IF({_known(f)} IS NULL, {i}, NULL)" for i, f in enumerate(features))
    found = df.select(F.explode(F.array_compact(F.expr(f"array({gaps})"))).alias("i")).distinct().collect()
    return {features[r.i] for r in found}  # at most one row per feature


def route_missing(df: DataFrame, features: Sequence[str], nullable: set[str], keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str], list[tuple[str, bool]]]:
    """Give each nullable feature two copies, missing far below and missing far above.

    A split on the first copy sends missing rows left, on the second right, so
    the tree learns the direction.  Returns the frame (``keep`` columns, then
    encoded ones), the encoded names, and per name its feature and whether
    missing goes left.
    """
    names, origin, columns = [], [], []
    for f in features:
        ends = ((_LOW, _BELOW, True), (_HIGH, _ABOVE, False)) if f in nullable else (("__all", None, True),)
        for suffix, stand_in, left in ends:
            value = _known(f) if stand_in is None else f"coalesce({_known(f)}, {stand_in!r}D)"
            names.append(f + suffix)
            origin.append((f, left))
            columns.append(f"{value} AS {quoted(f + suffix)}")
    keep = [c for c in df.columns if c not in features] if keep is None else keep
    return df.selectExpr(*[quoted(c) for c in keep], *columns), names, origin


# ---- trees ------------------------------------------------------------------------------------


def _read_tree(model, origin: Sequence[tuple[str, bool]], params: BoostParams) -> list[Node]:
    """Nodes of an MLlib tree with Newton leaf values, pruned by gain and child weight.

    A node's statistics are [sum h, sum h*y, ...] with y = -g/h, so the leaf is
    (sum h*y) / (sum h + lambda) and the cover is sum h.
    """

    def score(g: float, h: float) -> float:
        return g * g / (h + params.reg_lambda)

    def grow(node):
        stats = node.impurityStats().stats()
        h, g = float(stats[0]), float(stats[1])
        leaf = {"h": h, "g": g}
        if "Internal" not in node.getClass().getSimpleName():
            return leaf
        left, right = grow(node.leftChild()), grow(node.rightChild())
        if min(left["h"], right["h"]) < params.min_child_weight:
            return leaf
        if "kids" not in left and "kids" not in right:
            gain = 0.5 * (score(left["g"], left["h"]) + score(right["g"], right["h"]) - score(g, h)) - params.gamma
            if gain <= 0:
                return leaf
        split = node.split()
        return leaf | {"kids": (left, right), "split": (int(split.featureIndex()), float(split.threshold()))}

    nodes: list[Node] = []

    def number(item) -> int:
        at = len(nodes)
        nodes.append(None)  # type: ignore[arg-type]
        value = item["g"] / (item["h"] + params.reg_lambda)
        if "kids" not in item:
            nodes[at] = Node(None, 0.0, True, -1, -1, value, item["h"])
        else:
            feature, missing_left = origin[item["split"][0]]
            left, right = number(item["kids"][0]), number(item["kids"][1])
            nodes[at] = Node(feature, item["split"][1], missing_left, left, right, value, item["h"])
        return at

    number(grow(model._call_java("rootNode")))
    return nodes


@dataclass
class Encoded:
    """A training table ready for any number of fits: __id, __y, __x and the raw features."""

    table: DataFrame
    features: list[str]
    levels: list[str]
    origin: list[tuple[str, bool]]


def encode(df: DataFrame, features: Sequence[str], label: str, levels: Sequence[str], row_id: str = "rowIndex") -> Encoded:
    """Order the classes, route missing values, assemble vectors, write once."""
    levels_sql = ", ".join("'" + v.replace("'", "\\'") + "'" for v in levels)
    data = df.selectExpr(
        f"{quoted(row_id)} AS __id",
        f"array_position(array({levels_sql}), {quoted(label)}) - 1 AS __y",
        *[f"CAST({quoted(f)} AS DOUBLE) AS {quoted(f)}" for f in features],
    ).where("__y >= 0")
    routed, names, origin = route_missing(data, features, nullable_features(data, features), keep=data.columns)
    table = VectorAssembler(inputCols=names, outputCol="__x").transform(routed).drop(*names)
    return Encoded(settle_for_passes(table), list(features), list(levels), origin)


def fit_dart(df: DataFrame, features: Sequence[str], label: str, levels: Sequence[str], params: BoostParams, row_id: str = "rowIndex") -> Ensemble:
    """Fit boosted trees with dropout on a labelled table; other labels drop out."""
    return fit_encoded(encode(df, features, label, levels, row_id), params)


def fit_encoded(encoded: Encoded, params: BoostParams, rows: DataFrame | None = None) -> Ensemble:
    """Fit on an encoded table, or on those of its rows that ``rows`` (__id) names.

    Every tree's output is kept per row, so dropping trees costs a weighted sum
    instead of rescoring, and the table is rewritten every few rounds to keep
    the plan short.
    """
    features, origin = encoded.features, encoded.origin
    ensemble = Ensemble(list(features), list(encoded.levels))
    outputs = ensemble.outputs
    rng = random.Random(params.seed)
    state = encoded.table
    if rows is not None:
        state = settle(state.join(rows.select("__id"), "__id", "left_semi"))
    state = state.withColumn("__out", F.array().cast("array<double>"))

    for round_number in range(params.rounds):
        dropped = []
        if ensemble.trees and rng.random() >= params.skip_drop:
            dropped = [i for i in range(len(ensemble.trees)) if rng.random() < params.rate_drop]
        if params.colsample < 1.0:
            chosen = sorted(rng.sample(list(features), max(1, round(params.colsample * len(features)))))
            kept = [i for i, (f, _) in enumerate(origin) if f in set(chosen)]
        else:
            kept = list(range(len(origin)))

        def margin(klass: int) -> Column:
            terms = [F.lit(t.weight if t.klass == klass and i not in dropped else 0.0) for i, t in enumerate(ensemble.trees)]
            if not terms:
                return F.lit(0.0)
            return F.aggregate(F.zip_with("__out", F.array(*terms), lambda o, w: o * w), F.lit(0.0), lambda s, v: s + v)

        work = state
        if params.subsample < 1.0:
            draw = F.pmod(F.xxhash64(F.col("__id"), F.lit(round_number), F.lit(params.seed)), F.lit(1_000_000))
            work = work.where(draw < int(params.subsample * 1_000_000))
        if outputs == 1:
            p = 1 / (1 + F.exp(-margin(0)))
            steps = [(p - F.when(F.col("__y") == 0, 1.0).otherwise(0.0), p * (1 - p))]
        else:
            work = work.withColumn("__m", F.array(*[margin(k) for k in range(outputs)]))
            top = F.array_max("__m")
            total = F.aggregate("__m", F.lit(0.0), lambda s, m: s + F.exp(m - top))
            steps = []
            for k in range(outputs):
                p = F.exp(F.col("__m")[k] - top) / total
                steps.append((p - F.when(F.col("__y") == k, 1.0).otherwise(0.0), 2 * p * (1 - p)))

        grown = []
        for klass, (g, h) in enumerate(steps):
            weight = F.greatest(h, F.lit(1e-16))
            target = work.select("__x", (-g / weight).alias("__t"), weight.alias("__w"))
            inputs = "__x"
            if len(kept) < len(origin):
                target = VectorSlicer(inputCol="__x", outputCol="__s", indices=kept).transform(target)
                inputs = "__s"
            tree = DecisionTreeRegressor(
                featuresCol=inputs, labelCol="__t", weightCol="__w", maxDepth=params.max_depth, maxBins=params.max_bins, minInfoGain=0.0, seed=params.seed + round_number
            ).fit(target)
            grown.append(Tree(_read_tree(tree, [origin[i] for i in kept], params), klass))

        # Weights after dropout: the new trees share the place of the dropped ones.
        k = len(dropped) / outputs
        for i in dropped:
            ensemble.trees[i].weight *= k / (k + params.learning_rate)
        for tree in grown:
            tree.weight = params.learning_rate / (k + params.learning_rate) if dropped else params.learning_rate
            ensemble.trees.append(tree)
        state = state.withColumn("__out", F.concat("__out", F.array(*[F.expr(t.sql()) for t in grown])))
        if (round_number + 1) % _SETTLE_EVERY == 0 and round_number + 1 < params.rounds:
            state = settle(state)
    return ensemble


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, levels: Sequence[str], params: BoostParams):
    """MLlib gradient-boosted trees as a fast two-class baseline.

    Returns a scoring function with the columns of :meth:`Ensemble.score`.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    if len(levels) != 2:
        raise ValueError("the baseline handles two classes")
    nullable = nullable_features(df, features)

    def assembled(frame: DataFrame) -> DataFrame:
        routed, names, _ = route_missing(frame, features, nullable, keep=frame.columns)
        return VectorAssembler(inputCols=names, outputCol="__x").transform(routed).drop(*names)

    train = assembled(df.where(col(label).isin(list(levels)))).select("__x", F.when(col(label) == levels[0], 1.0).otherwise(0.0).alias("__y"))
    model = GBTClassifier(
        featuresCol="__x", labelCol="__y", maxIter=params.rounds, maxDepth=params.max_depth, stepSize=params.learning_rate, maxBins=params.max_bins, seed=params.seed
    ).fit(train)
    model.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c")

    def score(frame: DataFrame) -> DataFrame:
        p = vector_to_array("__p")
        scored = model.transform(assembled(frame))
        scored = scored.withColumns({"margin": F.array(F.log(p[1] / p[0])), "probability": F.array(p[1], p[0])})
        return scored.withColumn("PredictedLabel", F.when(p[1] >= 0.5, levels[0]).otherwise(levels[1])).drop("__x", "__p", "__r", "__c")

    return score


# ---- hyper-parameters -------------------------------------------------------------------------


def random_candidates(n: int = 100, seed: int = 1, base: BoostParams = BoostParams(), max_rounds: int = 1000) -> list[BoostParams]:
    """Seeded random candidates over our own documented ranges."""
    rng = random.Random(seed)
    return [
        replace(
            base,
            rounds=rng.randint(1, max_rounds),
            max_depth=rng.randint(1, 10),
            learning_rate=rng.uniform(0.001, 0.6),
            gamma=rng.uniform(0.0, 10.0),
            min_child_weight=float(rng.randint(0, 20)),
            subsample=rng.uniform(0.25, 1.0),
            colsample=rng.uniform(0.3, 0.7),
            rate_drop=rng.uniform(0.01, 0.5),
            skip_drop=rng.uniform(0.05, 0.95),
        )
        for _ in range(n)
    ]


def candidate_row(number: int, params: BoostParams) -> dict:
    return {"Candidate": number, **asdict(params)}
