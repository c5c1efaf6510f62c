"""Exact tree SHAP: what each feature adds to each row's margin.

Path-dependent attributions: an absent feature follows both branches in
proportion to their cover.  A feature on a leaf's path is a factor
``share (1 - t) + held t``, where ``share`` is the product of its cover shares
there and ``held`` says whether the row meets all its conditions; its Shapley
value is (held - share) times the integral over t from 0 to 1 of the other
factors' product.  That product is a polynomial, so a few Gauss-Legendre points
integrate it exactly, and at a point a factor joins or leaves it by one
multiplication or division.  Products are therefore extended once per edge on
the way down, shared by all leaves below, and leaves are summed once per edge on
the way up.  Blocks of trees and slices of rows go through numpy together; Spark
partitions the rows and turns the result long.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators.boosting import Ensemble, Tree

# The batch functions travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes of a block of trees (a larger tree is a block of its own), and bytes of products a task holds for it.
_BLOCK_NODES = 4096
_BLOCK_BYTES = 8 << 20


@dataclass
class TreeBlock:
    """The edges of some trees, level by level, siblings side by side.

    Entry 0 is the root of them all.  ``share`` is the product of the cover shares of the edge's feature from the
    root down to the edge, ``before`` the nearest edge above with the same feature, or 0.
    """

    parent: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    missing_left: np.ndarray
    share: np.ndarray
    before: np.ndarray
    value: np.ndarray
    levels: list[tuple[int, int]]
    distinct: int

    def __len__(self) -> int:
        return len(self.parent)


def tree_block(trees: Sequence[Tree], position: dict[str, int]) -> TreeBlock:
    edges: list[list] = [[0, 0, 0.0, True, True, 1.0, 0, 0.0]]
    levels, distinct = [], 1
    frontier: list[tuple[Tree, int, int, dict]] = [(tree, 0, 0, {}) for tree in trees]
    while frontier:
        first, below = len(edges), []
        for tree, i, place, above in frontier:
            n = tree.nodes[i]
            distinct = max(distinct, len(above))
            if n.feature is None:
                edges[place][-1] += n.value * tree.weight
                continue
            before = above.get(n.feature, 0)
            for child, left in ((n.left, True), (n.right, False)):
                share = tree.nodes[child].cover / n.cover if n.cover > 0 else 0.0
                below.append((tree, child, len(edges), above | {n.feature: len(edges)}))
                edges.append([place, position[n.feature], n.threshold, left, n.missing_left, share * edges[before][5], before, 0.0])
        if len(edges) > first:
            levels.append((first, len(edges)))
        frontier = below
    return TreeBlock(*[np.array(column) for column in zip(*edges)], levels, distinct)


def tree_blocks(trees: Sequence[Tree], position: dict[str, int]) -> list[TreeBlock]:
    blocks: list[list[Tree]] = []
    nodes = _BLOCK_NODES
    for tree in trees:
        if nodes + len(tree.nodes) > _BLOCK_NODES:
            blocks.append([])
            nodes = 0
        blocks[-1].append(tree)
        nodes += len(tree.nodes)
    return [tree_block(b, position) for b in blocks]


def expected_margin(ensemble: Ensemble, klass: int) -> float:
    """Margin of a row about which nothing is known."""

    def mean(tree: Tree, i: int = 0) -> float:
        n = tree.nodes[i]
        if n.feature is None:
            return n.value * tree.weight
        return sum(tree.nodes[c].cover / n.cover * mean(tree, c) for c in (n.left, n.right)) if n.cover > 0 else 0.0

    return sum(mean(t) for t in ensemble.trees if t.klass == klass)


def _without(product: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The product less one of its factors; where that is 0, no cover and no row gets there, and nothing counts."""
    return np.divide(product, factor, out=np.zeros_like(product), where=factor != 0)


def slice_contributions(block: TreeBlock, x: np.ndarray) -> np.ndarray:
    """Contributions of a block's trees for some rows: features x rows, as ``x``."""
    points, weights = np.polynomial.legendre.leggauss((block.distinct + 1) // 2)
    t, weights = (points + 1) / 2, weights / 2
    rows = x.shape[1]
    held = np.ones((len(block), rows), dtype=bool)
    product = np.ones((len(block), rows, len(t)))

    def factor(places) -> np.ndarray:
        return block.share[places, None, None] * (1 - t) + held[places][..., None] * t

    for first, end in block.levels:
        here, before = slice(first, end), block.before[first:end]
        values = x[block.feature[here]]
        goes_left = np.where(np.isnan(values), block.missing_left[here, None], values <= block.threshold[here, None])
        held[here] = (goes_left == block.left[here, None]) & held[before]
        product[here] = _without(product[block.parent[here]], factor(before)) * factor(here)
    product *= block.value[:, None, None]
    for first, end in reversed(block.levels[1:]):
        product[block.parent[first:end:2]] += product[first:end:2] + product[first + 1 : end : 2]
    phi = np.zeros_like(x)
    for first, end in block.levels:
        here, before = slice(first, end), block.before[first:end]
        gain = (held[here] - block.share[here, None]) * (_without(product[here], factor(here)) @ weights)
        # What lies below no longer carries the factor of the edge above with this feature.
        gain -= (held[before] - block.share[before, None]) * (_without(product[here], factor(before)) @ weights)
        order = np.argsort(block.feature[here], kind="stable")
        features, starts = np.unique(block.feature[here][order], return_index=True)
        phi[features] += np.add.reduceat(gain[order], starts, axis=0)
    return phi


def batch_contributions(blocks: Sequence[TreeBlock], x: np.ndarray) -> np.ndarray:
    """Contributions of all trees for one batch, features x rows; a task holds one block's slice of rows at a time."""
    phi = np.zeros_like(x)
    for block in blocks:
        step = max(1, _BLOCK_BYTES // (8 * len(block) * ((block.distinct + 1) // 2)))
        for at in range(0, x.shape[1], step):
            phi[:, at : at + step] += slice_contributions(block, x[:, at : at + step])
    return phi


def shap_contributions(df: DataFrame, ensemble: Ensemble, row_id: str = "rowIndex", keep_bias: bool = False) -> DataFrame:
    """Long contribution table: RowID, Label, Feature, SHAP.

    Row ids are those of the input, so every class of a row shares its id.  In a
    two-class model the margin, and so the Label, belongs to the first level.
    """
    ensemble._require(df)
    used = sorted({n.feature for t in ensemble.trees for n in t.nodes if n.feature is not None})
    position = {f: i for i, f in enumerate(used)}
    per_class = [tree_blocks([t for t in ensemble.trees if t.klass == k], position) for k in range(ensemble.outputs)]
    labels = ensemble.levels[: ensemble.outputs]
    # The edges grow with trees and leaves, so they travel once per executor, not with every task.
    shared = df.sparkSession.sparkContext.broadcast(per_class)
    id_type = df.select(col(row_id)).schema[0].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([batch[f].to_numpy(dtype=float, na_value=np.nan) for f in used]).reshape(len(used), len(batch))
            for label, blocks in zip(labels, shared.value):
                phi = batch_contributions(blocks, x)
                yield pd.DataFrame({"RowID": batch["RowID"], "Label": label, "phi": list(phi.T)})

    narrow = df.select(col(row_id).alias("RowID"), *[col(f).cast("double").alias(f) for f in used])
    wide = narrow.mapInPandas(explain, f"RowID {id_type}, Label string, phi array<double>")

    # Features no tree uses contribute an exact 0 and still get their rows.
    entry = lambda name, value: F.struct(F.lit(name).alias("Feature"), value.alias("SHAP"))
    cells = [entry(f, F.col("phi")[position[f]] if f in position else F.lit(0.0)) for f in ensemble.features]
    if keep_bias:
        bias = F.lit(None).cast("double")
        for k, label in enumerate(labels):
            bias = F.when(F.col("Label") == label, F.lit(expected_margin(ensemble, k))).otherwise(bias)
        cells.append(entry("BIAS", bias))
    return wide.select("RowID", "Label", F.inline(F.array(*cells)))


def additivity(df: DataFrame, ensemble: Ensemble, row_id: str = "rowIndex") -> DataFrame:
    """Per row and label: the summed contributions next to the margin they must equal."""
    sums = shap_contributions(df, ensemble, row_id, keep_bias=True).groupBy("RowID", "Label").agg(F.sum("SHAP").alias("Total"))
    labels = F.array(*[F.lit(v) for v in ensemble.levels[: ensemble.outputs]])
    scored = ensemble.score(df).select(col(row_id).alias("RowID"), F.explode(F.arrays_zip(labels.alias("Label"), F.col("margin").alias("Margin"))).alias("m"))
    margins = scored.select("RowID", F.col("m.Label").alias("Label"), F.col("m.Margin").alias("Margin"))
    return margins.join(sums, ["RowID", "Label"], "left").withColumn("Gap", F.abs(F.col("Margin") - F.col("Total")))
