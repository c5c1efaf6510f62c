"""Boosted trees with dropout, grown from gradient histograms: many fits in one aggregation.

Feature values become bin numbers once, missing values a bin of their own.  A level of
all open trees of all fits is one pass: tasks add up gradients and hessians by (fit,
node, feature, bin), Spark sums those tables, and a window over the bins gives every
split's second-order gain, with missing values tried on both sides.  The driver sees
one row per open node.  So the number of jobs follows rounds and depth, not candidates,
folds or repeats, and a task's table does not grow with its rows.

Which resamples a row trains and which it is held out of are bits of the row.  Margins
are kept with the rows and rewritten every few rounds; in between, and for dropped
trees, a task walks only the trees whose weight has changed since.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitlens.functions.names import col, quoted
from traitlens.operators.boosting import BoostParams, Ensemble, Node, Tree
from traitlens.operators.sketches import quantile_table
from traitlens.session import let_workers_import
from traitlens.sources.store import settle, settle_for_passes

#: Bytes of histograms that one task may hold for one group of fits.
HISTOGRAM_BYTES = 64 << 20
#: Trees per fit after which margins are written down.
_SETTLE_TREES = 16
_WIDE = 200
#: Rows packed into one block.
_BLOCK = 4096
_BLOCK_COLUMNS = "y binary, draw binary, bins binary, trains binary, held binary"
#: A cut beyond every value: known values left, missing ones right.
_BEYOND = 1e308
_CELL = "fit int, klass int, node int, feature int, bin int, lam double, gam double, least double, g double, h double"


# ---- binned rows ------------------------------------------------------------------------------


@dataclass
class Binned:
    """Rows ready for any number of fits, in blocks: each block's columns are packed one after another."""

    table: DataFrame
    features: list[str]
    levels: list[str]
    cuts: list[list[float]]

    @property
    def outputs(self) -> int:
        return 1 if len(self.levels) == 2 else len(self.levels)

    @property
    def bins(self) -> int:
        """Bins of the widest feature, the one of missing values included."""
        return max((len(c) for c in self.cuts), default=0) + 2


def _number(feature: str) -> Column:
    return F.expr(f"nullif(CAST({quoted(feature)} AS DOUBLE), DOUBLE('NaN'))")


def feature_cuts(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins but the last.

    Up to ``max_bins`` distinct values get a bin each, with edges half-way between them; other features
    are cut at quantiles of a mergeable sketch.  Sets of values are collected only where a first estimate says they are small.
    """
    found: list[list[float]] = []
    for at in range(0, len(features), _WIDE):
        some = features[at : at + _WIDE]
        narrow = df.select(*[_number(f).alias(f"f{i}") for i, f in enumerate(some)])
        sizes = narrow.agg(*[F.approx_count_distinct(f"f{i}", 0.05).alias(f"f{i}") for i in range(len(some))]).first()
        few = [i for i in range(len(some)) if sizes[i] <= 1.2 * max_bins]
        values = narrow.agg(*[F.collect_set(f"f{i}").alias(f"f{i}") for i in few]).first() if few else {}
        exact = {i: sorted(values[f"f{i}"]) for i in few if len(values[f"f{i}"]) <= max_bins}
        rest = [i for i in range(len(some)) if i not in exact]
        points = quantile_table(narrow, [f"f{i}" for i in rest], [k / max_bins for k in range(1, max_bins)]) if rest else {}
        for i in range(len(some)):
            found.append([(a + b) / 2 for a, b in zip(exact[i], exact[i][1:])] if i in exact else sorted(set(points[f"f{i}"])))
    return found


def bin_rows(
    df: DataFrame, features: Sequence[str], label: str, levels: Sequence[str], max_bins: int = 64, row_id: str = "rowIndex", trains: DataFrame | None = None, held: DataFrame | None = None, resamples: int = 1
) -> Binned:
    """Write the rows with a known label once, as bins and resample bits.

    ``trains`` and ``held`` are (row id, resamples): the numbers of the resamples that a row trains, and of
    those that hold it out, numbered from 0 to ``resamples`` - 1; without them every row trains resample 0.
    """
    let_workers_import(df.sparkSession)
    levels_sql = ", ".join("'" + v.replace("'", "\\'") + "'" for v in levels)
    data = df.select(col(row_id).alias("__id"), F.expr(f"array_position(array({levels_sql}), {quoted(label)}) - 1").cast("int").alias("__y"), *[_number(f).alias(f"__f{i}") for i, f in enumerate(features)])
    data = settle_for_passes(data.where("__y >= 0"))
    cuts = feature_cuts(data, [f"__f{i}" for i in range(len(features))], max_bins)
    for name, lists in (("__trains", trains), ("__held", held)):
        if lists is None:
            data = data.withColumn(name, F.array(F.lit(0)) if trains is None and name == "__trains" else F.array().cast("array<int>"))
        else:
            data = data.join(lists.select(col(row_id).alias("__id"), F.col("resamples").alias(name)), "__id", "left")
    shared = df.sparkSession.sparkContext.broadcast([np.asarray(c) for c in cuts])
    width = len(cuts)
    id_type = data.schema["__id"].dataType.simpleString()

    size = (resamples + 7) // 8

    def packed(lists: pd.Series) -> bytes:
        bits = np.zeros((len(lists), 8 * size), np.uint8)
        for row, one in zip(bits, lists):
            if one is not None and len(one):
                row[np.asarray(one)] = 1
        return np.packbits(bits, axis=1, bitorder="little").tobytes()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = shared.value
        for whole in batches:
            for at in range(0, len(whole), _BLOCK):
                batch = whole.iloc[at : at + _BLOCK]
                bins = np.zeros((len(batch), width), "<u2")
                for i, cut in enumerate(edges):
                    x = batch[f"__f{i}"].to_numpy(float, na_value=np.nan)
                    bins[:, i] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left") + 1)
                y, draw = batch["__y"].to_numpy("<i4").tobytes(), batch["__draw"].to_numpy("<i8").tobytes()
                yield pd.DataFrame([(batch["__id"].tolist(), y, draw, bins.tobytes(), packed(batch["__trains"]), packed(batch["__held"]))], columns=["ids", "y", "draw", "bins", "trains", "held"])

    rows = data.withColumn("__draw", F.xxhash64("__id")).mapInPandas(pack, f"ids array<{id_type}>, {_BLOCK_COLUMNS}")
    return Binned(settle(rows), list(features), list(levels), cuts)


# ---- fits on the driver -----------------------------------------------------------------------


@dataclass
class _Grown:
    """A tree over bin numbers; an open node has no value yet."""

    klass: int
    weight: float = 0.0
    settled: float = 0.0
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def leaf(self, value: float, cover: float) -> int:
        for name, entry in (("feature", -1), ("cut", 0), ("missing_left", True), ("left", 0), ("right", 0), ("value", value), ("cover", cover)):
            getattr(self, name).append(entry)
        return len(self.feature) - 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: np.asarray(getattr(self, n)) for n in ("feature", "cut", "missing_left", "left", "right", "value")}


@dataclass
class Fit:
    """One fit of a pass: its settings, the resample it trains, and its trees so far."""

    params: BoostParams
    resample: int = 0
    trees: list[_Grown] = field(default_factory=list)
    round: int = 0
    depth: int = 0
    dropped: list[int] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)
    growing: list[_Grown] = field(default_factory=list)
    rng: random.Random | None = None

    @property
    def done(self) -> bool:
        return self.round >= self.params.rounds

    def begin(self, outputs: int, features: int) -> None:
        """Draw the trees to drop and the features of the next round, and open its roots."""
        self.rng = self.rng or random.Random(self.params.seed)
        self.dropped = []
        if self.trees and self.rng.random() >= self.params.skip_drop:
            self.dropped = [i for i in range(len(self.trees)) if self.rng.random() < self.params.rate_drop]
        self.columns = list(range(features))
        if self.params.colsample < 1.0:
            self.columns = sorted(self.rng.sample(self.columns, max(1, round(self.params.colsample * features))))
        self.growing, self.depth = [_Grown(k) for k in range(outputs)], 0

    def grow(self, splits: dict[tuple[int, int], object], outputs: int) -> None:
        """Close or split the open nodes of this level; end the round when none is open."""
        self.depth += 1
        for tree in self.growing:
            opened = []
            for node in tree.open:
                s = splits.get((tree.klass, node))
                if s is None:
                    continue
                value = lambda g, h: -g / (h + self.params.reg_lambda) if h > 0 else 0.0
                tree.value[node], tree.cover[node] = value(s.g, s.h), s.h
                if s.gain > 0:
                    tree.feature[node], tree.cut[node], tree.missing_left[node] = s.feature, s.cut, s.missing_left
                    tree.left[node] = tree.leaf(value(s.gl, s.hl), s.hl)
                    tree.right[node] = tree.leaf(value(s.g - s.gl, s.h - s.hl), s.h - s.hl)
                    opened += [tree.left[node], tree.right[node]]
            tree.open = opened if self.depth < self.params.max_depth else []
        if any(tree.open for tree in self.growing):
            return
        k, rate = len(self.dropped) / outputs, self.params.learning_rate
        for i in self.dropped:
            self.trees[i].weight *= k / (k + rate)
        for tree in self.growing:
            tree.weight = rate / (k + rate) if self.dropped else rate
        self.trees += self.growing
        self.growing = []
        self.round += 1

    def ensemble(self, binned: Binned) -> Ensemble:
        """The finished model over raw feature values."""

        def node(t: _Grown, i: int) -> Node:
            f = t.feature[i]
            if f < 0:
                return Node(None, 0.0, True, -1, -1, t.value[i], t.cover[i])
            cuts = binned.cuts[f]
            return Node(binned.features[f], cuts[t.cut[i] - 1] if t.cut[i] <= len(cuts) else _BEYOND, bool(t.missing_left[i]), t.left[i], t.right[i], t.value[i], t.cover[i])

        trees = [Tree([node(t, i) for i in range(len(t.feature))], t.klass, t.weight) for t in self.trees]
        return Ensemble(list(binned.features), list(binned.levels), trees)


# ---- passes over the rows ---------------------------------------------------------------------


def _reached(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node of each row."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            return at
        x = bins[rows, np.maximum(f, 0)]
        goes_left = np.where(x == 0, tree["missing_left"][at], x <= tree["cut"][at])
        at = np.where(inner, np.where(goes_left, tree["left"][at], tree["right"][at]), at)


@dataclass
class _Task:
    """What tasks need of a fit: weights to add per tree, the trees being grown, and its draws."""

    number: int
    params: BoostParams
    resample: int
    round: int
    changed: list[tuple[int, float, dict[str, np.ndarray]]]
    growing: list[tuple[int, list[int], dict[str, np.ndarray]]]
    columns: np.ndarray


def _tasks(fits: Sequence[Fit], numbers: Sequence[int], final: bool = False) -> list[_Task]:
    out = []
    for number in numbers:
        fit = fits[number]
        dropped = set() if final or fit.done else set(fit.dropped)
        changed = [(t.klass, d, t.arrays()) for i, t in enumerate(fit.trees) if (d := (0.0 if i in dropped else t.weight) - t.settled) != 0.0]
        growing = [] if final else [(t.klass, t.open, t.arrays()) for t in fit.growing if t.open]
        out.append(_Task(number, fit.params, fit.resample, fit.round, changed, growing, np.asarray(fit.columns, np.int64)))
    return out


def _margins(task: _Task, bins: np.ndarray, settled: np.ndarray) -> np.ndarray:
    margins = settled.copy()
    for klass, delta, tree in task.changed:
        margins[:, klass] += delta * tree["value"][_reached(tree, bins)]
    return margins


def _probabilities(margins: np.ndarray) -> np.ndarray:
    """Rows x levels."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([p, 1 - p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _drawn(draw: np.ndarray, task: _Task) -> np.ndarray:
    """Which rows this round of the fit uses: a hash of the row, the round and the seed."""
    x = draw.view(np.uint64) ^ np.uint64((task.round * 0x9E3779B97F4A7C15 + task.params.seed * 0xBF58476D1CE4E5B9) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)) < np.uint64(int(task.params.subsample * (1 << 53)))


@dataclass(frozen=True)
class _Frames:
    """How to unpack blocks."""

    width: int
    outputs: int

    def __call__(self, batch: pd.DataFrame, fits: int) -> Iterator[dict[str, object]]:
        """Each block's classes, draws, bins, resample bits and settled margins per fit."""
        for k in range(len(batch)):
            y = np.frombuffer(batch["y"].iloc[k], "<i4")
            margins = np.frombuffer(batch["m"].iloc[k], "<f8").reshape(len(y), fits, self.outputs) if "m" in batch else np.zeros((len(y), fits, self.outputs))
            bits = {c: np.frombuffer(batch[c].iloc[k], np.uint8).reshape(len(y), -1) for c in ("trains", "held")}
            bins = np.frombuffer(batch["bins"].iloc[k], "<u2").reshape(len(y), self.width).astype(np.int32)
            yield {"row": k, "y": y, "draw": np.frombuffer(batch["draw"].iloc[k], "<i8"), "bins": bins, "margins": margins, **bits}


def _has(bits: np.ndarray, resample: int) -> np.ndarray:
    """Which rows have the resample's bit."""
    return (bits[:, resample // 8] >> (resample % 8) & 1).astype(bool)


@dataclass
class _State:
    """The rows with their margins of one group of fits."""

    table: DataFrame
    width: int
    outputs: int

    @property
    def frames(self) -> _Frames:
        return _Frames(self.width, self.outputs)


def _histograms(state: _State, tasks: list[_Task], fits: int, bins_of_all: int) -> DataFrame:
    """Sums of gradients and hessians by (fit, class, node, feature, bin), one small table per task."""
    shared = state.table.sparkSession.sparkContext.broadcast(tasks)
    frames, outputs, columns = state.frames, state.outputs, [c.split()[0] for c in _CELL.split(", ")]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for block in (b for batch in batches for b in frames(batch, fits)):
            for k, task in enumerate(shared.value):
                mine = _has(block["trains"], task.resample)
                if task.params.subsample < 1.0:
                    mine = mine & _drawn(block["draw"], task)
                if not mine.any():
                    continue
                x, observed = block["bins"][mine], block["y"][mine]
                p = _probabilities(_margins(task, x, block["margins"][mine, task.number]))
                for klass, open_nodes, tree in task.growing:
                    g = p[:, klass] - (observed == klass)
                    h = np.maximum((1 if outputs == 1 else 2) * p[:, klass] * (1 - p[:, klass]), 1e-16)
                    place = np.full(len(tree["feature"]), -1)
                    place[open_nodes] = np.arange(len(open_nodes))
                    node = place[_reached(tree, x)]
                    inside = node >= 0
                    width = len(task.columns)
                    cells = ((node[inside, None] * width + np.arange(width)) * bins_of_all + x[inside][:, task.columns]).ravel()
                    size = len(open_nodes) * width * bins_of_all
                    both = np.stack([np.bincount(cells, np.repeat(v[inside], width), size) for v in (g, h)])
                    sums[k, klass] = sums[k, klass] + both if (k, klass) in sums else both
        for (k, klass), (g, h) in sums.items():
            task = shared.value[k]
            open_nodes = next(o for c, o, _ in task.growing if c == klass)
            at = np.flatnonzero(h > 0)
            cell, bin_number = at // bins_of_all, at % bins_of_all
            node = np.asarray(open_nodes)[cell // len(task.columns)]
            feature = task.columns[cell % len(task.columns)]
            p = task.params
            yield pd.DataFrame(dict(zip(columns, (task.number, klass, node, feature, bin_number, p.reg_lambda, p.gamma, p.min_child_weight, g[at], h[at]))), columns=columns)

    return state.table.mapInPandas(add, _CELL)


def best_splits(cells: DataFrame) -> DataFrame:
    """Per (fit, klass, node) its sums and the split with the highest gain, as struct ``s``.

    gain = (GL² / (HL + lambda) + GR² / (HR + lambda) - G² / (H + lambda)) / 2 - gamma; both children weigh at
    least the child weight.  Equal gains: the smallest feature, then bin, then missing values left.
    """
    summed = cells.groupBy("fit", "klass", "node", "feature", "bin", "lam", "gam", "least").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy("fit", "klass", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.sum(F.when(F.col("bin") > 0, F.col(c)).otherwise(0.0))
    gone = lambda c: F.sum(F.when(F.col("bin") == 0, F.col(c)).otherwise(0.0)).over(whole)
    lines = summed.select(
        "fit", "klass", "node", "feature", "bin", "lam", "gam", "least", F.sum("g").over(whole).alias("ga"), F.sum("h").over(whole).alias("ha"),
        known("g").over(upto).alias("gk"), known("h").over(upto).alias("hk"), gone("g").alias("gm"), gone("h").alias("hm"),
    )
    sides = lines.withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    gl, hl = (F.col(k) + F.when(F.col("missing_left"), F.col(m)).otherwise(0.0) for k, m in (("gk", "gm"), ("hk", "hm")))
    sides = sides.withColumns({"gl": gl, "hl": hl})
    gr, hr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")
    part = lambda g, h: g * g / (h + F.col("lam"))
    gain = (part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("ga"), F.col("ha"))) / 2 - F.col("gam")
    # Sums of hessians over no rows can differ from 0 by rounding.
    fits = (F.col("bin") > 0) & (F.col("hl") >= F.col("least")) & (hr >= F.col("least")) & (F.least(F.col("hl"), hr) > 1e-9 * F.col("ha"))
    best = F.max(F.struct(F.round(F.when(fits, gain).otherwise(-1.0), 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "missing_left", "gl", "hl", F.col("ga").alias("g"), F.col("ha").alias("h")))
    return sides.groupBy("fit", "klass", "node").agg(best.alias("s"))


@dataclass(frozen=True)
class _Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    gl: float
    hl: float
    g: float
    h: float


def _settled(state: _State, fits: Sequence[Fit]) -> _State:
    """The rows with all margins of now; every fit's weights count as settled."""
    shared = state.table.sparkSession.sparkContext.broadcast(_tasks(fits, range(len(fits)), final=True))
    frames, names = state.frames, ["ids", "y", "draw", "bins", "trains", "held", "m"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            now = [np.stack([_margins(t, b["bins"], b["margins"][:, t.number]) for t in shared.value], axis=1) for b in frames(batch, len(shared.value))]
            yield batch.assign(m=[m.astype("<f8").tobytes() for m in now])[names]

    id_type = state.table.schema["ids"].dataType.simpleString()
    rows = state.table.mapInPandas(write, f"ids {id_type}, {_BLOCK_COLUMNS}, m binary")
    for fit in fits:
        for tree in fit.trees:
            tree.settled = tree.weight
    return _State(settle(rows), state.width, state.outputs)


def groups_of_fits(binned: Binned, fits: Sequence[Fit], most_bytes: int = HISTOGRAM_BYTES) -> list[list[int]]:
    """Numbers of the fits that share passes: as many as a task's histograms allow."""
    groups: list[list[int]] = []
    held = 0
    for number, fit in enumerate(fits):
        size = 16 * binned.outputs * 2 ** max(0, fit.params.max_depth - 1) * len(binned.features) * binned.bins
        if not groups or held + size > most_bytes:
            groups.append([])
            held = 0
        groups[-1].append(number)
        held += size
    return groups


def grow_all(binned: Binned, fits: Sequence[Fit], settle_trees: int = _SETTLE_TREES) -> _State:
    """Grow all trees of all fits; each pass takes every unfinished fit one level on."""
    state = _State(binned.table, len(binned.features), binned.outputs)
    while True:
        open_fits = [n for n, f in enumerate(fits) if not f.done]
        if not open_fits:
            return state
        for n in open_fits:
            if not fits[n].growing:
                fits[n].begin(binned.outputs, len(binned.features))
        if max(sum(t.settled != t.weight for t in fits[n].trees) for n in open_fits) >= settle_trees * binned.outputs:
            state = _settled(state, fits)
        rows = best_splits(_histograms(state, _tasks(fits, open_fits), len(fits), binned.bins)).collect()
        found: dict[int, dict[tuple[int, int], _Split]] = {}
        for r in rows:  # one row per open node
            s = r.s
            found.setdefault(r.fit, {})[r.klass, r.node] = _Split(s.gain, -s.f, -s.b, s.missing_left, s.gl, s.hl, s.g, s.h)
        for n in open_fits:
            fits[n].grow(found.get(n, {}), binned.outputs)


def held_out_losses(state: _State, fits: Sequence[Fit], least: float = 1e-15) -> DataFrame:
    """(fit, loss, n): sums of -log p of the observed level over the rows that each fit's resample holds out."""
    shared = state.table.sparkSession.sparkContext.broadcast(_tasks(fits, range(len(fits)), final=True))
    frames = state.frames

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tasks = shared.value
        loss, n = np.zeros(len(tasks)), np.zeros(len(tasks), np.int64)
        for block in (b for batch in batches for b in frames(batch, len(tasks))):
            for k, task in enumerate(tasks):
                mine = _has(block["held"], task.resample)
                p = _probabilities(_margins(task, block["bins"][mine], block["margins"][mine, k]))[np.arange(mine.sum()), block["y"][mine]]
                loss[k] -= np.log(np.clip(p, least, 1 - least)).sum()
                n[k] += len(p)
        yield pd.DataFrame({"fit": [t.number for t in tasks], "loss": loss, "n": n})

    return state.table.mapInPandas(judge, "fit int, loss double, n long").groupBy("fit").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def held_out_rows(binned: Binned, fits: Sequence[Fit], row_id: str = "rowIndex") -> DataFrame:
    """(row id, obs, part, p_observed, pred), part the resample: every row scored by the fits that hold it out, in one pass."""
    state = _State(binned.table, len(binned.features), binned.outputs)
    tasks = _tasks(fits, range(len(fits)), final=True)
    for task, fit in zip(tasks, fits):
        task.changed = [(t.klass, t.weight, t.arrays()) for t in fit.trees]
    shared = binned.table.sparkSession.sparkContext.broadcast(tasks)
    frames, outputs = state.frames, binned.outputs
    id_type = binned.table.schema["ids"].dataType.elementType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in frames(batch, len(shared.value)):
                ids, y = np.asarray(batch["ids"].iloc[block["row"]]), block["y"]
                for task in shared.value:
                    mine = np.flatnonzero(_has(block["held"], task.resample))
                    if len(mine):
                        p = _probabilities(_margins(task, block["bins"][mine], np.zeros((len(mine), outputs))))
                        yield pd.DataFrame({"id": ids[mine], "y": y[mine], "part": task.resample, "p": p[np.arange(len(mine)), y[mine]], "k": p.argmax(axis=1)})

    levels = F.array(*[F.lit(v) for v in binned.levels])
    scored = binned.table.mapInPandas(score, f"id {id_type}, y int, part int, p double, k long")
    return scored.select(F.col("id").alias(row_id), F.get(levels, F.col("y")).alias("obs"), "part", F.col("p").alias("p_observed"), F.get(levels, F.col("k").cast("int")).alias("pred"))


def fit_histogram(df: DataFrame, features: Sequence[str], label: str, levels: Sequence[str], params: BoostParams, row_id: str = "rowIndex") -> Ensemble:
    """One model over all rows with a known label."""
    binned = bin_rows(df, features, label, levels, params.max_bins, row_id)
    fits = [Fit(params)]
    grow_all(binned, fits)
    return fits[0].ensemble(binned)
