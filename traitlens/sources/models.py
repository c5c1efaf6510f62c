"""Models by address, and the ledger of a search's resamples.

Both write what belongs together into a folder of its own and a small commit row last;
readers go by the commit rows, so a job that died leaves nothing that is read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.operators.boosting import BoostParams, Ensemble
from traitlens.operators.histograms import Binned, Fit, _Grown


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


class ModelStore:
    """Models under ``root``, addressed by kind, run and host; each version holds model, training rows and settings."""

    _COMMIT = "version string, at long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _address(self, kind: str, run: str, host: str) -> str:
        for part in (kind, run, host):
            if not part or "/" in part or part.startswith("."):
                raise ValueError(f"not part of an address: {part!r}")
        return f"{self.root}/kind={kind}/run={run}/host={host}"

    def save(self, kind: str, run: str, host: str, model: Ensemble, rows: DataFrame, settings: dict) -> str:
        """Write a new version; it is visible once its commit row is written."""
        address, version = self._address(kind, run, host), uuid.uuid4().hex
        folder = f"{address}/versions/{version}"
        rows.write.parquet(f"{folder}/data")
        model.save(self.spark, f"{folder}/model")
        self.spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").coalesce(1).write.parquet(f"{folder}/settings")
        self.spark.createDataFrame([(version, time.time_ns())], self._COMMIT).coalesce(1).write.mode("append").parquet(f"{address}/commits")
        return version

    def versions(self, kind: str, run: str, host: str) -> list[str]:
        """Committed versions, oldest first."""
        commits = _read(self.spark, f"{self._address(kind, run, host)}/commits", self._COMMIT)
        return [] if commits is None else [r.version for r in commits.orderBy("at").collect()]

    def _folder(self, kind: str, run: str, host: str, version: str | None) -> str:
        known = self.versions(kind, run, host)
        if not known or (version is not None and version not in known):
            raise LookupError(f"no such model: {kind}, {run}, {host}, {version or 'any version'}")
        return f"{self._address(kind, run, host)}/versions/{version or known[-1]}"

    def model(self, kind: str, run: str, host: str, version: str | None = None) -> Ensemble:
        return Ensemble.load(self.spark, f"{self._folder(kind, run, host, version)}/model")

    def rows(self, kind: str, run: str, host: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(kind, run, host, version)}/data")

    def settings(self, kind: str, run: str, host: str, version: str | None = None) -> dict:
        return json.loads(self.spark.read.parquet(f"{self._folder(kind, run, host, version)}/settings").first().settings)


_TREES = "tree int, klass int, weight double, node int, feature int, cut int, missing_left boolean, left int, right int, value double, cover double"


class ResampleLedger:
    """What a search has finished: one committed row per (candidate, resample), its trees, and the binned rows all of them use."""

    _HEAD = "rows string, features array<string>, levels array<string>, cuts array<array<double>>"
    _DONE = "settings string, resample int, loss double, n long, batch string"

    def __init__(self, spark: SparkSession, root: str, task: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/task={task}"

    def binned(self, build: Callable[[], Binned]) -> Binned:
        """The task's binned rows; built and kept at the first call, read again at every later one."""
        head = _read(self.spark, f"{self.root}/head", self._HEAD)
        found = None if head is None else head.first()
        if found is None:
            made, path = build(), f"{self.root}/rows-{uuid.uuid4().hex}"
            made.table.write.parquet(path)
            self.spark.createDataFrame([(path, made.features, made.levels, made.cuts)], self._HEAD).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/head")
            return Binned(self.spark.read.parquet(path), made.features, made.levels, made.cuts)
        return Binned(self.spark.read.parquet(found.rows), list(found.features), list(found.levels), [list(c) for c in found.cuts])

    @staticmethod
    def key(params: BoostParams) -> str:
        return json.dumps(asdict(params), sort_keys=True)

    def done(self) -> DataFrame:
        """Committed rows."""
        found = _read(self.spark, f"{self.root}/done", self._DONE)
        return self.spark.createDataFrame([], self._DONE) if found is None else found

    def finished(self) -> set[tuple[str, int]]:
        return {(r.settings, r.resample) for r in self.done().select("settings", "resample").collect()}  # one per fit

    def commit(self, fits: Sequence[Fit], losses: dict[int, tuple[float, int]]) -> None:
        """Keep a group's trees, then say that its fits are finished."""
        batch = uuid.uuid4().hex
        trees = [
            (self.key(f.params), f.resample, i, t.klass, t.weight, n, t.feature[n], t.cut[n], bool(t.missing_left[n]), t.left[n], t.right[n], float(t.value[n]), float(t.cover[n]))
            for f in fits for i, t in enumerate(f.trees) for n in range(len(t.feature))
        ]
        self.spark.createDataFrame(trees, f"settings string, resample int, {_TREES}").write.parquet(f"{self.root}/trees/batch={batch}")
        rows = [(self.key(f.params), f.resample, *losses.get(k, (0.0, 0)), batch) for k, f in enumerate(fits)]
        self.spark.createDataFrame(rows, self._DONE).coalesce(1).write.mode("append").parquet(f"{self.root}/done")

    def fits(self, params: BoostParams) -> list[Fit]:
        """The finished fits of one candidate, by resample; sizes follow its settings, not the rows."""
        key = self.key(params)
        batches = sorted({r.batch for r in self.done().where(F.col("settings") == key).select("batch").collect()})
        if not batches:
            return []
        paths = [f"{self.root}/trees/batch={b}" for b in batches]
        rows = self.spark.read.schema(f"settings string, resample int, {_TREES}").parquet(*paths).where(F.col("settings") == key).collect()
        by_fit: dict[int, dict[int, _Grown]] = {}
        for r in sorted(rows, key=lambda r: (r.resample, r.tree, r.node)):
            tree = by_fit.setdefault(r.resample, {}).get(r.tree)
            if tree is None:
                tree = by_fit[r.resample][r.tree] = _Grown(r.klass, r.weight, feature=[], cut=[], missing_left=[], left=[], right=[], value=[], cover=[], open=[])
            for name in ("feature", "cut", "missing_left", "left", "right", "value", "cover"):
                getattr(tree, name).append(r[name])
        return [Fit(params, resample, [trees[i] for i in sorted(trees)], params.rounds) for resample, trees in sorted(by_fit.items())]
