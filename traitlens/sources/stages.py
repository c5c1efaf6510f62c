"""Stages of a job: named tables that are made once per state of their inputs and settings.

A stage's fingerprint is a hash of its name, its settings, the files it reads and the
stages before it.  While a committed result with that fingerprint exists, the stage is
read and not made again.  Tables are written into a folder of their own, checked, and
only then named by a commit row, so a job that died or failed a check leaves nothing
that a later run would read.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitlens.operators.merging import require_unique


@dataclass(frozen=True)
class Checked:
    """A table and what must hold for it.

    ``never`` names conditions no row may meet and ``rows`` is the number of rows wanted:
    both are counted while the table is written.  ``unique`` names key columns; they alone
    are read back from the written files.
    """

    df: DataFrame
    never: Mapping[str, Column] = field(default_factory=dict)
    rows: int | None = None
    unique: Sequence[str] = ()
    partition_by: Sequence[str] = ()


@dataclass(frozen=True)
class Stage:
    """A committed stage: its tables, notes (small settings found out while it ran), and whether this run made it."""

    name: str
    fingerprint: str
    tables: dict[str, DataFrame]
    rows: dict[str, int]
    notes: dict
    made: bool

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]


def write_checked(spark: SparkSession, table: Checked, path: str) -> int:
    """Write the table in one pass that also counts its rows and the rows that break a condition; fail when a check does.

    The counts sit right under the write, in its own tasks, where a task that runs again counts once.
    """
    seen = Observation()
    broken = {name: F.coalesce(condition, F.lit(False)) for name, condition in table.never.items()}
    counts = [F.count_if(condition).alias(name) for name, condition in broken.items()]
    watched = table.df.observe(seen, F.count(F.lit(1)).alias("__rows"), *counts)
    watched.write.mode("errorifexists").partitionBy(*table.partition_by).parquet(path)
    found = seen.get
    bad = {name: found[name] for name in table.never if found.get(name)}
    if bad:
        raise ValueError(f"rows that must not be: {bad}")
    rows = found.get("__rows", 0)
    if table.rows is not None and rows != table.rows:
        raise ValueError(f"expected {table.rows} rows, found {rows}")
    if table.unique:
        require_unique(spark.read.parquet(path), table.unique)
    return rows


def files_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of names, sizes and times of all files under the paths; their contents are not read."""
    if not paths:
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    each = F.xxhash64("path", "length", F.col("modificationTime").cast("timestamp"))
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(each).alias("mixed"), F.sum(F.pmod(each, F.lit(2**40))).alias("added")).first()
    return f"{total.n}-{total.size}-{total.mixed}-{total.added}"


class Stages:
    """Stage results under ``root``."""

    _COMMIT = "fingerprint string, folder string, rows map<string,bigint>, schemas map<string,string>, notes string, at bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def fingerprint(self, name: str, files: Sequence[str] = (), after: Sequence[Stage] = (), settings: Mapping | None = None) -> str:
        parts = [name, files_fingerprint(self.spark, files), sorted(files), [s.fingerprint for s in after], settings or {}]
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()

    def scratch(self, fingerprint: str) -> str:
        """A folder for what a stage keeps while it runs, found again by a run with the same inputs."""
        return f"{self.root}/scratch/{fingerprint}"

    def _commits(self, name: str) -> str:
        return f"{self.root}/stage={name}/commits"

    def _committed(self, name: str, fingerprint: str):
        path = self._commits(name)
        self.spark.createDataFrame([], self._COMMIT).write.mode("ignore").parquet(path)
        commits = self.spark.read.schema(self._COMMIT).parquet(path)
        return commits.where(F.col("fingerprint") == fingerprint).orderBy(F.desc("at")).first()

    def _stage(self, name: str, row, made: bool) -> Stage:
        read = lambda table, schema: self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{row.folder}/{table}")
        tables = {table: read(table, schema) for table, schema in row.schemas.items()}
        return Stage(name, row.fingerprint, tables, dict(row.rows), json.loads(row.notes), made)

    def run(
        self, name: str, build: Callable[[str], tuple[Mapping[str, Checked | DataFrame], dict]], *,
        files: Sequence[str] = (), after: Sequence[Stage] = (), settings: Mapping | None = None,
    ) -> Stage:
        """The stage's committed result, made by ``build`` when there is none.

        ``build`` gets the stage's scratch folder and returns tables and notes.
        """
        fingerprint = self.fingerprint(name, files, after, settings)
        known = self._committed(name, fingerprint)
        if known is not None:
            return self._stage(name, known, made=False)
        tables, notes = build(self.scratch(fingerprint))
        folder = f"{self.root}/stage={name}/results/{uuid.uuid4().hex}"
        rows, schemas = {}, {}
        for table, wanted in tables.items():
            wanted = wanted if isinstance(wanted, Checked) else Checked(wanted)
            rows[table] = write_checked(self.spark, wanted, f"{folder}/{table}")
            schemas[table] = wanted.df.schema.json()
        commit = (fingerprint, folder, rows, schemas, json.dumps(notes, sort_keys=True), time.time_ns())
        self.spark.createDataFrame([commit], self._COMMIT).coalesce(1).write.mode("append").parquet(self._commits(name))
        return self._stage(name, self._committed(name, fingerprint), made=True)
