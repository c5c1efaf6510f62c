"""Tables between stages: settled intermediates, run artefacts, CSV results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.functions.names import col

# A side of this many rows or fewer may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_LOCAL_ROOT: dict[str, str] = {}
# Paths settled inside each open ``settled_scope``, innermost last.
_SCOPES: list[list[str]] = []
_FITS: WeakKeyDictionary[DataFrame, tuple[int, bool]] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``.

    Only a master of one process gets a folder of our own when the setting is
    absent, removed when Python ends; anywhere else a machine-local folder would
    be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="traitlens-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT[app], ignore_errors=True)
    return _LOCAL_ROOT[app]


def new_shared_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; an open ``settled_scope`` deletes it."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def settled_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables settled inside the block when it ends.

    For callers that have read or written their result by then: frames built
    inside the block must not be used after it.
    """
    opened: list[str] = []
    _SCOPES.append(opened)
    try:
        yield
    finally:
        _SCOPES.remove(opened)
        for path in opened:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning for the
    readers, and fixes values that depend on partition layout.  With
    ``partition_by`` later filters on those columns read only their files; the
    rebalance hint keeps the files even, splitting large partitions.
    """
    spark = df.sparkSession
    path = new_shared_folder(spark, "settled")
    writer = df.write
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[col(c) for c in df.columns])


def settle_for_passes(df: DataFrame) -> DataFrame:
    """Settle a table that many passes will read.

    When the input had fewer splits than there are cores the table is small, and
    is written once more in even parts.
    """
    table = settle(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() < cores and table.count() > 10_000 * cores:
        table = settle(table.repartition(cores))
    return table


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a settled table has at most ``max_rows`` rows; counted once per frame."""
    known = _FITS.get(small)
    if known is None or known[0] != max_rows:
        known = (max_rows, small.limit(max_rows + 1).count() <= max_rows)
        _FITS[small] = known
    return known[1]


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a settled lookup table on keys where NULL matches NULL.

    The table is counted first: at or under ``max_rows`` it is broadcast, beyond
    that the join shuffles and adaptive execution handles skew.
    """
    renamed = small.withColumnsRenamed({k: f"__{k}" for k in keys})
    if fits_broadcast(small, max_rows):
        renamed = F.broadcast(renamed)
    matches = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__{k}")) for k in keys])
    return df.join(renamed, matches, how).drop(*[f"__{k}" for k in keys])


def write_artifact(df: DataFrame, root: str, kind: str, runid: str, partition_by: Sequence[str] = ("HOST",)) -> str:
    """Store a stage result under ``root/kind``, partitioned by run and host."""
    path = f"{root.rstrip('/')}/{kind}"
    df.withColumn("runid", F.lit(runid)).write.mode("append").partitionBy("runid", *partition_by).parquet(path)
    return path


def read_artifact(spark: SparkSession, root: str, kind: str, runid: str, host: str | None = None) -> DataFrame:
    """Read a stage result; run and host prune partitions."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{kind}").where(F.col("runid") == runid)
    return df if host is None else df.where(F.col("HOST") == host)


def write_csv(df: DataFrame, path: str) -> str:
    """Result sink: header, UTF-8 without a byte-order mark, NULL written as NA."""
    df.write.option("header", True).option("nullValue", "NA").csv(path)
    return path
