"""Pieces that several text operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.session import let_workers_import
from traitlens.sources.store import settle, shared_root

#: Bytes of one Arrow batch of texts.
BATCH_BYTES = 4 << 20

__all__ = ["held_out", "lean", "let", "let_workers_import", "new_folder", "settle", "table", "text_or_empty", "text_session", "whole_groups"]


def text_session(spark: SparkSession) -> None:
    """Settings for jobs that hand whole texts to Python: importable workers and Arrow batches bounded in bytes.

    A batch is bounded in rows already, but ten thousand long texts would fill a worker.
    """
    let_workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One whole table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``: inside lambdas the bound name is read, not computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def give_back() -> None:
    """Hand memory that this process has freed to the system; Arrow's pool and the C library keep it for later use."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same map over batches, whose worker gives freed memory back when its task ends.

    Spark keeps idle workers for later stages, so what each of them holds counts in every stage.
    """

    @wraps(rows)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches that arrive sorted by ``key``.

    Many small groups share a frame; a group cut by a batch border is carried over.
    """
    carried: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key]
        if carried and keys.iloc[0] == carried[0][key].iloc[0] == keys.iloc[-1]:
            carried.append(batch)
            continue
        last = (keys != keys.iloc[-1]).to_numpy().nonzero()[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        whole = pd.concat([*carried, batch.iloc[:cut]], ignore_index=True)
        if cut == 0 and carried and keys.iloc[0] != carried[0][key].iloc[0]:
            whole = pd.concat(carried, ignore_index=True)
        if len(whole):
            yield whole
        carried = [batch.iloc[cut:]]
    if carried:
        yield pd.concat(carried, ignore_index=True)
