"""Keys that hold too many rows for one task.

Rows are counted by a hash bucket of their key first, which costs a bounded
table however many keys there are; only keys of buckets that hold too many rows
are then counted themselves.  The counts are exact, and at most one key in
``HOT_ROWS`` rows can be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col

# A key with more rows than this is split instead of going to one task.
HOT_ROWS = 1_000_000
_BUCKETS = 1 << 16


def key_text(keys: Sequence[str]) -> Column:
    """One string per key combination; NULL parts are left out of it, so they differ from any value."""
    return F.to_json(F.struct(*[col(k) for k in keys]))


def hot_keys(parts: Sequence[DataFrame], keys: Sequence[str], rows: int | None = None) -> list[set[str]]:
    """Per frame, the key texts that hold more than ``rows`` rows; one job for all frames, two if any bucket is full."""
    rows = HOT_ROWS if rows is None else rows
    tagged = [p.select(F.lit(i).alias("part"), key_text(keys).alias("k")) for i, p in enumerate(parts)]
    stacked = tagged[0]
    for more in tagged[1:]:
        stacked = stacked.unionByName(more)
    bucketed = stacked.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(_BUCKETS)).cast("int"))
    full = bucketed.groupBy("part", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("part", "bucket").collect()
    found: list[set[str]] = [set() for _ in parts]
    if full:
        heavy = F.lit(False)
        for i in {r.part for r in full}:
            heavy = heavy | ((F.col("part") == i) & F.col("bucket").isin([r.bucket for r in full if r.part == i]))
        for r in bucketed.where(heavy).groupBy("part", "k").agg(F.count("*").alias("n")).where(F.col("n") > rows).collect():
            found[r.part].add(r.k)
    return found
