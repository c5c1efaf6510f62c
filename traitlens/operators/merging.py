"""Joins on entity keys, membership checks and key checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators.skew import hot_keys
from traitlens.sources.store import fits_broadcast, settle


def merge_outer(parts: Sequence[DataFrame], keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Full outer merge of any number of parts, with the keys coalesced.

    Every join uses the same keys, so each part is shuffled once.  With
    ``null_safe`` rows whose key is NULL meet each other; otherwise they stay
    apart, one row per side.

    A full outer join cannot have its hot partitions split.  When a sketch of
    the keys finds one that holds too many rows, the merge is put together from
    an inner join and two anti joins, which adaptive execution can split.  These
    read each side several times, so the parts are written once before.
    """
    if not any(hot_keys(parts, keys)):
        return reduce(lambda a, b: _full_pair(a, b, keys, null_safe), parts)
    return reduce(lambda a, b: _split_pair(a, b, keys, null_safe), [settle(p) for p in parts])


def _full_pair(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, list(keys), "full")
    other, matches, rest = _aside(left, right, keys, null_safe)
    merged = left.join(other, matches, "full")
    return merged.select(*[F.coalesce(col(k), col(f"__{k}")).alias(k) for k in keys], *[col(c) for c in rest])


def _split_pair(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    other, matches, rest = _aside(left, right, keys, null_safe)
    both = left.join(other, matches).select(*[col(k) for k in keys], *[col(c) for c in rest])
    known_right = right.select(*[col(k) for k in keys]).distinct()
    known_left = left.select(*[col(k) for k in keys]).distinct()
    right_keys, on_right, _ = _aside(left, known_right, keys, null_safe)
    left_keys, on_left, _ = _aside(right, known_left, keys, null_safe)
    only_left = left.join(right_keys, on_right, "left_anti")
    only_right = right.join(left_keys, on_left, "left_anti")
    stacked = both.unionByName(only_left, allowMissingColumns=True).unionByName(only_right, allowMissingColumns=True)
    return settle(stacked)


def _aside(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool):
    """The right side with its keys renamed, the match condition, and the non-key columns."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    pairs = [(col(k), col(f"__{k}")) for k in keys]
    matches = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
    rest = [c for c in (*left.columns, *right.columns) if c not in keys]
    return other, matches, rest


def enrich(df: DataFrame, other: DataFrame, on: dict[str, str] | Sequence[str], suffix: str = "_other") -> DataFrame:
    """Left join that keeps every row of ``df`` and its key names.

    ``on`` maps the left key to the right key where the names differ.  A
    non-key column that both sides carry is renamed on the right, never doubled.
    No side is assumed small: sizes known at run time decide the join.
    """
    pairs = on if isinstance(on, dict) else {k: k for k in on}
    renames = {right: f"__{left}" for left, right in pairs.items()}
    taken = set(df.columns)
    renames |= {c: c + suffix for c in other.columns if c not in renames and c in taken}
    other = other.withColumnsRenamed(renames)
    matches = reduce(lambda a, b: a & b, [col(left) == col(f"__{left}") for left in pairs])
    return df.join(other, matches, "left").drop(*[f"__{left}" for left in pairs])


def members(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in the list."""
    return df.join(listed.select(*[col(k) for k in keys]), list(keys), "left_semi")


def strangers(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the list."""
    return df.join(listed.select(*[col(k) for k in keys]), list(keys), "left_anti")


def require_disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    shared = members(left, right, keys).limit(5).collect()
    if shared:
        raise ValueError(f"keys on both sides, for example {[tuple(r[k] for k in keys) for r in shared]}")


def require_contained(part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> None:
    missing = strangers(part, whole, keys).limit(5).collect()
    if missing:
        raise ValueError(f"keys missing, for example {[tuple(r[k] for k in keys) for r in missing]}")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"repeated keys, for example {[tuple(r) for r in bad]}")


def require_rows(df: DataFrame, expected: int) -> None:
    actual = df.count()
    if actual != expected:
        raise ValueError(f"expected {expected} rows, found {actual}")


def listed_cohort(df: DataFrame, listed: DataFrame, keys: Sequence[str], replaces: Sequence[str]) -> DataFrame:
    """Rows on a selected list; the list's columns replace those of the table.

    A selected list is short by nature, yet it is only broadcast when a count
    says so; it is settled first, so that it is selected once.
    """
    listed = settle(listed)
    if fits_broadcast(listed):
        listed = F.broadcast(listed)
    return df.drop(*replaces).join(listed, list(keys))
