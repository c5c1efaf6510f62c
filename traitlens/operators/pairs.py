"""Quantiles of all pair distances in a group, found by counting instead of pairing.

How many pairs lie within a distance t follows from ranks: for each value, how
many values reach no further than value + t.  The wanted order statistics are
bracketed and each round asks for the count at several cuts of every bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators.ordering import _BROADCAST_CELLS, _split_table, _with_splits_below, default_ranges
from traitlens.sources.store import join_small, settle


def _signed_parts(df: DataFrame, keys: Sequence[str], label: str, value: str, mode: str) -> DataFrame:
    """Distinct values with weights.  Pairs within classes are counted class by
    class; pairs between classes are all pairs less those within classes."""
    rows = df.select(*[col(k) for k in keys], col(label).cast("string").alias("__c"), col(value).cast("double").alias("__x"))
    rows = rows.where(F.col("__x").isNotNull() & F.col("__c").isNotNull())
    own = F.struct(F.col("__c").alias("part"), F.lit(1 if mode == "within" else -1).alias("sign"))
    everyone = F.struct(F.lit(None).cast("string").alias("part"), F.lit(1).alias("sign"))
    parts = F.array(own) if mode == "within" else F.array(own, everyone)
    counted = rows.groupBy(*[col(k) for k in keys], "__c", "__x").agg(F.count("*").alias("__w"))
    spread = counted.withColumn("__part", F.explode(parts))
    return spread.groupBy(*[col(k) for k in keys], F.col("__part.part").alias("__p"), F.col("__part.sign").alias("__sign"), "__x").agg(F.sum("__w").alias("__w"))


def pair_distance_boxes(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    value: str,
    mode: str = "within",
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    *,
    cuts: int = 15,
    tolerance: float = 1e-10,
    ranges: int | None = None,
) -> DataFrame:
    """Type-7 quantiles of the distances that :func:`pair_distances` summarises.

    Returns keys, n_pairs and an array q.  Values are right to within
    ``tolerance`` of the group's largest distance.  Each round costs one shuffle
    of the distinct values times the cuts still open, spread over value ranges.
    """
    if mode not in ("within", "between"):
        raise ValueError("mode is 'within' or 'between'")
    ranges = ranges or default_ranges(df)
    group_cols = [col(k) for k in keys]
    parts = [*keys, "__p"]
    part_cols = [col(p) for p in parts]
    values = settle(_signed_parts(df, keys, label, value, mode))
    splits = _split_table(values, parts, "__x", ranges)

    def ranged(frame: DataFrame, at: str) -> DataFrame:
        tagged = join_small(frame, splits, parts, max_rows=max(1, _BROADCAST_CELLS // ranges))
        return _with_splits_below(tagged, at, ranges).drop("__splits")

    # Weight before each range.  A probe may also fall into a range without
    # values, so those get the weight up to there.
    placed = settle(ranged(values, "__x"))
    in_order = W.partitionBy(*part_cols).orderBy("__below")
    sizes = placed.groupBy(*part_cols, "__below").agg(F.sum("__w").alias("__n"))
    sizes = sizes.withColumn("__end", F.sum("__n").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sizes = sizes.withColumn("__next", F.coalesce(F.lead("__below").over(in_order), F.lit(ranges + 2)))
    own = sizes.select(*part_cols, "__below", (F.col("__end") - F.col("__n")).alias("__start"))
    empty = sizes.where(F.col("__next") > F.col("__below") + 1)
    empty = empty.select(*part_cols, F.explode(F.sequence(F.col("__below") + 1, F.col("__next") - 1)).alias("__below"), F.col("__end").alias("__start"))
    starts = settle(own.unionByName(empty))
    ends = settle(placed.groupBy(*part_cols).agg(F.max("__x").alias("__top"), F.sum("__w").alias("__all")))
    inside = W.partitionBy(*part_cols, "__below").orderBy("__y", "__probe").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = placed.select(*part_cols, "__below", F.col("__x").alias("__y"), "__w", F.lit(0).alias("__probe"))

    def reach(cut_table: DataFrame) -> DataFrame:
        """Per group and cut t: sum over values of weight times the weight at or below value + t."""
        moved = join_small(values, cut_table, keys).withColumns({"__y": F.col("__x") + F.col("__t"), "__signed": F.col("__sign") * F.col("__w")})
        moved = join_small(moved, ends, parts)
        # A probe past the largest value reaches all of its part: no range has to hold them.
        past = moved.where(F.col("__y") >= F.col("__top")).select(*group_cols, "__t", (F.col("__signed") * F.col("__all")).alias("__part"))
        probes = ranged(moved.where(F.col("__y") < F.col("__top")), "__y")
        asked = probes.select(*part_cols, "__below", "__y", F.lit(0).alias("__w"), F.lit(1).alias("__probe"), "__t", "__signed")
        upto = held.unionByName(asked, allowMissingColumns=True).withColumn("__upto", F.sum("__w").over(inside)).where(F.col("__probe") == 1)
        placed_probes = join_small(upto, starts, [*parts, "__below"])
        within = placed_probes.select(*group_cols, "__t", (F.col("__signed") * (F.col("__upto") + F.col("__start"))).alias("__part"))
        return within.unionByName(past).groupBy(*group_cols, "__t").agg(F.sum("__part").alias("__reach"))

    # Pairs within t: reach(t) - reach(0) plus the pairs of equal values.
    extent = values.groupBy(*group_cols).agg(
        F.sum(F.col("__sign") * F.col("__w") * (F.col("__w") - 1) / 2).alias("__equal"), (F.max("__x") - F.min("__x")).alias("__span")
    )
    totals = values.groupBy(*part_cols, "__sign").agg(F.sum("__w").alias("__w")).groupBy(*group_cols)
    totals = totals.agg(F.sum(F.col("__sign") * F.col("__w") * (F.col("__w") - 1) / 2).cast("long").alias("__pairs"))
    zero = reach(values.select(*group_cols).distinct().withColumn("__t", F.lit(0.0))).drop("__t").withColumnRenamed("__reach", "__zero")
    base = settle(join_small(join_small(settle(extent), settle(totals), keys), settle(zero), keys).where(F.col("__pairs") > 0))

    at = F.transform(F.array(*[F.lit(float(p)) for p in probabilities]), lambda p: p * (F.col("__pairs") - 1))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda h: F.floor(h)), F.transform(at, lambda h: F.ceil(h))))
    brackets = base.select(*group_cols, "__equal", "__zero", "__span", F.explode(ranks).alias("__k"))
    all_equal = F.col("__equal") > F.col("__k")
    brackets = brackets.withColumns({"__lo": F.lit(0.0), "__hi": F.when(all_equal, F.lit(0.0)).otherwise(F.col("__span") * (1 + 1e-12))})
    share = F.transform(F.sequence(F.lit(1), F.lit(cuts)), lambda m: F.col("__lo") + (F.col("__hi") - F.col("__lo")) * m / (cuts + 1))
    for _ in range(math.ceil(math.log(1 / tolerance) / math.log(cuts + 1))):
        tried = brackets.withColumn("__t", F.explode(share))
        counted = reach(tried.select(*group_cols, "__t").distinct()).withColumnsRenamed({k: f"__{k}" for k in [*keys, "__t"]})
        same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__{k}")) for k in [*keys, "__t"]])
        short = F.col("__reach") - F.col("__zero") + F.col("__equal") <= F.col("__k")
        narrowed = tried.join(counted, same).groupBy(*group_cols, "__equal", "__zero", "__span", "__k")
        brackets = settle(
            narrowed.agg(
                F.coalesce(F.max(F.when(short, F.col("__t"))), F.first("__lo")).alias("__lo"),
                F.coalesce(F.min(F.when(~short, F.col("__t"))), F.first("__hi")).alias("__hi"),
            )
        )

    found = brackets.groupBy(*group_cols).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__hi"))).alias("__at"))
    value_at = lambda k: F.element_at(F.col("__at"), k.cast("long"))
    interpolate = lambda h: value_at(F.floor(h)) + (h - F.floor(h)) * (value_at(F.ceil(h)) - value_at(F.floor(h)))
    factor = math.sqrt(2.0) if mode == "within" else 1.0
    return join_small(base, settle(found), keys).select(
        *group_cols, F.col("__pairs").alias("n_pairs"), F.transform(F.transform(at, interpolate), lambda q: q * factor).alias("q")
    )
