"""Exact order statistics without a single-task sort.

A window over a whole group puts the group in one task; with one group holding
a third of all rows that task never ends.  The operators here cut every group
into value ranges first:

1. a mergeable quantile sketch per group gives split points (bounded size);
2. every row falls either strictly between two split points or exactly on one,
   so a value shared by many rows is a split point and a range of its own;
3. counts per range, summed in value order, say how many rows lie before each
   range;
4. only within a range are rows ordered by a window.

Results are exact; the sketch decides balance only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitlens.functions.names import col
from traitlens.operators.sketches import stages
from traitlens.operators.skew import hot_keys, key_text
from traitlens.sources.store import join_small, settle

_RANGE, _SUB, _POINT, _N, _START, _FIRST = "__range", "__sub", "__point", "__n", "__start", "__first"
# Rows that share one value are cut into pieces of about this many rows.
PIECE_ROWS = 100_000
_BROADCAST_CELLS = 2_000_000
_FEW_SALTS = 8


def default_ranges(df: DataFrame) -> int:
    """Value ranges per group: grows with the cluster's shuffle parallelism."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(32, min(10_000, 4 * parallel))


def _with_group(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Ungrouped input gets one constant group, so there is one code path."""
    return (df, list(keys)) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])


def _split_table(df: DataFrame, keys: Sequence[str], value: str, ranges: int, salts: int | None = None) -> DataFrame:
    """Split points per group, merged in two stages: no task merges the sketches of all map tasks.

    First each group's rows meet by a salt of their map task; of a salt's quantiles as many stay as its
    share of the rows asks for.  Then the groups' points give the splits, which only decide how even the
    ranges are.
    """
    probabilities = [i / ranges for i in range(1, ranges)]
    names = [col(k) for k in keys]
    salts = salts or stages(df)
    # Below the square of this a single merge sees few sketches.
    if salts >= _FEW_SALTS:
        salted = df.groupBy(*names, (F.spark_partition_id() % salts).alias("__salt"))
        parts = settle(salted.agg(F.percentile_approx(value, probabilities, 10 * ranges).alias("__points"), F.count(value).alias(_N)))
        largest = parts.groupBy(*names).agg(F.max(_N).alias("__most"))
        weighed = parts.join(largest.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__{k}")) for k in keys]))
        kept = F.ceil((ranges - 1) * F.col(_N) / F.col("__most")).cast("int")
        picked = F.transform(F.sequence(F.lit(1), kept), lambda i: F.element_at("__points", F.ceil(i * F.lit(ranges - 1) / kept).cast("int")))
        df = weighed.select(*names, F.explode_outer(F.when(F.col(_N) > 0, picked)).alias(value))
    sketch = F.percentile_approx(value, probabilities, 10 * ranges)
    return settle(df.groupBy(*names).agg(F.array_distinct(sketch).alias("__splits")))


def _with_splits_below(df: DataFrame, value: str, ranges: int) -> DataFrame:
    """Add __below, the number of split points below the value, by binary search.

    One projection per halving step: all of them compile into the scan's code,
    which a lambda over the array would not.
    """
    df = df.withColumn("__below", F.lit(0))
    for power in range(math.ceil(math.log2(ranges + 1)) - 1, -1, -1):
        step = 2**power
        probe = F.get("__splits", F.col("__below") + (step - 1))
        df = df.withColumn("__below", F.col("__below") + F.when(probe < F.col(value), step).otherwise(0))
    return df


def _ranged(df: DataFrame, keys: Sequence[str], value: str, ranges: int) -> DataFrame:
    """Tag each row with its value range; NULLs form the last one."""
    # The splits are arrays, so their broadcast limit counts array cells.
    tagged = join_small(df, _split_table(df, keys, value, ranges), keys, max_rows=max(1, _BROADCAST_CELLS // ranges))
    tagged = _with_splits_below(tagged, value, ranges)
    on_point = F.coalesce(F.get(F.col("__splits"), F.col("__below")) == F.col(value), F.lit(False))
    return (
        tagged.withColumn(_POINT, on_point | F.col(value).isNull())
        .withColumn(
            _RANGE,
            F.when(F.col(value).isNull(), F.lit(2 * ranges + 2)).otherwise(2 * F.col("__below") + on_point.cast("int")),
        )
        .drop("__splits", "__below")
    )


def _with_starts(tagged: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Add the number of rows of the group that lie before each row's range, and the rows of the range itself.

    The range counts are small (groups x ranges) and are pre-aggregated before
    their shuffle, so a hot group costs no more than any other.
    """
    counts = tagged.groupBy(*[col(k) for k in keys], *levels).agg(F.count("*").alias(_N))
    upto = W.partitionBy(*[col(k) for k in keys]).orderBy(*levels).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn(_START, F.sum(_N).over(upto) - F.col(_N))
    if len(levels) > 1:
        whole = W.partitionBy(*[col(k) for k in keys], levels[0])
        counts = counts.withColumn(_FIRST, F.min(_START).over(whole)).withColumn(_N, F.sum(_N).over(whole))
    else:
        counts = counts.withColumn(_FIRST, F.col(_START))
    return join_small(tagged, settle(counts), [*keys, *levels])


def _pieces(rows: Column) -> Column:
    return F.ceil(rows / F.lit(float(PIECE_ROWS)))


def _with_tiebreak_slices(tagged: DataFrame, keys: Sequence[str], tiebreak: str) -> DataFrame:
    """Cut each value that stands on a point into slices of its own tiebreak span, as many as its rows ask for."""
    point = tagged.where(_POINT).groupBy(*[col(k) for k in keys], _RANGE)
    spans = point.agg(F.count("*").alias("__rows"), F.min(tiebreak).alias("__low"), F.max(tiebreak).alias("__high"))
    joined = join_small(tagged, settle(spans), [*keys, _RANGE], "left")
    width = F.greatest(F.lit(1.0), (F.col("__high") - F.col("__low") + 1) / _pieces(F.col("__rows")))
    slice_ = F.floor((F.col(tiebreak) - F.col("__low")) / width).cast("int")
    return joined.withColumn(_SUB, F.when(F.col(_POINT), F.coalesce(slice_, F.lit(-1))).otherwise(F.lit(0))).drop("__rows", "__low", "__high")


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    *,
    descending: bool = False,
    rank: str | None = "Rank",
    average: str | None = None,
    position: str | None = None,
    tiebreak: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Rank rows within groups of any size.

    ``rank`` names the minimum-tie rank, ``average`` the average-tie rank,
    ``position`` a unique 1..n position where ties follow the numeric
    ``tiebreak`` column.  Values keep their own type.  NULL ranks last in either
    direction; NaN is the largest number, as in any Spark sort.
    """
    if position and not tiebreak:
        raise ValueError("a unique position needs a tiebreak column")
    ranges = ranges or default_ranges(df)
    columns = [col(c) for c in df.columns]
    work, groups = _with_group(df, keys)
    work = work.withColumn("__v", value)
    _check_rankable(work, "__v")
    tagged = _ranged(work, groups, "__v", ranges)
    if descending:
        last = 2 * ranges + 2  # NULLs stay behind all ranges
        tagged = tagged.withColumn(_RANGE, F.when(F.col(_RANGE) == last, F.lit(last)).otherwise(F.lit(2 * ranges) - F.col(_RANGE)))

    # Rows on a point share one value.  For positions they are cut by their tiebreak; ranks follow from
    # the counts alone, so there any piece will do.
    if position:
        placed = _with_starts(_with_tiebreak_slices(tagged, groups, tiebreak), groups, [_RANGE, _SUB])
    else:
        placed = _with_starts(tagged, groups, [_RANGE])
        spread = F.pmod(F.xxhash64(*columns), _pieces(F.col(_N))).cast("int")
        placed = placed.withColumn(_SUB, F.when(F.col(_POINT), spread).otherwise(F.lit(0)))

    within = W.partitionBy(*[col(k) for k in groups], _RANGE, _SUB)
    order = F.col("__v").desc() if descending else F.col("__v").asc()
    by_value = within.orderBy(order)
    out = []
    if rank:
        out.append(
            F.when(F.col(_POINT), F.col(_FIRST) + 1).otherwise(F.col(_START) + F.rank().over(by_value)).cast("long").alias(rank)
        )
    if average:
        peers = F.count("*").over(by_value.rangeBetween(W.currentRow, W.currentRow))
        out.append(
            F.when(F.col(_POINT), F.col(_FIRST) + (F.col(_N) + 1) / 2.0)
            .otherwise(F.col(_START) + F.rank().over(by_value) + (peers - 1) / 2.0)
            .alias(average)
        )
    if position:
        out.append((F.col(_START) + F.row_number().over(within.orderBy(order, tiebreak))).cast("long").alias(position))
    return placed.select(*columns, *out)


def _check_rankable(df: DataFrame, name: str) -> None:
    """Split points need numbers, dates or timestamps; a text is refused whatever the size of its groups."""
    if not isinstance(df.schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"cannot rank {df.schema[name].dataType.simpleString()} values")


def rank_groups(df: DataFrame, keys: Sequence[str], value: Column, *, descending: bool = False, rank: str = "Rank") -> DataFrame:
    """Minimum-tie rank within many groups that are small as a rule.

    A window does the work; a group with too many rows for one task is ranked by
    value ranges instead, with the same result.  NULL values rank last.
    """
    _check_rankable(df.select(value.alias("__v")), "__v")
    hot = list(hot_keys([df], keys)[0])
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    by_window = F.rank().over(W.partitionBy(*[col(k) for k in keys]).orderBy(order)).cast("long")
    if not hot:
        return df.withColumn(rank, by_window)
    is_hot = key_text(keys).isin(hot)
    large = rank_within(df.where(is_hot), keys, value, descending=descending, rank=rank)
    return df.where(~is_hot).withColumn(rank, by_window).unionByName(large)


def hashed_position(df: DataFrame, keys: Sequence[str], hashed: Column, position: str = "Position", ranges: int | None = None) -> DataFrame:
    """Unique 1..n position within each group in the order of an md5 column.

    A hash is uniform, so equal slices of its first digits balance themselves
    and no sketch is needed.
    """
    ranges = ranges or default_ranges(df)
    columns = [col(c) for c in df.columns]
    work, groups = _with_group(df, keys)
    lead = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    tagged = work.withColumn("__h", hashed).withColumn(_RANGE, F.floor(lead * ranges).cast("int"))
    placed = _with_starts(tagged, groups, [_RANGE])
    within = W.partitionBy(*[col(k) for k in groups], _RANGE).orderBy("__h")
    return placed.select(*columns, (F.col(_START) + F.row_number().over(within)).cast("long").alias(position))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], *, ranges: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (the usual type 7) per group: keys, n, q array.

    Three scans and three tiny shuffles: sketch, range counts, and then only the
    rows of ranges that hold a wanted rank.
    """
    ranges = ranges or default_ranges(df)
    work, groups = _with_group(df.where(col(value).isNotNull()), keys)
    group_cols = [col(g) for g in groups]
    work = work.select(*group_cols, col(value).cast("double").alias("__v"))
    tagged = _ranged(work, groups, "__v", ranges)

    group_window = W.partitionBy(*group_cols)
    upto = group_window.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, W.currentRow)
    targets = F.array(*[F.lit(float(p)) for p in probabilities])
    at = F.transform(targets, lambda p: p * (F.col("__total") - 1))
    wanted_ranks = F.array_distinct(F.concat(F.transform(at, lambda h: F.floor(h)), F.transform(at, lambda h: F.ceil(h))))
    hit_ranges = settle(
        tagged.groupBy(*group_cols, _RANGE)
        .agg(F.count("*").alias(_N), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        .withColumn("__total", F.sum(_N).over(group_window))
        .withColumn(_START, F.sum(_N).over(upto) - F.col(_N))
        .withColumn("__want", F.filter(wanted_ranks, lambda r: (r >= F.col(_START)) & (r < F.col(_START) + F.col(_N))))
        .where(F.size("__want") > 0)
    )

    constant = F.col("__lo") == F.col("__hi")
    known = hit_ranges.where(constant).select(*group_cols, "__total", F.explode("__want").alias("__k"), F.col("__lo").alias("__x"))
    open_ranges = hit_ranges.where(~constant).select(*group_cols, _RANGE, _START, "__want", "__total")
    distinct = join_small(tagged.drop(_POINT), open_ranges, [*groups, _RANGE]).groupBy(
        *group_cols, _RANGE, "__v"
    ).agg(F.count("*").alias(_N), F.first(_START).alias(_START), F.first("__want").alias("__want"), F.first("__total").alias("__total"))
    inside = W.partitionBy(*group_cols, _RANGE).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    searched = (
        distinct.withColumn("__before", F.col(_START) + F.sum(_N).over(inside) - F.col(_N))
        .withColumn("__k", F.explode(F.filter("__want", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col(_N)))))
        .select(*group_cols, "__total", "__k", F.col("__v").alias("__x"))
    )
    found = known.unionByName(searched).groupBy(*group_cols).agg(
        F.first("__total").alias("__total"), F.map_from_entries(F.collect_list(F.struct("__k", "__x"))).alias("__at")
    )
    value_at = lambda k: F.element_at(F.col("__at"), k.cast("long"))
    interpolate = lambda h: value_at(F.floor(h)) + (h - F.floor(h)) * (value_at(F.ceil(h)) - value_at(F.floor(h)))
    out = found.select(*group_cols, F.col("__total").alias("n"), F.transform(at, interpolate).alias("q"))
    return out if keys else out.drop("__all")


def top_with_ties(df: DataFrame, value: str, n: int, *, bottom: bool = False) -> DataFrame:
    """The n largest (or smallest) rows, with all ties of the last one.

    The n-th value comes from a distributed top-n (each task keeps n values);
    the rows are then a plain filter, so no global sort happens.
    """
    order = F.col(value).asc_nulls_last() if bottom else F.col(value).desc_nulls_last()
    nth = df.where(F.col(value).isNotNull()).select(value).orderBy(order).limit(n)
    edge = nth.agg(F.max(value) if bottom else F.min(value))
    return df.where(F.col(value) <= edge.scalar() if bottom else F.col(value) >= edge.scalar())


def stable_row_id(df: DataFrame, order: Sequence[str], name: str = "rowIndex") -> DataFrame:
    """Dense 1..n row id in the order of the given columns, fixed once written.

    Rows are range-partitioned and sorted in parallel and written; partition
    sizes then give each partition its first id.  The written table is the
    snapshot, so the id never changes on a recompute.
    """
    columns = [col(c) for c in df.columns]
    # The hash keeps rows that share all order columns from forming one partition.
    keys = [*[col(c).asc_nulls_first() for c in order], F.xxhash64(*columns)]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(spread.withColumn("__at", F.monotonically_increasing_id()))
    block = F.shiftright("__at", 33).cast("int")
    placed = placed.withColumn("__block", block)
    upto = W.orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = settle(
        placed.groupBy("__block").agg(F.count("*").alias(_N)).select("__block", (F.sum(_N).over(upto) - F.col(_N)).alias(_START))
    )
    offset = F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    return join_small(placed, starts, ["__block"]).select((F.col(_START) + offset + 1).alias(name), *columns)


def sliding_mean(
    df: DataFrame, keys: Sequence[str], position: str, value: str, width: int, name: str, *, block: int = 100_000
) -> DataFrame:
    """Centred mean over ``width`` consecutive positions; the frame shrinks at the ends.

    Groups are cut into blocks of positions.  Rows near a block's edge are also
    sent to the neighbouring block, so every frame is whole within its block.
    """
    after = width // 2
    before = width - 1 - after
    block = max(block, width)
    home = F.floor((F.col(position) - 1) / block)
    reached = F.array_distinct(
        F.array(home, F.greatest(F.floor((F.col(position) - 1 - after) / block), F.lit(0)), F.floor((F.col(position) - 1 + before) / block))
    )
    spread = df.withColumn("__home", home).withColumn("__block", F.explode(reached))
    frame = W.partitionBy(*[col(k) for k in keys], "__block").orderBy(position).rowsBetween(-before, after)
    return (
        spread.withColumn("__mean", F.avg(value).over(frame))
        .where(F.col("__home") == F.col("__block"))
        .drop("__home", "__block")
        .withColumnRenamed("__mean", name)
    )
