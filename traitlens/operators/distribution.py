"""Distribution summaries: box statistics, densities, within-group distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.functions.names import col
from traitlens.operators.ordering import exact_quantiles, rank_within
from traitlens.sources.store import join_small, settle


def _narrow(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys and value, written once.  The NULL filter comes after: before it, the
    optimizer would push the value's whole expression down a second time."""
    return settle(df.select(*[col(k) for k in keys], col(value).cast("double").alias("__x"))).where(F.col("__x").isNotNull())


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 box lengths, row and outlier counts per group.

    Quartiles come from the split-range search; whiskers need one more
    aggregation that combines on the map side.
    """
    rows = _narrow(df, keys, value)  # read four times below
    fences = settle(
        exact_quantiles(rows, keys, "__x", [0.25, 0.5, 0.75]).select(
            *[col(k) for k in keys], F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__x") >= F.col("q1") - reach) & (F.col("__x") <= F.col("q3") + reach)
    return (
        join_small(rows, fences, keys)
        .groupBy(*[col(k) for k in keys])
        .agg(
            F.count("*").alias("n"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def density(df: DataFrame, keys: Sequence[str], value: str, grid: int = 512) -> DataFrame:
    """Gaussian kernel density per group on an even grid over the group's range.

    The bandwidth is the usual rule of thumb, 0.9 min(sd, IQR/1.34) n^(-1/5).
    Rows are first shared linearly between their two grid points, an
    aggregation bounded by the grid; the kernel then runs over grid points only.
    """
    rows = _narrow(df, keys, value)
    group_cols = [col(k) for k in keys]
    quartiles = settle(exact_quantiles(rows, keys, "__x", [0.25, 0.75]))
    moments = rows.groupBy(*group_cols).agg(F.stddev("__x").alias("__sd"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    spread = F.least(F.col("__sd"), (F.col("q")[1] - F.col("q")[0]) / 1.34)
    spread = F.coalesce(F.nullif(spread, F.lit(0.0)), F.nullif(F.col("__sd"), F.lit(0.0)), F.lit(1.0))
    scale = settle(
        join_small(moments, quartiles, keys).select(
            *group_cols,
            F.col("n").alias("__n"),
            "__min",
            ((F.col("__max") - F.col("__min")) / (grid - 1)).alias("__step"),
            (0.9 * spread * F.pow(F.col("n"), F.lit(-0.2))).alias("__bw"),
        )
    )
    place = F.coalesce(F.try_divide(F.col("__x") - F.col("__min"), F.col("__step")), F.lit(0.0))
    low = F.least(F.floor(place), F.lit(grid - 1)).cast("int")
    shares = F.array(
        F.struct(low.alias("i"), (1 - (place - low)).alias("w")),
        F.struct(F.least(low + 1, F.lit(grid - 1)).alias("i"), (place - low).alias("w")),
    )
    binned = (
        join_small(rows, scale, keys)
        .select(*group_cols, F.explode(shares).alias("s"))
        .groupBy(*group_cols, F.col("s.i").alias("i"))
        .agg(F.sum("s.w").alias("w"))
        .groupBy(*group_cols)
        .agg(F.collect_list(F.struct("i", "w")).alias("__bins"))
    )
    points = join_small(binned, scale, keys).withColumn("GridIndex", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    distance = lambda b: (F.col("GridIndex") - b["i"]) * F.col("__step") / F.col("__bw")
    mass = F.aggregate("__bins", F.lit(0.0), lambda total, b: total + b["w"] * F.exp(-0.5 * distance(b) * distance(b)))
    return points.select(
        *group_cols,
        F.col("GridIndex").cast("long").alias("GridIndex"),
        (F.col("__min") + F.col("GridIndex") * F.col("__step")).alias("x"),
        (mass / (F.col("__n") * F.col("__bw") * F.sqrt(2 * F.pi()))).alias("Density"),
    )


def _pair_sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number, sum and square sum of all pair distances per group, without pairs.

    In sorted order a value is added once for each smaller one and subtracted
    once for each larger one, so ranks carry the whole sum.  Values are centred
    on the group's mean, which keeps the sums short.
    """
    group_cols = [col(k) for k in keys]
    sizes = settle(df.groupBy(*group_cols).agg(F.count("*").alias("__m"), F.avg("__x").alias("__mu")))
    ranked = join_small(rank_within(df, keys, F.col("__x"), rank=None, average="__r"), sizes, keys)
    x = F.col("__x") - F.col("__mu")
    return ranked.groupBy(*group_cols).agg(
        (F.first("__m") * (F.first("__m") - 1) / 2).alias("__pairs"),
        F.sum((2 * F.col("__r") - F.col("__m") - 1) * x).alias("__abs"),
        (F.first("__m") * F.sum(x * x) - F.pow(F.sum(x), 2)).alias("__square"),
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
    )


def pair_distances(df: DataFrame, keys: Sequence[str], label: str, value: str, mode: str = "within") -> DataFrame:
    """Summary of the distances between all pairs of rows in each group.

    ``within`` covers pairs of the same class, whose distance carries the factor
    sqrt(2) that comes from comparing two-column rows with one column missing;
    ``between`` covers pairs of different classes, with the plain distance.
    The number of pairs is quadratic in the group, so pairs are never built.
    """
    rows = df.select(*[col(k) for k in keys], col(label).alias("__c"), col(value).cast("double").alias("__x"))
    rows = settle(rows).where(F.col("__x").isNotNull() & F.col("__c").isNotNull())
    group_cols = [col(k) for k in keys]
    classes = settle(_pair_sums(rows, [*keys, "__c"]))
    same = classes.groupBy(*group_cols).agg(
        F.sum("__pairs").alias("__pairs"), F.sum("__abs").alias("__abs"), F.sum("__square").alias("__square"), F.max(F.col("__max") - F.col("__min")).alias("__far")
    )
    if mode == "within":
        pairs, total, square, far, factor = F.col("__pairs"), F.col("__abs"), F.col("__square"), F.col("__far"), F.sqrt(F.lit(2.0))
        table = same
    elif mode == "between":
        both = _pair_sums(rows.drop("__c"), keys).withColumnsRenamed({"__pairs": "__ap", "__abs": "__aa", "__square": "__as", "__min": "__lo", "__max": "__hi"})
        # The farthest pair of different classes: largest of one class against
        # smallest of another, from the few per-class extremes.
        ends = classes.groupBy(*group_cols).agg(F.collect_list(F.struct("__c", "__min", "__max")).alias("__ends"))
        table = join_small(join_small(both, same, keys), ends, keys)
        gap = lambda a, b: F.when(a["__c"] != b["__c"], F.abs(a["__max"] - b["__min"]))
        far = F.array_max(F.flatten(F.transform("__ends", lambda a: F.transform("__ends", lambda b: gap(a, b)))))
        pairs, total, square = F.col("__ap") - F.col("__pairs"), F.col("__aa") - F.col("__abs"), F.col("__as") - F.col("__square")
        factor = F.lit(1.0)
    else:
        raise ValueError("mode is 'within' or 'between'")
    return table.where(pairs > 0).select(
        *group_cols,
        pairs.cast("long").alias("n_pairs"),
        (factor * total / pairs).alias("MeanDist"),
        (factor * F.sqrt(F.greatest(square / pairs, F.lit(0.0)))).alias("RmsDist"),
        (factor * far).alias("MaxDist"),
    )
