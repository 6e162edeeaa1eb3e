"""Error metrics of pairs (expected, calculated): fourteen of them, by group.

A pair's difference is |expected - calculated|; relative, it is divided by |expected| (0 expected: 0 if the
difference is nothing, else 1000); squared on demand; what is not finite is 1000. A metric needs a number of pairs
and is null without them, and null where its value is not finite. With ``prefer_more`` it is divided by the
number of pairs once more. Sums and maxima combine before the shuffle; the metrics of sorted differences use windows
of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import DAY, micros

LARGE = 1000.0


@dataclass(frozen=True)
class Options:
    relative: bool = False
    squared: bool = False
    prefer_more: bool = False
    threshold: float = 95.0
    required: int = 1


def difference(options: Options) -> Column:
    expected, calculated = F.col("expected"), F.col("calculated")
    d = F.abs(expected - calculated)
    if options.relative:
        d = F.when(expected != 0, d / F.when(expected != 0, F.abs(expected))).when(d <= 2.220446049250313e-16, 0.0).otherwise(LARGE)
    d = F.when(F.isnan(d) | (d == float("inf")), LARGE).otherwise(d)
    return d * d if options.squared else d


def differences(pairs: DataFrame, options: Options) -> DataFrame:
    """``pairs`` with ``d``, without pairs that lack a side."""
    known = F.col("expected").isNotNull() & F.col("calculated").isNotNull() & ~F.isnan("calculated")
    return pairs.where(known).withColumn("d", difference(options))


def finish(value: Column, n: Column, options: Options) -> Column:
    if options.prefer_more:
        value = value / n
    return F.when((n >= max(1, options.required)) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def simple(pairs: DataFrame, by: list[str], options: Options) -> DataFrame:
    """n, avg_abs, max_abs, over_threshold, rmse, aic and exp_weighted, in one aggregation."""
    rows = differences(pairs, options)
    d, n = F.col("d"), F.count("*").cast("double")
    hypo = F.when(F.col("calculated") + options.threshold < F.col("expected"), d * (1 + d)).otherwise(d)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        finish(F.avg(d), n, options).alias("avg_abs"),
        finish(F.max(d), n, options).alias("max_abs"),
        finish(F.count_if(d > options.threshold / 100).cast("double"), n, options).alias("over_threshold"),
        finish(F.sqrt(F.avg(d)), n, options).alias("root_mean"),
        finish(n * F.log(F.avg(d * d)), n, options).alias("aic"),
        finish(F.avg(hypo), n, options).alias("exp_weighted"),
    )


def leal(pairs: DataFrame, by: list[str], options: Options) -> DataFrame:
    """Sum of d**4 over the sum of squares of expected around its mean, from moments in one aggregation."""
    rows = differences(pairs, Options())
    n, e = F.count("*").cast("double"), F.col("expected")
    value = F.sum(F.pow("d", F.lit(4.0))) / (F.var_pop(e) * n)
    return rows.groupBy(*by).agg(F.when(F.var_pop(e) > 0, finish(value, n, options)).alias("leal"))


def ordered(pairs: DataFrame, by: list[str], options: Options) -> DataFrame:
    """percentile, variance, std_dev, avg_plus_sd, avg_pow_sd and integral_cdf: metrics of the sorted differences.

    The percentile is the difference one place under the rounded share ``threshold``; the others leave out that
    share at both ends. Mean and variance both divide by n - 1.5 + 1 / (8 (n - 1)), n being all pairs.
    """
    rows = differences(pairs, options)
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("d")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(group).cast("double"), "prev": F.lag("d").over(order)})
    n, share = F.col("n"), options.threshold / 100
    at = F.least(F.floor(n * share + 0.5), n - 1)
    at = F.when(at > 0, at - 1).otherwise(at)
    low, high = F.floor(n * share), F.ceil(n - n * share)
    inside = (F.col("i") >= low) & (F.col("i") < high)
    sums = rows.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.max(F.when(F.col("i") == at, F.col("d"))).alias("percentile"),
        F.count_if(inside).cast("double").alias("m"),
        F.sum(F.when(inside, F.col("d"))).alias("s"),
        F.sum(F.when(inside, F.col("d") * F.col("d"))).alias("ss"),
        F.sum(F.when(inside & (F.col("i") > low), (F.col("prev") + F.col("d")) / 2)).alias("area"),
    )
    m = F.col("m")
    divisor = F.when(n > 1.5, n - 1.5 + 1 / (8 * F.when(n > 1.5, n - 1))).otherwise(n)
    mean = F.coalesce("s", F.lit(0.0)) / divisor
    # the sum of (d - mean)**2, written out because the mean has another divisor than m
    variance = F.greatest(F.lit(0.0), (F.coalesce("ss", F.lit(0.0)) - 2 * mean * F.coalesce("s", F.lit(0.0)) + m * mean * mean) / divisor)
    out = {"percentile": F.col("percentile"), "variance": variance, "std_dev": F.sqrt(variance), "avg_plus_sd": mean + F.sqrt(variance), "avg_pow_sd": F.log(mean) + F.log(F.sqrt(variance)), "integral_cdf": F.when(m > 0, F.coalesce("area", F.lit(0.0)) / (n * n))}
    return sums.select(*by, *[finish(v, n, options).alias(k) for k, v in out.items()])


def crosswalk(pairs: DataFrame, by: list[str], options: Options) -> DataFrame:
    """The two ways that cross between measured and calculated at each pair, less the way along the measured, per pair.

    Pairs go by time, in days. Relative: all levels are divided by the measured one of their time.
    """
    order = Window.partitionBy(*by).orderBy("device_time", "seq")
    rows = differences(pairs, options).withColumn("t", micros())
    if options.relative:
        rows = rows.withColumns({"calculated": F.when(F.col("expected") != 0, F.col("calculated") / F.col("expected")), "expected": F.lit(1.0)})
    rows = rows.withColumns({"dt": (F.col("t") - F.lag("t").over(order)) / (DAY * 1e6), "e0": F.lag("expected").over(order), "c0": F.lag("calculated").over(order)})
    way = lambda a, b: F.sqrt(F.col("dt") * F.col("dt") + (b - a) * (b - a))
    excess = way(F.col("e0"), F.col("calculated")) + way(F.col("c0"), F.col("expected")) - way(F.col("e0"), F.col("expected"))
    n = F.count("*").cast("double")
    return rows.groupBy(*by).agg(finish(F.abs(F.coalesce(F.sum(excess), F.lit(0.0))) / n, n, options).alias("crosswalk"))


def all_metrics(pairs: DataFrame, by: list[str], options: Options = Options()) -> DataFrame:
    """Every metric of each group; the parts share the partitioning by ``by``."""
    out = simple(pairs, by, options)
    for part in (leal(pairs, by, options), ordered(pairs, by, options), crosswalk(pairs, by, options)):
        out = out.join(part, by, "left")
    return out


def running_average(pairs: DataFrame, by: list[str], options: Options = Options()) -> DataFrame:
    """The average metric of all pairs so far, after each pair."""
    order = Window.partitionBy(*by).orderBy("device_time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = differences(pairs, options)
    n = F.count("*").over(order).cast("double")
    return rows.select(*by, "device_time", "seq", finish(F.avg("d").over(order), n, options).alias("metric"))
