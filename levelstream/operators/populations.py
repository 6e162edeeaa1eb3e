"""First populations of a search: points that fill the bounds evenly, the same on every run and any partitioning."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bounds = dict[str, tuple[float, float]]


def primes(n: int) -> list[int]:
    """The first ``n`` primes: the bases of the parameters."""
    found: list[int] = []
    for k in count(2):
        if len(found) == n:
            return found
        if all(k % p for p in found):
            found.append(k)
    return found


def radical_inverse(index: Column, base: int) -> Column:
    """The digits of a whole number from 0 in ``base``, mirrored at the point: in [0, 1); null for negative numbers."""
    most = 1
    while base**most < 1 << 62:
        most += 1
    digits = F.sequence(F.lit(0), F.lit(most - 1))
    start = F.struct(index.cast("long").alias("rest"), F.lit(0.0).alias("sum"), F.lit(1.0 / base).alias("unit"))

    def digit(state: Column, _: Column) -> Column:
        rest = state["rest"]
        return F.struct(F.floor(rest / base).cast("long").alias("rest"), (state["sum"] + (rest % base) * state["unit"]).alias("sum"), (state["unit"] / base).alias("unit"))

    return F.when(index >= 0, F.aggregate(digits, start, digit, lambda s: s["sum"]))


def _inside(at: dict[str, Column], bounds: Bounds) -> list[Column]:
    return [(F.lit(float(low)) + F.lit(float(high - low)) * at[n]).alias(n) for n, (low, high) in bounds.items()]


def halton(spark: SparkSession, bounds: Bounds, size: int, skip: int = 1) -> DataFrame:
    """(candidate, parameters): the points ``skip``, skip + 1, ... of the Halton sequence, a prime base for each parameter."""
    rows = spark.range(size).withColumnRenamed("id", "candidate")
    at = {n: radical_inverse(F.col("candidate") + skip, base) for n, base in zip(bounds, primes(len(bounds)), strict=True)}
    return rows.select("candidate", *_inside(at, bounds))


def diagonal(spark: SparkSession, bounds: Bounds, size: int, cross: bool = False) -> DataFrame:
    """(candidate, parameters): even points on the diagonal from all lower bounds to all upper ones.

    With ``cross`` every second point is on the other diagonal, on which every second parameter falls.
    """
    rows = spark.range(size).withColumnRenamed("id", "candidate")
    share = F.col("candidate") / F.lit(float(max(1, size - 1)))
    falls = F.lit(cross) & (F.col("candidate") % 2 == 1)
    at = {n: F.when(falls & F.lit(k % 2 == 1), 1 - share).otherwise(share) for k, n in enumerate(bounds)}
    return rows.select("candidate", *_inside(at, bounds))


#: The ways a search can begin besides at random.
STARTS = {"halton": halton, "diagonal": diagonal, "cross": lambda spark, bounds, size: diagonal(spark, bounds, size, True)}
