"""Exact order statistics and running sums without one task for a group: by counts of cells first.

A group of any size, all rows included, is cut into cells: ranges of values, or of time. Sums by cell say which cell
holds a rank, or what came before a cell, and only within cells rows are ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that order_statistics cuts all rows into.
CELLS = 200


def with_cells(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` with ``cell``: the range of values, of about CELLS even ones, that a row falls into.

    The bounds are a subquery of the plan that reads ``counts``: both share its exchange, and no job runs before.
    """
    bounds = counts.agg(F.percentile_approx(value, [i / CELLS for i in range(1, CELLS)], 10_000).alias("bounds")).scalar()
    bounded = counts.withColumn("bounds", F.coalesce(bounds, F.array().cast("array<double>")))
    return bounded.withColumn("cell", F.size(F.filter("bounds", lambda b: b <= F.col(value)))).drop("bounds")


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group: ``by``, n and, by name, the value at a rank (from 0 on) that is given as a function of n.

    Equal values are one row with a count. Null values are left out, a null in ``by`` is a group. Where one range of
    values is crowded its cell is large, and the result stays exact.
    """
    x = F.col(value).cast("double")
    counts = rows.where(x.isNotNull()).groupBy(F.struct(*by).alias("key"), x.alias("x")).agg(F.count("*").alias("c"))
    cells = with_cells(counts, "x")
    group = Window.partitionBy("key")
    sums = cells.groupBy("key", "cell").agg(F.sum("c").alias("m"))
    sums = sums.withColumns({"before": F.sum("m").over(group.orderBy("cell")) - F.col("m"), "n": F.sum("m").over(group)})
    holds = F.lit(False)
    for rank in ranks.values():
        holds = holds | ((rank(F.col("n")) >= F.col("before")) & (rank(F.col("n")) < F.col("before") + F.col("m")))
    placed = cells.join(sums.where(holds).drop("m"), ["key", "cell"])
    first = F.col("before") + F.sum("c").over(Window.partitionBy("key", "cell").orderBy("x")) - F.col("c")
    placed = placed.withColumn("first", first)
    picks = [F.max(F.when((rank(F.col("n")) >= F.col("first")) & (rank(F.col("n")) < F.col("first") + F.col("c")), F.col("x"))).alias(name) for name, rank in ranks.items()]
    return placed.groupBy("key").agg(F.first("n").alias("n"), *picks).select("key.*", "n", *ranks)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group: ``by``, n and, by name, the percentile at a share, linear between the neighbours of share * (n - 1)."""
    ranks = {}
    for name, share in shares.items():
        ranks[f"{name}_low"] = lambda n, share=share: F.floor(share * (n - 1))
        ranks[f"{name}_high"] = lambda n, share=share: F.ceil(share * (n - 1))
    found = order_statistics(rows, by, value, ranks)

    def between(name: str, share: float) -> Column:
        at, low, high = share * (F.col("n") - 1), F.col(f"{name}_low"), F.col(f"{name}_high")
        part = at - F.floor(at)
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return found.select(*by, "n", *[between(name, share).alias(name) for name, share in shares.items()])


def running_sums(rows: DataFrame, cell: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums, by name, over all rows up to each in ``order``, of which ``cell`` is a rising function."""
    celled = rows.withColumn("cell", cell)
    totals = celled.groupBy("cell").agg(*[F.sum(c).alias(f"{name}_in") for name, c in sums.items()])
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    totals = totals.select("cell", *[F.coalesce(F.sum(f"{name}_in").over(before), F.lit(0)).alias(f"{name}_before") for name in sums])
    within = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = celled.join(totals, "cell")
    for name, c in sums.items():
        found = found.withColumn(name, F.col(f"{name}_before") + F.sum(c).over(within))
    return found.drop("cell", *[f"{name}_before" for name in sums])
