"""Fits of every segment at once: the state of a search is a row a segment, and a step is one aggregation.

A step joins the rows of a segment with its state and averages the squared error of each trial as a column, so rows
are not copied for their trials, and nothing of a segment comes to the driver. The rows are written once; the rounds
of one parameter are one plan, in which the exchange of the rows by segment is the same in each and so is made once.
Parameters that all segments share are few numbers on the driver.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trials of a step are columns of one aggregation; more are refused.
MOST_TRIALS = 400
#: Parameters by name to the model's level, over the columns of the rows.
Model = Callable[[dict[str, Column]], Column]
Bounds = dict[str, tuple[float, float]]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir``: the plan begins anew there, and lost executors lose no more.

    Where the setting is missing, a local master uses a folder of its machine; any other is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "levelstream-checkpoints"))
    return df.checkpoint()


def kept_rows(inputs: DataFrame, by: list[str]) -> DataFrame:
    """The rows of a fit, written once; rows without an expected level are left out, and so are those without a segment."""
    return cut(inputs.where("expected is not null").dropna(subset=by))


def _gap(level: Column) -> Column:
    """What the model misses; null where it gives no number, so that the row does not count."""
    return F.nanvl(F.col("expected") - level, F.lit(None).cast("double"))


def _step(inputs: DataFrame, state: DataFrame, by: list[str], model: Model, trials: list[dict[str, Column]]) -> DataFrame:
    """``state`` with ``errors``: the mean squared error of each trial on the rows of the segment; null if a trial has no level."""
    if len(trials) > MOST_TRIALS:
        raise ValueError(f"more than {MOST_TRIALS} trials in a step")
    held = [c for c in state.columns if c not in by]
    gap = [_gap(model(t)) for t in trials]
    errors = F.array(*[F.avg(g * g) for g in gap])
    return inputs.join(state, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in held], errors.alias("errors"), F.count("*").alias("n"))


def _least(errors: Column) -> Column:
    """The place, from 0, of the least error, of equals the first; null if there is none."""
    return (F.array_position(errors, F.array_min(errors)) - 1).cast("int")


def scan(inputs: DataFrame, bounds: Bounds, model: Model, by: list[str], steps: int = 10, generations: int = 3) -> DataFrame:
    """(by, parameters, n, fitness): one parameter after the other takes the best of steps + 1 even values, the others held.

    Starts at the lower bounds; a value must be better than the one held. Ends when no segment has improved in a whole
    generation, or after ``generations``. The fitness is the root mean square error. A segment whose model gives no
    number keeps its start and has a null fitness; null levels of the model do not count; an empty table gives an
    empty one; other columns are ignored.
    """
    rows = kept_rows(inputs, by)
    state = rows.select(*by).distinct().select(*by, *[F.lit(float(low)).alias(n) for n, (low, _) in bounds.items()])
    for _ in range(generations):
        state = state.withColumn("improved", F.lit(False))
        for name, (low, high) in bounds.items():
            if low == high:
                continue
            values = [low + (high - low) * i / steps for i in range(steps + 1)]
            trials = [{n: F.col(n) for n in bounds}, *[{n: F.lit(v) if n == name else F.col(n) for n in bounds} for v in values]]
            tried = _step(rows, state, by, model, trials).withColumn("best", _least(F.col("errors")))
            better = F.coalesce((F.col("best") > 0) & (F.get("errors", "best") < F.coalesce(F.col("errors")[0], F.lit(float("inf")))), F.lit(False))
            value = F.get(F.array(*map(F.lit, values)), F.col("best") - 1)
            state = tried.select(*by, *[F.when(better, value).otherwise(F.col(n)).alias(n) if n == name else n for n in bounds], (F.col("improved") | better).alias("improved"))
        state = cut(state)
        if not state.where("improved").limit(1).count():
            break
    return _fitness(rows, state.select(*by, *bounds), by, model, bounds)


def ternary(inputs: DataFrame, bounds: Bounds, model: Model, by: list[str], rounds: int = 12, generations: int = 2) -> DataFrame:
    """(by, parameters, n, fitness): the interval of one parameter after the other, the last first, shrinks by a third a round.

    For errors that are convex in each parameter. Two points at its thirds are compared; the third beyond the worse
    goes, of equals both outer ones. After ``rounds`` the better of the last two points is taken if it is better than
    the value held, which is the middle at first. Rows and results are as in ``scan``.
    """
    rows = kept_rows(inputs, by)
    state = rows.select(*by).distinct().select(*by, *[F.lit((low + high) / 2).alias(n) for n, (low, high) in bounds.items()])
    for _ in range(generations):
        state = state.withColumn("improved", F.lit(False))
        for name, (low, high) in reversed(bounds.items()):
            if low == high:
                continue
            now = state.withColumns({"low": F.lit(float(low)), "high": F.lit(float(high))})
            third = (F.col("high") - F.col("low")) / 3
            points = [F.col("low") + third, F.col("low") + 2 * third]
            trials = [{n: x if n == name else F.col(n) for n in bounds} for x in [*points, F.col(name)]]
            for _ in range(rounds):
                tried = _step(rows, now, by, model, trials)
                left, right = F.col("errors")[0], F.col("errors")[1]
                own = [*by, *bounds, "improved", "errors"]
                shrunk = [F.when(right < left, points[0]).when(left < right, F.col("low")).otherwise(points[0]).alias("low"), F.when(left < right, points[1]).when(right < left, F.col("high")).otherwise(points[1]).alias("high")]
                tried = tried.select(*own, *shrunk, points[0].alias("left"), points[1].alias("right"))
                now = tried.drop("errors", "left", "right")
            value, error = F.when(left < right, F.col("left")).otherwise(F.col("right")), F.when(left < right, left).otherwise(right)
            better = F.coalesce(error < F.coalesce(F.col("errors")[2], F.lit(float("inf"))), F.lit(False))
            state = cut(tried.select(*by, *[F.when(better, value).otherwise(F.col(n)).alias(n) if n == name else n for n in bounds], (F.col("improved") | better).alias("improved")))
        if not state.where("improved").limit(1).count():
            break
    return _fitness(rows, state.select(*by, *bounds), by, model, bounds)


def _fitness(rows: DataFrame, state: DataFrame, by: list[str], model: Model, names: Bounds) -> DataFrame:
    scored = _step(rows, state, by, model, [{n: F.col(n) for n in names}])
    return scored.select(*by, *names, "n", F.sqrt(F.col("errors")[0]).alias("fitness"))


def solve_segments(inputs: DataFrame, own: Bounds, shared: Bounds, model: Model, by: list[str], steps: int = 5, rounds: int = 4) -> tuple[DataFrame, dict[str, float], float]:
    """Parameters ``own`` of each segment and ``shared`` of all: ((by, own, n, fitness), shared values, fitness of all).

    Grids of ``steps`` values a parameter, which shrink to the steps around the best. In a round every segment takes
    the best of its own grid with the shared values as they are (the middle at first), all segments in one aggregation;
    then the shared ones take the best of theirs with every segment's own, in another that gives one row. A row whose
    model gives no number does not count. An empty table has no segments, the middle of the shared bounds and no fitness.
    """
    rows = kept_rows(inputs, by)
    state = rows.select(*by).distinct().select(*by, *[F.lit(float(x)).alias(f"{n}_{k}") for n, ends in own.items() for k, x in zip(("low", "high"), ends, strict=True)])
    found = rows.select(*by, *[F.lit(0.0).alias(n) for n in own]).limit(0)
    values, around, total = {n: (low + high) / 2 for n, (low, high) in shared.items()}, dict(shared), float("nan")
    share = lambda i: i / (steps - 1)
    for _ in range(rounds):
        held = {n: F.lit(v) for n, v in values.items()}
        places = list(product(range(steps), repeat=len(own)))
        at = lambda n, i: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * i
        tried = _step(rows, state, by, model, [{n: at(n, share(i)) for n, i in zip(own, place, strict=True)} | held for place in places])
        best = F.coalesce(_least(F.col("errors")), F.lit(0))
        digit = lambda k: F.floor(F.col("best") / steps ** (len(own) - 1 - k)) % steps
        chosen = tried.withColumn("best", best).withColumns({n: at(n, digit(k) / (steps - 1)) for k, n in enumerate(own)})
        step = lambda n: (F.col(f"{n}_high") - F.col(f"{n}_low")) / (steps - 1)
        near = [c for n, (low, high) in own.items() for c in (F.greatest(F.lit(float(low)), F.col(n) - step(n)).alias(f"{n}_low"), F.least(F.lit(float(high)), F.col(n) + step(n)).alias(f"{n}_high"))]
        chosen = cut(chosen.select(*by, *own, *near))
        found, state = chosen.select(*by, *own), chosen.drop(*own)
        grid = [{n: low + (high - low) * share(i) for (n, (low, high)), i in zip(around.items(), place, strict=True)} for place in product(range(steps), repeat=len(shared))]
        known = {n: F.col(n) for n in own}
        gaps = [_gap(model(known | {n: F.lit(v) for n, v in t.items()})) for t in grid]
        errors = rows.join(found, by).agg(F.array(*[F.avg(g * g) for g in gaps])).first()[0]
        scored = [(e, k) for k, e in enumerate(errors) if e is not None]
        if not scored:
            break
        error, k = min(scored)
        values, total = grid[k], error**0.5
        for n, (low, high) in around.items():
            half = (high - low) / (steps - 1)
            around[n] = (max(shared[n][0], values[n] - half), min(shared[n][1], values[n] + half))
    fixed = {n: F.lit(v) for n, v in values.items()}
    return _fitness(rows, found, by, lambda t: model(t | fixed), own), values, total
