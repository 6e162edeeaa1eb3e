"""Averaged exponentials: a smooth signal by repeated halving of the intervals between knots.

A pass puts a point into the middle of each interval and smooths the inner points: each is the mean of what the curve
of the point before it and its own say, where the curve of a point goes from it towards the second next (of the last
but one, the next). The curve is exponential, of levels lifted by OFFSET so that they are positive, or a line.

A pass doubles the points, so they are never made for a whole signal: the value at a time depends on the four points
on each side of it in every pass. Each asked time takes its eight knots along and halves only its own surroundings,
in numpy for a batch of asked times at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E
from .asof import bracket

OFFSET = 10_000.0
#: Points on each side of an asked time that its value depends on.
SIDE = 4


class _Points:
    """The points (t, y) around each of many asked times, a row for each: ``count`` of them, and whether the last is the last of the signal."""

    def __init__(self, t, y, count, end, at, kind: str):
        self.t, self.y, self.count, self.end, self.at, self.kind = t, y, count, end, at, kind

    def before(self):
        """How many points are before the time."""
        return ((self.t < self.at[:, None]) & (np.arange(self.t.shape[1]) < self.count[:, None])).sum(axis=1)

    def pick(self, values, i):
        return np.take_along_axis(values, np.clip(i, 0, self.count[:, None] - 1), axis=1)

    def curve(self, i, at):
        """What the curve of point i, which goes from it towards the second next, says at a time."""
        last = self.count[:, None] - 1
        towards = np.where(self.end[:, None] & (i == last - 1), i + 1, np.minimum(i + 2, last))
        (t, y), (t2, y2) = ((self.pick(self.t, k), self.pick(self.y, k)) for k in (i, towards))
        if self.kind == "exp":
            share = y2 / y
            rate = np.log(np.where(np.isfinite(share) & (share > 0), share, np.nan)) / (t2 - t)
        else:
            rate = (y2 - y) / (t2 - t)
        rate = np.where(t2 == t, 0.0, rate)
        return y * np.exp(rate * (at - t)) if self.kind == "exp" else y + rate * (at - t)

    def near(self) -> _Points:
        """The points on both sides of the time, as far as there are SIDE."""
        before = np.maximum(self.before() - 1, 0)
        first = np.maximum(before - (SIDE - 1), 0)
        upto = np.minimum(before + SIDE, self.count - 1)
        i = np.minimum(first[:, None] + np.arange(2 * SIDE), upto[:, None])
        return _Points(self.pick(self.t, i), self.pick(self.y, i), upto - first + 1, self.end & (before + SIDE >= self.count - 1), self.at, self.kind)

    def halved(self) -> _Points:
        """The points of the next pass around the time."""
        i, last = np.broadcast_to(np.arange(self.t.shape[1]), self.t.shape), self.count[:, None] - 1
        middle = (self.t + self.pick(self.t, i + 1)) * 0.5
        single = (i == 0) | (self.end[:, None] & (i == last - 1))
        own = np.where(single | (i == last), self.y, (self.curve(i - 1, self.t) + self.y) * 0.5)
        alone = self.curve(i, middle)
        between = np.where(single, alone, (self.curve(i - 1, middle) + alone) * 0.5)
        t, y = (np.stack(pair, axis=2).reshape(len(self.t), -1) for pair in ((self.t, middle), (own, between)))
        return _Points(t, y, 2 * self.count - 1, self.end, self.at, self.kind).near()

    def value(self):
        after, at = self.before()[:, None], self.at[:, None]  # the first point at the time or later
        before = self.curve(after - 1, at)
        both = np.where(self.end[:, None] & (after == self.count[:, None] - 1), before, (before + self.curve(after, at)) * 0.5)
        return np.where(after == 0, self.y[:, :1], both)[:, 0]


def _smoothed(passes: int, kind: str):
    """A function of asked times, the knots around each and whether the last of them is the last of the signal, to the values there."""

    @F.pandas_udf("double")
    def smoothed(at: pd.Series, times: pd.Series, levels: pd.Series, last: pd.Series) -> pd.Series:
        count = np.array([len(x) for x in times], dtype=np.int64)
        filled = np.arange(2 * SIDE) < count[:, None]
        t, y = np.full(filled.shape, np.nan), np.full(filled.shape, np.nan)
        if filled.any():
            t[filled], y[filled] = np.concatenate(list(times)), np.concatenate(list(levels))
        with np.errstate(all="ignore"):
            points = _Points(t, y, np.maximum(count, 1), last.to_numpy(dtype=bool), at.to_numpy(), kind).near()
            for _ in range(passes):
                points = points.halved()
            return pd.Series(points.value())

    return smoothed


def averaged(asked: DataFrame, knots: DataFrame, passes: int = 10, kind: str = "exp", name: str = "value") -> DataFrame:
    """``asked`` with the smoothed signal of ``knots`` (segment_id, device_time, level; one a time) at its times.

    ``kind`` is ``exp`` or ``line``. Null outside the knots, and where a segment has fewer than two; a level of
    -OFFSET or less has no logarithm and gives null around it. An empty table gives an empty one.
    """
    if kind not in ("exp", "line"):
        raise ValueError(f"no such curve: {kind}")
    order = Window.partitionBy("segment_id").orderBy("device_time")
    point = F.struct(E.days().alias("t"), (F.col("level") + (OFFSET if kind == "exp" else 0.0)).cast("double").alias("y"))
    around = F.array(*[F.lag(point, k).over(order) for k in range(SIDE - 1, 0, -1)], point, *[F.lead(point, k).over(order) for k in range(1, SIDE + 1)])
    last = F.lead(F.lit(True), SIDE + 1).over(order).isNull()
    first = F.lag(F.lit(True)).over(order).isNull()
    marked = knots.withColumns({"around": F.filter(around, lambda p: p.isNotNull()), "last": last, "lone": first & F.lead(F.lit(True)).over(order).isNull()})
    found = bracket(asked, marked, payload=F.struct(E.days().alias("t"), "around", "last", "lone"))
    at = E.days()
    inside = F.col("after").isNotNull() & ~F.col("before.lone")
    none = F.array().cast("array<double>")
    value = _smoothed(passes, kind)(at, *[F.coalesce(f"before.around.{c}", none) for c in "ty"], F.coalesce("before.last", F.lit(False)))
    value = value - OFFSET if kind == "exp" else value
    return found.withColumn(name, F.when(inside, F.nanvl(value, F.lit(None).cast("double")))).drop("before", "after")
