"""Pairs of levels of two signals by nearness in time and value, and the error of levels and times together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E

#: Neighbours in time on each side that are looked at first.
_NEAR = 16


def _nearest(t: np.ndarray, v: np.ndarray, times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (t, v) the first nearest of (times, values) by |dt| + |dv|; ``times`` ascend.

    Neighbours in time are looked at first. Where one beyond them could be as near, by its time alone, four times as
    many are, so the result is that of all pairs.
    """
    best, far = np.zeros(len(t), np.int64), np.full(len(t), np.inf)
    place, open_, width = np.searchsorted(times, t), np.arange(len(t)), _NEAR
    while len(open_):
        undecided = []
        for k in range(0, len(open_), max(1, (1 << 20) // (2 * width))):
            rows = open_[k : k + max(1, (1 << 20) // (2 * width))]
            low, high = np.maximum(place[rows] - width, 0), np.minimum(place[rows] + width, len(times))
            at = low[:, None] + np.arange(2 * width)
            inside = at < high[:, None]
            at = np.minimum(at, len(times) - 1)
            gap = np.where(inside, np.abs(t[rows, None] - times[at]) + np.abs(v[rows, None] - values[at]), np.inf)
            column = gap.argmin(axis=1)
            best[rows], far[rows] = at[np.arange(len(rows)), column], gap[np.arange(len(rows)), column]
            before = np.where(low > 0, np.abs(t[rows] - times[np.maximum(low - 1, 0)]), np.inf)
            after = np.where(high < len(times), np.abs(times[np.minimum(high, len(times) - 1)] - t[rows]), np.inf)
            undecided.append(rows[(before <= far[rows]) | (after < far[rows])])
        open_, width = np.concatenate(undecided), 4 * width
    return best, far


def nearest_pairs(events: DataFrame, reference: str, error: str) -> DataFrame:
    """(segment_id, t, expected, error_t, calculated) by rounds: each free reference level points to its nearest free
    error level, and each error level takes the nearest that points to it.

    What stays free counts too: a reference level against 0 at its own time, an error level against its distance
    to the segment's mean reference level. Rounds depend on each other, so a segment's levels of both signals are
    held by one task: some 100 bytes each, 10 million for a gigabyte; cut longer ones by ``cut_segments`` before. A
    segment without reference levels has no pairs.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "seq"])
        ref, err = rows[rows.is_ref], rows[~rows.is_ref]
        if not len(ref):
            return pd.DataFrame(columns=["segment_id", "t", "expected", "error_t", "calculated"])
        rt, rv, et, ev = (x.to_numpy(float) for x in (ref.t, ref.level, err.t, err.level))
        free_r, free_e, out = np.arange(len(rt)), np.arange(len(et)), []
        while len(free_r) and len(free_e):
            best, far = _nearest(rt[free_r], rv[free_r], et[free_e], ev[free_e])
            order = np.argsort(far, kind="stable")
            chosen, first = np.unique(best[order], return_index=True)
            pair = order[first]
            out += [(rt[r], rv[r], et[e], ev[e]) for r, e in zip(free_r[pair], free_e[chosen], strict=True)]
            free_r, free_e = np.delete(free_r, pair), np.delete(free_e, chosen)
        out += [(rt[r], rv[r], rt[r], 0.0) for r in free_r]
        out += [(et[e], abs(ev[e] - rv.mean()), et[e], ev[e]) for e in free_e]
        made = pd.DataFrame(out, columns=["t", "expected", "error_t", "calculated"])
        made.insert(0, "segment_id", key[0])
        return made

    rows = events.where(E.is_level() & F.col("signal_id").isin(reference, error) & F.col("level").isNotNull())
    rows = rows.select("segment_id", E.days().alias("t"), "level", "seq", (F.col("signal_id") == reference).alias("is_ref"))
    return rows.groupBy("segment_id").applyInPandas(run, "segment_id long, t double, expected double, error_t double, calculated double")


def temporal_error(pairs: DataFrame) -> DataFrame:
    """By segment: the mean level error, the mean time error scaled to the range of the expected levels, and their sum."""
    whole = Window.partitionBy("segment_id")
    lag = F.abs(F.col("error_t") - F.col("t"))
    rows = pairs.withColumn("lag", lag)
    rows = rows.withColumns({"l0": F.min("lag").over(whole), "l1": F.max("lag").over(whole), "e0": F.min("expected").over(whole), "e1": F.max("expected").over(whole)})
    scaled = F.when(F.col("l1") > F.col("l0"), F.col("e0") + (F.col("e1") - F.col("e0")) * (F.col("lag") - F.col("l0")) / (F.col("l1") - F.col("l0")))
    out = rows.groupBy("segment_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("expected") - F.col("calculated"))).alias("level_error"), F.avg(F.abs(scaled)).alias("time_error"))
    return out.withColumn("error", F.col("level_error") + F.col("time_error"))
