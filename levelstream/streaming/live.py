"""The operators on unbounded streams: event-time segments, statistics, smoothing and masking with state.

Late events are waited for as long as the watermark says; state of a segment goes when its timeout passes or its
stop marker comes. A stream that has ended gives what the batch operators give on the same events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from levelstream.operators import events as E

OUT = "segment_id long, signal_id string, device_time timestamp_ntz, seq long, level double, event_code string"


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    """Events with the time column ``at`` that streaming needs, and a watermark on it."""
    return events.withColumn("at", F.col("device_time").cast("timestamp")).withWatermark("at", delay)


def live_segments(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of each segment and signal that end after ``gap`` without a level: start, stop, n, mean."""
    rows = watermarked(events.where(E.is_level()), delay)
    return rows.groupBy("segment_id", "signal_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.avg("level").alias("avg_level")).select("segment_id", "signal_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "avg_level")


def live_stats(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Count, mean, population deviation and bounds of each signal in tumbling windows."""
    rows = watermarked(events.where(E.is_level()), delay)
    x = F.col("level")
    return rows.groupBy("signal_id", F.window("at", window).alias("w")).agg(F.count(x).alias("n"), F.avg(x).alias("avg"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most")).select("signal_id", F.col("w.start").alias("start"), "n", "avg", "sd", "least", "most")


def live_levels(events: DataFrame, delay: str) -> DataFrame:
    """The level events, each (segment, signal, time, seq) once, however often it is delivered within ``delay``."""
    return watermarked(events.where(E.is_level()), delay).dropDuplicatesWithinWatermark(["segment_id", "signal_id", "device_time", "seq"])


def _in_order(events: DataFrame, signal: str, delay: str, idle: str, start: tuple, types: str, step: Callable) -> DataFrame:
    """A stateful operator on a signal that sees the levels of each segment by time and seq, whatever order they come in.

    Levels wait in the state until the watermark, ``delay`` behind the latest level of the stream, has passed them;
    then ``step(state, rows)`` gives the new state and the rows out. All clocks are event time, so a stream that is
    replayed slowly or fast gives the same. A level that comes later than the watermark is dropped. A level more than
    ``idle`` after the one before it in its segment begins with the state ``start``; a state that nothing else can
    follow goes.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, last, micros, seqs, levels = state.get if state.exists else (*start, 0, [], [], [])
        held = pd.DataFrame({"micros": list(micros), "seq": list(seqs), "level": list(levels)})
        rows = pd.concat([held, *(b[["micros", "seq", "level"]] for b in batches)]).sort_values(["micros", "seq"], ignore_index=True)
        mark = state.getCurrentWatermarkMs()
        ready, rest = rows[rows.micros < mark * 1000], rows[rows.micros >= mark * 1000]
        if len(ready):
            gaps = (ready.micros // 1000).diff()
            gaps.iloc[0] = ready.micros.iloc[0] // 1000 - last
            made = []
            for fresh, part in ready.groupby((gaps > idle_ms).cumsum()):
                own, out = step(start if fresh or gaps.iloc[0] > idle_ms else tuple(own), part)
                made.append(out)
            last = int(ready.micros.iloc[-1] // 1000)
            made = pd.concat(made)
            made = made.assign(segment_id=key[0], signal_id=signal, device_time=pd.to_datetime(made["micros"], unit="us"))
            yield made[["segment_id", "signal_id", "device_time", "seq", "level", "event_code"]]
        if len(rest):
            wake = int(rest.micros.iloc[0] // 1000) + 1
        elif last + idle_ms < mark:
            if state.exists:
                state.remove()
            return
        else:
            wake = last + idle_ms
        state.update((*own, last, rest.micros.astype("int64").tolist(), rest.seq.astype("int64").tolist(), rest.level.astype("float64").tolist()))
        state.setTimeoutTimestamp(max(wake, mark + 1))

    mine = watermarked(events.where(E.is_level() & (F.col("signal_id") == signal) & F.col("level").isNotNull()), delay)
    rows = mine.select("segment_id", "at", E.micros().alias("micros"), "seq", "level")
    held = "last long, micros array<long>, seqs array<long>, levels array<double>"
    return rows.groupBy("segment_id").applyInPandasWithState(run, OUT, f"{types}, {held}", "append", GroupStateTimeout.EventTimeTimeout)


def live_mask(events: DataFrame, signal: str, bits: str, delay: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """The masking operator with the counter of each segment as state; the counter is 0 again after ``idle`` without a level."""
    bits = bits.replace(" ", "")

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (place,) = state
        codes = [E.MASKED if bits[k % len(bits)] == "0" else E.LEVEL for k in range(place, place + len(rows))]
        return ((place + len(rows)) % len(bits),), rows.assign(event_code=codes)

    return _in_order(events, signal, delay, idle, (0,), "place long", step)


def live_mean(events: DataFrame, signal: str, delay: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """The running mean of a signal's levels in each segment, with count and sum as state; both are 0 again after ``idle`` without a level."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n, total = state
        sums = total + rows["level"].cumsum()
        means = sums / (n + pd.Series(range(1, len(rows) + 1), index=rows.index))
        return (n + len(rows), float(sums.iloc[-1])), rows.assign(level=means, event_code=E.LEVEL)

    return _in_order(events, signal, delay, idle, (0, 0.0), "n long, total double", step)
