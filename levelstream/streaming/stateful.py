"""Functions with a memory that see the levels of a segment in order, on tables and on streams alike.

A function gets its memory (a dict of JSON values, empty at first) and the levels of one instant, by seq, and returns
what is to be sent on: the levels as they are, changed, none of them, or others besides. Time_Segment_Stop and
Warm_Reset of a segment empty its memory. On a table a task walks its rows in order and holds one instant; on a stream
rows wait in state until the watermark has passed them, so late and shuffled rows give the same. Streams need a
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from levelstream.operators import events as E

OUT = "segment_id long, signal_id string, device_time timestamp_ntz, seq long, level double, parameters array<double>"
ENDS = (E.STOP, "Warm_Reset")
_ROW = ["micros", "seq", "event_code", "signal_id", "level"]
_NAMES = ["segment_id", "signal_id", "device_time", "seq", "level", "parameters"]


class Level(NamedTuple):
    """A level in or out; ``slope`` (per day, from the signal's level before) is None at the first and where time does not advance."""

    signal: str
    micros: int
    seq: int
    level: float
    slope: float | None = None
    parameters: list[float] | None = None


Function = Callable[[dict, list[Level]], Iterable[Level]]


class Memory:
    """What a segment's function knows, and the last level of each signal."""

    def __init__(self, own: dict | None = None, last: dict[str, tuple[int, float]] | None = None):
        self.own, self.last = own or {}, last or {}

    def run(self, function: Function, rows: list[tuple]) -> list[Level]:
        """The rows (micros, seq, event_code, signal_id, level) of one instant, sorted by seq, through the function."""
        sent: list[Level] = []
        levels: list[Level] = []
        for micros, seq, code, signal, level in rows:
            if code in ENDS:
                sent += function(self.own, levels) if levels else []
                self.own, self.last, levels = {}, {}, []
                continue
            before = self.last.get(signal)
            slope = (level - before[1]) / (micros - before[0]) * E.DAY * 1e6 if before and micros > before[0] else None
            self.last[signal] = (micros, level)
            levels.append(Level(signal, micros, seq, level, slope))
        return [*sent, *(function(self.own, levels) if levels else [])]


def _rows_of(events: DataFrame, signals: list[str] | None) -> DataFrame:
    """The rows that a function sees, with whole microseconds; null levels and rows without segment or time are no rows."""
    code = F.col("event_code")
    mine = E.is_level() & F.col("level").isNotNull() & (F.col("signal_id").isin(*signals) if signals else F.col("signal_id").isNotNull())
    wanted = events.where((mine | code.isin(*ENDS)) & F.col("segment_id").isNotNull() & F.col("device_time").isNotNull())
    return wanted.withColumn("micros", E.micros())


def _frames(sent: list[tuple[int, Level]]) -> pd.DataFrame:
    rows = [(s, x.signal, pd.Timestamp(x.micros, unit="us"), x.seq, x.level, x.parameters) for s, x in sent]
    return pd.DataFrame(rows, columns=_NAMES)


def replay(events: DataFrame, function: Function, signals: list[str] | None = None) -> DataFrame:
    """What ``function`` sends for the levels of ``signals`` (all, if none), by segment, time and seq.

    One shuffle by segment and a sort; a task holds the rows of one instant. An empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, instant, memory, held = None, None, Memory(), []
        for batch in batches:
            sent: list[tuple[int, Level]] = []
            for own, *row in batch.itertuples(index=False):
                if held and (own != segment or row[0] != instant):
                    sent += [(segment, x) for x in memory.run(function, held)]
                    held = []
                if own != segment:
                    segment, memory = own, Memory()
                instant = row[0]
                held.append(tuple(row))
            if sent:
                yield _frames(sent)
        if held:
            yield _frames([(segment, x) for x in memory.run(function, held)])

    rows = _rows_of(events, signals).select("segment_id", *_ROW).repartition("segment_id").sortWithinPartitions("segment_id", "micros", "seq")
    return rows.mapInPandas(run, OUT)


class _Live(StatefulProcessor):
    """Rows wait in a list; the memory is a value, the last levels a map; a timer wakes the segment when rows are due."""

    def __init__(self, function: Function):
        self.function = function

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "micros long, seq long, event_code string, signal_id string, level double")
        self.memory = handle.getValueState("memory", "own string")
        self.last = handle.getMapState("last", "signal string", "micros long, level double")

    def _due(self, segment: int, new: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        rows = sorted([*held, *new], key=lambda r: (r[0], r[1]))
        ready, rest = [r for r in rows if r[0] < mark * 1000], [r for r in rows if r[0] >= mark * 1000]
        if ready:
            own = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
            memory = Memory(own, {k[0]: tuple(v) for k, v in self.last.iterator()} if self.last.exists() else {})
            sent, at = [], 0
            while at < len(ready):
                end = at
                while end < len(ready) and ready[end][0] == ready[at][0]:
                    end += 1
                sent += memory.run(self.function, ready[at:end])
                at = end
            self.last.clear()
            for signal, (micros, level) in memory.last.items():
                self.last.updateValue((signal,), (micros, level))
            if memory.own:
                self.memory.update((json.dumps(memory.own),))
            else:
                self.memory.clear()
            if sent:
                yield _frames([(segment, x) for x in sent])
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for batch in rows for r in batch[_ROW].itertuples(index=False)]
        new = [(int(m), int(s), c, g, None if v is None or v != v else float(v)) for m, s, c, g, v in new]
        yield from self._due(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live(events: DataFrame, function: Function, delay: str, signals: list[str] | None = None) -> DataFrame:
    """``replay`` on a stream: what comes up to ``delay`` after the latest row of the stream is still put in order; later rows are dropped.

    The state of a segment holds the rows that the watermark has not passed, its memory and its last levels; the latter
    two end with the segment.
    """
    rows = _rows_of(events, signals).withColumn("at", F.col("device_time").cast("timestamp")).withWatermark("at", delay)
    return rows.groupBy("segment_id").transformWithStateInPandas(statefulProcessor=_Live(function), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def pairing(reference: str, calculated: str) -> Function:
    """A function that sends each reference level with the calculated signal's line at its time, and the mean absolute gap so far.

    The reference levels since the last knot wait in the memory until the next knot closes the bracket; those before
    the first knot have none. The level sent is the running mean; ``parameters`` has the expected and calculated levels.
    """

    def run(memory: dict, levels: list[Level]) -> list[Level]:
        sent: list[Level] = []

        def pair(micros: int, seq: int, expected: float, value: float) -> None:
            memory["n"], memory["total"] = memory.get("n", 0) + 1, memory.get("total", 0.0) + abs(expected - value)
            sent.append(Level("metric", micros, seq, memory["total"] / memory["n"], None, [expected, value]))

        knots = [x for x in levels if x.signal == calculated]
        if knots:  # of one time the last written
            knot, before = knots[-1], memory.get("knot")
            if before:
                slope = (knot.level - before[1]) / (knot.micros - before[0])
                for micros, seq, expected in memory.get("waiting", []):
                    pair(micros, seq, expected, before[1] + (micros - before[0]) * slope)
            memory["waiting"], memory["knot"] = [], [knot.micros, knot.level]
        for x in levels:
            if x.signal == reference and "knot" in memory:
                if memory["knot"][0] == x.micros:
                    pair(x.micros, x.seq, x.level, memory["knot"][1])
                else:
                    memory["waiting"].append([x.micros, x.seq, x.level])
        return sent

    return run
