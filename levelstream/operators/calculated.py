"""A calculated signal: a model with parameters that travel in the stream, evaluated ahead and at the measured times.

Parameters are events with an array that holds until the next one of the segment. Each input level asks for the
calculated level a prediction window later, each reference level for the level at its own time, and a time is
answered once. A level is known when the levels it reads are, and takes the parameters that hold then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import events as E
from .asof import bracket, line_value

#: Parameter vectors for all segments are literals of the plan; more are refused.
MOST_SHARED = 1000
_VECTOR = "struct<t:bigint,seq:bigint,parameters:array<double>>"
#: (parameters, levels by input) to a level.
Model = Callable[[Column, dict[str, Column]], Column]


def parameters_of(events: DataFrame, signal: str) -> DataFrame:
    """(segment_id, device_time, seq, parameters) of a signal's parameter events; a null segment means all segments."""
    return events.where((F.col("event_code") == E.PARAMETERS) & (F.col("signal_id") == signal) & F.col("parameters").isNotNull()).select("segment_id", "device_time", "seq", "parameters")


def _shared(parameters: DataFrame) -> Column:
    """The vectors for all segments, by time and seq, as an array."""
    rows = parameters.where("segment_id is null").select(E.micros().alias("t"), "seq", "parameters").orderBy("t", "seq").limit(MOST_SHARED + 1).collect()
    if len(rows) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} parameter vectors for all segments")
    vectors = [F.struct(F.lit(r.t).cast("long").alias("t"), F.lit(r.seq).cast("long").alias("seq"), F.array(*map(F.lit, r.parameters)).cast("array<double>").alias("parameters")) for r in rows]
    return F.array(*vectors) if vectors else F.array().cast(f"array<{_VECTOR}>")


def in_force(rows: DataFrame, parameters: DataFrame, default: list[float], name: str = "parameters") -> DataFrame:
    """``rows`` (segment_id, device_time, ...) with the last vector at or before their time, the segment's own or one for all; else ``default``.

    Of vectors of one time the last written holds. One union and one sort by segment; no row meets more than one
    vector of its segment.
    """
    own = parameters.where("segment_id is not null").groupBy("segment_id", "device_time").agg(F.max_by("parameters", "seq").alias("parameters"), F.max("seq").alias("seq"))
    found = bracket(rows, own, payload=F.struct(E.micros().alias("t"), "seq", "parameters"))
    common = F.try_element_at(F.filter(_shared(parameters), lambda p: p["t"] <= E.micros()), F.lit(-1))
    later = F.greatest(F.struct(F.col("before.t"), F.col("before.seq")), F.struct(common["t"], common["seq"]))
    mine = common.isNull() | (F.col("before").isNotNull() & (later == F.struct(F.col("before.t"), F.col("before.seq"))))
    chosen = F.when(mine, F.col("before.parameters")).otherwise(common["parameters"])
    return found.withColumn(name, F.coalesce(chosen, F.array(*map(F.lit, default)).cast("array<double>"))).drop("before", "after")


def asked_times(events: DataFrame, inputs: list[str], reference: str | None, window: float) -> DataFrame:
    """(segment_id, device_time, asked_at): each time that a level asks for, once, with the first time it was asked at."""
    levels = events.where(E.is_level() & F.col("level").isNotNull() & F.col("segment_id").isNotNull() & F.col("signal_id").isin(*inputs, *([reference] if reference else [])))
    now = F.col("device_time")
    times = F.array(E.moved(now, window * E.DAY), F.when(F.col("signal_id") == reference, now)) if reference else F.array(E.moved(now, window * E.DAY))
    each = levels.select("segment_id", now.alias("asked_at"), F.explode(F.array_distinct(times)).alias("device_time")).where("device_time is not null")
    return each.groupBy("segment_id", "device_time").agg(F.min("asked_at").alias("asked_at"))


def inputs_at(asked: DataFrame, events: DataFrame, inputs: dict[str, tuple[str, float]]) -> DataFrame:
    """``asked`` with the level of each input (signal, days before) and ``known_at``, when the last knot that it reads is there."""
    rows = asked.withColumn("at", F.col("device_time")).withColumn("known_at", F.col("asked_at"))
    for name, (signal, back) in inputs.items():
        moved = rows.withColumn("device_time", E.moved(F.col("at"), -back * E.DAY))
        found = bracket(moved, E.last_written(E.signal(events, signal)), payload=F.struct(E.micros().alias("t"), "level", "device_time"))
        rows = found.withColumn(name, line_value()).withColumn("known_at", F.greatest("known_at", "after.device_time")).drop("before", "after")
    return rows.withColumn("device_time", F.col("at")).drop("at")


def calculate(events: DataFrame, signal: str, inputs: dict[str, tuple[str, float]], model: Model, default: list[float], reference: str | None = None, window: float = 0.0) -> DataFrame:
    """(segment_id, device_time, level, parameters, known_at): the levels of ``signal`` that the events ask for and the inputs answer.

    A time that some input does not cover, or at which the model gives null or NaN, is not answered. Events of
    ``signal`` itself, levels without a segment and null levels ask nothing; an empty table gives an empty one.
    """
    asked = asked_times(events, [s for s, _ in inputs.values()], reference, window)
    rows = inputs_at(asked, events, inputs).select("segment_id", F.col("known_at").alias("device_time"), F.col("device_time").alias("at"), *inputs)
    rows = in_force(rows.where(" and ".join(f"{name} is not null" for name in inputs)), parameters_of(events, signal), default)
    level = model(F.col("parameters"), {name: F.col(name) for name in inputs}).cast("double")
    found = rows.select("segment_id", F.col("at").alias("device_time"), level.alias("level"), "parameters", F.col("device_time").alias("known_at"))
    return found.where(F.col("level").isNotNull() & ~F.isnan("level"))


def hint_fitness(rows: DataFrame, hints: DataFrame, model: Model, names: list[str], default: list[float]) -> DataFrame:
    """(segment_id, seq, device_time, parameters, n, fitness) of each vector on the levels of its segment.

    ``rows`` has segment_id, expected and the inputs ``names``; ``hints`` is as of ``parameters_of``. Vectors for all
    segments and the default (null seq) are scored on each segment. The fitness is the mean absolute error; errors
    combine before they shuffle. A segment without rows scores nothing.
    """
    own = hints.where("segment_id is not null").groupBy("segment_id").agg(F.collect_list(F.struct(E.micros().alias("t"), "seq", "parameters")).cast(f"array<{_VECTOR}>").alias("own"))
    plain = F.array(F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("seq"), F.array(*map(F.lit, default)).cast("array<double>").alias("parameters")))
    each = F.concat(F.coalesce("own", F.array().cast(f"array<{_VECTOR}>")), _shared(hints), plain)
    tried = rows.join(own, "segment_id", "left").select("segment_id", "expected", *names, F.explode(each).alias("hint"))
    gap = F.abs(F.col("expected") - model(F.col("hint.parameters"), {n: F.col(n) for n in names}))
    scored = tried.groupBy("segment_id", "hint").agg(F.count(gap).alias("n"), F.avg(gap).alias("fitness"))
    return scored.select("segment_id", "hint.seq", F.timestamp_micros("hint.t").cast("timestamp_ntz").alias("device_time"), "hint.parameters", "n", "fitness")


def best_hints(scored: DataFrame) -> DataFrame:
    """Of each segment the vector of least fitness, of equals the earliest; the default only if it is better than all."""
    order = F.struct("fitness", F.col("device_time").isNull(), "device_time", "seq")
    best = F.min_by(F.struct("seq", "device_time", "parameters", "n", "fitness"), F.when(F.col("fitness").isNotNull(), order))
    return scored.groupBy("segment_id").agg(best.alias("best")).select("segment_id", "best.*")


def improving(scored: DataFrame) -> DataFrame:
    """The vectors that a segment takes if it takes only those that are better than all it has had, the default first."""
    before = Window.partitionBy("segment_id").orderBy(F.col("device_time").asc_nulls_first(), "seq").rowsBetween(Window.unboundedPreceding, -1)
    known = scored.withColumn("least", F.min("fitness").over(before))
    return known.where((F.col("seq").isNotNull()) & (F.col("fitness") < F.coalesce("least", F.lit(float("inf"))))).drop("least")
