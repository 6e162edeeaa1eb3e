"""Operators over the order of a signal: smoothing, periods, episodes, segments, markers, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E
from .asof import bracket
from .routing import condition


def series() -> Window:
    return Window.partitionBy("segment_id", "signal_id").orderBy("device_time", "seq")


def _trailing(seconds: float | None) -> Window:
    by = Window.partitionBy("segment_id", "signal_id")
    if seconds is None:
        return by.orderBy("device_time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return by.orderBy(E.micros()).rangeBetween(-int(seconds * 1e6), 0)


def mean_response(events: DataFrame, signal: str, seconds: float | None) -> DataFrame:
    """Each level becomes the mean of the levels of the last ``seconds``, its own time included; None: of all so far."""
    mine = events.where(E.is_level() & (F.col("signal_id") == signal))
    return mine.withColumn("level", F.avg("level").over(_trailing(seconds)))


def median_response(events: DataFrame, signal: str, seconds: float | None) -> DataFrame:
    """As mean_response, with the median; of an even number the middle of the two."""
    mine = events.where(E.is_level() & (F.col("signal_id") == signal))
    return mine.withColumn("level", F.percentile("level", 0.5).over(_trailing(seconds)))


def periods(events: DataFrame) -> DataFrame:
    """(segment_id, signal_id, device_time, period): days since the level before; the first has none and is left out."""
    gap = (E.micros() - F.lag(E.micros()).over(series())) / (E.DAY * 1e6)
    return events.where(E.is_level()).select("segment_id", "signal_id", "device_time", "seq", gap.alias("period")).where("period is not null")


def episodes(events: DataFrame, signal: str, when: str) -> DataFrame:
    """Runs of level events that meet ``when``: segment_id, first_time, last_time, n_levels, duration (days).

    The borders of an episode are the middles to its neighbours (at the segment's start the first time itself); an
    episode that is open at the end of its segment is left out.
    """
    order = Window.partitionBy("segment_id").orderBy("device_time", "seq")
    rows = events.where(E.is_level() & (F.col("signal_id") == signal)).withColumn("t", E.micros()).withColumn("hit", condition(when))
    rows = rows.withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order), "new": (F.col("hit") != F.lag("hit", 1, False).over(order)).cast("int")})
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("hit").groupBy("segment_id", "run").agg(
        F.min("device_time").alias("first_time"),
        F.max("device_time").alias("last_time"),
        F.count("*").alias("n_levels"),
        F.min(F.coalesce((F.col("before") + F.col("t")) / 2, F.col("t"))).alias("low"),
        F.max(F.struct("t", F.col("seq"), "after")).alias("end"),
    )
    return runs.where("end.after is not null").select("segment_id", "first_time", "last_time", "n_levels", (((F.col("end.t") + F.col("end.after")) / 2 - F.col("low")) / (E.DAY * 1e6)).alias("duration"))


def cut_segments(levels: DataFrame, leading: str, gap_seconds: float, least: int, required: str | None = None) -> DataFrame:
    """Give rows (source key segment_id) a new part number: a part ends when a time is over ``gap_seconds`` after the last level of ``leading``.

    Only parts with ``least`` levels of the leading signal, and one of ``required`` if given, are kept.
    """
    order = Window.partitionBy("segment_id").orderBy("device_time", "seq")
    micros = E.micros()
    leads = F.when(F.col("signal_id") == leading, micros)
    last = F.last(leads, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = levels.withColumn("broken", F.coalesce((micros > last + int(gap_seconds * 1e6)).cast("int"), F.lit(0)))
    # After a break the clock is the next leading level, so a run of other signals breaks once.
    rows = rows.withColumn("broken", F.when((F.col("broken") == 1) & (F.lag("broken", 1, 0).over(order) == 1) & (F.lag("signal_id").over(order) != leading), 0).otherwise(F.col("broken")))
    rows = rows.withColumn("part", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("segment_id", "part")
    rows = rows.withColumn("leads", F.count_if(F.col("signal_id") == leading).over(whole))
    keep = F.col("leads") >= least
    if required is not None:
        rows = rows.withColumn("has", F.count_if(F.col("signal_id") == required).over(whole))
        keep = keep & (F.col("has") > 0)
    return rows.where(keep).drop("broken", "leads", "has")


def with_markers(events: DataFrame) -> DataFrame:
    """The events with a start and a stop marker for each segment, at its first and last level."""
    ends = events.where(E.is_level()).groupBy("segment_id").agg(F.min("device_time").alias("low"), F.max("device_time").alias("high"))
    marks = ends.select("segment_id", F.explode(F.array(F.struct(F.lit(E.START).alias("code"), F.col("low").alias("time")), F.struct(F.lit(E.STOP).alias("code"), F.col("high").alias("time")))).alias("m"))
    marks = marks.select(F.col("m.code").alias("event_code"), F.col("m.time").alias("device_time"), "segment_id")
    return events.unionByName(marks, allowMissingColumns=True)


def replay_order() -> list:
    """The order of a replayed log: time, segment, start first, stop last, source order."""
    rank = F.when(F.col("event_code") == E.START, 0).when(F.col("event_code") == E.STOP, 2).otherwise(1)
    return [F.col("device_time"), F.col("segment_id"), rank, F.col("seq")]


def replay(events: DataFrame) -> DataFrame:
    """A log as it would be replayed: shut-downs and old markers dropped, markers anew; ``place`` counts within the segment."""
    body = events.where(~F.col("event_code").isin(E.SHUT_DOWN, E.START, E.STOP))
    order = Window.partitionBy("segment_id").orderBy(*[c for c in replay_order() if c is not None])
    return with_markers(body).withColumn("place", F.row_number().over(order))


def intervals_to_levels(intervals: DataFrame, base: DataFrame) -> DataFrame:
    """Temporary rates (segment_id, start, stop, level) over a base rate (segment_id, device_time, level).

    At its start the temporary level holds; at its stop the base level of that time is restored, unless a later
    interval has begun meanwhile, which cancels the earlier one.
    """
    order = Window.partitionBy("segment_id").orderBy("start")
    rows = intervals.withColumn("next", F.lead("start").over(order))
    starts = rows.select("segment_id", F.col("start").alias("device_time"), "level", F.lit("temporary").alias("origin"))
    stops = rows.where(F.col("next").isNull() | (F.col("next") > F.col("stop"))).select("segment_id", F.col("stop").alias("device_time"))
    knots = base.select("segment_id", "device_time", F.col("level").alias("known"), F.lit(0).alias("asked"))
    asked = stops.select("segment_id", "device_time", F.lit(None).cast("double").alias("known"), F.lit(1).alias("asked"))
    known = F.last("known", ignorenulls=True).over(Window.partitionBy("segment_id").orderBy("device_time"))
    restored = knots.union(asked).withColumn("level", known).where("asked = 1 and level is not null").select("segment_id", "device_time", "level", F.lit("base").alias("origin"))
    return starts.union(restored)


def interval_ends(intervals: DataFrame, clock: DataFrame, level: float) -> DataFrame:
    """Levels that end intervals (segment_id, start, stop): ``level`` at the stop of each that the stream outlives.

    Ends are seen when a row of ``clock`` (segment_id, device_time) comes at or after them; an interval that begins
    until then takes the place of the earlier one.
    """
    order = Window.partitionBy("segment_id").orderBy("start")
    asked = intervals.select("segment_id", F.greatest("start", "stop").alias("device_time"), "start", "stop", F.lead("start").over(order).alias("next"))
    knots = clock.select("segment_id", "device_time").distinct().withColumn("level", F.lit(0.0))
    seen = bracket(asked, knots).where("after is not null")
    kept = seen.where(F.col("next").isNull() | (E.micros("next") > F.col("after.t")))
    return kept.select("segment_id", F.col("stop").alias("device_time"), F.lit(level).alias("level"))


def resolved_intervals(events: DataFrame) -> DataFrame:
    """The level events of a device's stream with its helper signals resolved and left out.

    Physical_Activity_Duration (days) ends an activity with level 1, the basal metabolism. Sleep_Endtime (days since
    1970) starts the sleep of the Sleep_Quality at its time, and ends it with 0. Insulin_Temp_Rate until
    Insulin_Temp_Rate_Endtime sets a rate, and restores the last Requested_Insulin_Basal_Rate; a new basal rate without a
    temporary one ends that.
    """
    named = lambda n: E.last_written(E.signal(events, n)).select("segment_id", "device_time", "level")
    clock = events.select("segment_id", "device_time")
    at_days = lambda c: F.timestamp_micros(F.round(c * (E.DAY * 1e6)).cast("long")).cast("timestamp_ntz")
    row = lambda df, n: df.select(F.lit(E.LEVEL).alias("event_code"), F.lit(n).alias("signal_id"), "device_time", "segment_id", "level")
    both = lambda a, b: named(a).withColumnRenamed("level", "value").join(named(b), ["segment_id", "device_time"])

    active = named("Physical_Activity_Duration").select("segment_id", F.col("device_time").alias("start"), E.moved(F.col("device_time"), F.col("level") * E.DAY).alias("stop"))
    asleep = both("Sleep_Quality", "Sleep_Endtime")
    sleeps = asleep.select("segment_id", F.col("device_time").alias("start"), at_days(F.col("level")).alias("stop"))
    temporary, basal = both("Insulin_Temp_Rate", "Insulin_Temp_Rate_Endtime"), named("Requested_Insulin_Basal_Rate")
    plain = basal.join(temporary, ["segment_id", "device_time"], "left_anti")
    # A plain basal rate is an interval without an end, so it takes the place of a temporary one.
    spans = temporary.select("segment_id", F.col("device_time").alias("start"), at_days(F.col("level")).alias("stop"))
    spans = spans.union(plain.select("segment_id", "device_time", F.lit("9999-01-01").cast("timestamp_ntz")))
    ends = interval_ends(spans, clock, 0.0).select("segment_id", "device_time")
    restored = bracket(ends, basal).where("before is not null").select("segment_id", "device_time", F.col("before.level").alias("level"))
    silent = ["Physical_Activity_Duration", "Insulin_Temp_Rate", "Insulin_Temp_Rate_Endtime", "Sleep_Endtime", "Sleep_Quality", "Requested_Insulin_Basal_Rate"]
    body = events.where(E.is_level() & ~F.col("signal_id").isin(silent)).select("event_code", "signal_id", "device_time", "segment_id", "level")
    rates = [row(temporary.drop("level").withColumnRenamed("value", "level"), "Requested_Insulin_Basal_Rate"), row(plain, "Requested_Insulin_Basal_Rate"), row(restored, "Requested_Insulin_Basal_Rate")]
    others = [row(interval_ends(active, clock, 1.0), "Physical_Activity"), row(asleep.drop("level").withColumnRenamed("value", "level"), "Sleep_Quality"), row(interval_ends(sleeps, clock, 0.0), "Sleep_Quality")]
    for part in (*rates, *others):
        body = body.unionByName(part)
    return body
