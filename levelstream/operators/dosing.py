"""Insulin delivery: scheduled doses, suspension on low levels, basal rates as small boluses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E


#: Doses of a schedule at most: it goes to every task.
MOST_DOSES = 10_000


def scheduled_boluses(segments: DataFrame, schedule: DataFrame, step_seconds: float) -> DataFrame:
    """Doses of a schedule (k, offset_seconds, dose; k from 0) in each segment (segment_id, start).

    Time goes in steps; a step delivers one dose at most, in the schedule's order, the first step at or after its
    offset that is free: step n of dose k is the greatest of ceil(offset j / step) + k - j over j <= k.
    """
    if schedule.limit(MOST_DOSES + 1).count() > MOST_DOSES:
        raise ValueError(f"a schedule has up to {MOST_DOSES} doses")
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    first = F.greatest(F.lit(1), F.ceil(F.col("offset_seconds") / step_seconds))
    steps = schedule.withColumn("step", F.max(first - F.col("k")).over(order) + F.col("k"))
    rows = segments.join(F.broadcast(steps))
    return rows.select("segment_id", "k", E.moved(F.col("start"), F.col("step") * F.lit(step_seconds)).alias("device_time"), F.col("dose").alias("level"))


def suspensions(levels: DataFrame, threshold: float, timeout_seconds: float) -> DataFrame:
    """(segment_id, start, stop): from a level at or under the threshold until a higher one or ``timeout`` after the last low one."""
    order = Window.partitionBy("segment_id").orderBy("device_time", "seq")
    t, wait = E.micros(), int(timeout_seconds * 1e6)
    rows = levels.withColumn("low", F.col("level") <= threshold)
    rows = rows.withColumns({"was_low": F.lag("low", 1, False).over(order), "since": t - F.lag(t).over(order), "next": F.lead("device_time").over(order)})
    rows = rows.where("low").withColumn("new", (~F.col("was_low") | (F.col("since") >= wait)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own_end = E.moved(F.col("device_time"), timeout_seconds)
    end = F.least(own_end, F.coalesce("next", own_end))
    return rows.groupBy("segment_id", "run").agg(F.min("device_time").alias("start"), F.max(end).alias("stop")).drop("run")


def suspended_rates(levels: DataFrame, threshold: float, timeout_seconds: float) -> DataFrame:
    """The rate 0 that each suspension requests, as levels."""
    return suspensions(levels, threshold, timeout_seconds).select("segment_id", F.col("start").alias("device_time"), F.lit(0.0).alias("level"))


def postponed(doses: DataFrame, stops: DataFrame) -> DataFrame:
    """Doses (segment_id, device_time, level) with those that fall into a suspension moved to its stop.

    Suspensions of a segment do not overlap, so the last one begun is the one that holds.
    """
    marks = stops.select("segment_id", F.col("start").alias("device_time"), F.col("stop"), F.lit(None).cast("double").alias("level"), F.lit(0).alias("kind"))
    both = marks.unionByName(doses.select("segment_id", "device_time", F.lit(None).cast("timestamp_ntz").alias("stop"), "level", F.lit(1).alias("kind")))
    order = Window.partitionBy("segment_id").orderBy("device_time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last("stop", ignorenulls=True).over(order)
    return both.withColumn("held", held).where("kind = 1").select("segment_id", F.greatest("device_time", "held").alias("device_time"), "level")


def rates_pack(segments: DataFrame, boluses: DataFrame, rates: DataFrame, initial_rate: float, levels: DataFrame, threshold: float, timeout_seconds: float, step_seconds: float) -> DataFrame:
    """Requests (segment_id, signal_id, device_time, level) of a pack: an initial basal rate, boluses and basal rates by
    schedule, and a rate of 0 for each suspension by low ``levels``, which puts off what is due meanwhile.

    Boluses and rates have schedules of their own (k, offset_seconds, dose), as scheduled_boluses takes them.
    """
    stops = suspensions(levels, threshold, timeout_seconds)
    first = segments.select("segment_id", E.moved(F.col("start"), step_seconds).alias("device_time"), F.lit(float(initial_rate)).alias("level"))
    due = lambda schedule: postponed(scheduled_boluses(segments, schedule, step_seconds), stops)
    named = lambda rows, name: rows.select("segment_id", F.lit(name).alias("signal_id"), "device_time", "level")
    basal = first.union(due(rates)).union(suspended_rates(levels, threshold, timeout_seconds))
    return named(basal, "Requested_Insulin_Basal_Rate").union(named(due(boluses), "Requested_Insulin_Bolus"))


def basal_and_bolus(events: DataFrame, carbs: str, basal_rate: float, carb_ratio: float) -> DataFrame:
    """Requests (segment_id, signal_id, device_time, level): the basal rate at a segment's first event, and a bolus of ratio times carbs with each intake."""
    first = events.groupBy("segment_id").agg(F.min("device_time").alias("device_time"))
    basal = first.select("segment_id", F.lit("Requested_Insulin_Basal_Rate").alias("signal_id"), "device_time", F.lit(float(basal_rate)).alias("level"))
    return basal.union(E.signal(events, carbs).select("segment_id", F.lit("Requested_Insulin_Bolus"), "device_time", F.col("level") * carb_ratio))


def basal_to_boluses(events: DataFrame, rate: str, minimum: float = 0.05, period_days: float = 5 / 1440) -> DataFrame:
    """Small boluses for a basal rate (units per hour), delivered at event times of the segment.

    A period's amount under ``minimum`` prolongs the period. A rise of the amount by more than the minimum gives
    the difference at once; a rate of 0 stops; a rate that is negative or no number changes nothing. A segment's
    deliveries depend on each other, so its events are held by one task; cut longer ones by ``cut_segments`` before.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        period = round(period_days * E.DAY * 1e6)
        amount, every, due, running, out = 0.0, period, 0, False, []
        for t, time, is_rate, level in zip(*(rows.sort_values(["t", "seq"])[c] for c in ("t", "device_time", "is_rate", "level")), strict=True):
            if is_rate and level == 0:
                running = False
            elif is_rate and 0 < level < float("inf"):
                before, amount = amount, level * period_days * 24
                stretch = max(1.0, minimum / amount)
                amount, every = amount * stretch, round(period * stretch)
                if not running:
                    due, running = t, True
                elif amount - before > minimum:
                    out.append((key[0], time, amount - before))
            if running and t >= due:
                out.append((key[0], time, amount))
                due = t + every
        return pd.DataFrame(out, columns=["segment_id", "device_time", "level"])

    rows = events.where(E.is_level()).select("segment_id", "device_time", E.micros().alias("t"), (F.col("signal_id") == rate).alias("is_rate"), "level", "seq")
    return rows.groupBy("segment_id").applyInPandas(run, "segment_id long, device_time timestamp_ntz, level double")
