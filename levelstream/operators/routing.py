"""Operators that rename, drop, copy or change events one by one, or by their place in a signal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import events as E


def condition(text: str) -> Column:
    """A filter condition in the reference's spelling as a column.

    && || ! and ^ (exclusive or, of conditions in parentheses) are spelled out and the rest is Spark SQL; the names
    level, is_level_event, is_info_event and is_control_event are those of the event. Null is false.
    """
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    names = {"is_level_event": f"(event_code = '{E.LEVEL}')", "is_info_event": f"(event_code in ({quoted(E.INFO)}))", "is_control_event": f"(event_code in ({quoted(E.CONTROL)}))"}
    text = re.sub(r"!(?!=)", " not ", text.replace("&&", " and ").replace("||", " or ").replace("^", " <> "))
    text = re.sub(r"\b(is_\w+_event)\b", lambda m: names.get(m[1], m[1]), text)
    return F.coalesce(F.expr(text), F.lit(False))


def map_signal(events: DataFrame, source: str, to: str | None) -> DataFrame:
    """Rename a signal; to nothing drops its events, except a shut-down."""
    mine = F.coalesce(F.col("signal_id") == source, F.lit(False))
    if to is None:
        return events.where(~mine | (F.col("event_code") == E.SHUT_DOWN))
    return events.withColumn("signal_id", F.when(mine, F.lit(to)).otherwise(F.col("signal_id")))


def decouple(events: DataFrame, source: str | None, to: str | None, when: str, copy: bool = False) -> DataFrame:
    """Events of ``source`` (None: of any signal) that meet ``when`` move to ``to``, are copied there, or are dropped (to None)."""
    mine = condition(when)
    if source is not None:
        mine = mine & F.coalesce(F.col("signal_id") == source, F.lit(False))
    if to is None:
        return events.where(~mine)
    if copy:
        both = F.when(mine, F.array(F.col("signal_id"), F.lit(to))).otherwise(F.array("signal_id"))
        return events.withColumn("signal_id", F.explode(both))
    return events.withColumn("signal_id", F.when(mine, F.lit(to)).otherwise(F.col("signal_id")))


def _order() -> Window:
    return Window.partitionBy("segment_id", "signal_id").orderBy("device_time", "seq")


def mask(events: DataFrame, signal: str, bits: str) -> DataFrame:
    """Hide the level events of a signal whose place in the segment has a 0 in the repeating mask of 8 to 64 bits."""
    bits = bits.replace(" ", "")
    if not 8 <= len(bits) <= 64 or set(bits) - {"0", "1"}:
        raise ValueError("a mask has 8 to 64 digits 0 and 1")
    mine = E.is_level() & (F.col("signal_id") == signal)
    place = F.row_number().over(Window.partitionBy("segment_id").orderBy("device_time", "seq"))
    hidden = F.substring(F.lit(bits), F.col("place") % len(bits) + 1, F.lit(1)) == "0"
    masked = events.where(mine).withColumn("place", (place - 1).cast("int")).withColumn("event_code", F.when(hidden, F.lit(E.MASKED)).otherwise(F.col("event_code"))).drop("place")
    return masked.unionByName(events.where(~F.coalesce(mine, F.lit(False))))


def unmask(events: DataFrame, signal: str) -> DataFrame:
    return events.withColumn("event_code", F.when((F.col("event_code") == E.MASKED) & (F.col("signal_id") == signal), F.lit(E.LEVEL)).otherwise(F.col("event_code")))


def add_noise(events: DataFrame, signal: str, most: float = 1.0, seed: int = 1) -> DataFrame:
    """Add uniform noise from -most to most, drawn from a digest of (seed, segment, seq), so reruns and retries agree."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(seed), "segment_id", "seq")), 1, 12)
    unit = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))
    mine = E.is_level() & (F.col("signal_id") == signal)
    return events.withColumn("level", F.when(mine, F.col("level") + (unit * 2 - 1) * most).otherwise(F.col("level")))


def drop_repeats(events: DataFrame) -> DataFrame:
    """Drop a level equal to the one before it in its segment and signal."""
    before = F.lag("level").over(_order())
    return events.where(E.is_level()).withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("level"))).drop("before")


def boluses_of_carbs(events: DataFrame, carbs: str, bolus: str, ratio: float) -> DataFrame:
    """For each carbohydrate intake also the bolus of carbs times ratio at the same time."""
    mine = E.is_level() & (F.col("signal_id") == carbs)
    return events.unionByName(events.where(mine).withColumns({"signal_id": F.lit(bolus), "level": F.col("level") * ratio}))


def with_last(events: DataFrame, signals: list[str]) -> DataFrame:
    """Each level event with the last level, time and slope (per day) of each signal: what a script per level needs.

    Columns are NAME_level, NAME_time and NAME_slope; the event itself counts for its own signal.
    """
    own, all_ = _order(), Window.partitionBy("segment_id").orderBy("device_time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where(E.is_level()).withColumn("last_slope", (F.col("level") - F.lag("level").over(own)) / (E.micros() - F.lag(E.micros()).over(own)) * (E.DAY * 1e6))
    marks = {s: F.last(F.when(F.col("signal_id") == s, F.struct("level", "device_time", "last_slope")), ignorenulls=True).over(all_) for s in signals}
    rows = rows.withColumns({f"{s}_last": m for s, m in marks.items()})
    parts = {"level": "level", "time": "device_time", "slope": "last_slope"}
    return rows.withColumns({f"{s}_{k}": F.col(f"`{s}_last`")[v] for s in signals for k, v in parts.items()}).drop("last_slope", *[f"{s}_last" for s in signals])
