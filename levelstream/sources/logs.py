"""The text log: events as lines of nine fields, and back; sinks of levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelstream.operators import events as E
from levelstream.operators.windows import replay

TIME = "yyyy-MM-dd HH:mm:ss.SSS"
FIELDS = ("seq", "device_time", "event_code", "signal_id", "payload", "segment_id", "code", "device_id", "signal_guid")


def payload() -> Column:
    """The live arm of an event: level, parameters joined by spaces, or info."""
    level = F.col("level").cast("string")
    return F.coalesce(level, F.array_join(F.transform("parameters", lambda x: x.cast("string")), " "), F.col("info"), F.lit(""))


def lines(events: DataFrame, reduced: bool = False) -> DataFrame:
    """One column ``value``: the line of each event; a null is an empty field.

    A reduced log leaves source order and names empty, which the later fields tell as well, and events that say nothing out.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = lambda c: F.lit("") if reduced else text(c)
    if reduced:
        events = events.where("event_code <> 'Nothing'")
    fields = [named(F.col("seq")), F.date_format("device_time", TIME), named(F.col("event_code")), named(F.col("signal_id")), payload(), text(F.col("segment_id")), F.col("event_code"), F.lit(""), text(F.col("signal_id"))]
    return events.select("segment_id", F.concat_ws("; ", *fields).alias("value"))


def write_log(events: DataFrame, path: str, per_segment: bool = False, reduced: bool = False) -> None:
    out = lines(events, reduced)
    if per_segment:
        out.write.partitionBy("segment_id").text(path)
    else:
        out.select("value").write.text(path)


def parse(rows: DataFrame) -> DataFrame:
    """Events of the lines in ``value``; lines that are no events come with event_code null."""
    return parse_with(rows, [])


def parse_with(rows: DataFrame, keep: list[str]) -> DataFrame:
    parts = F.split("value", "; ?")
    at = lambda i: F.when(F.size(parts) >= 7, F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")))
    code = F.coalesce(at(2), at(6))
    return rows.select(
        code.alias("event_code"),
        F.coalesce(at(3), at(8)).alias("signal_id"),
        F.try_to_timestamp(at(1), F.lit(TIME)).cast("timestamp_ntz").alias("device_time"),
        at(5).try_cast("long").alias("segment_id"),
        F.when(code.isin(E.LEVEL, E.MASKED), at(4).try_cast("double")).alias("level"),
        F.when(code == E.PARAMETERS, F.transform(F.split(at(4), " "), lambda x: x.try_cast("double"))).alias("parameters"),
        F.when(code.isin(*E.INFO), at(4)).alias("info"),
        at(0).try_cast("long").alias("seq"),
        *keep,
    )


def read_log(spark: SparkSession, path: str, file_as_segment: bool = False, renumber: bool = False) -> DataFrame:
    """A written log as it is replayed: bad lines and shut-downs dropped, segment markers made anew.

    With ``file_as_segment`` each file is a segment, named by segments_of_files; with ``renumber`` segments are 1, 2, ...
    in order of their ids.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    events = parse_with(rows, ["file"]).where("event_code is not null and device_time is not null")
    if file_as_segment:
        events = segments_of_files(events)
    if renumber:
        ids = events.select("segment_id").distinct()
        ids = ids.where("segment_id is not null").withColumn("number", F.row_number().over(Window.orderBy("segment_id")).cast("long"))  # a row for each segment
        events = events.join(ids, "segment_id", "left").withColumn("segment_id", F.col("number")).drop("number")
    return replay(events.drop("file"))


def segments_of_files(events: DataFrame) -> DataFrame:
    """Segments named by their ``file``: the first digits of its name; files without any, or with those of an earlier
    one, get the numbers after the greatest. Of a file with several segments these are 1000 times that and 1, 2, ..."""
    files = events.groupBy("file").agg(F.count_distinct("segment_id").alias("segments"))
    digits = F.regexp_extract(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1), r"([0-9]+)", 1).try_cast("long")
    files = files.withColumn("id", F.when(digits > 0, digits))
    again = F.row_number().over(Window.partitionBy("id").orderBy("file")) > 1
    files = files.withColumn("taken", F.col("id").isNull() | again)
    most, free = F.coalesce(F.max("id").over(Window.partitionBy()), F.lit(0)), F.row_number().over(Window.partitionBy("taken").orderBy("file"))
    files = files.withColumn("name", F.when(F.col("taken"), most + free).otherwise(F.col("id")))  # a row for each file
    places = events.select("file", "segment_id").distinct().where("segment_id is not null").withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("segment_id")))
    names = places.join(files, "file").select("file", F.col("segment_id").alias("old"), F.when(F.col("segments") > 1, F.col("name") * 1000 + F.col("place")).otherwise(F.col("name")).cast("long").alias("segment"))
    joined = events.alias("e").join(names.alias("n"), (F.col("e.file") == F.col("n.file")) & (F.col("e.segment_id") == F.col("n.old")), "left")
    return joined.select(*[F.col("n.segment").alias(c) if c == "segment_id" else F.col(f"e.{c}") for c in events.columns])


def database_parameters(events: DataFrame) -> DataFrame:
    """Rows for the table of model parameters: each vector as its doubles in bytes, little-endian."""

    @F.pandas_udf("binary")
    def doubles(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else np.asarray(a, "<f8").tobytes())

    rows = events.where((F.col("event_code") == E.PARAMETERS) & F.col("parameters").isNotNull())
    return rows.select(F.col("device_time").alias("recorded_at"), "signal_id", doubles("parameters").alias("parameters"), F.col("segment_id").alias("time_segment_id"))


def database_rows(events: DataFrame, virtual: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """Rows for the table of measured values: levels of signals that no model makes, and of those in ``always``."""
    levels = events.where(E.is_level() & F.col("level").isNotNull())
    kept = levels.join(virtual.select("signal_id"), "signal_id", "left_anti").unionByName(levels.where(F.col("signal_id").isin(list(always))).join(virtual.select("signal_id"), "signal_id", "left_semi"))
    return kept.select(F.col("device_time").alias("measured_at"), "signal_id", F.col("level").alias("value"), F.col("segment_id").alias("time_segment_id"))


def pivot_wide(events: DataFrame, signals: list[str]) -> DataFrame:
    """The legacy table: a row for each segment and time, a column for each signal, the last written level."""
    rows = events.where(E.is_level())
    return rows.groupBy("segment_id", "device_time").pivot("signal_id", signals).agg(F.max_by("level", "seq"))


def write_database(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    rows.write.jdbc(url, table, mode="append", properties=properties)
