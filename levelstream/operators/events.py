"""The event stream: rows of one schema, and adapters of tables to it.

segment_id is the episode, signal_id the named series, device_time the event time, level the value, seq a source
order that breaks ties. event_code is a name; parameters and info are the other payloads, null on level events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL, MASKED, PARAMETERS, INFORMATION = "Level", "Masked_Level", "Parameters", "Information"
START, STOP, SHUT_DOWN = "Time_Segment_Start", "Time_Segment_Stop", "Shut_Down"
CONTROL = (START, STOP, SHUT_DOWN, "Solve_Parameters", "Warm_Reset")
INFO = (INFORMATION, "Warning", "Error")
DAY = 86_400.0

SCHEMA = T.StructType(
    [
        T.StructField("event_code", T.StringType()),
        T.StructField("signal_id", T.StringType()),
        T.StructField("device_time", T.TimestampNTZType()),
        T.StructField("segment_id", T.LongType()),
        T.StructField("level", T.DoubleType()),
        T.StructField("parameters", T.ArrayType(T.DoubleType())),
        T.StructField("info", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def level_events(rows: DataFrame, segment: str, signal: Column, time: str, level: str, seq: str) -> DataFrame:
    """Level events of a table; a level that is NaN is null, as missing is one thing here."""
    value = F.col(level).cast("double")
    return rows.select(
        F.lit(LEVEL).alias("event_code"),
        signal.alias("signal_id"),
        F.col(time).cast("timestamp_ntz").alias("device_time"),
        F.col(segment).cast("long").alias("segment_id"),
        F.when(~F.isnan(value), value).alias("level"),
        F.lit(None).cast("array<double>").alias("parameters"),
        F.lit(None).cast("string").alias("info"),
        F.col(seq).cast("long").alias("seq"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: segment = user, signal = type."""
    return level_events(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", F.col("event_type"), "ts", "value", "event_id")


def read_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a stream: segment = customer, one signal, level = price in thousands."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("price", F.col("o_totalprice") / 1000)
    return level_events(rows, "o_custkey", F.lit("price"), "o_orderdate", "price", "o_orderkey")


def is_level() -> Column:
    return F.col("event_code") == LEVEL


def days(time: Column | str = "device_time") -> Column:
    """A time as a double of days since 1970, the unit of slopes and model constants."""
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp")) / F.lit(DAY * 1e6)


def micros(time: Column | str = "device_time") -> Column:
    """A time in whole microseconds, so that differences are exact."""
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp"))


def moved(time: Column, seconds: Column | float) -> Column:
    """A time so many seconds later."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(round(seconds, 6))
    return time + F.make_dt_interval(secs=seconds)


def signal(events: DataFrame, name: str) -> DataFrame:
    """(segment_id, device_time, level, seq) of a signal's level events with a level."""
    return events.where(is_level() & (F.col("signal_id") == name) & F.col("level").isNotNull()).select("segment_id", "device_time", "level", "seq")


def last_written(levels: DataFrame) -> DataFrame:
    """One level for each segment and time: the last written (highest seq) wins."""
    return levels.groupBy("segment_id", "device_time").agg(F.max_by("level", "seq").alias("level"), F.max("seq").alias("seq"))
