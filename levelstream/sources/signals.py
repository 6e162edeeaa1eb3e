"""The dimension of signals: well-known ones, and own ones from a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The well-known signals and their units.
SIGNALS = (
    ("BG", "mmol/L"), ("BG_Calibration", "mmol/L"), ("IG", "mmol/L"), ("ISIG", "A"),
    ("Requested_Insulin_Bolus", "U"), ("Requested_Insulin_Basal_Rate", "U/hr"), ("Requested_Insulin_Intradermal_Rate", "U/hr"),
    ("Delivered_Insulin_Bolus", "U"), ("Delivered_Insulin_Total", "U"), ("Delivered_Insulin_Basal_Rate", "U/hr"), ("Delivered_Insulin_Intradermal_Rate", "U/hr"), ("Delivered_Insulin_Inhaled", "U"),
    ("Insulin_Activity", ""), ("IOB", ""), ("COB", ""), ("Carb_Intake", "g"), ("Carb_Rescue", "g"), ("Physical_Activity", "%"),
    ("Skin_Temperature", "%"), ("Air_Temperature", "%"), ("Heartbeat", "%"), ("Electrodermal_Activity", "%"), ("Steps", "%"), ("Sleep_Quality", "%"), ("Acceleration", "%"), ("Movement_Speed", "m/s"),
    ("Insulin_Sensitivity", ""), ("Carb_Ratio", ""),
)


def known_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SIGNALS), "signal_id string, unit string").withColumn("description", F.replace("signal_id", F.lit("_"), F.lit(" ")))


def own_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals of a file with the columns id; description; unit; unit id; ..., the first line being their names."""
    names = ["signal_id", "description", "unit", "unit_id", "fill", "stroke", "visualization", "mark", "pattern"]
    rows = spark.read.csv(path, sep=";", header=True, schema=", ".join(f"{n} string" for n in names), enforceSchema=True)
    return rows.select(F.trim("signal_id").alias("signal_id"), F.trim("unit").alias("unit"), F.trim("description").alias("description")).where("signal_id <> ''")


def with_names(events: DataFrame, signals: DataFrame) -> DataFrame:
    """The events with unit and description of their signal; the dimension has one row for each signal."""
    return events.join(signals, "signal_id", "left")
