"""Device exports: text, XML and database tables as streams of level events.

A layout says how a file is recognised (texts that its first lines must hold) and which columns hold what. Lines
before the data need no counting: a row without a time is not data.
"""

from __future__ import annotations

import configparser
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelstream.functions.units import convert
from levelstream.operators import events as E
from levelstream.operators.windows import cut_segments, with_markers

SEPARATORS = (";", "\t", ",")


@dataclass(frozen=True)
class Series:
    """A signal in a column: its unit conversion, and the columns of comments that go along."""

    signal: str
    column: int
    conversion: str = "identity"
    comments: tuple[int, ...] = ()


@dataclass(frozen=True)
class Layout:
    """``signature`` holds texts, alternatives split by %%; ``time`` the columns joined by a space to the time."""

    name: str
    signature: tuple[str, ...]
    time: tuple[int, ...]
    time_format: str
    series: tuple[Series, ...]
    width: int = 32
    xml_row: str | None = field(default=None)
    #: Texts that given cells hold: (row, column, text with alternatives), both counted from 0.
    cells: tuple[tuple[int, int, str], ...] = ()


def read_layouts(text: str) -> list[Layout]:
    """Layouts from INI text: a section each, with signature.N, cell.ROW.COLUMN, time, format, and series.NAME = column; conversion; comments."""
    config = configparser.ConfigParser(interpolation=None, delimiters=("=",))
    config.optionxform = str
    config.read_string(text)
    out = []
    for name in config.sections():
        items = dict(config[name])
        series = []
        for key, value in items.items():
            if key.startswith("series."):
                column, conversion, comments = ([x.strip() for x in value.split(";")] + ["", ""])[:3]
                series.append(Series(key[7:], int(column), conversion or "identity", tuple(int(c) for c in comments.split(",") if c.strip())))
        signature = tuple(v for k, v in sorted(items.items()) if k.startswith("signature."))
        cells = tuple((*map(int, k.split(".")[1:]), v) for k, v in sorted(items.items()) if k.startswith("cell."))
        out.append(Layout(name, signature, tuple(int(c) for c in items["time"].split(",")), items["format"], tuple(series), int(items.get("width", 32)), cells=cells))
    return out


def head(spark: SparkSession, path: str, lines: int = 32) -> list[str]:
    """The first lines of a file."""
    return [r.value.lstrip("﻿") for r in spark.read.text(path).limit(lines).collect()]


def separator(lines: list[str]) -> str:
    """The most frequent of ; tab , in the first line of three characters at least."""
    line = next((x for x in lines if len(x) >= 3), "")
    return max(SEPARATORS, key=line.count)


def detect(lines: list[str], layouts: list[Layout]) -> Layout | None:
    """The first layout all of whose signature texts (or one alternative of each) are in the lines."""
    text = "\n".join(lines)
    return next((x for x in layouts if x.signature and all(any(a in text for a in s.split("%%")) for s in x.signature)), None)


#: Lines of a file in which a layout is looked for.
HEAD = 32


def file_layouts(lines: DataFrame, layouts: list[Layout]) -> DataFrame:
    """(file, sep, layout) of lines (file, place, value): the number of the first layout that the head of a file meets, or null.

    All signature texts are somewhere in the head, all cells hold their text.
    """
    first = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    heads = lines.withColumn("row", first).where(F.col("row") <= HEAD).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("head"))
    line = F.get(F.filter("head", lambda x: F.char_length(x) >= 3), F.lit(0))
    counts = [F.struct(F.regexp_count(line, F.lit(s)).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("sep")) for k, s in enumerate(SEPARATORS)]
    heads = heads.withColumns({"sep": F.coalesce(F.greatest(*counts)["sep"], F.lit(SEPARATORS[0])), "text": F.array_join("head", "\n")})
    either = lambda where, texts: F.exists(F.array(*map(F.lit, texts.split("%%"))), lambda t: F.contains(where, t))
    found = F.lit(None).cast("int")
    for k, layout in reversed(list(enumerate(layouts))):
        meets = F.lit(bool(layout.signature or layout.cells))
        for text in layout.signature:
            meets = meets & either(F.col("text"), text)
        for row, column, text in layout.cells:
            meets = meets & F.coalesce(either(F.get(F.split(F.get("head", F.lit(row)), F.col("sep")), F.lit(column)), text), F.lit(False))
        found = F.when(meets, F.lit(k)).otherwise(found)
    return heads.select("file", "sep", found.alias("layout"))


def read_files(spark: SparkSession, path: str, layouts: list[Layout], leading: str = "IG", gap_seconds: float = 720.0, least: int = 1, required: str | None = None) -> DataFrame:
    """The events of all delimited files of a folder or pattern, of one subject: detected, merged by time and cut into segments with markers.

    Each file has the first layout that it meets; files that meet none are left out. Of levels of a signal and time
    the one of the last file, then line, holds. Fields do not reach over lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    known = lines.join(file_layouts(lines, layouts).where("layout is not null"), "file")
    parts = []
    for k, layout in enumerate(layouts):
        names = [f"c{i}" for i in range(layout.width)]
        for sep in SEPARATORS:
            schema = ", ".join(f"{n} string" for n in names)
            row = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
            mine = known.where((F.col("layout") == k) & (F.col("sep") == sep)).select("file", "place", row.alias("r")).select("file", "place", "r.*")
            parts.append(_long(mine, layout, names, 1, F.struct("file", "place")))
    events = reduce(DataFrame.unionByName, parts)
    whole = events.groupBy("signal_id", "device_time").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("signal_id", "device_time")]), "rank").alias("e"))
    whole = whole.select("signal_id", "device_time", "e.*").drop("rank")
    cut = cut_segments(whole, leading, gap_seconds, least, required)
    numbered = F.dense_rank().over(Window.partitionBy("segment_id").orderBy("part")).cast("long")  # one subject's stream, ordered as a whole by cut_segments
    return with_markers(cut.withColumn("segment_id", numbered).drop("part"))


def _number(column: Column) -> Column:
    return F.replace(F.trim(column), F.lit(","), F.lit(".")).try_cast("double")


def read_delimited(spark: SparkSession, path: str, layout: Layout, segment: int = 1) -> DataFrame:
    """Level events of a delimited file; comments are joined by '; ' into info."""
    sep = separator(head(spark, path))
    names = [f"c{i}" for i in range(layout.width)]
    rows = spark.read.csv(path, sep=sep, schema=", ".join(f"{n} string" for n in names), quote='"', escape='"', mode="PERMISSIVE")
    return _long(rows, layout, names, segment)


def read_xml(spark: SparkSession, path: str, row_tag: str, columns: list[str], layout: Layout, segment: int = 1, where: str | None = None) -> DataFrame:
    """Level events of XML elements; ``columns`` are the fields (attributes as _NAME) in the layout's order."""
    rows = spark.read.xml(path, rowTag=row_tag, schema=", ".join(f"`{c}` string" for c in columns))
    if where:
        rows = rows.where(where)
    names = [f"c{i}" for i in range(len(columns))]
    return _long(rows.toDF(*names), layout, names, segment)


def _long(rows: DataFrame, layout: Layout, names: list[str], segment: int, rank: Column | None = None) -> DataFrame:
    time = F.try_to_timestamp(F.concat_ws(" ", *[F.trim(names[c]) for c in layout.time]), F.lit(layout.time_format)).cast("timestamp_ntz")
    rows = rows.withColumns({f"v{i}": _number(F.col(names[s.column])) for i, s in enumerate(layout.series)})
    cells = [
        F.struct(F.lit(s.signal).alias("signal_id"), convert(f"v{i}", s.conversion).alias("level"), F.nullif(F.concat_ws("; ", *[F.nullif(F.trim(names[c]), F.lit("")) for c in s.comments]), F.lit("")).alias("info"))
        for i, s in enumerate(layout.series)
    ]
    order = F.monotonically_increasing_id() if rank is None else rank
    long = rows.select(time.alias("device_time"), order.alias("rank"), F.explode(F.array(*cells)).alias("x")).where("device_time is not null and x.level is not null")
    last = [F.max_by("level", "rank").alias("level"), F.max_by("info", F.when(F.col("info").isNotNull(), F.col("rank"))).alias("info"), F.max("rank").alias("rank")]
    merged = long.select("device_time", "rank", "x.*").groupBy("signal_id", "device_time").agg(*last)
    return merged.select(*([] if rank is None else ["rank"]), F.lit(E.LEVEL).alias("event_code"), "signal_id", "device_time", F.lit(segment).cast("long").alias("segment_id"), "level", F.lit(None).cast("array<double>").alias("parameters"), "info", F.unix_micros(F.col("device_time").cast("timestamp")).alias("seq"))


def unpivot_wide(rows: DataFrame, segment: str, time: str, columns: list[str]) -> DataFrame:
    """A table with a column for each signal to level events; null, NaN and infinite values are no events."""
    long = rows.unpivot([segment, time], columns, "signal_id", "level").where(F.col("level").isNotNull() & ~F.isnan("level") & (F.abs("level") < math.inf))
    return long.select(F.lit(E.LEVEL).alias("event_code"), "signal_id", F.col(time).cast("timestamp_ntz").alias("device_time"), F.col(segment).cast("long").alias("segment_id"), F.col("level").cast("double").alias("level"))


def read_database(spark: SparkSession, url: str, table: str, properties: dict[str, str], segments: list[int] | None = None) -> DataFrame:
    """Measured values over JDBC, for the given segments, without null, zero or non-finite values."""
    rows = spark.read.jdbc(url, table, properties=properties)
    return database_levels(rows if segments is None else rows.where(F.col("time_segment_id").isin(segments)))


def database_levels(rows: DataFrame) -> DataFrame:
    value = F.col("value").cast("double")
    return rows.where(value.isNotNull() & (value != 0) & ~F.isnan(value) & (F.abs(value) < math.inf)).select(
        F.lit(E.LEVEL).alias("event_code"), "signal_id", F.col("measured_at").cast("timestamp_ntz").alias("device_time"), F.col("time_segment_id").cast("long").alias("segment_id"), value.alias("level")
    )


def sine_and_cosine(spark: SparkSession, days: float, step_minutes: float = 5.0, period_minutes: float = 240.0, amplitude: float = 2.0, offset: float = 6.0) -> DataFrame:
    """A synthetic segment 1: IG is a sine, BG a cosine, and each BG is a calibration too."""
    n = int(days * 1440 / step_minutes)
    t = F.col("id") * step_minutes
    phase = t * (2 * math.pi / period_minutes)
    rows = spark.range(n).select("id", (F.timestamp_seconds(F.lit(1_704_067_200) + t * 60)).cast("timestamp_ntz").alias("device_time"), (F.sin(phase) * amplitude + offset).alias("ig"), (F.cos(phase) * amplitude + offset).alias("bg"))
    kinds = F.array(*[F.struct(F.lit(s).alias("signal_id"), F.col(c).alias("level"), F.lit(k).alias("k")) for k, (s, c) in enumerate((("IG", "ig"), ("BG", "bg"), ("Calibration", "bg")))])
    long = rows.select("id", "device_time", F.explode(kinds).alias("x"))
    return long.select(F.lit(E.LEVEL).alias("event_code"), "x.signal_id", "device_time", F.lit(1).cast("long").alias("segment_id"), "x.level", (F.col("id") * 3 + F.col("x.k")).alias("seq"))
