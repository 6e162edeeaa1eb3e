"""A table of measured values over JDBC that may be written again: keys are made once, and a batch counts once.

A batch is staged by all tasks in parallel, then one transaction on the driver updates the levels that are known,
inserts the others and notes the batch. A task or a whole batch that runs again leaves what it left before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelstream.operators import events as E
from levelstream.operators.segment_fits import cut

_KEYS = ("time_segment_id", "signal_id", "measured_at")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,60}(\.[A-Za-z][A-Za-z0-9_]{0,60})?")


def _connected(spark: SparkSession, url: str, properties: dict[str, str], work: Callable):
    """``work`` on a statement of one transaction, which is undone if it fails."""
    jvm = spark._jvm
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    own = jvm.java.util.Properties()
    for k, v in properties.items():
        own.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        connection.setAutoCommit(False)
        found = work(connection.createStatement())
        connection.commit()
        return found
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def _number(statement, sql: str) -> int | None:
    rows = statement.executeQuery(sql)
    return rows.getLong(1) if rows.next() else None


def _checked(table: str) -> str:
    if not _NAME.fullmatch(table):
        raise ValueError(f"not a table name: {table}")
    return table


def create_tables(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> None:
    """The table of levels with its keys, the counter of keys and the list of batches; fails where they exist."""
    table = _checked(table)

    def work(statement) -> None:
        statement.execute(f"create table {table} (id bigint not null primary key, measured_at timestamp not null, signal_id varchar(64) not null, value double precision not null, time_segment_id bigint not null, unique ({', '.join(_KEYS)}))")
        statement.execute(f"create table {table}_next (next_id bigint not null)")
        statement.execute(f"insert into {table}_next values (1)")
        statement.execute(f"create table {table}_batches (batch varchar(200) not null primary key)")

    _connected(spark, url, properties, work)


def write_levels(events: DataFrame, url: str, table: str, batch: str, properties: dict[str, str]) -> bool:
    """Levels of ``events`` into ``table``, of each (segment, signal, time) the last written; False if ``batch`` was written before.

    A level that the table has keeps its id and gets the new value. A range of ids is reserved for the batch, and each
    partition numbers its rows in its own part of it, so a lost range leaves a gap and never a second use. Levels that
    are null or not finite, or lack a key, are no rows.
    """
    spark, table = events.sparkSession, _checked(table)
    if len(batch) > 200 or "'" in batch:
        raise ValueError(f"not a batch name: {batch}")
    if _connected(spark, url, properties, lambda s: _number(s, f"select count(*) from {table}_batches where batch = '{batch}'")):
        return False
    sound = E.is_level() & F.col("level").isNotNull() & ~F.isnan("level") & (F.abs("level") < float("inf"))
    keys = [F.col("device_time").cast("timestamp").alias("measured_at"), "signal_id", F.col("segment_id").alias("time_segment_id")]
    levels = events.where(sound).select(*keys, "level", "seq").dropna(subset=list(_KEYS))
    levels = cut(levels.groupBy("measured_at", "signal_id", "time_segment_id").agg(F.max_by("level", "seq").alias("value")).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted((r.part, r["count"]) for r in levels.groupBy(part.alias("part")).count().collect())  # a row a partition
    total = sum(n for _, n in sizes)

    def reserve(statement) -> int:
        statement.execute(f"update {table}_next set next_id = next_id + {total}")
        return _number(statement, f"select next_id from {table}_next") - total

    first = _connected(spark, url, properties, reserve)
    starts = spark.createDataFrame([(p, first + sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)], "part long, start long")
    staged = levels.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "measured_at", "signal_id", "value", "time_segment_id")
    stage = f"{table}_s{hashlib.sha256(batch.encode()).hexdigest()[:16]}"
    try:  # of an attempt that failed
        _connected(spark, url, properties, lambda s: s.execute(f"drop table {stage}"))
    except Py4JJavaError:
        pass
    kinds = "id bigint, measured_at timestamp, signal_id varchar(64), value double precision, time_segment_id bigint"
    _connected(spark, url, properties, lambda s: s.execute(f"create table {stage} ({kinds})"))
    staged.write.jdbc(url, stage, mode="append", properties=properties)

    def settle(statement) -> None:
        same = " and ".join(f"s.{k} = t.{k}" for k in _KEYS)
        columns = ["id", "measured_at", "signal_id", "value", "time_segment_id"]
        # a task that ran twice has staged its rows twice, all alike
        statement.execute(f"update {table} t set value = (select max(s.value) from {stage} s where {same}) where exists (select 1 from {stage} s where {same})")
        statement.execute(f"insert into {table} ({', '.join(columns)}) select distinct {', '.join('s.' + c for c in columns)} from {stage} s where not exists (select 1 from {table} t where {same})")
        statement.execute(f"insert into {table}_batches values ('{batch}')")

    _connected(spark, url, properties, settle)
    _connected(spark, url, properties, lambda s: s.execute(f"drop table {stage}"))
    return True


def batch_writer(url: str, table: str, stream: str, properties: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a micro-batch that is delivered again, by its number in ``stream``, is not written again."""

    def write(events: DataFrame, number: int) -> None:
        write_levels(events, url, table, f"{stream}-{number}", properties)

    return write


def read_levels(spark: SparkSession, url: str, table: str, properties: dict[str, str], partitions: int = 8) -> DataFrame:
    """The table as level events, read by ``partitions`` tasks in ranges of ids; an empty table gives no rows."""
    table = _checked(table)
    low, high = _connected(spark, url, properties, lambda s: (_number(s, f"select min(id) from {table}"), _number(s, f"select max(id) from {table}")))
    rows = spark.read.jdbc(url, table, column="id", lowerBound=low or 0, upperBound=(high or 0) + 1, numPartitions=partitions, properties=properties)
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    return rows.select(
        F.lit(E.LEVEL).alias("event_code"), "signal_id", F.col("measured_at").cast("timestamp_ntz").alias("device_time"), F.col("time_segment_id").cast("long").alias("segment_id"), F.col("value").alias("level"),
        F.lit(None).cast("array<double>").alias("parameters"), F.lit(None).cast("string").alias("info"), F.col("id").cast("long").alias("seq"),
    )
