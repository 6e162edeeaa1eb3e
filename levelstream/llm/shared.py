"""What the operators of this folder share: tables in the shared folder, batches cut at keys, components."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The innermost scope of this thread.
_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)
_WRITES, _BEFORE = threading.Lock(), []


class Scope:
    """The tables that ``materialize`` writes while a ``scope`` is open in this thread."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, table: DataFrame) -> DataFrame:
        """A table of ``materialize`` that stays when the scope ends."""
        own = {os.path.basename(os.path.dirname(f)) for f in table.inputFiles()[:1]}
        self.paths = [p for p in self.paths if os.path.basename(p) not in own]
        return table


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Deletes at its end the tables that were written in it, by this thread and for no scope inside, but those kept.

    The result of an operator reads such tables until it is written itself, so write it inside. Other callers, in
    other threads too, keep theirs.
    """
    own = Scope()
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        for path in own.paths:
            _delete(spark, path)


@contextmanager
def _shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write go when it ends; the setting is put back when the last write at a time has ended."""
    with _WRITES:
        _BEFORE.append(_BEFORE[-1] if _BEFORE else spark.conf.get(_CLEANUP, "false"))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _WRITES:
            before = _BEFORE.pop()
            if not _BEFORE:
                spark.conf.set(_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves, which only a local master may use.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "levelstream-shared")


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    A long job holds the shuffle files of one step at a time. The table stays until ``discard``, or until the
    ``scope`` ends in which it was written.
    """
    spark, own = df.sparkSession, _SCOPE.get()
    path = f"{shared_folder(spark)}/levelstream/{tag}-{uuid.uuid4().hex}"
    if own is not None:
        own.paths.append(path)
    with _shuffle_files_go(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in ``order``: a distributed sort, then one count a partition on the driver."""
    spark = df.sparkSession
    rows = materialize(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(name, 33)
    sizes = sorted((r.part, r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    before = [(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)]
    starts = spark.createDataFrame(before, "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn(name, F.col("before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, name)


def row_key() -> list[Column]:
    """(row_doc, row_hash): what tells rows (doc_id, text) apart; neither is ever null."""
    return [F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("row_doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("row_hash")]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    files = table.inputFiles()
    if files:
        _delete(table.sparkSession, os.path.dirname(files[0]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where the key changes, from batches that are sorted by ``keys``.

    Holds one batch and the rows of the key that is open; callers bound the rows of a key.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(batch.num_rows, bool)
        for values in last:
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1] != batch.column(batch.schema.get_field_index(k))[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Links between numbered rows, kept as a forest: a link inside a tree is dropped."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The links (a, b) that join two trees."""
        new = self.root[a] != self.root[b]
        kept = []
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                kept.append((x, y))
        if kept:
            root = np.asarray(self.parent)
            while (root[root] != root).any():
                root = root[root]
            self.root = root
        return kept


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (a, b): component is the smallest id that links reach.

    Alternates large stars and small stars until the edges no longer change. A round is two aggregations that
    combine before they shuffle and two joins that Spark can split at hot nodes; each round is written to the
    shared folder. No node or edge is collected; only a count and a checksum come to the driver. Ends that are
    null link nothing; an empty table gives an empty one.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and a is not null and b is not null").distinct(), "edges")
    state = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state(now)
    while seen[0]:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).union(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        after = materialize(small.distinct(), "edges")
        then = state(after)
        discard(now)
        now = after
        if then == seen:
            break
        seen = then
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
