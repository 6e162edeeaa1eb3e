"""Mixing sources to target weights in equal-token blocks, apportioned by Sainte-Laguë.

Of all quotients target / (2 k - 1) of the sources the highest win a word each, so that a source of any size comes
within a word of its share. The words of a source are cut into shards (documents by keyed hash), and those of a
shard, documents in keyed order, into n blocks that are equal to a word: about BLOCK words, or a FINEth of a shard
that is smaller. The blocks that a source's words come to are given to its shards by the highest quotients
words / (2 k - 1). A shard with quota q takes each block q // n times and q % n blocks once more: those that come
first in a seeded permutation of the n blocks, which needs no sort.

A quotient's rank is never computed: the lowest quotient that wins is found by bisection over the doubles, counting
seats, and only cells that tie at it go by their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, numbered, row_key, whole_groups

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words; a source gives at most PASSES times its own.
SHARE, PASSES = 1.5, 2
#: Words of a block, and the blocks of a shard that is too small for as many.
BLOCK, FINE = 32, 16
#: Words for which a source gets a shard, and the most shards of a source (a task holds their quotas).
SHARD_WORDS, MOST_SHARDS = 16_384, 1 << 16
SEED = 20
#: Rounds of the permutation, and thresholds that a job counts seats for.
ROUNDS, THRESHOLDS = 20, 256


def seats_at(weight: np.ndarray, cap: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many of the quotients weight / (2 k - 1), k from 1 to cap, are ``least`` or more; ``least`` is positive."""
    with np.errstate(over="ignore"):
        k = np.minimum(np.floor((weight / least + 1) / 2), cap).astype(np.int64)
    k -= (k > 0) & (weight / (2 * k - 1) < least)
    return k + ((k < cap) & (weight / (2 * k + 1) >= least))


def sainte_lague(start: np.ndarray, weight: np.ndarray, cap: np.ndarray, seats: np.ndarray) -> np.ndarray:
    """Seats of each cell; the cells of a group begin at ``start`` and share ``seats``, as far as their caps go.

    Doubles above zero are in the order of their bits, so all groups bisect at once in 63 steps. Cells without weight
    get none; ties go by the order of the cells.
    """
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(weight))))
    cap = np.where(weight > 0, cap, 0)
    total = lambda x: np.add.reduceat(x, start)
    seats = np.minimum(seats, total(cap))
    least = lambda bits: bits.view(np.float64)[group]
    low, high = np.ones(len(start), np.int64), np.full(len(start), np.float64(np.inf).view(np.int64))
    while (high - low > 1).any():
        middle = low + (high - low) // 2
        enough = total(seats_at(weight, cap, least(middle))) >= seats
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    sure = seats_at(weight, cap, least(high))
    tied = seats_at(weight, cap, least(low)) - sure
    before = np.cumsum(tied) - tied
    return sure + ((tied > 0) & (before - before[start][group] < (seats - total(sure))[group]))


def _shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (origin, cell, words, blocks, seats) sorted by origin and cell, with quota for words and seats."""
    for table in whole_groups(batches, ["origin"]):
        origin, words, blocks, seats = (table.column(k).to_numpy() for k in ("origin", "words", "blocks", "seats"))
        start = np.flatnonzero(np.append(True, origin[1:] != origin[:-1]))
        quota = sainte_lague(start, words.astype(np.float64), PASSES * blocks, seats[start])
        yield from table.select(["origin", "cell", "words", "blocks"]).append_column("quota", pa.array(quota)).to_batches()


def apportion_shards(cells: DataFrame) -> DataFrame:
    """(origin, cell, words, blocks, quota) of shards (origin, cell, words, blocks, seats): an origin has MOST_SHARDS cells at most."""
    rows = cells.select("origin", "cell", "words", "blocks", "seats").repartition("origin").sortWithinPartitions("origin", "cell")
    return rows.mapInArrow(_shared_out, "origin long, cell long, words long, blocks long, quota long")


def _counted(thresholds: list[float]):
    """A function of batches (weight, cap) that counts the seats at each threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(thresholds), np.int64)
        for batch in batches:
            weight, cap = (batch.column(k).to_numpy() for k in (0, 1))
            total += [int(seats_at(weight, cap, np.float64(t)).sum()) for t in thresholds]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["counts"])

    return count


def apportion_sources(sources: DataFrame, weight: str, cap: str, seats: int) -> DataFrame:
    """(cell, quota) of any number of sources, by whole passes over their table: a job counts seats at THRESHOLDS doubles.

    Sources that tie at the lowest winning quotient go by ``cell``; the last that wins is found by counts as well.
    """
    rows = sources.where(F.col(weight) > 0).select("cell", F.col(weight).cast("double").alias("weight"), F.col(cap).cast("long").alias("cap"))
    asked = lambda some: np.sum([r.counts for r in rows.select("weight", "cap").mapInArrow(_counted(some), "counts array<long>").collect()] or [[0] * len(some)], axis=0)
    seats = min(seats, rows.agg(F.sum("cap")).first()[0] or 0)
    low, high = 1, int(np.float64(np.inf).view(np.int64))
    while high - low > 1:
        step = max(1, -(-(high - low) // THRESHOLDS))
        some = list(range(low + step, high, step))
        enough = asked(np.array(some, np.int64).view(np.float64).tolist()) >= seats
        k = int(enough.sum())  # counts fall as thresholds rise
        low, high = ([low, *some][k], [*some, high][k])
    least, next_ = (float(np.int64(x).view(np.float64)) for x in (low, high))
    won = lambda t: _seats_column(F.col("weight"), F.col("cap"), t)
    rows = rows.select("cell", won(next_).alias("sure"), (won(least) > won(next_)).alias("tied"))
    left = seats - (rows.agg(F.sum("sure")).first()[0] or 0)
    bounds = rows.where("tied").agg(F.min("cell"), F.max("cell")).first()
    low, high = (bounds[0] - 1, bounds[1]) if bounds[0] is not None else (0, 0)  # ties up to high are ``left`` or more
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if rows.where(F.col("tied") & (F.col("cell") <= middle)).count() >= left else (middle, high)
    return rows.select("cell", (F.col("sure") + (F.col("tied") & (F.col("cell") <= high) & F.lit(left > 0)).cast("long")).alias("quota"))


def _seats_column(weight: Column, cap: Column, least: float) -> Column:
    """``seats_at`` as a column."""
    k = F.least(F.floor((weight / F.lit(least) + 1) / 2), cap)
    k = k - F.when((k > 0) & (weight / (2 * k - 1) < least), 1).otherwise(0)
    return (k + F.when((k < cap) & (weight / (2 * k + 1) >= least), 1).otherwise(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(cell, source, source_size, target) per source: weights by code point, nulls last, capped and reshared.

    The level grows until no source's weight times level is above its cap; a round is one sum over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("cell") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(numbered(sources, [F.col("source").asc_nulls_last()], "cell").withColumn("weight", weight), "sources")
    cap = PASSES * F.col("source_size").cast("double")
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = SHARE * (words or 0) / (weights or 1)
    while True:
        over = cap < F.col("weight") * level
        capped, open_weight = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        after = (SHARE * words - (capped or 0.0)) / open_weight if open_weight else level
        if after == level:
            break
        level = after
    return sources.select("cell", "source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a / b, of non-negative whole numbers."""
    return F.call_function("div", a, b)


def shuffled(place: Column, size: Column, keys: Column) -> Column:
    """Where a permutation of 0 .. size - 1 puts ``place``; ``keys`` are its ROUNDS numbers below size.

    Swap or not: a round pairs x with key - x modulo size and swaps the two if a hash of the round and of the
    larger one is odd, so each round is a permutation of any size.
    """

    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(key - x, size)
        return F.when(F.pmod(F.xxhash64(key, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(keys, place.cast("long"), swap)


def mix(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``documents``: doc_id, source, size, source_size, target, taken, passes, ranges, and ``keep``.

    ``passes`` whole copies of the row are in the mix, and of one more copy the words in ``ranges`` (array of
    start and length); ``taken`` counts all these words. Null or empty text has size 0 and is not taken; a null
    source is a source, after all others; a null doc_id is an id; repeated rows each count, and rows of one id are
    told apart by a hash of their text; a very long text has many blocks of its own; an empty table gives an empty
    one; other columns are ignored. Equal tables give equal mixes, however they are partitioned.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kept = F.struct(F.lit(0).alias("none"), *keep).alias("kept")
    sized = materialize(documents.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("hash"), kept), "sizes")
    sources = source_targets(sized)
    keyed = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS)))
    cell = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "hash"), shards).alias("cell")
    keyed = keyed.select("doc_id", "hash", "kept", "d.source", "size", "source_size", "target", F.col("cell").alias("origin"), cell)
    cells = keyed.groupBy("origin", "cell").agg(F.sum("size").alias("words"))
    count = F.greatest(F.round(F.col("words") / BLOCK), F.least("words", F.lit(FINE))).cast("long")
    cells = materialize(cells.where("words > 0").select("origin", "cell", "words", count.alias("blocks")), "cells")
    sources = sources.select(F.col("cell").alias("origin"), "source_size", "target")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    given = apportion_sources(sources.select(F.col("origin").alias("cell"), "target", (PASSES * F.col("source_size")).alias("most")), "target", "most", round(total))
    room = cells.groupBy("origin").agg(F.sum("blocks").alias("all"), F.sum("words").alias("held"))
    seats = room.join(given, room["origin"] == given["cell"]).select("origin", F.round(F.col("quota") * F.col("all") / F.col("held")).cast("long").alias("seats"))
    shard_quotas = materialize(apportion_shards(cells.join(seats, "origin")), "quotas")

    order = Window.partitionBy("origin", "cell").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id", "hash"), "doc_id", "hash", "size")
    placed = keyed.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(shard_quotas, ["origin", "cell"], "left").fillna(0, ["quota"]).fillna(1, ["blocks", "words"])
    extra = F.col("quota") % F.col("blocks")
    keys = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.pmod(F.xxhash64(F.lit(SEED + 2), "origin", "cell", r), F.col("blocks")))
    placed = placed.withColumns({"extra": extra, "keys": keys, "passes": F.floor(F.col("quota") / F.col("blocks"))})
    chosen = lambda b: shuffled(b, F.col("blocks"), F.col("keys")) < F.col("extra")
    edge = lambda b: _whole(b * F.col("words"), F.col("blocks"))
    low = lambda b: F.greatest(edge(b), F.col("at")) - F.col("at")
    high = lambda b: F.least(edge(b + 1), F.col("at") + F.col("size")) - F.col("at")
    block_of = lambda word: _whole((word + 1) * F.col("blocks") - 1, F.col("words"))
    blocks = F.sequence(block_of(F.col("at")), block_of(F.col("at") + F.col("size") - 1))
    ranges = F.transform(F.filter(blocks, chosen), lambda b: F.struct(low(b).alias("start"), (high(b) - low(b)).alias("length")))
    placed = placed.withColumn("ranges", F.when((F.col("size") > 0) & (F.col("extra") > 0), ranges).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>")))
    more = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    taken = (F.col("passes") * F.col("size") + more).cast("long")
    names = ["doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.col("passes").cast("long").alias("passes"), "ranges"]
    return placed.select(*names, *[F.col(f"kept.{c}").alias(c) for c in keep if c not in ("doc_id", "source")])


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words in ranges (start, length) with the white space between them; ranges that do not touch are parted by a space."""
    data = text.encode("utf-8", "surrogatepass")
    code = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], (code != 32) & ((code < 9) | (code > 13)), [False]])
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    joined: list[list[int]] = []
    for start, length in ranges:
        if joined and joined[-1][1] == start:
            joined[-1][1] += length
        else:
            joined.append([start, start + length])
    return b" ".join(data[starts[a] : ends[b - 1]] for a, b in joined).decode("utf-8", "surrogatepass")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, size, passes, ranges, others) to a row (text, others) for each copy in the mix."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            rows, texts = [], []
            for k, (text, size, passes, ranges) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                copies = [text] * passes
                if ranges:
                    some = [(r["start"], r["length"]) for r in ranges]
                    copies.append(text if sum(n for _, n in some) == size else cut_words(text, some))
                texts += copies
                rows += [k] * len(copies)
            others = batch.select(range(4, batch.num_columns)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *others.columns], ["text", *others.schema.names])


def mixed_texts(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """text and the columns ``keep`` of a row for each copy of a text, or of words of it, that the mix takes.

    A row that is not taken has none, so null and empty texts go. Repeated rows are mixed each for itself; a null
    doc_id is kept; other columns are ignored.
    """
    rows = documents.select("text", *dict.fromkeys(("doc_id", "source", *keep)), *row_key())
    taken = mix(rows, (*keep, "row_doc", "row_hash")).where("taken > 0")
    names = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    taken = materialize(taken.select("row_doc", "row_hash", "size", "passes", "ranges", *names), "taken")
    # One text of rows that are equal, so that n equal rows meet n and not n * n.
    texts = rows.select("row_doc", "row_hash", "text").dropDuplicates(["row_doc", "row_hash"])
    joined = texts.join(taken, ["row_doc", "row_hash"]).select("text", "size", "passes", "ranges", *[f"kept_{k}" for k in range(len(keep))])
    kinds = "".join(f", kept_{k} {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    return joined.mapInArrow(_copies, f"text string{kinds}").select("text", *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "size", "source_size", "target", "taken")
