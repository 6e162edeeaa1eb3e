"""Near-duplicate documents by SimHash, searched with tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, discard, materialize, whole_groups

WORDS, RADIUS = 4, 4
#: Blocks that the 64 bits are cut into; fingerprints within 4 bits agree on all but 4 of them. Beyond MANY distinct
#: fingerprints there is a block more, so that the keys are longer (27 bits for 21) and fewer share one.
BLOCKS, MANY = 6, 1 << 28
#: Fingerprints of one routing key that a task compares at once; larger keys are cut into tiles of this size.
TILE = 4096
#: Reference fingerprints of the distance table, eight to a long.
REFERENCES = [int(r) for r in np.random.default_rng(64).integers(-(1 << 63), 1 << 63, 16, dtype=np.int64)]
TABLE = [f"pivots_{k}" for k in range(0, len(REFERENCES), 8)]
_SLICE = 1 << 18


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of whole UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        words = [b" ".join(words)]
        starts, ends, joined = [0], [len(words[0])], words[0]
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-WORDS]]
        ends = [e - 1 for e in ends[WORDS - 1 :]]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        prints = np.array([fingerprint(t or b"") for k in range(0, len(texts), 250) for t in texts.slice(k, 250).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], [*batch.schema.names[1:], "print"])
    pa.default_memory_pool().release_unused()  # the worker process lives on


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and print: the SimHash of every row's whole text, as a signed long; null text counts as empty."""
    rows = documents.select("text", *keep)
    return rows.mapInArrow(_fingerprints, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:]) + "print long")


def _masks(blocks: int) -> list[int]:
    parts, at = [], 0
    for k in range(blocks):
        width = 64 // blocks + (k < 64 % blocks)
        parts.append(((1 << width) - 1) << at)
        at += width
    masks = [sum(some) for some in combinations(parts, blocks - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distance_table() -> list[Column]:
    """The Hamming distances of ``print`` to the references, each in a byte of the columns TABLE."""
    byte = lambda k, r: F.shiftleft(F.bit_count(F.col("print").bitwiseXOR(F.lit(r))).cast("long"), 8 * k)
    parts = [REFERENCES[k : k + 8] for k in range(0, len(REFERENCES), 8)]
    return [reduce(Column.bitwiseOR, [byte(k, r) for k, r in enumerate(part)]).alias(name) for name, part in zip(TABLE, parts, strict=True)]


def close_pairs(prints: np.ndarray, table: np.ndarray, group: np.ndarray, own: np.ndarray, crossed: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the pairs of rows of the same group within RADIUS bits; where ``crossed``, of different ``own`` only.

    ``table`` has a row's distances to the references. Rows go by group, then by the first distance. A pair of which
    one distance differs by more than RADIUS is discarded unseen (the triangle inequality): by the first one whole
    ranges of rows are never paired. What is left is verified bit by bit.
    """
    forest, kept = Forest(len(prints)), []
    first, step = np.arange(len(prints) - 1), 1
    lead = table[:, 0]
    while len(first):
        first = first[first + step < len(prints)]
        first = first[(group[first] == group[first + step]) & (lead[first + step] - lead[first] <= RADIUS)]
        a = first[~crossed[first] | (own[first] != own[first + step])]
        b = a + step
        for k in range(1, table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, k] - table[b, k]) <= RADIUS
            a, b = a[near], b[near]
        same = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
        kept += forest.add(a[same], b[same])
        step += 1
    return kept


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["combo", "part", "left", "right"]):
        keys = [rows.column(k).to_numpy() for k in ("combo", "part", "left", "right")]
        new = np.zeros(rows.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        prints = rows.column("print").to_numpy().astype(np.int64)
        table = np.concatenate([rows.column(c).to_numpy().astype("<i8").view(np.int8).reshape(-1, 8) for c in TABLE], axis=1)
        links = np.array(close_pairs(prints.view(np.uint64), table, np.cumsum(new), rows.column("own").to_numpy(), keys[2] != keys[3]), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(prints[links[:, 0]]), pa.array(prints[links[:, 1]])], ["a", "b"])


def print_links(prints: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (print and TABLE) that connect all within RADIUS bits: a forest of each task's links.

    Routing: for each choice of blocks that a close pair must agree on a row, keyed by the bits of these blocks.
    A key with more than TILE fingerprints is cut into tiles by hash, and each pair of tiles is a task's group of
    its own, so no task holds a hot key whole and no pair is lost; in a group of two tiles only pairs across are
    looked at.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("print").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(_masks(blocks))])
    keyed = prints.select("print", *TABLE, F.explode(parts).alias("k")).select("print", *TABLE, "k.combo", "k.part")
    hot = materialize(keyed.groupBy("combo", "part").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "hot-keys")
    tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    dealt = keyed.join(hot, ["combo", "part"], "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    dealt = dealt.select("combo", "part", "print", *TABLE, "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("combo", "part", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "print", *TABLE)
    keys = ["combo", "part", "left", "right"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col(TABLE[0]).bitwiseAND(F.lit(255)))
    return ordered.mapInArrow(_links, "a long, b long")


def near_duplicates(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, print, component_id and root of every row: component_id is the smallest doc_id that links reach.

    ``keep`` holds doc_id; root is a fingerprint of the component, which names it where no doc_id does.

    Equal fingerprints are one node; membership stays apart, so a group of copies of any size is one row until
    the last join. A text without words has fingerprint 0 and links like any other; null text is empty;
    repeated rows are all returned; a very long text is read in slices; a null doc_id is returned and is nobody's smallest id unless alone; an empty
    table gives an empty one; other columns are ignored.
    """
    prints = materialize(fingerprints(documents, keep), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    nodes = materialize(nodes.select("print", "first_id", *distance_table()), "nodes")
    blocks = BLOCKS if nodes.count() <= MANY else BLOCKS + 1
    tree = components(print_links(nodes.select("print", *TABLE), blocks))
    rooted = nodes.join(tree, nodes["print"] == tree["id"], "left").select("print", "first_id", F.coalesce("component", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("print", "component_id", "root"), "named")
    discard(nodes)
    return prints.join(named, "print").select(*keep, "print", "component_id", "root")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
