"""Document fingerprints: digests of content-defined chunks, weighted by length.

A gear hash over the UTF-8 bytes (the last 32 bytes count) marks boundaries. Chunking is normalised: up to the
normal size a stricter mask must match, after it a looser one, never below the least or above the largest size.
A fingerprint is the set of (digest, length) of the chunks; an insertion moves the boundaries next to it only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, NORMAL, MOST = 24, 64, 256
STRICT, LOOSE = np.uint32(0xEA000000), np.uint32(0xA8000000)
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
_SLICE = 1 << 22
#: Ranges of doc_id for each partition of the shuffle, so that hashing spreads them evenly.
RANGES_PER_PARTITION = 4


def _marks(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of chunks that the strict and the loose mask allow, ascending."""
    strict, loose = [], []
    for at in range(0, len(data), _SLICE):
        low = max(0, at - 31)
        h = _GEAR[data[low : at + _SLICE]]
        for step in (1, 2, 4, 8, 16):
            if len(h) > step:
                h[step:] += h[:-step].copy() << np.uint32(step)
        h = h[at - low :]
        ends = np.flatnonzero((h & LOOSE) == 0)
        loose += (ends + at + 1).tolist()
        strict += (ends[(h[ends] & STRICT) == 0] + at + 1).tolist()
    return strict, loose


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the chunks of whole bytes."""
    strict, loose = _marks(np.frombuffer(data, np.uint8))
    found, start, n = [], 0, len(data)
    while start < n:
        end = min(start + MOST, n)
        k = bisect_left(strict, start + LEAST)
        if k < len(strict) and strict[k] < start + NORMAL:
            end = min(end, strict[k])
        else:
            k = bisect_left(loose, start + NORMAL)
            if k < len(loose):
                end = min(end, loose[k])
        found.append((start, end))
        start = end
    return found


def fingerprint(text: str) -> dict[int, int]:
    """Digest to length of the distinct chunks; empty for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    return {xxhash.xxh3_64_intdigest(data[a:b]): b - a for a, b in chunks(data)}


def likeness(one: dict[int, int], other: dict[int, int]) -> float:
    """The share of one's chunk length that other holds too; two empty fingerprints are alike."""
    total = sum(one.values())
    return sum(n for digest, n in one.items() if digest in other) / total if total else float(not other)


def as_text(prints: dict[int, int]) -> str:
    return ",".join(f"{digest:016x}:{n}" for digest, n in sorted(prints.items()))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, halo, doc_id, text): each row with the one after it in its range."""
    held, out = None, []
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc, text, own, after, after_print):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = fingerprint(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, after_print)))

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for part, halo, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            prints = fingerprint(text)
            if held and held[0] == part and not held[1]:
                row(*held[2:], text, prints)
            if not (held and held[0] == part and held[1]):
                held = (part, halo, doc, text, prints)
            if len(out) >= 500:
                yield made()
                out.clear()
    if out:
        yield made()


def document_prints(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the
    next document, ascending doc_id, after the last the first. Documents go by hash of a range of doc_id, in one
    shuffle; the first row of each range goes to the range before it too. Null text is empty; null ids come
    first; equal ids go by text, repeated rows are all returned; a very long text is one row with as many chunks as it
    has; one row alone is its own next document; an empty
    table gives an empty one; other columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("at"))
    wanted = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("at", [i / wanted for i in range(1, wanted)], 0.2 / wanted)) - {float("-inf")})
    ranged = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="range").transform(rows).withColumn("range", F.col("range").cast("int"))
    # One row for each range, so at most RANGES_PER_PARTITION times the shuffle partitions.
    firsts = sorted((r["range"], r["low"]) for r in ranged.groupBy("range").agg(F.min("at").alias("low")).collect())
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}
    if not before:
        before = {0.0: 0}
    halo = spark.createDataFrame(list(before.items()), "at double, copy_to int")
    copies = ranged.join(F.broadcast(halo), "at").select(F.col("copy_to").alias("range"), F.lit(True).alias("halo"), "doc_id", "text")
    both = ranged.select("range", F.lit(False).alias("halo"), "doc_id", "text").union(copies)
    order = ["range", "halo", F.col("doc_id").asc_nulls_first(), "text"]
    sorted_rows = both.repartition("range").sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return document_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
