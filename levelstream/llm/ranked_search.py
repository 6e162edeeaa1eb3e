"""Ranked lexical search: hashed max-sketches bound the score of every document, and bounds are rescored in order.

A document's impact of a term grows with the term's count tf alone, as its length is fixed. So its sketch holds, in
one byte a coordinate, the largest tf of the terms that hash there (255: any number), and becomes the coordinatewise
maximum of impacts once the collection's N and L are known. A sketch has two to four coordinates for each distinct
term. The sum over an item's terms of weight times sketched impact is never under the score: bounds of a batch of
documents are looked up together, and documents are rescored exactly, by descending bound, until the next bound is
under the item's tenth score.

The index (counts, sketch and terms of every document) is written once to the shared folder. Items come in blocks of
bounded size; each block reads the index twice, for the document frequencies of its terms and for the search. A task
returns ten rows an item at most, which windows merge in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

TOP = 10
#: Terms and items that go to the tasks together; an item with more terms is a block of its own.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 16, 1024
#: The least coordinates of a sketch, and the count that stands for any larger one.
LEAST, ANY = 64, 255
#: Bytes of a text that are cut into terms at once, of texts in a batch, and numbers of a batch of sketches.
_CUT, _BATCH, _NUMBERS = 1 << 20, 4 << 20, 1 << 20
#: Groups in which the rows of tasks are merged first.
MERGES = 64
#: Fixed values of the score.
SCALE, LEAST_PART, LENGTH_PART, TF_FACTOR, LENGTH_FACTOR = 1_000_000_000, 25, 75, 1000, 8
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: bytes) -> Counter:
    """How often each term occurs: runs of ASCII letters and digits and of all other characters, A-Z lower-cased.

    A long text is cut at separators, so that its terms are never all held.
    """
    found: Counter = Counter()
    data, at = text.translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + _CUT)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def sketch(hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The largest tf, at most ANY, of the terms at each coordinate; their number is a power of two, twice the terms or more."""
    size = max(LEAST, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else LEAST
    out = np.zeros(size, np.uint8)
    np.maximum.at(out, hashes & np.uint32(size - 1), np.minimum(tf, ANY).astype(np.uint8))
    return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of tf occurrences in documents of length factor m."""
    return SCALE * tf // (TF_FACTOR * tf + LENGTH_FACTOR * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text as bytes) to (doc_id, n, sketch, terms, tfs)."""
    names = ["doc_id", "n", "sketch", "terms", "tfs"]
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().cumsum()
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BATCH, "right")))
            part = batch.slice(at, end - at)
            at = end
            n, sketches, keys, tfs, offsets = [], [], [], [], [0]
            for text in part.column(1):
                found = counts(text.as_py() or b"")
                own, tf = list(found), np.fromiter(found.values(), np.int64, len(found))
                sketches.append(sketch(np.fromiter(map(crc32, own), np.uint32, len(own)), tf).tobytes())
                n.append(int(tf.sum()))
                keys += own
                tfs.append(tf)
                offsets.append(len(keys))
            place = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(place, pa.array(keys, pa.binary())), pa.ListArray.from_arrays(place, pa.array(np.concatenate(tfs)))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), *lists], names)


def index(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n (terms with repeats), sketch, terms, tfs; written to the shared folder."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(_indexed, "doc_id long, n long, sketch binary, terms array<binary>, tfs array<long>"), "search-index")


def _frequencies(vocabulary: list[bytes]):
    """A function of batches (terms) that counts the rows which hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = pa.array(vocabulary, pa.binary()), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = pc.index_in(batch.column(0).slice(at, 1000).flatten(), known)
                df += np.bincount(found.drop_null().to_numpy(), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["place", "df"])

    return count


class Block:
    """Items with their terms as places in a vocabulary: what goes to every task of a search."""

    def __init__(self, items: list[tuple[int, Counter]]):
        self.names = [name for name, _ in items]
        self.vocabulary = sorted({t for _, found in items for t in found})
        place = {t: k for k, t in enumerate(self.vocabulary)}
        self.places = [np.fromiter((place[t] for t in found), np.int64, len(found)) for _, found in items]
        self.times = [np.fromiter(found.values(), np.int64, len(found)) for _, found in items]
        self.hashes = np.fromiter(map(crc32, self.vocabulary), np.uint32, len(self.vocabulary))
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n: int, df: dict[int, int]) -> None:
        self.weights = np.array([weight(n, df.get(k, 0)) for k in range(len(self.vocabulary))], np.int64)


class Best:
    """The best rows of one item so far: highest score first, equal scores by ascending doc_id, nulls last."""

    def __init__(self):
        self.rows: list[tuple[int, bool, int]] = []

    def floor(self) -> int:
        """A document whose bound is under this cannot enter."""
        return -self.rows[-1][0] if len(self.rows) == TOP else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(-int(s), d is None, d or 0) for s, d in zip(scores, ids, strict=True) if s > 0]
        self.rows = sorted(self.rows + new)[:TOP]


class Part:
    """Documents whose sketches have one size: their bounds and exact scores for the items of a block."""

    def __init__(self, batch: pa.RecordBatch, block: Block, known: pa.Array, n_docs: int, n_terms: int):
        self.block, self.ids = block, batch.column(0)
        own = batch.column(1).to_numpy()
        m = 100 - LENGTH_PART + (LENGTH_PART * own * n_docs) // n_terms
        rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        self.most = np.where(rows == ANY, SCALE // TF_FACTOR, impact(rows.astype(np.int64), m[:, None]))
        self.at = (block.hashes & np.uint32(rows.shape[1] - 1)).astype(np.int64)
        found = pc.fill_null(pc.index_in(batch.column(3).flatten(), known), -1).to_numpy()
        held = np.flatnonzero(found >= 0)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(3)).to_numpy())[held]
        self.place, self.impacts = found[held], impact(batch.column(4).flatten().to_numpy()[held], m[row])
        self.start = np.searchsorted(row, np.arange(batch.num_rows + 1))

    def bounds(self, item: int) -> np.ndarray:
        places = self.block.places[item]
        return self.most[:, self.at[places]] @ (self.block.times[item] * self.block.weights[places])

    def scores(self, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact scores of the rows; ``value`` has what an impact of each term of the vocabulary counts."""
        size = self.start[rows + 1] - self.start[rows]
        end = np.cumsum(size)
        own = np.repeat(self.start[rows] - end + size, size) + np.arange(size.sum())
        total = np.concatenate([[0], np.cumsum(self.impacts[own] * value[self.place[own]])])
        return total[end] - total[end - size]


def _search(block: Block, n_docs: int, n_terms: int):
    """A function of batches (doc_id, n, sketch, terms, tfs) that returns the best rows of its task for each item."""

    def look_up(part: Part, best: list[Best], value: np.ndarray) -> None:
        for item, own in enumerate(best):
            bound = part.bounds(item)
            order = np.flatnonzero(bound >= own.floor())
            order = order[np.argsort(-bound[order], kind="stable")]
            places = block.places[item]
            value[places] = block.times[item] * block.weights[places]
            at, step = 0, TOP
            while at < len(order) and bound[order[at]] >= own.floor():
                some = order[at : at + step]
                own.add(part.scores(some, value), part.ids.take(pa.array(some)).to_pylist())
                at, step = at + step, 2 * step
            value[places] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = pa.array(block.vocabulary, pa.binary()), np.zeros(len(block.vocabulary), np.int64)
        best = [Best() for _ in block.names]
        for batch in batches:
            n, size = batch.column(1).to_numpy(), pc.binary_length(batch.column(2)).to_numpy()
            for s in np.unique(size[n > 0]).tolist():
                same, some = np.flatnonzero((size == s) & (n > 0)), max(1, _NUMBERS // s)
                for at in range(0, len(same), some):
                    look_up(Part(batch.take(pa.array(same[at : at + some])), block, known, n_docs, n_terms), best, value)
        out = [(k, block.names[k], -s, None if null else d) for k, b in enumerate(best) for s, null, d in b.rows]
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "score", "doc_id"])

    return run


def blocks(items: DataFrame) -> Iterator[Block]:
    """The distinct rows (item_id, text) in order, BLOCK_ITEMS and BLOCK_TERMS at most; one partition is on the driver at a time."""
    held, terms_held = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        found = counts((row.text or "").encode("utf-8", "surrogatepass"))
        if held and (len(held) == BLOCK_ITEMS or terms_held + len(found) > BLOCK_TERMS):
            yield Block(held)
            held, terms_held = [], 0
        held.append((row.item_id, found))
        terms_held += len(found)
    if held:
        yield Block(held)


def search(indexed: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP rows of ``indexed`` for each distinct row (item_id, text) of ``items``: item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores go by ascending doc_id, a null doc_id last, and rows that repeat a doc_id
    are documents each. Items of one id with different texts are ranked each for itself. A null or empty text has no
    terms: such an item has no rows, such a document is in none and does not count; empty tables give an empty result.
    """
    spark = indexed.sparkSession
    n_docs, n_terms = indexed.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    results = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for block in blocks(items) if n_docs else ():
        found = indexed.select("terms").mapInArrow(_frequencies(block.vocabulary), "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
        block.weigh(n_docs, {r.place: r.df for r in found.collect()})  # a row for each term of the block
        best = indexed.mapInArrow(_search(block, n_docs, n_terms), "item long, item_id long, score long, doc_id long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = best.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
        for keys in (("item", "merge"), ("item",)):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= TOP)
        results.append(materialize(best.select("item_id", "rank", "doc_id", "score"), "ranked"))
    for more in results[1:]:
        results[0] = results[0].union(more)
    return results[0]


def rank(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``search`` over an index of ``documents`` (doc_id, text); other columns are ignored."""
    return search(index(documents), items)


def query(spark, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"
ORACLE = f"""
with docs as (select doc_id, {_TERMS} as terms from documents), sized as (select doc_id, terms, len(terms)::bigint as n from docs where len(terms) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sized),
held as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from sized) group by 1, 2, 3),
wanted as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
weighed as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*)::bigint as df from held group by 1), total),
scored as (
  select item_id, doc_id, sum(times * w * (({SCALE} * tf) // ({TF_FACTOR} * tf + {LENGTH_FACTOR} * ({100 - LENGTH_PART} + ({LENGTH_PART} * n * n_docs) // n_terms))))::bigint as score
  from wanted join weighed using (term) join held using (term), total group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}
"""
