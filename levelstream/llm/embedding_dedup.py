"""Near-duplicate vectors by cosine, with int8 tile products that are proved by error bounds.

A vector v of length 1 is stored as q * s with int8 q and s = max|v| / 127, and e = |v - q s| is measured. Then
|v.w - (q s).(r t)| <= e + f + e f, so a pair whose quantised product plus that bound stays under the threshold
cannot be a link. The others are computed again in double precision from the vectors as given.

Vectors are quantised once, and codes alone meet all others of their label, tile by tile. Only for the vectors of a
tile pair that are in doubt the vectors themselves are sent there afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, discard, materialize, whole_groups

COSINE = 0.93
#: Vectors of a tile; a task holds the codes of two tiles.
TILE = 1024
#: For what the float arithmetic of the screening may lose; the bound itself is exact.
SLACK = 1e-5
_SCREEN = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e) of rows of length 1: int8 codes, scale and measured error |v - q s|."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def doubtful(codes: np.ndarray, scale: np.ndarray, error: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) whose cosine may reach COSINE; ``left`` and ``right`` are row numbers.

    The int8 products are exact in float32: below 2**24 for up to 1000 dimensions; beyond that they are in int32.
    """
    work = np.float32 if codes.shape[1] <= 1000 else np.int32
    other = codes[right].astype(work).T
    for at in range(0, len(left), _SCREEN):
        rows = left[at : at + _SCREEN]
        product = (codes[rows].astype(work) @ other) * scale[rows][:, None] * scale[right][None, :]
        e, f = error[rows][:, None], error[right][None, :]
        a, b = np.nonzero(product + e + f + e * f >= COSINE - SLACK)
        yield rows[a], right[b]


def links(vectors: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) with cosine >= COSINE, of vectors in double precision."""
    norm = np.linalg.norm(vectors, axis=1)
    some = max(1, (1 << 22) // vectors.shape[1])
    for a, b in doubtful(*quantise(vectors / norm[:, None]), left, right):
        for k in range(0, len(a), some):
            x, y = a[k : k + some], b[k : k + some]
            exact = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y])
            yield x[exact >= COSINE], y[exact >= COSINE]


def _bounded(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two, which is exact and keeps their squares finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, node, copies, embedding) with codes, scale and error for the embedding."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            vectors = _bounded(part.column(4).flatten().to_numpy().astype(np.float64).reshape(-1, dim))
            codes, scale, error = quantise(vectors / np.linalg.norm(vectors, axis=1)[:, None])
            columns = [*part.columns[:4], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "node", "copies", "codes", "scale", "error"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, int]]:
    """The rows of each tile pair with its dimension and tile numbers, from rows sorted by (label, dim, left, right)."""
    for table in whole_groups(batches, ["label", "dim", "left", "right"]):
        keys = [table.column(k).to_numpy() for k in ("label", "dim", "left", "right")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        bounds = [*np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield table.slice(a, b - a), *(int(k[a]) for k in keys[1:])


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile pair that are in a doubtful pair, without their codes."""
    names = ["label", "dim", "left", "right", "own", "node", "copies"]
    for part, dim, i, j in _tiles(batches):
        own, scale, error = (part.column(k).to_numpy() for k in ("own", "scale", "error"))
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int8).reshape(-1, dim)
        found = np.zeros(len(own), bool)
        for a, b in doubtful(codes, scale, error, np.flatnonzero(own == i), np.flatnonzero(own == j)):
            other = a != b
            found[a[other]] = found[b[other]] = True
        yield from part.select(names).filter(pa.array(found)).to_batches()


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per tile pair the links' weights of each end, and a forest."""
    for part, dim, i, j in _tiles(batches):
        ids, own, copies = (part.column(k).to_numpy() for k in ("node", "own", "copies"))
        vectors = _bounded(part.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim))
        forest, weight, trees = Forest(len(ids)), np.zeros(len(ids), np.int64), []
        for x, y in links(vectors, np.flatnonzero(own == i), np.flatnonzero(own == j)):
            if i == j:
                x, y = x[x < y], y[x < y]
            for ends, others in ((x, y), (y, x)):
                weight += np.bincount(ends, copies[others], len(ids)).astype(np.int64)
            trees += forest.add(x, y)
        some = np.flatnonzero(weight)
        pairs = np.array(trees, np.int64).reshape(-1, 2)
        a_ends = np.concatenate([ids[some], ids[pairs[:, 0]]])
        b_ends = np.concatenate([np.full(len(some), -1), ids[pairs[:, 1]]])
        count = np.concatenate([weight[some], np.zeros(len(pairs), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(a_ends), pa.array(b_ends, mask=count > 0), pa.array(count)], ["a", "b", "links"])


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept; links join equal labels at cosine >= COSINE.

    Equal vectors of a label are one node that stands for all its copies, so copies are never paired. The nodes of
    a label are dealt into tiles of about TILE by hash, and each two tiles meet in a task, which returns sums and
    a forest, never its pairs. Vectors that are null, empty, zero or hold a null or a component that is not
    finite, and rows with a null label, link with nothing; vectors of other dimensions are not compared. A
    repeated vec_id with equal vector counts as two vectors; a null vec_id links like any other and is the smallest
    only where it is alone; an empty table gives an empty one; other columns
    are ignored.
    """
    value = F.col("embedding")
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    good = F.col("label").isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    # 0.0 and -0.0 are equal numbers of different bytes
    same = F.transform(value, lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.when(good, same).alias("embedding"))
    nodes = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # The numbers are written with the nodes, so every later read finds the same.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    codes = nodes.select("label", "dim", "node", "copies", "embedding").mapInArrow(_quantised, "label long, dim int, node long, copies long, codes binary, scale double, error double")
    codes = materialize(codes, "codes")
    labels = codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = codes.join(labels, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.select("label", "dim", "own", "node", "copies", "codes", "scale", "error", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("label", "dim", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "node", "copies", "codes", "scale", "error")
    keys = ["label", "dim", "left", "right"]
    screened = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_screened, "label long, dim int, left int, right int, own int, node long, copies long")
    screened = materialize(screened, "screened")
    near = screened.join(nodes.select("node", "embedding"), "node").repartition(*keys).sortWithinPartitions(*keys)
    found = materialize(near.mapInArrow(_tile_pairs, "a long, b long, links long"), "tile-links")
    discard(codes)
    discard(screened)
    tree = components(found.where("b is not null").select("a", "b"))
    weight = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = nodes.join(weight, F.col("node") == F.col("a"), "left").join(tree, F.col("node") == F.col("id"), "left")
    known = known.select("label", "embedding", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "root").select("label", "embedding", "n_links", "component_id")
    joined = rows.join(known, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
with recursive good as (
  select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
), reach as (
  select vec_id as id, vec_id as other from embeddings union select r.id, p.b from reach r join pairs p on r.other = p.a
), smallest as (select id, min(other) as component_id from reach group by 1), links as (select a, count(*) as n from pairs group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join smallest on vec_id = id left join links on vec_id = a
"""
