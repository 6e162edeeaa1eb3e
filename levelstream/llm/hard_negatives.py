"""Hard negatives by the threshold algorithm: sorted lists a dimension, random access to integer scores, early stop.

A vector's components become integers, and a row's score for an anchor is their integer inner product. The rows of a
block are sorted along each dimension. For an anchor the lists are walked from the end that its sign prefers; each row
met is scored at once by all its components, and no row that has not been met can score more than the threshold, the
anchor's product with the values last read. A goal (the anchor's positives, or the window of scores that one positive
allows its negatives) is done when the threshold is strictly under its last kept score, or under the window.

Anchors of a group meet runs of blocks, and what a goal has kept in one block serves in the next. Positives are sought
in runs of the anchor's label alone, negatives in runs of all rows. A task returns what each goal kept in its run, and
windows merge the runs. A run grows with the table to RUN_MOST rows, so that anchors are sent to few runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, whole_groups

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Of its positive's score a negative has at least and at most, in hundredths.
LEAST, MOST = 30, 90
EVERY = 100
#: Rows of a block, of a run at least and at most, runs that a table has before they grow, and anchors of a group.
BLOCK, RUN_LEAST, RUN_MOST, RUNS, GROUP = 8192, 1024, 1 << 17, 64, 8192
#: Rows of each list that are read first; then twice as many each time.
STEP = 16
_KEYS = ["shelf", "dim", "group", "run", "block"]
_ROW = [*_KEYS, "row", "vec_id", "label", "goals", "codes"]
_GOALS = "array<struct<row:bigint,id:bigint,score:bigint>>"
_NONE, _ALL = -(1 << 63), (1 << 63) - 1


class Lists:
    """A block of candidates, sorted along each dimension."""

    def __init__(self, table: pa.Table, dim: int):
        self.row, self.label = (table.column(k).to_numpy() for k in ("row", "label"))
        ids = table.column("vec_id").combine_chunks()
        self.null, self.id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        self.order = np.ascontiguousarray(np.argsort(self.codes, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.codes.T, self.order, axis=1)
        self.largest = int(np.abs(self.codes).max())
        self.exact = self.codes.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray, doubles: bool) -> np.ndarray:
        """Integer inner products; in doubles where every sum stays an exact integer."""
        return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64) if doubles else self.codes[rows] @ anchor


class Goal:
    """The best ``top`` rows with a score from low to high: highest first, equal scores by id (null last), then by row."""

    def __init__(self, top: int, low: int = _NONE, high: int = _ALL):
        self.top, self.low, self.high = top, low, high
        self.rows: list[tuple[int, bool, int, int]] = []

    def floor(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.top else self.low

    def done(self, threshold: int) -> bool:
        """Whether no row that scores the threshold or less can enter."""
        return self.low > self.high or threshold < self.floor()

    def add(self, lists: Lists, rows: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.floor()) & (scores <= self.high)
        rows, scores = rows[fit], scores[fit]
        if len(rows) > self.top:
            best = np.lexsort((lists.row[rows], lists.id[rows], lists.null[rows], -scores))[: self.top]
            rows, scores = rows[best], scores[best]
        if len(rows):
            new = zip((-scores).tolist(), lists.null[rows].tolist(), lists.id[rows].tolist(), lists.row[rows].tolist(), strict=True)
            self.rows = sorted([*self.rows, *new])[: self.top]


def walk(lists: Lists, anchor: np.ndarray, goals: list[Goal], fits: np.ndarray) -> int:
    """The threshold algorithm on a block for one anchor; rows count only where ``fits``. Returns how many rows it scored."""
    n = len(lists.row)
    dims = np.flatnonzero(anchor)
    dims = dims if len(dims) else np.array([0])
    own = anchor[dims]
    doubles = lists.largest * int(np.abs(anchor).max()) * len(anchor) < 1 << 53
    place = lambda depth: np.where(own > 0, n - 1 - depth, depth)
    limit = lambda depth: int((own * lists.values[dims, place(depth)]).sum())
    seen = np.zeros(n, bool)
    depth, step, threshold = 0, STEP, limit(0)
    left = [g for g in goals if not g.done(threshold)]
    while left and depth < n:
        end = min(n, depth + step)
        met = np.zeros(n, bool)
        met[lists.order[dims[:, None], place(np.arange(depth, end)[:, None]).T]] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        scores = lists.scores(new, anchor, doubles)
        valid = fits[new]
        for goal in left:
            goal.add(lists, new[valid], scores[valid])
        depth, step, threshold = end, 2 * step, limit(end - 1)
        left = [g for g in left if not g.done(threshold)]
    return int(seen.sum())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each key, of rows sorted by the keys."""
    for table in whole_groups(batches, _KEYS):
        keys = [table.column(k).to_numpy() for k in _KEYS]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        bounds = [*np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield tuple(int(k[a]) for k in keys), table.slice(a, b - a)


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each goal keeps of its run: rows with block -1 are the anchors, which come before the candidates."""
    names = ["anchor", "anchor_id", "goal", "goal_id", "goal_score", "row", "id", "score"]
    anchors: list[tuple] = []
    group: tuple = ()

    def kept() -> pa.RecordBatch:
        out = [(a, i, *g, row, None if null else own, -score) for a, i, _, _, goals in anchors for g, goal in goals for score, null, own, row in goal.rows]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(8)], names)

    for key, table in _pieces(batches):
        if key[-1] < 0:
            yield kept()
            codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, key[1])
            anchors, group = [], key[:-1]
            for k, (row, vec, label, goals) in enumerate(zip(*(table.column(c).to_pylist() for c in ("row", "vec_id", "label", "goals")), strict=True)):
                if goals is None:
                    wanted = [((None, None, None), Goal(POSITIVES))]
                else:
                    wanted = [((g["row"], g["id"], g["score"]), Goal(NEGATIVES, -(-LEAST * g["score"] // 100), MOST * g["score"] // 100)) for g in goals]
                anchors.append((row, vec, (label, goals is None), codes[k], wanted))
        elif key[:-1] == group:  # a group may have no anchors
            lists = Lists(table, key[1])
            for _, vec, (label, same), own, wanted in anchors:
                fits = (lists.label == label) & (lists.null | (lists.id != vec)) if same else lists.label != label
                walk(lists, own, [g for _, g in wanted], fits)
    yield kept()


def _meet(anchors: DataFrame, candidates: DataFrame, shelf: Column) -> DataFrame:
    """What the goals of ``anchors`` keep of the ``candidates`` of their shelf and dimension, run by run."""
    spark = anchors.sparkSession
    anchors, candidates = anchors.withColumn("shelf", shelf), candidates.withColumn("shelf", shelf)
    asked = anchors.groupBy("shelf", "dim").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    held = candidates.groupBy("shelf", "dim").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(RUN_LEAST), F.least(F.lit(RUN_MOST), F.ceil(F.col("n") / RUNS)))
    shelves = asked.join(held, ["shelf", "dim"]).select("shelf", "dim", "groups", F.ceil(F.col("n") / size).cast("int").alias("runs"), F.ceil(size / BLOCK).cast("int").alias("blocks"))
    shelves = materialize(shelves, "shelves")
    dealt = lambda n, *salt: F.pmod(F.xxhash64("row", *salt), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = anchors.join(shelves, ["shelf", "dim"]).withColumns({"group": dealt("groups"), "run": each("runs"), "block": F.lit(-1)}).select(*_ROW)
    far = candidates.withColumn("goals", F.lit(None).cast(_GOALS)).join(shelves, ["shelf", "dim"])
    far = far.withColumns({"group": each("groups"), "run": dealt("runs"), "block": dealt("blocks", F.lit(1))}).select(*_ROW)
    # a task's time is in its products, not its bytes, so its keys are not put together by size
    both = near.unionByName(far).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_KEYS[:-1]).sortWithinPartitions(*_KEYS)
    return both.mapInArrow(_mined, "anchor long, anchor_id long, goal long, goal_id long, goal_score long, row long, id long, score long")


def _best(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, embedding).

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part. Anchors are rows
    whose vec_id is divisible by ``every``; their positives are the first POSITIVES rows of their label with another
    vec_id, and each positive has the first NEGATIVES rows of other labels within its window. Higher scores come
    first, then smaller ids (a null id last). Rows that repeat a vec_id are rows each, so a repeated anchor has its
    results as often. Vectors of different dimensions never meet. Components are cut off where the product of two
    vectors could leave the range of long (beyond 1,480,000 in 64 dimensions). An anchor without positives, or a
    positive without negatives, has no rows; an empty table gives an empty one; other columns are ignored.
    """
    value, dim = F.col("embedding"), F.size("embedding")
    good = F.col("label").isNotNull() & (dim > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.floor(F.sqrt(F.lit(9.2e18) / dim))
    codes = F.transform(value, lambda x: F.greatest(-most, F.least(most, F.floor(SCALE * x.cast("double")))))
    rows = embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), dim.alias("dim"), codes.alias("codes"))
    # The numbers are written with the rows, so every later read finds the same.
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "mined-vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    pairs = _best(_meet(anchors.withColumn("goals", F.lit(None).cast(_GOALS)), rows, F.col("label")), ["anchor"], POSITIVES)
    goals = pairs.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", "id", "score")).alias("goals"))
    goals = materialize(anchors.join(goals, "row").select("row", "vec_id", "label", "dim", "codes", "goals"), "mined-goals")
    found = _best(_meet(goals, rows, F.lit(0).cast("long")), ["anchor", "goal"], NEGATIVES)
    return found.select("anchor_id", F.col("goal_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("goal_score").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(rows.withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")))


ORACLE = f"""
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as codes from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.codes, b.codes)::bigint as score
  from good a join good b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id and len(a.codes) = len(b.codes)
), positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, other) <= {POSITIVES}
), ranked as (
  select p.*, n.other as negative_id, n.score as negative_score, row_number() over (partition by anchor_id, positive_id order by n.score desc, n.other)::int as rank
  from positives p join scored n using (anchor_id) where not n.same and {LEAST} * positive_score <= 100 * n.score and 100 * n.score <= {MOST} * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= {NEGATIVES}
"""
