import math

import numpy as np
import pyarrow as pa
import pytest

from levelstream.llm import hard_negatives as H


def brute(rows):
    ok = [(v, label, [math.floor(256 * x) for x in e]) for v, e, label in rows if label is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for v, label, a in ok:
        if v is None or v % 100:
            continue
        others = [(sum(x * y for x, y in zip(a, b, strict=True)), w, other == label) for w, other, b in ok if w != v and len(a) == len(b)]
        for score, positive, _ in sorted((o for o in others if o[2]), key=key)[:5]:
            fit = sorted((o for o in others if not o[2] and 30 * score <= 100 * o[0] <= 90 * score), key=key)[:10]
            out += [(v, positive, k + 1, o[1], score, o[0]) for k, o in enumerate(fit)]
    return sorted(out, key=str)


def made(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(7, dim))
    rows = []
    for i in range(n):
        x = base[i % 7] + rng.normal(size=dim) * rng.choice([0.0, 0.2, 0.5, 1.0])
        rows.append((i * 10, [float(np.float32(y)) for y in x], int(rng.integers(0, 4)) if i % 9 else 1))
    return rows


@pytest.mark.parametrize("sizes", [(8192, 1024, 8192), (16, 40, 3)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "RUN_LEAST", "GROUP"), sizes, strict=True):
        monkeypatch.setattr(H, name, size)
    monkeypatch.setattr(H, "RUN_MOST", 200)
    odd = [(None, [0.5] * 8, 1), (None, [0.25] * 8, 2), (100_000, None, 1), (100_100, [], 1), (100_200, [None] * 8, 1), (100_300, [float("nan")] * 8, 1), (100_400, [float("inf")] * 8, 1), (100_500, [1.0] * 8, None)]
    odd += [(100_600, [0.0] * 8, 1), (100_700, [-1.0] * 8, 9), (100_800, [1.0, 2.0], 1), (100_801, [2.0, 1.0], 1), (100_802, [1.0, 1.0], 2), (100_900, [3e5, -3e5] * 4, 3), (-100, [1.0] * 8, 1)]
    odd += [(200_001 + i, [0.75] * 8, i % 2) for i in range(60)]
    rows = made(4, 240, 8) + odd
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, goals string, row int").repartition(5)
    got = H.mine(table)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(100, [1.0, 1.0], 1)] * 2 + [(1, [1.0, 0.5], 1)] * 2 + [(2, [0.5, 0.5], 2)] * 3
    kind = "vec_id long, embedding array<double>, label long"
    got = H.mine(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 2 * 2 * 3 and {(r.anchor_id, r.positive_id, r.negative_id) for r in got} == {(100, 1, 2)}
    assert H.mine(spark.createDataFrame([], kind)).count() == 0
    assert H.mine(spark.createDataFrame([(3, [1.0], 1), (4, [1.0], 2)], kind)).count() == 0


def test_walk_stops_early_and_exactly():
    rng = np.random.default_rng(8)
    n, dim = 4000, 3
    codes = rng.integers(-300, 300, (n, dim))
    lists = H.Lists(pa.table({"row": np.arange(n), "vec_id": np.arange(n), "label": np.zeros(n, np.int64), "codes": pa.array(codes.tolist(), pa.list_(pa.int64()))}), dim)
    for anchor in (np.array([200, -100, 0]), np.array([0, 0, 0]), np.array([-1, 2, 250])):
        goals = [H.Goal(5), H.Goal(10, 3000, 20_000), H.Goal(10, 5, 4)]
        fits = rng.random(n) < 0.9
        read = H.walk(lists, anchor, goals, fits)
        scores = codes @ anchor
        for g in goals:
            want = sorted((-int(scores[i]), False, i, i) for i in range(n) if fits[i] and g.low <= scores[i] <= g.high)[: g.top]
            assert g.rows == want
        assert read == n if not anchor.any() else read > 0
    alone = [H.Goal(5)]
    assert H.walk(lists, np.array([200, -100, 0]), alone, np.ones(n, bool)) < n // 2
