import numpy as np
import pytest

from levelstream.llm import embedding_dedup as E

from .test_simhash import brute_components


def brute(rows):
    ok = {}
    for i, (v, x, label) in enumerate(rows):
        a = np.array([np.nan if y is None else y for y in x] if x else [np.nan], np.float32).astype(float)
        if label is not None and np.isfinite(a).all() and (a != 0).any():
            ok[i] = a
    links = []
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt(ok[i] @ ok[i]) / np.sqrt(ok[j] @ ok[j]) >= E.COSINE:
                links.append((i, j))
    root = brute_components(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], sum(i in p for p in links), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [8, 1024])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(9, 12))
    rows = []
    for i in range(160):
        x = base[i % 9] + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.25, 0.4, 1.0])
        rows.append((int(i * 7 % 1000), [float(np.float32(y)) for y in x], int(i % 3) if i % 11 else None))
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 12, 1), (2003, [float("nan")] * 12, 1), (2004, [None] * 12, 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [float("inf")] * 12, 1), (2008, [-0.0, 1.0], 2), (2009, [0.0, 1.0], 2)]
    got = E.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_bound_holds_and_empty(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = E.quantise(x)
    gap = np.abs((q.astype(int) @ q.T.astype(int)) * s[:, None] * s - x @ x.T)
    assert (gap <= e[:, None] + e + e[:, None] * e + 1e-12).all()
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (None, None, 1), (7, [0.0, 1.0], None)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("5", 1, "5", True), ("7", 0, "7", True), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 1, "5", False)]
