import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from levelstream.operators import averaged as A
from levelstream.operators import events as E

from .test_routing import T0


def tables(spark, knots, asked):
    at = lambda m: T0 + datetime.timedelta(seconds=round(m * 60))
    k = spark.createDataFrame([(g, at(m), float(v), "x") for g, m, v in knots], "segment_id long, device_time timestamp_ntz, level double, around string")
    a = spark.createDataFrame([(g, at(m), i, 1) for i, (g, m) in enumerate(asked)], "segment_id long, device_time timestamp_ntz, seq long, last int")
    return a, k


def plain(knots, x, passes, kind):
    """Every pass on the whole signal (t, y)."""
    rate = (lambda a, b: math.log(b[1] / a[1]) / (b[0] - a[0])) if kind == "exp" else (lambda a, b: (b[1] - a[1]) / (b[0] - a[0]))
    go = (lambda p, k, t: p[1] * math.exp(k * (t - p[0]))) if kind == "exp" else (lambda p, k, t: p[1] + k * (t - p[0]))
    p = [(t, y + (A.OFFSET if kind == "exp" else 0)) for t, y in knots]
    if len(p) < 2 or not p[0][0] <= x <= p[-1][0]:
        return None
    for step in range(passes + 1):
        m = len(p) - 1
        ks = [rate(p[i], p[min(i + 2, m)]) for i in range(m)]
        if step == passes:
            break
        new = []
        for i in range(m + 1):
            new.append(p[i] if i in (0, m - 1, m) else (p[i][0], (go(p[i - 1], ks[i - 1], p[i][0]) + p[i][1]) / 2))
            if i < m:
                t = (p[i][0] + p[i + 1][0]) / 2
                own = go(p[i], ks[i], t)
                new.append((t, own if i in (0, m - 1) else (go(p[i - 1], ks[i - 1], t) + own) / 2))
        p = new
    r = next(i for i, q in enumerate(p) if q[0] >= x)
    lift = A.OFFSET if kind == "exp" else 0
    if r == 0:
        return p[0][1] - lift
    before = go(p[r - 1], ks[r - 1], x)
    return (before if r == m else (before + go(p[r], ks[r], x)) / 2) - lift


@pytest.mark.parametrize(("passes", "kind"), [(0, "exp"), (1, "line"), (4, "exp")])
def test_local_halving_is_the_whole_one(spark, passes, kind):
    rng = random.Random(passes)
    knots = [(g, m, rng.uniform(-5, 30)) for g in range(1, 14) for m in sorted(rng.sample(range(0, 600), min(g, 12)))]
    asked = [(g, m) for g, m, _ in knots] + [(g, rng.uniform(-20, 620)) for g in range(1, 14) for _ in range(12)] + [(77, 5)]
    a, k = tables(spark, knots, asked)
    got = A.averaged(a, k, passes, kind).withColumn("x", E.days()).collect()
    days = {(r.segment_id, r.t): r.level for r in k.select("segment_id", E.days().alias("t"), "level").collect()}
    assert len(got) == len(asked)
    for r in got:
        want = plain(sorted((t, y) for (g, t), y in days.items() if g == r.segment_id), r.x, passes, kind)
        assert (r.value is None) == (want is None), r
        assert want is None or math.isclose(r.value, want, abs_tol=1e-5), (r, want)


def test_a_ramp_is_met_and_a_constant_stays(spark):
    a, k = tables(spark, [(1, m, 2.0 + 0.1 * m) for m in (0, 7, 20, 22, 60, 90)] + [(2, m, 6.0) for m in (0, 10, 50)], [(g, m) for g in (1, 2) for m in range(0, 51, 5)])
    for r in A.averaged(a, k, 6, "line").withColumn("m", F.timestamp_diff("MINUTE", F.lit(T0), F.col("device_time"))).collect():
        assert math.isclose(r.value, 2.0 + 0.1 * r.m if r.segment_id == 1 else 6.0, abs_tol=1e-6)
    assert all(math.isclose(r.value, 6.0, abs_tol=1e-6) for r in A.averaged(a, k, 10).where("segment_id = 2").collect())
    assert A.averaged(a, k.limit(0), 2).where("value is not null").count() == 0 and A.averaged(a.limit(0), k, 2).count() == 0
    with pytest.raises(ValueError):
        A.averaged(a, k, 2, "spline")


def test_batches_are_halved_together(spark):
    """Asked times of segments of all lengths in one batch, and levels without a logarithm, meet no other row's points."""
    rng = random.Random(9)
    knots = [(g, m, rng.uniform(-5, 30)) for g in range(1, 11) for m in sorted(rng.sample(range(0, 300), g))] + [(50, m, -A.OFFSET - 1 if m == 20 else 5.0) for m in range(0, 100, 10)]
    asked = [(g, m) for m in range(0, 300, 17) for g in [*range(1, 11), 50]]
    a, k = tables(spark, knots, asked)
    made = A.averaged(a.coalesce(1), k.coalesce(1), 3)
    # Before, each row was halved by itself in nested lambdas of columns.
    assert "ArrowEvalPython" in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.segment_id, r.seq): r.value for r in made.collect()}
    for g in range(1, 11):
        alone = {(r.segment_id, r.seq): r.value for r in A.averaged(a.where(f"segment_id = {g}"), k.where(f"segment_id = {g}"), 3).collect()}
        assert alone == {key: v for key, v in got.items() if key[0] == g}
    assert got[50, asked.index((50, 17))] is None and math.isclose(got[50, asked.index((50, 85))], 5.0, abs_tol=1e-6)
