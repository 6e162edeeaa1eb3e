import math
import random

import pytest
from pyspark.sql import functions as F

from levelstream.operators import segment_fits as S

BOUNDS = {"gain": (-2.0, 3.0), "bias": (-10.0, 20.0)}


def line(p):
    return p["gain"] * F.col("x") + p["bias"]


def made(seed, noise):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        a, b = rng.uniform(-1, 2), rng.uniform(-5, 12)
        out += [(g, x, a * x + b + rng.gauss(0, noise)) for x in (rng.uniform(-3, 3) for _ in range(rng.randrange(4, 30)))]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 7.0) for r in rows], "segment_id long, x double, expected double, errors double").repartition(5)


def error(rows, gain, bias):
    return sum((y - gain * x - bias) ** 2 for x, y in rows) / len(rows)


def by_segment(rows):
    out = {}
    for g, x, y in rows:
        out.setdefault(g, []).append((x, y))
    return out


def check(got, want, names=("gain", "bias")):
    assert {r.segment_id for r in got} == want.keys()
    for r in got:
        assert all(math.isclose(r[n], want[r.segment_id][k], abs_tol=1e-9) for k, n in enumerate(names)), (r, want[r.segment_id])


def test_scan_is_the_plain_scan(spark):
    rows = made(1, 2.0)
    want = {}
    for g, own in by_segment(rows).items():
        held = [low for low, _ in BOUNDS.values()]
        for _ in range(3):
            for k, (low, high) in enumerate(BOUNDS.values()):
                trials = [[*held[:k], low + (high - low) * i / 6, *held[k + 1 :]] for i in range(7)]
                best = min(trials, key=lambda t: error(own, *t))
                held = best if error(own, *best) < error(own, *held) else held
        want[g] = held
    got = S.scan(table(spark, rows), BOUNDS, line, ["segment_id"], 6, 3).collect()
    check(got, want)
    assert all(math.isclose(r.fitness, error(by_segment(rows)[r.segment_id], r.gain, r.bias) ** 0.5, rel_tol=1e-9) and r.n == len(by_segment(rows)[r.segment_id]) for r in got)


def test_contraction_finds_the_line(spark):
    rows = made(2, 0.0)
    got = S.ternary(table(spark, rows), BOUNDS, line, ["segment_id"], 14, 6).collect()
    assert len(got) == 12 and all(r.fitness < 0.2 for r in got)
    # one parameter alone is convex and so exact to the width of the last interval
    fixed = {"gain": (-2.0, 3.0), "bias": (0.0, 0.0)}
    ramps = [(g, float(x), 0.3 * g * x - 1.5 * x) for g in range(5) for x in range(1, 6)]
    got = S.ternary(table(spark, ramps), fixed, line, ["segment_id"], 20, 1).collect()
    assert all(abs(r.gain - (0.3 * r.segment_id - 1.5)) < 5 * (2 / 3) ** 19 and r.bias == 0.0 for r in got)


def test_own_and_shared_are_the_plain_rounds(spark):
    rows = made(3, 1.0)
    segments = by_segment(rows)
    own, shared = {g: [-2.0, 3.0, None] for g in segments}, [-10.0, 20.0, 5.0]
    for _ in range(4):
        for state in own.values():
            state[2] = None
        for g, state in own.items():
            low, high, _ = state
            gain = min((low + (high - low) * i / 4 for i in range(5)), key=lambda v: error(segments[g], v, shared[2]))
            own[g] = [max(-2.0, gain - (high - low) / 4), min(3.0, gain + (high - low) / 4), gain]
        low, high, _ = shared
        bias = min((low + (high - low) * i / 4 for i in range(5)), key=lambda v: sum((y - own[g][2] * x - v) ** 2 for g, x, y in rows))
        shared = [max(-10.0, bias - (high - low) / 4), min(20.0, bias + (high - low) / 4), bias]
    found, values, total = S.solve_segments(table(spark, rows), {"gain": BOUNDS["gain"]}, {"bias": BOUNDS["bias"]}, line, ["segment_id"])
    check(found.collect(), {g: [s[2]] for g, s in own.items()}, ("gain",))
    assert math.isclose(values["bias"], shared[2])
    assert math.isclose(total**2, sum((y - own[g][2] * x - shared[2]) ** 2 for g, x, y in rows) / len(rows), rel_tol=1e-9)


def test_two_own_parameters_two_keys_and_odd_rows(spark):
    rows = [("a", 1, float(x), 2.0 * x + 4) for x in range(5)] + [("a", 2, float(x), -1.0 * x) for x in range(5)] + [("b", 1, None, 3.0), ("b", 2, float("nan"), 3.0), ("c", 1, 1.0, None)]
    inputs = spark.createDataFrame(rows, "user string, day int, x double, expected double")
    own = {"gain": (-2.0, 2.0), "bias": (-4.0, 4.0)}
    found, values, total = S.solve_segments(inputs, own, {"offset": (0.0, 0.0)}, lambda p: line(p) + p["offset"], ["user", "day"], 5, 2)
    got = {(r.user, r.day): r for r in found.collect()}
    assert got.keys() == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert (got["a", 1].gain, got["a", 1].bias, got["a", 1].fitness) == (2.0, 4.0, 0.0) and (got["a", 2].gain, got["a", 2].bias) == (-1.0, 0.0)
    assert got["b", 1].fitness is None
    for fit in (S.scan, S.ternary):
        got = {(r.user, r.day): r for r in fit(inputs, own, line, ["user", "day"]).collect()}
        assert len(got) == 4 and got["a", 2].fitness < 1.0 and got["b", 1].fitness is None
        assert fit(inputs.limit(0), own, line, ["user", "day"]).count() == 0
    assert S.solve_segments(inputs.limit(0), own, {"offset": (0.0, 2.0)}, line, ["user", "day"])[0].count() == 0


def test_rounds_share_one_exchange_of_the_rows(spark):
    rows = S.kept_rows(table(spark, made(1, 1.0)), ["segment_id"])
    state = S.cut(rows.select("segment_id").distinct().withColumn("gain", F.lit(1.0)))
    for _ in range(3):
        state = S._step(rows, state, ["segment_id"], lambda p: p["gain"] * F.col("x"), [{"gain": F.col("gain")}]).select("segment_id", (F.col("gain") + F.col("errors")[0] * 0).alias("gain"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = state.select("*")
        frame._jdf.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") >= 2, plan


def test_too_many_trials_are_refused(spark):
    with pytest.raises(ValueError):
        S.solve_segments(table(spark, made(1, 1.0)), {f"p{k}": (0.0, 1.0) for k in range(4)}, {"q": (0.0, 1.0)}, lambda p: p["q"], ["segment_id"])
