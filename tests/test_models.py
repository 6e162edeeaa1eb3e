import datetime
import math

import pytest

from levelstream.operators import asof, fitting, metrics, models, scores
from levelstream.operators import events as E

from .test_routing import T0, made

KNOTS = "segment_id long, device_time timestamp_ntz, level double"


def knots(spark, points, segment=1):
    return spark.createDataFrame([(segment, T0 + datetime.timedelta(minutes=m), float(v)) for m, v in points], KNOTS)


def asked(spark, minutes, segment=1):
    rows = [(segment, T0 + datetime.timedelta(minutes=m), i) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "segment_id long, device_time timestamp_ntz, seq long")


@pytest.mark.parametrize("how", [asof.interpolate, asof.akima])
def test_a_ramp_is_met_and_nothing_is_extrapolated(spark, how):
    points = [(m, 3 + m / 10) for m in (0, 7, 10, 21, 30, 33)]
    got = {r.seq: r.value for r in how(asked(spark, [-1, 0, 5, 10, 25.5, 33, 34]), knots(spark, points)).collect()}
    assert got[0] is None and got[6] is None
    assert all(abs(got[i] - (3 + m / 10)) < 1e-9 for i, m in ((1, 0), (2, 5), (3, 10), (4, 25.5), (5, 33)))


def test_akima_of_a_sine_and_too_few_knots(spark):
    points = [(m, math.sin(m / 60)) for m in range(0, 400, 10)]
    got = {r.seq: r.value for r in asof.akima(asked(spark, [33, 101, 222]), knots(spark, points)).collect()}
    assert all(abs(got[i] - math.sin(m / 60)) < 2e-3 for i, m in enumerate((33, 101, 222)))
    assert asof.akima(asked(spark, [5]), knots(spark, points[:4])).first().value is None


def test_slope_is_per_day(spark):
    got = models.at(asked(spark, [5]), knots(spark, [(0, 1), (10, 2)]), 0.0, "slope", slope=True).first().slope
    assert abs(got - 144) < 1e-9


def test_one_bolus_decays(spark):
    doses = knots(spark, [(0, 4.0)]).withColumnRenamed("x", "x")
    minutes = [-5, 0, 74, 76, 179, 180, 300]
    for kernel in ("bilinear", "exponential"):
        got = {minutes[r.seq]: r.value for r in models.on_board(asked(spark, minutes), doses, kernel).collect()}
        assert got[-5] == 0 and abs(got[0] - 4) < 0.05 and got[180] == 0 and got[300] == 0
        assert got[0] > got[74] > got[76] > got[179] >= -0.01
    grid = list(range(0, 181))
    got = models.on_board(asked(spark, grid), doses, "bilinear_activity").collect()
    assert abs(sum(r.value for r in got) - 4) < 0.1


def test_blood_of_steady_state(spark):
    model = models.Diffusion()
    level = 6.0
    roots = [r.value for r in models.diffusion_blood(asked(spark, [100]), knots(spark, [(m, level) for m in range(0, 300, 5)]), model).collect()]
    b = roots[0]
    assert abs(model.cg * b * b + (model.p - model.cg * level) * b + model.c - level) < 1e-9


def test_lags_and_suspend(spark):
    ist = knots(spark, [(m, 5 - (m == 60) * 2) for m in range(0, 200, 5)])
    got = {r.seq: r.value for r in models.low_glucose_suspend(asked(spark, [50, 60, 85, 95]), ist).collect()}
    assert got == {0: 1.3, 1: 0.0, 2: 0.0, 3: 1.3}
    lags = models.lag_grid(asked(spark, [20]), ist, 5 * models.MINUTE, 6).first().lags
    assert lags == [5.0] * 5 + [None]


@pytest.mark.parametrize(("levels", "name"), [((1, 2, 4), "accel"), ((1, 3, 4), "up"), ((1, 2, 2), "concave"), ((4, 3, 3.05), "convex"), ((4, 3, 1), "deccel"), ((4, 2, 1), "down"), ((1, 1, 2), "steady_up"), ((2, 2.05, 1), "steady_down"), ((1, 1.08, 1.05), "steady")])
def test_shapes(spark, levels, name):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([tuple(map(float, levels))], "a double, b double, c double")
    assert row.select(models.shape(F.col("a"), F.col("b"), F.col("c"))).first()[0] == name


def test_grid_zones(spark):
    from pyspark.sql import functions as F

    points = [(100, 100, "A"), (100, 160, "B"), (150, 300, "C"), (50, 120, "D"), (50, 300, "E"), (300, 50, "E")]
    rows = spark.createDataFrame([(a / scores.MGDL, b / scores.MGDL) for a, b, _ in points], "e double, c double")
    assert [r[0] for r in rows.select(scores.zone("clarke", F.col("e"), F.col("c"))).collect()] == [z for _, _, z in points]


def test_metrics_by_hand(spark):
    ds = [0.5, 1.0, 2.0, 4.0, 0.0]
    rows = [(1, T0 + datetime.timedelta(days=i), i, 10.0, 10.0 - x) for i, x in enumerate(ds)]
    pairs = spark.createDataFrame(rows, "segment_id long, device_time timestamp_ntz, seq long, expected double, calculated double")
    r = metrics.all_metrics(pairs, ["segment_id"], metrics.Options(threshold=0.0)).first()
    n = len(ds)
    div = n - 1.5 + 1 / (8 * (n - 1))
    mean = sum(ds) / div
    assert abs(r.avg_abs - 1.5) < 1e-12 and r.max_abs == 4 and r.over_threshold == 4 and r.leal is None and r.percentile == 0.0
    assert abs(r.variance - sum((x - mean) ** 2 for x in ds) / div) < 1e-9
    s = sorted(ds)
    assert abs(r.integral_cdf - sum((a + b) / 2 for a, b in zip(s, s[1:], strict=False)) / n / n) < 1e-12
    way = lambda a, b: math.sqrt(1 + (a - b) ** 2)
    c = [10 - x for x in ds]
    assert abs(r.crosswalk - sum(way(10, c[i]) + way(c[i - 1], 10) - 1 for i in range(1, n)) / n) < 1e-9
    assert metrics.simple(pairs, ["segment_id"], metrics.Options(required=6)).first().avg_abs is None
    assert abs(metrics.simple(pairs, ["segment_id"], metrics.Options(prefer_more=True)).first().avg_abs - 0.3) < 1e-12


def test_total_is_of_the_union(spark):
    events = made(spark, [(i % 4, "ig", i, (i * i) % 17) for i in range(80)])
    rows = {r.segment_id: r for r in scores.signal_stats(events, "ig").collect()}
    assert rows[None].n == sum(r.n for k, r in rows.items() if k is not None) == 80 and len(rows) == 5
    assert rows[None].most == max(r.most for r in rows.values())


def test_fitting_finds_a_line(spark):
    rows = spark.createDataFrame([(float(2 * x + 1), float(x)) for x in range(50)], "expected double, calculated double")
    from pyspark.sql import functions as F

    model = F.col("gain") * F.col("calculated") + F.col("bias")
    found, fitness = fitting.refine(rows, {"gain": (0.0, 4.0), "bias": (-3.0, 5.0)}, model, 5, 3)
    assert fitness < 1e-9 and abs(found["gain"] - 2) < 1e-9 and abs(found["bias"] - 1) < 1e-9
    evolved, score = fitting.evolve(rows, {"gain": (0.0, 4.0), "bias": (-3.0, 5.0)}, model, 16, 8)
    assert score < 3
    flown, score = fitting.swarm(rows, {"gain": (0.0, 4.0), "bias": (-3.0, 5.0)}, model, 16, 8)
    assert score < 3 and 0 <= flown["gain"] <= 4


def test_sensor_line_is_least_squares(spark):
    events = made(spark, [(1, "sensed", m, 2 * m + 3) for m in range(0, 100, 5)] + [(1, "cal", m, m) for m in range(10, 90, 20)])
    r = models.sensor_calibration(events, "sensed", "cal").first()
    assert abs(r.slope - 0.5) < 1e-9 and abs(r.offset - 1.5) < 1e-9
    corrected = {x.seq: x.level for x in models.emulated_sensor(events, "sensed", "cal").collect()}
    assert abs(corrected[4] - 20) < 1e-9
    assert E.signal(events, "cal").count() == 4


def test_lag_grows_with_the_level(spark):
    """On a ramp the lag of the blood model is dt + k i (i - i_h) / h, and the interstitial model finds its way back."""
    ist = knots(spark, [(m, 5 + m / 100) for m in range(0, 1500, 5)])
    model = models.Diffusion(k=-2.6e-3)
    at = lambda m: 5 + m / 100
    got = models.diffusion_blood(asked(spark, [600]), ist, model).first().value
    i, back = at(600), at(600 - model.h * 1440)
    future = at(600 + (model.dt + model.k * i * (i - back) / model.h) * 1440)
    beta = model.p - model.cg * i
    assert abs(got - (math.sqrt(beta**2 - 4 * model.cg * (model.c - future)) - beta) / (2 * model.cg)) < 1e-6
    r = models.diffusion_interstitial(asked(spark, [600, 5000]), ist, ist, model).collect()
    miss = lambda o: abs(o + model.k / model.h * 86400 * at(600 - model.dt * 1440 + o / 60) * (model.h * 1440 / 100))
    best = min(range(-900, 901), key=miss)
    here = at(600 - model.dt * 1440 + best / 60)
    value = {x.seq: x.value for x in r}
    assert value[1] is None and abs(value[0] - (model.p * here + model.c)) < 1e-6


def test_lags_are_tried_where_the_knots_are(spark):
    import random

    rng = random.Random(3)
    ist = [(m, rng.uniform(4, 15)) for m in sorted(rng.sample(range(300), 50))]
    table = knots(spark, ist).union(knots(spark, [(100, 5.0)], 2))
    times = asked(spark, range(-20, 400, 9)).union(asked(spark, [100, 140], 2)).union(asked(spark, [5], 3))
    found = models.diffusion_interstitial(times, table, table)
    # Before, each asked time was 122 rows of a shuffle, and 122 more.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
    model = models.Diffusion()

    def at(t):
        for (a, x), (b, y) in zip(ist, ist[1:], strict=False):
            if a * 60 <= t <= b * 60:
                return x + (t - a * 60) * (y - x) / ((b - a) * 60)

    def near(t, tried):
        known = [(abs(o + model.k / model.h * 86400 * h * (h - b)), o) for o in tried for h, b in [(at(t + o - model.dt * 86400), at(t + o - (model.dt + model.h) * 86400))] if h is not None and b is not None]
        return min(known)[1] if known else None

    got = {(r.segment_id, (r.device_time - T0).total_seconds()): r.value for r in found.collect()}
    assert len(got) == times.count()
    for (g, t), value in got.items():
        about = near(t, range(-900, 901, 30)) if g == 1 else None
        want = None
        if about is not None:
            x = at(t + near(t, range(max(-900, about - 30), min(900, about + 30) + 1)) - model.dt * 86400)
            want = model.p * x + model.c
        assert (value is None) == (want is None) and (want is None or math.isclose(value, want, abs_tol=1e-6)), (g, t, value, want)
    assert sum(v is not None for v in got.values()) > 20


def test_many_lags_are_no_rows(spark):
    from pyspark.sql import functions as F

    ist = knots(spark, [(m, 4 + m / 100 + (m % 7) / 5) for m in range(0, 200, 3)]).union(knots(spark, [(50, 6.0)], 2))
    times = asked(spark, [-5, 0, 20, 51, 100, 190, 300]).union(asked(spark, [50, 60], 2)).union(asked(spark, [5], 3))
    got = {(r.segment_id, r.seq): r.lags for r in models.at_shifts(times, ist, [-k * models.MINUTE for k in range(30)], "lags").collect()}
    want = {(r.segment_id, r.seq): r.lags for r in models.lag_grid(times, ist, models.MINUTE, 30).collect()}
    assert got == want and any(x is None for x in got[1, 2]) and None not in got[1, 3]
    doses = times.withColumn("iob", F.lit(0.1))
    made = models.beta_pid(times, ist, doses)
    rates = {(r.segment_id, r.seq): r.value for r in made.collect()}
    assert rates.keys() == got.keys() and all(0 <= v <= 3.5 for k, v in rates.items() if v is not None) and rates[1, 4] is not None
    assert all(rates[k] is None for k in got if got[k][0] is None)
    # Before, each asked time was 31 rows, gathered in one row of 31 columns.
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_knots_around_a_time(spark):
    table = knots(spark, [(m, m) for m in (0, 10, 20, 30, 40)])
    got = {r.seq: r.levels for r in asof.around(asked(spark, [-50, 15, 25, 35, 90]), table, -6 * 60_000_000, 6 * 60_000_000).collect()}
    assert got == {0: [], 1: [0.0, 10.0, 20.0, 30.0], 2: [10.0, 20.0, 30.0, 40.0], 3: [20.0, 30.0, 40.0], 4: [40.0]}


def test_patterns_are_learnt_over_segments(spark):
    """A sawtooth of 5-minute levels: what followed a pattern in one segment is told in the next."""
    levels = [4.0, 4.5, 5.5, 7.0, 6.0, 5.0] * 4
    one = [(1, "ig", 5 * k, v) for k, v in enumerate(levels)]
    two = [(2, "ig", 5 * k + 1000, v) for k, v in enumerate(levels[:6])]
    rows = E.signal(made(spark, one + two), "ig")
    got = {(r.segment_id, r.seq): r for r in models.pattern_prediction(rows, 10 * models.MINUTE, 5 * models.MINUTE).collect()}
    state, want = {}, {}
    order = sorted([(m, i, g, v) for i, (g, _, m, v) in enumerate(one + two)])
    level = {(g, m): v for m, _, g, v in order}
    name = lambda a, b, c: next(n for n, test in (("up", a < b < c and abs(c - b) <= abs(b - a)), ("accel", a < b < c), ("concave", a < b), ("convex", a > b and c >= b), ("down", a > b > c and abs(c - b) <= abs(b - a)), ("deccel", a > b > c)) if test)
    pattern = lambda g, m: None if any((g, m - d) not in level for d in (0, 5, 10)) else (name(*(level[g, m - d] for d in (10, 5, 0))), 31 if level[g, m] >= 13 else math.floor((level[g, m] - 3) * 3 + 0.5))
    for m, i, g, v in order:
        if pattern(g, m - 10):
            state[pattern(g, m - 10)] = v
        if pattern(g, m):
            want[g, i] = (*pattern(g, m), state.get(pattern(g, m)))
    assert {k: (r["shape"], r["band"], r.predicted) for k, r in got.items()} == want
    assert any(g == 2 and v[2] is not None for (g, _), v in want.items())


@pytest.mark.parametrize("part", ["signal", "period", "error"])
def test_skewness_of_equal_values_is_the_quotient_by_zero(spark, part):
    from fractions import Fraction

    levels = {g: v for g, v in enumerate((5.3, 29.27, 122.79, 12.7, 0.1, 64.0, 0.0))}
    if part == "signal":
        got = scores.signal_stats(made(spark, [(g, "ig", 0, v) for g, v in levels.items()] + [(8, "ig", m, 0.5) for m in (0, 1)]), "ig")
        levels[8] = 0.5
    elif part == "period":
        got = scores.period_stats(made(spark, [(g, "ig", m, 1.0) for g, v in levels.items() for m in (0, 7 * g + 3)]), "ig")
        levels = {g: (7 * g + 3) * 60e6 / 86400e6 for g in levels}
    else:
        got = scores.signal_error_stats(spark.createDataFrame([(g, v, 0.0) for g, v in levels.items()], "segment_id long, expected double, calculated double")).where("kind = 'absolute'")
    got = {r.segment_id: r for r in got.collect()}
    cube = lambda x: float(Fraction(x) ** 3)
    for g, x in levels.items():
        rest = cube(x) - 3 * x * (x * x) + 2 * cube(x)
        assert got[g].sd == 0 and got[g].kurtosis is None
        assert math.isnan(got[g].skewness) if rest == 0 else got[g].skewness == math.copysign(math.inf, rest)
    assert math.isfinite(got[None].skewness)


def test_percentiles_of_hot_groups_are_exact(spark, monkeypatch):
    import numpy as np

    from levelstream.operators import ranks

    monkeypatch.setattr(ranks, "CELLS", 4)
    rng = np.random.default_rng(1)
    rows = [(1, float(x)) for x in rng.integers(0, 30, 500)] + [(2, float(x)) for x in rng.normal(size=50)] + [(3, 7.0), (None, 1.0), (4, None)]
    got = ranks.percentiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", {"p25": 0.25, "p99": 0.99}).collect()
    assert {r.g for r in got} == {1, 2, 3, None}
    for r in got:
        values = [x for g, x in rows if g == r.g and x is not None]
        assert r.n == len(values) and np.allclose([r.p25, r.p99], np.percentile(values, [25, 99]))


def test_fast_error_by_hand(spark):
    rows = [(1, "ref", 0, 10), (1, "err", 1, 8), (1, "ref", 2, 12), (1, "err", 3, 9), (1, "ref", 4, 11), (2, "ref", 5, 1), (2, "ref", 6, 2), (2, "err", 7, 5)]
    d = [r.d for r in scores.fast_errors(made(spark, rows), "ref", "err").orderBy("seq").collect()]
    assert [round(x, 9) for x in d] == [4, 1.5, 2]  # 9 against 13, 11 against 9.5, 5 against 3
    total = scores.fast_error_total(scores.fast_errors(made(spark, rows), "ref", "err")).first()
    acc = var = 0.0
    for n, x in enumerate(d, 1):
        acc += x
        div = n - 1.5 + 1 / (8 * (n - 1)) if n > 1.5 else 1.0
        var += (x - acc / div) ** 2 * (n - 1) / n
    assert total.n == 3 and abs(total.avg - 2.5) < 1e-12 and abs(total.avg_plus_sd - (acc / div + math.sqrt(var / div))) < 1e-12
    assert scores.fast_error_total(scores.fast_errors(made(spark, rows), "ref", "err"), 4).first().avg is None


def test_solutions_of_several_objectives(spark):
    import itertools

    from pyspark.sql import functions as F

    points = [(1.0, 4.5), (2.0, 2.0), (4.0, 1.3), (3.0, 3.0), (1.0, 4.5), (2.0, None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "candidate long, a double, b double")
    assert sorted(r.candidate for r in fitting.front(rows, [], ["a", "b"]).collect()) == [0, 1, 2, 4]
    assert [r.candidate for r in fitting.front(rows, [], ["a", "b"], "weighted_euclidean").collect()] == [1]
    pairs = spark.createDataFrame([(list(x), list(y)) for x, y in itertools.product(points, repeat=2)], "x array<double>, y array<double>")
    for strategy in fitting.STRATEGIES:
        for r in pairs.select("x", "y", fitting.better(F.col("x"), F.col("y"), 2, strategy).alias("b"), fitting.better(F.col("y"), F.col("x"), 2, strategy).alias("w")).collect():
            assert r.b is not None and (strategy in ("any",) or None in r.x + r.y or not (r.b and r.w) or strategy == "soft"), (strategy, r)
            if None not in r.x + r.y and all(p <= q for p, q in zip(r.x, r.y, strict=True)) and r.x != r.y:
                assert r.b and not r.w, (strategy, r)


def test_plot_curve_bends_towards_the_middle_knot(spark):
    points = [(0, 1), (10, 5), (20, 1), (30, 7), (40, 2), (50, 2)]
    got = {r.seq: r.value for r in asof.plot_curve(asked(spark, [0, 4, 6, 10, 15, 20, 25, 44, 47, 60]), knots(spark, points)).collect()}
    assert got[0] == 1 and got[1] is None and got[3] == 5 and got[5] == 1 and got[7] is None and got[8] is None and got[9] is None
    assert abs(got[2] - (0.7**2 + 2 * 0.3 * 0.7 * 5 + 0.3**2)) < 1e-12 and abs(got[4] - (0.25**2 + 2 * 0.75 * 0.25 * 5 + 0.75**2)) < 1e-12
    assert abs(got[6] - (1 * 0.75**2 + 2 * 0.25 * 0.75 * 7 + 2 * 0.25**2)) < 1e-12


def test_front_without_groups_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(k, float(k), -float(k), k % 2) for k in range(6)], "candidate long, a double, b double, half int")
    assert fitting.front(rows, [], ["a", "b"]).count() == 6
    monkeypatch.setattr(fitting, "MOST_CANDIDATES", 5)
    with pytest.raises(ValueError, match="candidates"):
        fitting.front(rows, [], ["a", "b"])
    assert fitting.front(rows, ["half"], ["a", "b"]).count() == 6
