import datetime

import numpy as np

from levelstream.operators import dosing, matching
from levelstream.operators import events as E
from levelstream.sources import signals

from .test_routing import T0, made


def test_a_step_delivers_one_dose(spark):
    schedule = spark.createDataFrame([(0, 0.0, 1.0), (1, 60.0, 2.0), (2, 61.0, 3.0), (3, 900.0, 4.0)], "k int, offset_seconds double, dose double")
    starts = spark.createDataFrame([(1, T0)], "segment_id long, start timestamp_ntz")
    got = sorted((r.k, int((r.device_time - T0).total_seconds())) for r in dosing.scheduled_boluses(starts, schedule, 60.0).collect())
    assert got == [(0, 60), (1, 120), (2, 180), (3, 900)]


def test_suspension_and_postponing(spark):
    levels = made(spark, [(1, "ig", m, v) for m, v in ((0, 6), (5, 3), (10, 3.5), (15, 6), (60, 3), (200, 3), (205, 9))])
    stops = dosing.suspensions(E.signal(levels, "ig"), 4.0, 3600.0)
    minutes = lambda t: int((t - T0).total_seconds() // 60)
    assert sorted((minutes(r.start), minutes(r.stop)) for r in stops.collect()) == [(5, 15), (60, 120), (200, 205)]
    assert dosing.suspended_rates(E.signal(levels, "ig"), 4.0, 3600.0).count() == 3
    doses = E.signal(made(spark, [(1, "d", m, m) for m in (0, 7, 15, 90, 130)]), "d")
    assert sorted((int(r.level), minutes(r.device_time)) for r in dosing.postponed(doses, stops).collect()) == [(0, 0), (7, 15), (15, 15), (90, 120), (130, 130)]


def test_basal_as_boluses(spark):
    events = made(spark, [(1, "rate", 0, 1.2)] + [(1, "ig", m, 6) for m in range(1, 31)] + [(1, "rate", 31, 0)] + [(1, "ig", m, 6) for m in range(32, 40)])
    got = [(int((r.device_time - T0).total_seconds() // 60), round(r.level, 6)) for r in dosing.basal_to_boluses(events, "rate").orderBy("device_time").collect()]
    assert got == [(m, 0.1) for m in (0, 5, 10, 15, 20, 25, 30)]
    small = made(spark, [(1, "rate", 0, 0.3)] + [(1, "ig", m, 6) for m in range(1, 31)])
    assert {round(r.level, 6) for r in dosing.basal_to_boluses(small, "rate").collect()} == {0.05}
    rise = made(spark, [(1, "rate", 0, 1.2), (1, "rate", 1, 2.4)])
    assert [round(r.level, 6) for r in dosing.basal_to_boluses(rise, "rate").orderBy("device_time").collect()] == [0.1, 0.1]


def brute_pairs(ref, err):
    ref, err, out = list(ref), list(err), []
    mean = np.mean([v for _, v in ref])
    while ref and err:
        near = sorted(((min(abs(t - a) + abs(v - b) for a, b in err), k) for k, (t, v) in enumerate(ref)), key=lambda x: x[0])
        used_r, used_e = set(), set()
        for gap, k in near:
            e = next(j for j, (a, b) in enumerate(err) if abs(ref[k][0] - a) + abs(ref[k][1] - b) == gap)
            if e not in used_e:
                used_e.add(e)
                used_r.add(k)
                out.append((*ref[k], *err[e]))
        ref = [x for k, x in enumerate(ref) if k not in used_r]
        err = [x for k, x in enumerate(err) if k not in used_e]
    return sorted(out + [(t, v, t, 0.0) for t, v in ref] + [(t, abs(v - mean), t, v) for t, v in err])


def test_matching_is_greedy_by_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(g, s, int(rng.integers(0, 9000)), float(rng.normal())) for g in (1, 2) for s, n in (("r", 14 + g), ("e", 13 + 2 * g)) for _ in range(n)]
    events = made(spark, rows)
    pairs = matching.nearest_pairs(events, "r", "e").collect()
    known = events.select("segment_id", "signal_id", E.days().alias("t"), "level", "seq").orderBy("t", "seq").collect()
    for g in (1, 2):
        side = lambda s: [(r.t, r.level) for r in known if r.segment_id == g and r.signal_id == s]  # noqa: B023, E731
        got = sorted((p.t, p.expected, p.error_t, p.calculated) for p in pairs if p.segment_id == g)
        assert np.allclose(got, brute_pairs(side("r"), side("e")))
    assert matching.temporal_error(matching.nearest_pairs(events, "r", "e")).where("error is not null").count() == 2
    assert matching.nearest_pairs(made(spark, [(1, "e", 0, 1)]), "r", "e").count() == 0


def test_signal_dimension(spark, tmp_path):
    assert signals.known_signals(spark).count() == 28
    path = tmp_path / "own.csv"
    path.write_text("Signal Id; Description; Unit Desc\n{A};Muscle;mmol/L;3;0xFE;0xFE;0;x;\n")
    own = signals.own_signals(spark, str(path))
    assert [tuple(r) for r in own.collect()] == [("{A}", "mmol/L", "Muscle")]
    events = made(spark, [(1, "IG", 0, 1), (1, "none", 0, 1)])
    assert {(r.signal_id, r.unit) for r in signals.with_names(events, signals.known_signals(spark)).collect()} == {("IG", "mmol/L"), ("none", None)}
    assert T0 == datetime.datetime(2024, 1, 1)


def test_nearest_is_that_of_all_pairs():
    import numpy as np

    from levelstream.operators import matching

    rng = np.random.default_rng(5)
    for n, m, spread in ((200, 300, 1.0), (50, 1000, 400.0), (30, 1, 1.0)):
        times = np.sort(np.round(rng.uniform(0, 50, m), 1))
        values, t, v = np.round(rng.uniform(0, spread, m)), np.round(rng.uniform(-5, 55, n), 1), np.round(rng.uniform(0, spread, n))
        gap = np.abs(t[:, None] - times) + np.abs(v[:, None] - values)
        best, far = matching._nearest(t, v, times, values)
        assert (best == gap.argmin(axis=1)).all() and np.allclose(far, gap.min(axis=1))
