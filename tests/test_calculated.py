import datetime
import math

import pytest
from pyspark.sql import functions as F

from levelstream.operators import calculated as C
from levelstream.operators import events as E

from .test_routing import T0, made


def vectors(spark, rows, signal="estimate"):
    """(segment, minutes, parameters) to parameter events."""
    out = [(E.PARAMETERS, signal, T0 + datetime.timedelta(minutes=m), g, None, p, None, 1000 + i) for i, (g, m, p) in enumerate(rows)]
    return spark.createDataFrame(out, E.SCHEMA)


def line(p, x):
    return p[0] * x["now"] + p[1]


def minutes(t):
    return round((t - T0).total_seconds() / 60)


def test_parameters_change_within_a_segment(spark):
    events = made(spark, [(g, "ig", m, 10.0 + m) for g in (1, 2) for m in range(0, 60, 10)] + [(1, "bg", 25, 1.0), (1, "bg", 200, 1.0), (1, "ig", 5, None), (None, "ig", 5, 1.0), (1, "other", 33, 1.0)])
    own = vectors(spark, [(1, 20, [2.0, 0.0]), (1, 40, [3.0, 1.0]), (1, 40, [4.0, 1.0]), (None, 30, [5.0, 0.0]), (3, 0, [9.0, 9.0])]).unionByName(vectors(spark, [(1, 0, [7.0, 7.0])], "else"))
    got = C.calculate(events.unionByName(own).repartition(3), "estimate", {"now": ("ig", 0.0)}, line, [1.0, 0.5], "bg").collect()
    held = {1: [(0, [1.0, 0.5]), (20, [2.0, 0.0]), (30, [5.0, 0.0]), (40, [4.0, 1.0])], 2: [(0, [1.0, 0.5]), (30, [5.0, 0.0])]}
    want = {}
    for g in (1, 2):
        for m in [*range(0, 60, 10), *([25] if g == 1 else [])]:
            known = 30 if m == 25 else m  # the line at 25 waits for the level at 30
            p = [p for t, p in held[g] if t <= known][-1]
            want[g, m] = p[0] * (10.0 + m) + p[1]
    assert {(r.segment_id, minutes(r.device_time)): r.level for r in got} == want


def test_levels_ahead_are_answered_once(spark):
    events = made(spark, [(1, "ig", m, float(m)) for m in (0, 10, 20, 30)] + [(1, "bg", 10, 5.0), (1, "bg", 20, 5.0)])
    got = C.calculate(events, "estimate", {"now": ("ig", 10 / 1440)}, line, [1.0, 0.0], "bg", 10 / 1440).collect()
    assert sorted((minutes(r.device_time), r.level, minutes(r.known_at)) for r in got) == [(10, 0.0, 0), (20, 10.0, 10), (30, 20.0, 20), (40, 30.0, 30)]
    nan = C.calculate(events, "estimate", {"now": ("ig", 0.0)}, lambda p, x: F.when(x["now"] > 10, x["now"]).otherwise(float("nan")), [1.0])
    assert sorted(r.level for r in nan.collect()) == [20.0, 30.0]
    assert C.calculate(events.limit(0), "estimate", {"now": ("ig", 0.0)}, line, [1.0, 0.0]).count() == 0


def test_hints_of_segments_and_of_all(spark):
    rows = [(g, float(x), 2.0 * x + g) for g in (1, 2, 3) for x in range(5)]
    table = spark.createDataFrame([(g, x, y) for g, x, y in rows], "segment_id long, now double, expected double")
    hints = [(1, 5, [2.0, 1.5]), (1, 6, [2.0, 1.0]), (1, 7, [2.0, 1.0]), (2, 1, [0.0, 0.0]), (None, 3, [2.0, 2.5]), (9, 1, [2.0, 2.0])]
    scored = C.hint_fitness(table, C.parameters_of(vectors(spark, hints), "estimate"), line, ["now"], [2.0, 3.0])

    def fitness(g, p):
        return sum(abs(y - p[0] * x - p[1]) for s, x, y in rows if s == g) / 5

    got = {r.segment_id: (r.seq, r.parameters, r.fitness) for r in C.best_hints(scored).collect()}
    assert got.keys() == {1, 2, 3}
    assert got[1][:2] == (1001, [2.0, 1.0]) and got[2][:2] == (1004, [2.0, 2.5]) and got[3][:2] == (None, [2.0, 3.0])
    assert all(math.isclose(f, fitness(g, p), abs_tol=1e-12) for g, (_, p, f) in got.items())
    assert sorted((r.segment_id, r.seq) for r in C.improving(scored).collect()) == sorted(plain_improving(hints, fitness))


def plain_improving(hints, fitness):
    out = []
    for g in (1, 2, 3):
        least = fitness(g, [2.0, 3.0])
        for k, (s, _, p) in sorted(enumerate(hints), key=lambda h: (h[1][1], h[0])):
            if s in (g, None) and fitness(g, p) < least:
                least = fitness(g, p)
                out.append((g, 1000 + k))
    return out


def test_many_shared_vectors_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_SHARED", 1)
    parameters = C.parameters_of(vectors(spark, [(None, 1, [1.0]), (None, 2, [2.0])]), "estimate")
    with pytest.raises(ValueError):
        C.in_force(made(spark, [(1, "ig", 0, 1.0)]), parameters, [0.0])
