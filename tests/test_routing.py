import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from levelstream.operators import events as E
from levelstream.operators import routing as R
from levelstream.operators import windows as W
from levelstream.plans import chain

T0 = datetime.datetime(2024, 1, 1)


def made(spark, rows):
    """(segment, signal, minutes, level) to level events."""
    out = [(E.LEVEL, s, T0 + datetime.timedelta(minutes=m), g, float(v) if v is not None else None, None, None, i) for i, (g, s, m, v) in enumerate(rows)]
    return spark.createDataFrame(out, E.SCHEMA)


def some(n=60):
    return [(i % 3, "ig" if i % 4 else "bg", i, (i * 37) % 100) for i in range(n)]


def as_set(df):
    return sorted(map(str, df.collect()))


def test_mask_marks_the_zeros_and_restarts_by_segment(spark):
    rows = [(g, "ig", m, m) for g in (1, 2) for m in range(20)]
    got = {(r.segment_id, r.level): r.event_code for r in R.mask(made(spark, rows), "ig", "1101 1110").collect()}
    assert {k for k, v in got.items() if v == E.MASKED} == {(g, float(m)) for g in (1, 2) for m in range(20) if m % 8 in (2, 7)}
    with pytest.raises(ValueError):
        R.mask(made(spark, rows), "ig", "101")


def test_unmask_undoes_mask(spark):
    events = made(spark, some())
    assert as_set(R.unmask(R.mask(events, "ig", "10101010"), "ig")) == as_set(events)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 100))
def test_decoupling_splits(spark, limit):
    events = made(spark, some())
    moved = R.decouple(events, "ig", "new", f"level > {limit}")
    taken, rest = moved.where("signal_id = 'new'"), moved.where("signal_id <> 'new'")
    assert as_set(rest.unionByName(taken.drop("signal_id").selectExpr("*", "'ig' as signal_id").select(*events.columns))) == as_set(events)
    copied = R.decouple(events, "ig", "new", f"level > {limit}", copy=True)
    assert copied.count() == events.count() + taken.count()
    assert as_set(R.decouple(events, "ig", None, f"level > {limit}")) == as_set(rest)


def test_conditions(spark):
    rows = made(spark, [(1, "a", 0, 1), (1, "a", 1, 5), (1, "a", 2, None)])
    ask = lambda text: [r[0] for r in rows.orderBy("seq").select(R.condition(text)).collect()]
    assert ask("level + 2 * 3 == 7") == [True, False, False]
    assert ask("!(level < 3) && is_level_event") == [False, True, False]
    assert ask("(level < 3) ^ (level > 0)") == [False, True, False]
    assert ask("is_control_event || level != 1") == [False, True, False]


def test_map_to_nothing_keeps_a_shut_down(spark):
    events = made(spark, [(1, "a", 0, 1)]).unionByName(spark.createDataFrame([(E.SHUT_DOWN, "a", T0, None, None, None, None, 9)], E.SCHEMA))
    assert [r.event_code for r in R.map_signal(events, "a", None).collect()] == [E.SHUT_DOWN]


def test_noise_is_bounded_and_repeatable(spark):
    events = made(spark, some(200))
    one = {r.seq: r.level for r in R.add_noise(events, "ig", 2.0).collect()}
    two = {r.seq: r.level for r in R.add_noise(events.repartition(7), "ig", 2.0).collect()}
    base = {r.seq: (r.signal_id, r.level) for r in events.collect()}
    assert one == two and len({round(one[k] - v, 6) for k, (s, v) in base.items() if s == "ig"}) > 50
    assert all(abs(one[k] - v) <= (2 if s == "ig" else 0) for k, (s, v) in base.items())


def test_repeats_and_segments(spark):
    events = made(spark, [(1, "ig", m, v) for m, v in ((0, 1), (5, 1), (10, 2), (15, 2), (20, 1))])
    assert sorted(r.seq for r in R.drop_repeats(events).collect()) == [0, 2, 4]
    islands = [(1, "ig", m, 1) for m in (0, 5, 10, 40, 45, 50, 55, 100)] + [(1, "bg", 41, 5), (1, "bg", 200, 5)]
    got = W.cut_segments(made(spark, islands), "ig", 12 * 60, 3)
    assert {(r.seq, r.part) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (8, 1)}
    assert {r.part for r in W.cut_segments(made(spark, islands), "ig", 12 * 60, 3, "bg").collect()} == {1}


def test_episode_bounds(spark):
    events = made(spark, [(1, "ig", m, v) for m, v in ((0, 9), (10, 9), (20, 1), (30, 9), (40, 1), (50, 9))])
    got = sorted((r.n_levels, round(r.duration * 1440, 6)) for r in W.episodes(events, "ig", "level > 5").collect())
    assert got == [(1, 10.0), (2, 15.0)]


def test_intervals_restore_the_base(spark):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    base = spark.createDataFrame([(1, at(0), 1.0), (1, at(60), 2.0)], "segment_id long, device_time timestamp_ntz, level double")
    spans = spark.createDataFrame([(1, at(10), at(30), 5.0), (1, at(20), at(70), 6.0)], "segment_id long, start timestamp_ntz, stop timestamp_ntz, level double")
    got = sorted((r.device_time, r.level, r.origin) for r in W.intervals_to_levels(spans, base).collect())
    assert got == [(at(10), 5.0, "temporary"), (at(20), 6.0, "temporary"), (at(70), 2.0, "base")]


def test_chain_is_its_operators(spark):
    events = made(spark, some())
    text = "[02 mask]\nsignal = x\nbits = 1101 1110\n[01 map]\nsource = ig\nto = $(TO)\n"
    want = R.mask(R.map_signal(events, "ig", "x"), "x", "11011110")
    assert as_set(chain.apply(events, text, {"TO": "x"})) == as_set(want)
    with pytest.raises(ValueError):
        chain.parse("[1 nothing]\n")
