import datetime
import random

import pytest
from pyspark.sql import functions as F

from levelstream.operators import events as E
from levelstream.operators import metrics, scores
from levelstream.streaming import stateful as S

from .test_routing import T0, made

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def counted(memory, levels):
    """Drops every third level, doubles the others, and sends a count at every fifth."""
    for x in levels:
        memory["n"] = memory.get("n", 0) + 1
        if memory["n"] % 3:
            yield x._replace(level=2 * x.level)
        if memory["n"] % 5 == 0:
            yield x._replace(signal="count", level=float(memory["n"]), parameters=[x.slope] if x.slope is not None else None)


def control(spark, rows):
    out = [(code, None, T0 + datetime.timedelta(minutes=m), g, None, None, None, 5000 + i) for i, (code, g, m) in enumerate(rows)]
    return spark.createDataFrame(out, E.SCHEMA)


def plain(rows, function):
    """Rows of one segment after the other through a function, instant by instant."""
    out = []
    rows = sorted((r for r in rows if r.segment_id is not None and (r.level is not None or r.event_code in S.ENDS)), key=lambda r: (r.segment_id, r.device_time, r.seq))
    segment, memory, last = None, {}, {}
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and (rows[end].segment_id, rows[end].device_time) == (rows[at].segment_id, rows[at].device_time):
            end += 1
        if rows[at].segment_id != segment:
            segment, memory, last = rows[at].segment_id, {}, {}
        levels = []
        for r in rows[at:end]:
            if r.event_code in S.ENDS:
                out += [(segment, x) for x in function(memory, levels)] if levels else []
                memory, last, levels = {}, {}, []
                continue
            micros = round((r.device_time - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))
            b = last.get(r.signal_id)
            levels.append(S.Level(r.signal_id, micros, r.seq, r.level, (r.level - b[1]) / (micros - b[0]) * 86400e6 if b and micros > b[0] else None))
            last[r.signal_id] = (micros, r.level)
        out += [(segment, x) for x in function(memory, levels)] if levels else []
        at = end
    return sorted((s, x.signal, x.seq, x.level, x.parameters and [round(p, 6) for p in x.parameters]) for s, x in out)


def shown(df):
    return sorted((r.segment_id, r.signal_id, r.seq, r.level, r.parameters and [round(p, 6) for p in r.parameters]) for r in df.collect())


def events_of(spark):
    rows = [(i % 3, "ig" if i % 4 else "bg", (i * 7) // 2, float((i * 37) % 100)) for i in range(150)] + [(1, "ig", 10, None), (None, "ig", 10, 1.0)]
    return made(spark, rows).unionByName(control(spark, [(E.STOP, 0, 100), ("Warm_Reset", 1, 200), ("Information", 2, 50)]))


def test_replay_is_the_plain_walk(spark):
    events = events_of(spark)
    assert shown(S.replay(events.repartition(7), counted)) == plain(events.collect(), counted)
    some = S.replay(events, counted, ["ig"])
    assert shown(some) == plain([r for r in events.collect() if r.signal_id in ("ig", None)], counted)
    assert S.replay(events.limit(0), counted).count() == 0


def streamed(spark, tmp_path, events, function, name, delay, batches=4, seed=1):
    """Deliver the events in files, each file shuffled, and collect what the stream appends."""
    rows = sorted(events.collect(), key=lambda r: (r.device_time, r.seq))
    size = -(-len(rows) // batches)
    folder, rng = str(tmp_path / name), random.Random(seed)
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        rng.shuffle(part)
        spark.createDataFrame(part, E.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    end = made(spark, [(99, "ig", 10**6, 1.0)])
    end.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = S.live(source, function, delay).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name).where("segment_id <> 99")


def test_a_stream_is_its_table(rocks, tmp_path):
    events = events_of(rocks)
    assert shown(streamed(rocks, tmp_path, events, counted, "counted", "3 hours")) == shown(S.replay(events, counted))


def test_pairs_of_two_streams_are_the_joined_ones(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(g, "bg" if rng.random() < 0.4 else "ig", rng.randrange(0, 500), rng.uniform(3, 12)) for g in (1, 2, 3) for _ in range(40)]
    rows += [(1, "ig", 77, 5.0), (1, "bg", 77, 6.0), (1, "ig", 77, 7.0), (4, "bg", 5, 1.0), (4, "ig", 9, 1.0)]
    events = made(rocks, rows)
    joined = metrics.running_average(scores.pairs(events, "bg", "ig"), ["segment_id"])
    want = {r.seq: r.metric for r in joined.collect()}
    for got in (S.replay(events, S.pairing("bg", "ig")), streamed(rocks, tmp_path, events, S.pairing("bg", "ig"), "paired", "10 hours")):
        have = {r.seq: r.level for r in got.collect()}
        assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    pairs = {r.seq: (r.expected, r.calculated) for r in scores.pairs(events, "bg", "ig").collect()}
    got = S.replay(events, S.pairing("bg", "ig")).select("seq", F.col("parameters")[0], F.col("parameters")[1]).collect()
    assert {r[0] for r in got} == pairs.keys() and all(abs(r[1] - pairs[r[0]][0]) + abs(r[2] - pairs[r[0]][1]) < 1e-9 for r in got)
