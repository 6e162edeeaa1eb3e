from pyspark.sql import functions as F

from levelstream.operators import events as E
from levelstream.operators import routing, windows
from levelstream.streaming import live

from .test_routing import made


def run(spark, tmp_path, events, stream_of, name, batches=3):
    """Deliver the events in files and collect what the stream appends."""
    folder = str(tmp_path / name)
    rows = events.orderBy("device_time", "seq").collect()
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], E.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = stream_of(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stream_events(spark):
    return made(spark, [(i % 3, "ig" if i % 4 else "bg", i * 7 + (1000 if i > 60 else 0), (i * 37) % 100) for i in range(120)])


def closed(spark, events, minutes=100_000):
    """The events and one of another segment so late that the watermark passes all of them."""
    return events.unionByName(made(spark, [(99, "ig", minutes, 1.0)]).withColumn("seq", F.lit(10**6).cast("long")))


def test_mask_and_mean_are_the_batch_ones(spark, tmp_path):
    events = stream_events(spark)
    shuffled = closed(spark, events)
    got = run(spark, tmp_path, shuffled, lambda s: live.live_mask(s, "ig", "1101 1110", "2 hours", "30 days"), "masked").where("segment_id <> 99")
    want = routing.mask(events, "ig", "11011110").where("signal_id = 'ig'")
    assert {(r.seq, r.event_code) for r in got.collect()} == {(r.seq, r.event_code) for r in want.collect()}
    got = {r.seq: r.level for r in run(spark, tmp_path, shuffled, lambda s: live.live_mean(s, "ig", "2 hours", "30 days"), "means").where("segment_id <> 99").collect()}
    want = {r.seq: r.level for r in windows.mean_response(events, "ig", None).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_late_levels_are_put_in_order_and_idle_segments_reset(spark, tmp_path):
    events = made(spark, [(1, "ig", m, v) for m, v in ((0, 1), (30, 9), (10, 2), (40, 8), (20, 3), (5000, 100), (5010, 200))])
    folder = str(tmp_path / "late")
    for r in [*events.orderBy("seq").collect(), *closed(spark, events).where("segment_id = 99").collect()]:
        spark.createDataFrame([r], E.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = live.live_mean(source, "ig", "1 hour", "1 day").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "late-c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r.seq: r.level for r in spark.table("late").where("segment_id = 1").collect()}
    by_time = [1, 2, 3, 9, 8]
    want = [sum(by_time[: k + 1]) / (k + 1) for k in range(5)]
    seqs = [r.seq for r in events.orderBy("device_time").collect()]
    assert [round(got[s], 9) for s in seqs] == [round(x, 9) for x in [*want, 100, 150]]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    events = stream_events(spark)
    got = run(spark, tmp_path, events, lambda s: live.live_segments(s, "2 hours", "10 minutes"), "sessions")
    first = got.where("signal_id = 'ig'").collect()
    assert {r.segment_id for r in first} == {0, 1, 2} and sum(r.n for r in first) == sum(1 for i in range(61) if i % 4)
    stats = run(spark, tmp_path, events, lambda s: live.live_stats(s, "1 hour", "10 minutes"), "hours")
    assert stats.where("n > 0").count() > 5


def test_a_level_delivered_twice_counts_once(spark, tmp_path):
    events = stream_events(spark)
    got = run(spark, tmp_path, events.union(events), lambda s: live.live_levels(s, "1 day").select("seq"), "once")
    assert sorted(r.seq for r in got.collect()) == list(range(120))
