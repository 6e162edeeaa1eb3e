import uuid

import pytest

from levelstream.operators import events as E
from levelstream.sources import database as D

from .test_routing import made

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture
def url(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    D.create_tables(spark, url, "levels", DRIVER)
    return url


def rows_of(spark, url, partitions=4):
    found = D.read_levels(spark, url, "levels", DRIVER, partitions)
    return {(r.segment_id, r.signal_id, r.device_time): (r.seq, r.level) for r in found.collect()}


def plain(events):
    last = {}
    for r in sorted(events.collect(), key=lambda r: r.seq):
        if r.level is not None and abs(r.level) < float("inf") and None not in (r.segment_id, r.signal_id):
            last[r.segment_id, r.signal_id, r.device_time] = r.level
    return last


def test_a_write_run_twice_leaves_one_copy(spark, url):
    events = made(spark, [(i % 5, "ig" if i % 3 else "bg", i // 2, i * 0.5) for i in range(300)] + [(1, "ig", 900, None), (None, "ig", 1, 1.0), (1, "ig", 901, float("inf")), (1, "ig", 902, 1.0), (1, "ig", 902, 2.0)]).repartition(6)
    assert D.write_levels(events, url, "levels", "first", DRIVER)
    once = rows_of(spark, url)
    assert {k: v for k, (_, v) in once.items()} == plain(events)
    assert len({seq for seq, _ in once.values()}) == len(once)
    assert not D.write_levels(events, url, "levels", "first", DRIVER)
    assert D.write_levels(events.repartition(3), url, "levels", "again under another name", DRIVER)
    assert rows_of(spark, url) == once
    more = made(spark, [(1, "ig", 902, 7.0), (1, "ig", 2000, 8.0)])
    assert D.write_levels(more, url, "levels", "more", DRIVER)
    after = rows_of(spark, url)
    new = {k: v for k, v in after.items() if once.get(k) != v}
    assert len(after) == len(once) + 1 and sorted(v for _, v in new.values()) == [7.0, 8.0]
    assert next(seq for seq, v in new.values() if v == 8.0) > max(seq for seq, _ in once.values())
    changed = next(k for k, (_, v) in new.items() if v == 7.0)
    assert after[changed][0] == once[changed][0]


def test_a_failed_batch_leaves_nothing_and_can_run_again(spark, url, monkeypatch):
    events = made(spark, [(1, "ig", i, float(i)) for i in range(50)])
    whole = D._connected
    calls = []

    def fails_at_the_end(spark, url, properties, work):
        calls.append(work)
        if work.__name__ == "settle":
            def broken(statement):
                work(statement)
                raise RuntimeError("lost")
            return whole(spark, url, properties, broken)
        return whole(spark, url, properties, work)

    monkeypatch.setattr(D, "_connected", fails_at_the_end)
    with pytest.raises(RuntimeError):
        D.write_levels(events, url, "levels", "b", DRIVER)
    monkeypatch.setattr(D, "_connected", whole)
    assert rows_of(spark, url) == {}
    assert D.write_levels(events, url, "levels", "b", DRIVER)
    assert len(rows_of(spark, url)) == 50


def test_reading_is_partitioned(spark, url):
    assert rows_of(spark, url) == {}
    D.write_levels(made(spark, [(1, "ig", i, float(i)) for i in range(400)]), url, "levels", "b", DRIVER)
    found = D.read_levels(spark, url, "levels", DRIVER, 5)
    assert found.rdd.getNumPartitions() == 5
    sizes = [len(p) for p in found.rdd.glom().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 100
    assert [f.name for f in found.schema] == [f.name for f in E.SCHEMA]
    with pytest.raises(ValueError):
        D.read_levels(spark, url, "levels; drop table levels", DRIVER)


def test_micro_batches_delivered_again_count_once(spark, url, tmp_path):
    events = made(spark, [(i % 3, "ig", i, float(i)) for i in range(90)])
    for k in range(3):
        events.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for attempt in range(2):  # the second has lost its checkpoint and delivers all batches again
        source = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        write = D.batch_writer(url, "levels", "stream", DRIVER)
        query = source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"c{attempt}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        found = rows_of(spark, url)
        assert {k: v for k, (_, v) in found.items()} == plain(events)
        assert max(seq for seq, _ in found.values()) == 90
