import os

import pytest

from levelstream.sources import log_source, logs

LINE = "{0}; 2024-01-01 00:{1:02d}:00.000; Level; click; {0}.5; {2}; Level; ; click\n"


def text(low, high):
    return "".join(LINE.format(i, i % 60, i % 3) for i in range(low, high))


def put(path, data, mode="w"):
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(data)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_hold_each_line_once(tmp_path, split):
    data = "first\n\nlonger than a range\r\nœuvre\nno end"
    put(tmp_path / "a.log", data)
    size = len(data.encode())
    got = [x for r in log_source._ranges(str(tmp_path), "a.log", 0, size, split) for x in log_source.lines_in(r)]
    assert [line for line, _ in got] == data.encode().split(b"\n")
    assert all(data.encode()[at:].startswith(line) for line, at in got)


def test_table_is_that_of_text(spark, tmp_path):
    put(tmp_path / "a.log", text(0, 200) + "no event\n")
    put(tmp_path / "b.log", text(200, 230) + "9; 2024-01-01 00:00:00.000; Shut_Down; ; ; 1; Shut_Down; ; \n")
    put(tmp_path / "_mark", "x\n")
    got = log_source.replay(spark, str(tmp_path), split=500)
    assert got.rdd.getNumPartitions() > 10
    want = logs.parse(spark.read.text([str(tmp_path / "a.log"), str(tmp_path / "b.log")])).where("event_code = 'Level'")
    assert sorted(map(str, got.drop("file", "position").collect())) == sorted(map(str, want.collect()))
    os.makedirs(tmp_path / "empty")
    assert log_source.replay(spark, str(tmp_path / "empty")).count() == 0


def test_stream_started_again_loses_and_repeats_nothing(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()

    def run():
        events = log_source.replay(spark, str(folder), streaming=True, split=300)
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(out).collect())

    whole = text(40, 60)
    put(folder / "a.log", text(0, 40) + whole[:30])
    assert run() == list(range(40))
    put(folder / "a.log", whole[30:], "a")
    put(folder / "b.log", text(60, 75))
    assert run() == list(range(75))
    assert run() == list(range(75))
    put(folder / "b.log", "short\n")
    with pytest.raises(Exception, match="only grow"):
        run()
