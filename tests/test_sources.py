import math

from levelstream.functions.units import convert
from levelstream.operators import events as E
from levelstream.sources import device_files as D
from levelstream.sources import logs

from .test_routing import made, some

LAYOUTS = """
[sensor]
signature.1 = Glucose Value
signature.2 = Event Type%%Ereignis
time = 1
format = yyyy-MM-dd HH:mm:ss
series.IG = 3; mgdl_to_mmoll; 4
series.BG = 5
[other]
signature.1 = Nothing Like This
time = 0,1
format = dd.MM.yyyy HH:mm
series.IG = 2
"""
EXPORT = "﻿Index;Timestamp;Event Type;Glucose Value (mg/dL);Note;BG\n;;;;;\n1;2024-01-01 00:05:00;EGV;180,182;after lunch;\n2;2024-01-01 00:10:00;EGV;90.091;\"a; \"\"b\"\"\";5.5\n3;bad;EGV;1;;\n4;2024-01-01 00:10:00;EGV;;;6.5\n"


def test_delimited_export(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(EXPORT)
    lines = D.head(spark, str(path))
    layout = D.detect(lines, D.read_layouts(LAYOUTS))
    assert layout.name == "sensor" and D.separator(lines) == ";"
    got = sorted((r.signal_id, r.device_time.minute, round(r.level, 6), r.info) for r in D.read_delimited(spark, str(path), layout, 4).collect())
    assert got[1:] == [("IG", 5, 10.0, "after lunch"), ("IG", 10, 5.0, 'a; "b"')] if len(got) == 3 else got[-2:] == [("IG", 5, 10.0, "after lunch"), ("IG", 10, 5.0, 'a; "b"')]
    assert D.detect(["nothing"], D.read_layouts(LAYOUTS)) is None


def test_xml_export(spark, tmp_path):
    path = tmp_path / "x.xml"
    path.write_text('<log><e t="2024-01-01 01:00:00" kind="ig">7.5</e><e t="2024-01-01 02:00:00" kind="other">9</e><e t="?" kind="ig">1</e></log>')
    layout = D.Layout("x", (), (0,), "yyyy-MM-dd HH:mm:ss", (D.Series("IG", 2),))
    got = D.read_xml(spark, str(path), "e", ["_t", "_kind", "_VALUE"], layout, where="_kind = 'ig'").collect()
    assert [(r.signal_id, r.level, r.device_time.hour) for r in got] == [("IG", 7.5, 1)]


def test_log_round_trip(spark, tmp_path):
    events = made(spark, some(30)).unionByName(spark.createDataFrame([(E.PARAMETERS, "m", None, 1, None, [1.5, 2.0], None, 100)], E.SCHEMA).withColumn("device_time", made(spark, some(1)).first().device_time and __import__("pyspark").sql.functions.lit("2024-01-01 00:01:00").cast("timestamp_ntz")))
    path = str(tmp_path / "log")
    logs.write_log(events, path)
    back = logs.read_log(spark, path)
    body = back.where(~back.event_code.isin(E.START, E.STOP))
    key = lambda r: (r.seq, r.event_code, r.signal_id, r.segment_id, r.level, r.parameters, r.device_time)
    assert sorted(map(key, body.collect()), key=str) == sorted(map(key, events.collect()), key=str)
    assert back.where(back.event_code == E.START).count() == 3
    logs.write_log(events, str(tmp_path / "per"), per_segment=True)
    assert (tmp_path / "per" / "segment_id=1").is_dir()
    assert logs.parse(spark.createDataFrame([("nonsense",)], "value string")).first().event_code is None


def test_database_sinks(spark):
    events = made(spark, [(1, "ig", 0, 5), (1, "virtual", 0, 6), (1, "requested", 0, 7), (1, "ig", 1, None)])
    virtual = spark.createDataFrame([("virtual",), ("requested",)], "signal_id string")
    assert sorted(r.signal_id for r in logs.database_rows(events, virtual, ("requested",)).collect()) == ["ig", "requested"]
    wide = logs.pivot_wide(events, ["ig", "virtual"])
    assert sorted(D.unpivot_wide(wide, "segment_id", "device_time", ["ig", "virtual"]).select("signal_id", "level").collect()) == [("ig", 5.0), ("virtual", 6.0)]


def test_units(spark):
    row = spark.createDataFrame([(98.6, 18.0182, 0.0)], "f double, g double, z double")
    got = row.select(convert("f", "fahrenheit_to_celsius"), convert("g", " mgdl_to_mmoll "), convert("z", "1 / nullif(x, 0)"), convert("z", "ln(x - 1)")).first()
    assert abs(got[0] - 37) < 1e-9 and abs(got[1] - 1) < 1e-12 and got[2] is None and got[3] is None


def test_sine_and_cosine(spark):
    rows = D.sine_and_cosine(spark, 1.0).collect()
    ig = [r.level for r in rows if r.signal_id == "IG"]
    assert len(rows) == 3 * 288 and abs(max(ig) - 8) < 0.01 and abs(min(ig) - 4) < 0.01 and abs(rows[0].level - 6) < 1e-12
    assert math.isclose(sum(r.level for r in rows if r.signal_id == "BG"), sum(r.level for r in rows if r.signal_id == "Calibration"))


def test_reduced_log_and_files_as_segments(spark, tmp_path):
    events = made(spark, some(12))
    for name, part in (("run12.log", "segment_id = 1"), ("b12.log", "segment_id = 2"), ("plain.log", "segment_id < 2")):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / name).write_text("\n".join(r.value for r in logs.lines(events.where(part), reduced=True).collect()) + "\n")
    assert all(line.startswith("; ") for line in (tmp_path / "logs" / "plain.log").read_text().split("\n") if line)
    plain = logs.read_log(spark, str(tmp_path / "logs" / "plain.log"))
    key = lambda r: (r.event_code, r.signal_id, r.segment_id, r.level, r.device_time)
    assert sorted(map(key, plain.where("level is not null").collect())) == sorted(map(key, events.where("segment_id < 2").collect()))
    named = logs.read_log(spark, str(tmp_path / "logs"), file_as_segment=True)
    # b12 comes first and keeps 12, run12 and plain get the numbers after it; plain has two segments.
    assert {r.segment_id for r in named.select("segment_id").distinct().collect()} == {12, 13001, 13002, 14}
    again = logs.read_log(spark, str(tmp_path / "logs"), file_as_segment=True, renumber=True)
    assert {r.segment_id for r in again.select("segment_id").distinct().collect()} == {1, 2, 3, 4}


def test_parameters_as_bytes(spark):
    import struct

    events = spark.createDataFrame([(E.PARAMETERS, "m", None, 1, None, [1.5, -2.0], None, 1), (E.LEVEL, "x", None, 1, 3.0, None, None, 2)], E.SCHEMA)
    rows = logs.database_parameters(events).collect()
    assert [bytes(r.parameters) for r in rows] == [struct.pack("<2d", 1.5, -2.0)] and rows[0].time_segment_id == 1


def test_device_intervals_are_resolved(spark):
    from levelstream.operators import windows

    day = lambda minutes: 19723 + minutes / 1440  # noqa: E731  2024-01-01 in days since 1970
    rows = [
        (1, "Requested_Insulin_Basal_Rate", 0, 1.0), (1, "Insulin_Temp_Rate", 10, 0.5), (1, "Insulin_Temp_Rate_Endtime", 10, day(40)), (1, "Physical_Activity", 15, 3.0), (1, "Physical_Activity_Duration", 15, 30 / 1440),
        (1, "IG", 50, 6.0), (1, "Sleep_Quality", 60, 0.8), (1, "Sleep_Endtime", 60, day(90)), (1, "Insulin_Temp_Rate", 70, 0.2), (1, "Insulin_Temp_Rate_Endtime", 70, day(200)), (1, "Requested_Insulin_Basal_Rate", 80, 2.0), (1, "IG", 95, 6.5),
    ]
    got = sorted((int((r.device_time - windows_start()).total_seconds() // 60), r.signal_id, r.level) for r in windows.resolved_intervals(made(spark, rows)).collect())
    assert got == sorted([
        (0, "Requested_Insulin_Basal_Rate", 1.0), (10, "Requested_Insulin_Basal_Rate", 0.5), (40, "Requested_Insulin_Basal_Rate", 1.0), (15, "Physical_Activity", 3.0), (45, "Physical_Activity", 1.0),
        (50, "IG", 6.0), (60, "Sleep_Quality", 0.8), (90, "Sleep_Quality", 0.0), (70, "Requested_Insulin_Basal_Rate", 0.2), (80, "Requested_Insulin_Basal_Rate", 2.0), (95, "IG", 6.5),
    ])


def windows_start():
    import datetime

    return datetime.datetime(2024, 1, 1)


def test_a_folder_of_exports_is_one_stream(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    (folder / "a.csv").write_text(EXPORT)
    (folder / "b.txt").write_text("Device,Date,Value\nx,01.01.2024 00:10,7.5\nx,01.01.2024 03:00,6.5\nx,01.01.2024 03:05,6.6\n")
    (folder / "c.txt").write_text("nothing that is known\n1;2;3\n")
    layouts = D.read_layouts(LAYOUTS + "[cells]\ncell.0.1 = Time%%Date\ntime = 1\nformat = dd.MM.yyyy HH:mm\nseries.IG = 2\n")
    rows = D.read_files(spark, str(folder), layouts).collect()
    levels = sorted((r.segment_id, r.device_time.hour * 60 + r.device_time.minute, r.signal_id, round(r.level, 6)) for r in rows if r.event_code == E.LEVEL)
    assert levels == [(1, 5, "IG", 10.0), (1, 10, "BG", 6.5), (1, 10, "IG", 7.5), (2, 180, "IG", 6.5), (2, 185, "IG", 6.6)]
    assert sorted((r.event_code, r.segment_id) for r in rows if r.event_code != E.LEVEL) == [(E.START, 1), (E.START, 2), (E.STOP, 1), (E.STOP, 2)]
    assert [r.info for r in rows if r.segment_id == 1 and r.signal_id == "IG" and r.device_time.minute == 5] == ["after lunch"]
