"""Text formats with odd values and bad lines; window counts of streams with null times and late rows."""

import datetime

import pytest

from tidemill.sources.text import parsed, written
from tidemill.streaming import events as streaming


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_odd_values_come_back(spark, tmp_path, kind):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(1, "plain", 1.5, at), (2, None, None, None), (3, "", 0.1 + 0.2, at), (None, 'say "a, b"', -1e300, None), (5, "é\\,\"", 2.0, at), (5, " pad ", 2.0, at)]
    schema = "id long, `a.b` string, v double, at timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    written(df, f"{tmp_path}/out", kind)
    good, bad = parsed(spark, f"{tmp_path}/out", kind, schema)
    assert good.columns == df.columns and sorted(map(str, good.collect())) == sorted(map(str, df.collect())) and bad.count() == 0


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("1,x,2.5\n\n2,y\n3,z,word\n4,w,1,9\n5,,\n")
    good, bad = parsed(spark, f"{tmp_path}/csv", "csv", "id long, t string, v double")
    assert sorted(map(tuple, good.collect())) == [(1, "x", 2.5), (5, None, None)]
    assert sorted(r.line for r in bad.collect()) == ["2,y", "3,z,word", "4,w,1,9"] and bad.count() == 3
    assert good.select("id").count() == 2 and sorted(r.id for r in good.select("id").collect()) == [1, 5]  # the same rows, whatever columns are asked for
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"id": 1, "other": 3}\n{"id": "x"}\n{"id": 2, "t": null}\nnot json\n\n')
    good, bad = parsed(spark, f"{tmp_path}/json", "json", "id long, t string")
    assert sorted(map(tuple, good.collect())) == [(1, None), (2, None)]
    assert sorted(r.line for r in bad.collect()) == ["not json", '{"id": "x"}']


def test_window_counts_with_null_times_and_late_rows(spark, tmp_path):
    schema, hour = "event_id long, ts timestamp, event_type string, value double", datetime.datetime(2024, 1, 1)
    at = lambda minutes: hour + datetime.timedelta(minutes=minutes)
    batches = [
        [(1, at(5), "a", 1.0), (2, at(6), "a", None), (3, None, "a", 9.0), (4, at(7), None, 2.0)],
        [(5, at(100), "a", 1.0)],  # the watermark is at 90 minutes after this batch, so the first hour is final
        [(6, at(10), "a", 50.0), (7, at(300), "a", 1.0)],  # the first of these is late
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        counts = streaming.window_counts(streaming.read_events(spark, f"{tmp_path}/in/*", schema))
        streaming.to_files(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.start.hour, str(r.event_type), r.n, r.total) for r in out) == [(0, "None", 1, 2.0), (0, "a", 2, 1.0), (1, "a", 1, 1.0)]
