"""Streams over files, run once."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from caseloom.streaming import operations as O

T0 = dt.datetime(2024, 1, 1)


def stream(spark, path, rows, schema):
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_pairs_of_start_and_completion(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [[(1, at(0), "start"), (2, at(1), "complete")], [(1, at(5), "complete"), (1, at(9), "start")], [(1, at(12), "complete"), (3, at(20), "start")]]
    out = O.run_once(O.pairs(stream(spark, tmp_path / "p", rows, "id long, ts timestamp, kind string")), f"t{uuid.uuid4().hex}")
    assert sorted((r.id, r.ms) for r in out.collect()) == [(1, 3000.0), (1, 5000.0)]


def test_repeats_within_a_time_to_live(spark, tmp_path):
    rows = [[("a", T0), ("a", T0), ("b", T0)], [("a", T0 + dt.timedelta(minutes=1))]]
    out = O.run_once(O.without_repeats(stream(spark, tmp_path / "d", rows, "k string, ts timestamp"), ["k"]), f"t{uuid.uuid4().hex}")
    assert sorted(r.k for r in out.collect()) == ["a", "b"]


def test_batches_by_count(spark, tmp_path):
    rows = [[("s", T0 + dt.timedelta(milliseconds=i)) for i in range(7)]]
    out = O.run_once(O.batches(stream(spark, tmp_path / "b", rows, "tier string, ts timestamp"), 3, 1000), f"t{uuid.uuid4().hex}")
    assert [r["size"] for r in out.filter("reason = 'full'").collect()] == [3, 3]


def test_windows_and_files(spark, tmp_path):
    rows = [[("m", T0 + dt.timedelta(hours=i), 10.0, i % 2 == 0) for i in range(5)]]
    s = stream(spark, tmp_path / "w", rows, "mode string, ts timestamp, ms double, success boolean")
    out = O.run_once(O.windowed(s, "mode", "2 hours"), f"t{uuid.uuid4().hex}", "complete")
    assert out.agg(F.sum("n"), F.sum("failed")).first()[:] == (5, 2)
    O.to_files(s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
