"""Inputs that queries write for themselves grow in parts, not in the size of a few parts."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans import q_sources, q_streams
from plumbline.schemas import EVENTS


@pytest.fixture
def given(spark, tmp_path):
    """600 events of three runs over ten days; every tenth id is the same."""
    start = datetime.datetime(2024, 1, 1)
    e = spark.range(600).selectExpr(
        "if(id % 10 = 0, 7, id) AS event_id", f"timestamp_ntz'{start}' + make_dt_interval(0, 0, int(id) * 24) AS ts",
        "id % 3 AS user_id", "'purchase' AS event_type", "double(id % 90) AS value", """'{"k": 3}' AS props""")
    schema = spark.createDataFrame([], EVENTS).schema
    kept = e.select(*[F.col(f.name).cast(f.dataType if f.name != "ts" else "timestamp_ntz").alias(f.name) for f in schema])
    kept.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_event_files_grow_with_the_rows(spark, given, monkeypatch):
    monkeypatch.setattr(q_streams, "_ROWS_PER_FILE", 20)
    seen = {}
    monkeypatch.setattr(q_streams.jobs, "event_stream", lambda spark, path, files_per_batch: seen.update(path=path, n=files_per_batch))
    for build in (q_streams._stream, q_streams._timed_stream):
        build(spark, given)
        files = [f for f in os.listdir(seen["path"]) if f.endswith(".parquet")]
        assert seen["n"] == 10 and len(files) >= 30
        assert spark.read.parquet(seen["path"]).where("event_id IS NOT NULL").count() == 600


def test_timed_files_of_a_write_are_one_micro_batch(spark, given, monkeypatch):
    """Equal ids leave no file out, so no micro-batch reaches into the next write."""
    monkeypatch.setattr(q_streams, "_ROWS_PER_FILE", 20)
    paths = []
    monkeypatch.setattr(q_streams.jobs, "event_stream", lambda spark, path, files_per_batch: paths.append(path))
    q_streams._timed_stream(spark, given)
    files = spark.read.parquet(paths[0]).groupBy(F.input_file_name().alias("f")).agg(F.max("event_id").alias("m"))
    assert files.where("m IS NOT NULL").count() == 30


def test_log_parts_grow_with_the_lines(spark, given, monkeypatch):
    monkeypatch.setattr(q_sources, "_LINES_PER_PART", 30)
    read = {}
    scan = q_sources.readers.scan_log

    def kept(spark, path, pattern):
        read["path"] = path
        return scan(spark, path, pattern)

    monkeypatch.setattr(q_sources.readers, "scan_log", kept)
    rows = q_sources.scan_log(spark, given).collect()
    files = [f for _, _, names in os.walk(read["path"]) for f in names if f.endswith(".txt")]
    assert len(files) >= 15
    for run in "012":
        assert sorted(r.idx for r in rows if r.run == run) == list(range(200))
