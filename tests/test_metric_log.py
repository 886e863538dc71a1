"""The metric log as a stream with state: restarts, repeats, conflicting hints, null rows."""

import statistics

import pytest
from pyspark.errors import StreamingQueryException

from glyphgrid.streaming import events, metric_log

SCHEMA = "metric string, iteration long, value double, smooth boolean, arrived long"


def _append(spark, tmp_path, rows, window=3, ttl_ms=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), SCHEMA)
    metric_log.append_metrics(stream, str(tmp_path / "out"), str(tmp_path / "state"), window, ttl_ms).awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_only_newer_iterations_after_each_restart(spark, tmp_path):
    first = [("loss", 0, 5.0, True, 1), ("loss", 1, 4.0, None, 2), ("loss", 1, 4.5, None, 3), ("time", 7, 1.0, False, 4), (None, 1, 1.0, None, 5), ("loss", None, 1.0, None, 6)]
    assert _append(spark, tmp_path, first) == [("loss", 0, 5.0, 5.0, True), ("loss", 1, 4.5, 4.75, True), ("time", 7, 1.0, 1.0, False)]
    again = _append(spark, tmp_path, [("loss", 1, 9.0, True, 7), ("loss", 3, 1.0, None, 8), ("loss", 2, 2.0, None, 9), ("new", -1, 3.0, None, 10)])
    values = [5.0, 4.5, 2.0, 1.0]
    want = [("loss", k, v, statistics.median(values[max(0, k - 2) : k + 1]), True) for k, v in enumerate(values)]
    assert [r for r in again if r[0] == "loss"] == want and ("new", -1, 3.0, 3.0, None) in again and len(again) == 6
    with pytest.raises(StreamingQueryException, match="conflicting smoothing hints"):
        _append(spark, tmp_path, [("time", 8, 1.0, True, 11)])


def test_silent_metrics_are_forgotten(spark, tmp_path):
    assert len(_append(spark, tmp_path, [("a", 5, 1.0, None, 1)], window=1, ttl_ms=1)) == 1
    assert len(_append(spark, tmp_path, [("a", 5, 2.0, None, 2)], window=1, ttl_ms=1)) == 2  # the state is older than a millisecond
