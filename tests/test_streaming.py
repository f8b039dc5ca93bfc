"""Windows over streams: late rows, state behind the watermark, hot addresses."""

from datetime import datetime, timedelta

import pytest

from flowlens.errors import ParsingError
from flowlens.streaming import ip_windows, run_ip_windows, stream_flows
from flowlens.streaming.windows import _bits, _combine, _either, read_windows

SCHEMA = "ipsrc string, date timestamp_ntz, portdst int, action string"
START = datetime(2024, 5, 1, 10)


def rows(*minutes, ip="10.0.0.1", port=80, action="DENY"):
    return [(ip, START + timedelta(minutes=m), port, action) for m in minutes]


class Feed:
    def __init__(self, spark, tmp_path):
        self.spark, self.dirs = spark, [str(tmp_path / n) for n in ("in", "state", "out")]

    def send(self, data):
        folder, checkpoint, sink = self.dirs
        self.spark.createDataFrame(data, SCHEMA).repartition(3).write.mode("append").parquet(folder)
        arriving = stream_flows(self.spark, folder, "parquet", schema=self.spark.createDataFrame([], SCHEMA).schema)
        _, progress = run_ip_windows(ip_windows(arriving, "1 hour", delay="30 minutes"), checkpoint, sink)
        return progress[-1]["stateOperators"][0]["numRowsTotal"]

    def found(self):
        got = read_windows(self.spark, self.dirs[2]).collect()
        return {(r.ipsrc, int((r.window_start - START).total_seconds() // 3600)): tuple(r)[3:] for r in got}


def test_late_rows_are_counted_apart_and_state_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    # Watermark 11:45; the window from 10 is closed, those from 11 and 12 stay.
    data = rows(1, 2, 50, port=80) + rows(3, port=443, action="PERMIT") + rows(70) + rows(135) + rows(5, ip="10.0.0.2", port=None)
    data += [(None, START, 1, "DENY"), ("10.0.0.3", None, 1, "DENY"), ("10.0.0.2", START, 70_000, None)]
    assert feed.send(data) == 2
    assert feed.found() == {("10.0.0.1", 0): (4, 3, 2, 0), ("10.0.0.2", 0): (2, 1, 0, 0)}
    # Late rows for a closed window do not open it again; a row before the watermark whose window is open counts.
    assert feed.send(rows(4, 59, ip="10.0.0.1") + rows(6, ip="10.0.0.9") + rows(80, port=22)) == 2
    assert feed.found() == {("10.0.0.1", 0): (4, 3, 2, 2), ("10.0.0.2", 0): (2, 1, 0, 0), ("10.0.0.9", 0): (0, 0, 0, 1)}
    assert feed.send(rows(60 * 24)) == 1
    assert feed.found()[("10.0.0.1", 1)] == (2, 2, 2, 0) and feed.found()[("10.0.0.1", 2)] == (1, 1, 1, 0)


def test_a_window_that_ends_at_the_watermark_is_open(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed.send(rows(0) + rows(90)) == 2  # watermark 11:00
    assert feed.send(rows(1)) == 2
    feed.send(rows(60 * 24))
    assert feed.found()[("10.0.0.1", 0)] == (2, 2, 1, 0)


def test_a_hot_address_leaves_a_task_as_one_row():
    import pandas as pd

    frame = pd.DataFrame({"ipsrc": "a", "start": 0, "stop": 9, "denied": 1, "portdst": [i % 700 for i in range(50_000)]})
    (out,) = _combine(iter([frame, frame.head(0)]))
    assert out[["flows", "denies"]].values.tolist() == [[50_000, 50_000]]
    assert len(out["ports"][0]) == 88 and _either([out["ports"][0], _bits(__import__("numpy").array([65535]))])[-1] == 1


def test_streams_need_a_year_or_a_schema(spark, tmp_path):
    with pytest.raises(ParsingError):
        stream_flows(spark, str(tmp_path))
    with pytest.raises(ParsingError):
        stream_flows(spark, str(tmp_path), "parquet")
    with pytest.raises(ParsingError):
        stream_flows(spark, str(tmp_path), "other")
