"""Event-time windows per source address, with late rows counted apart.

Every (address, window) has a state of three numbers' worth: flows, denies, and a bit for each destination
port met. A timer at the window's end closes it: once the watermark has passed the end, the state
becomes one output row and is removed. Rows that come for a window that the watermark has
passed are late; they never reopen a state but give a row with their number. So on-time and
late rows add up to all rows with a time and an address.

Spark's own windowed aggregation drops late rows without a trace (its metric counts rows after partial
aggregation), and it has no exact distinct count on streams; hence the custom state.

Tasks combine their rows first: what is shuffled is one row per task, address and window, at most,
so an address with a third of all flows is no hot key. A state has at most 8 KB of ports.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.session import scratch_path

PORTS = 1 << 16
FAR = 9_000_000_000  # seconds: the year 2255, as pandas ends in 2262
COMBINED = "ipsrc string, start long, stop long, flows long, denies long, ports binary"
STATE = "flows long, denies long, ports binary"
WINDOWS = "ipsrc string, start long, stop long, total_flows long, denies long, unique_dst_ports long, late_flows long"


def _bits(ports: np.ndarray) -> bytes:
    """One bit a port, without trailing zeros."""
    mask = np.zeros(PORTS, bool)
    mask[ports] = True
    return np.packbits(mask[: int(ports.max()) + 1]).tobytes() if len(ports) else b""


def _either(parts) -> bytes:
    """The ports of any of the parts."""
    out = np.zeros(max(map(len, parts), default=0), np.uint8)
    for p in parts:
        out[: len(p)] |= np.frombuffer(p, np.uint8)
    return out.tobytes()


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per address and window of a batch of rows."""
    for frame in frames:
        if not len(frame):
            continue
        keys = ["ipsrc", "start", "stop"]
        counted = frame.groupby(keys, sort=False).agg(flows=("denied", "size"), denies=("denied", "sum")).reset_index()
        ports = frame.dropna(subset=["portdst"]).drop_duplicates([*keys, "portdst"])
        ports = ports.groupby(keys, sort=False)["portdst"].agg(lambda p: _bits(p.to_numpy(np.int64))).rename("ports")
        counted = counted.merge(ports.reset_index(), on=keys, how="left")
        counted["ports"] = counted["ports"].map(lambda p: p if isinstance(p, bytes) else b"")
        yield counted[["ipsrc", "start", "stop", "flows", "denies", "ports"]]


def _row(key, flows: int, denies: int, ports: bytes, late: int) -> pd.DataFrame:
    unique = int(np.unpackbits(np.frombuffer(ports, np.uint8)).sum())
    return pd.DataFrame([(*key, flows, denies, unique, late)], columns=[c.split()[0] for c in WINDOWS.split(", ")])


def _update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    key = (key[0], int(key[1]), int(key[2]))
    stop = key[2]
    if state.hasTimedOut:
        yield _row(key, *state.get, 0)
        state.remove()
        return
    flows, denies, parts = 0, 0, []
    for frame in frames:
        flows, denies = flows + int(frame["flows"].sum()), denies + int(frame["denies"].sum())
        parts += [_either(list(frame["ports"]))]
    if stop // 1000 < state.getCurrentWatermarkMs():
        yield _row(key, 0, 0, b"", flows)
        return
    if state.exists:
        old = state.get
        flows, denies, parts = flows + old[0], denies + old[1], [*parts, old[2]]
    state.update((flows, denies, _either(parts)))
    state.setTimeoutTimestamp(stop // 1000)


def ip_windows(flows: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour", denied=("DENY",)) -> DataFrame:
    """Per address and window of a stream of flows: flows, denies and distinct ports once it is closed, or late rows.

    ``delay`` is how far the watermark stays behind the latest time met. Columns ``ipsrc``, ``date``, ``portdst`` and
    ``action`` are read; rows without time or address are left out, ports that are none are not counted.
    Append mode: a window gives one row with late_flows = 0 when it closes, and one for every batch with late rows.
    """
    rows = flows.select("ipsrc", F.col("date").cast("timestamp").alias("date"), "portdst", "action")
    rows = rows.withWatermark("date", delay).where(F.col("ipsrc").isNotNull() & F.col("date").isNotNull())
    port = F.col("portdst").try_cast("int")
    parts = rows.withColumn("w", F.window("date", length, slide)).select(
        "ipsrc",
        # plain numbers: as event times, late rows would be dropped before they can be counted
        F.unix_micros("w.start").alias("start"),
        F.unix_micros("w.end").alias("stop"),
        F.coalesce(F.col("action").isin(*denied), F.lit(False)).cast("long").alias("denied"),
        F.when(port.between(0, PORTS - 1), port).alias("portdst"),
    )
    combined = parts.mapInPandas(_combine, COMBINED)
    # Timers ask for an event time among the columns, and rows with an old one would be dropped: this one never is.
    never_late = F.timestamp_seconds(F.lit(FAR)).alias("never_late", metadata=rows.schema["date"].metadata)
    closed = combined.select("*", never_late).groupBy("ipsrc", "start", "stop").applyInPandasWithState(
        _update, WINDOWS, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    times = [F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for c, n in (("start", "window_start"), ("stop", "window_end"))]
    return closed.select("ipsrc", *times, "total_flows", "denies", "unique_dst_ports", "late_flows")


def run_ip_windows(windows: DataFrame, checkpoint: str | None = None, sink: str | None = None) -> tuple[str, list]:
    """Works off what has arrived and stops: the sink's folder and the progress of the batches.

    With the same checkpoint a later call goes on where this one ended; open windows wait in its state.
    """
    spark = windows.sparkSession
    sink = sink or scratch_path(spark, "ip-windows")
    checkpoint = checkpoint or scratch_path(spark, "ip-windows-state")
    query = windows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return sink, query.recentProgress


def read_windows(spark: SparkSession, sink: str) -> DataFrame:
    """What the batches so far have given, one row per address and window."""
    schema = "ipsrc string, window_start timestamp_ntz, window_end timestamp_ntz, total_flows long, denies long, unique_dst_ports long, late_flows long"
    sums = [F.sum(c).alias(c) for c in ("total_flows", "denies", "unique_dst_ports", "late_flows")]
    return spark.read.schema(schema).parquet(sink).groupBy("ipsrc", "window_start", "window_end").agg(*sums)
