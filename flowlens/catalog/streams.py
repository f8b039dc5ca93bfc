"""Streams: tables arrive in a folder in two batches, the second with late rows."""

from pyspark.sql import functions as F

from flowlens import fixtures
from flowlens.catalog.base import FLOWS, RAW_SQL, Query
from flowlens.operators.columns import normalize_log_columns
from flowlens.session import scratch_path
from flowlens.streaming import ip_windows, run_ip_windows, stream_flows
from flowlens.streaming.windows import read_windows

QUERIES: dict[str, Query] = {}


def add(name, run, sql=None):
    QUERIES[name] = Query(run, sql)


def batches(flows):
    """Conditions of the two batches: nine of ten rows of the first half of the time span, then the rest."""
    seconds = F.unix_seconds(F.col("date").cast("timestamp"))
    low, high = flows.agg(F.min(seconds), F.max(seconds)).first()
    first = F.coalesce((2 * seconds < low + high) & (F.col("event_id") % 10 != 0), F.lit(False))
    return first, ~first


def _ip_window(length: str, slide: str | None = None):
    def run(spark, sf):
        flows = fixtures.flows(spark, sf).select("event_id", "ipsrc", "date", "portdst", "action")
        folder, checkpoint, sink = (scratch_path(spark, n) for n in ("arriving", "stream-state", "windows"))
        for batch in batches(flows):
            flows.where(batch).write.mode("append").parquet(folder)
            arriving = stream_flows(spark, folder, "parquet", schema=flows.schema)
            run_ip_windows(ip_windows(arriving, length, slide, delay="1 hour"), checkpoint, sink)
        return read_windows(spark, sink)

    return run


def _window_sql(starts: str, length: str) -> str:
    return f"""{FLOWS},
timed as (select *, case when 2 * cast(epoch(date) as bigint) < min(cast(epoch(date) as bigint)) over () + max(cast(epoch(date) as bigint)) over ()
    and event_id % 10 <> 0 then 1 else 2 end as batch from flows where date is not null),
marks as (select max(date) filter (where batch = 1) - interval 1 hour as w1, max(date) - interval 1 hour as w2 from timed),
placed as (select ipsrc, action, portdst, batch, {starts} as window_start from timed where ipsrc is not null),
judged as (select *, window_start + interval {length} as window_end,
  batch = 2 and window_start + interval {length} < w1 as late from placed, marks),
closed as (select ipsrc, window_start, window_end, count(*) as total_flows, count(*) filter (where action = 'DENY') as denies,
  count(distinct portdst) as unique_dst_ports, 0 as late_flows
  from judged where not late and window_end < w2 group by all),
late as (select ipsrc, window_start, window_end, 0 as total_flows, 0 as denies, 0 as unique_dst_ports, count(*) as late_flows
  from judged where late group by ipsrc, window_start, window_end)
select ipsrc, window_start, window_end, cast(sum(total_flows) as bigint) as total_flows, cast(sum(denies) as bigint) as denies,
  cast(sum(unique_dst_ports) as bigint) as unique_dst_ports, cast(sum(late_flows) as bigint) as late_flows
from (select * from closed union all select * from late) group by all"""


add("stream_ip_window", _ip_window("1 hour"), _window_sql("date_trunc('hour', date)", "1 hour"))
add(
    "stream_ip_window_sliding",
    _ip_window("2 hours", "1 hour"),
    _window_sql("unnest([date_trunc('hour', date), date_trunc('hour', date) - interval 1 hour])", "2 hours"),
)


def _stream_flows(spark, sf):
    folder, sink, checkpoint = (scratch_path(spark, n) for n in ("tailed", "streamed", "stream-state"))
    fixtures.kernel_lines(fixtures.flows_raw(spark, sf)).write.text(folder)
    stream = stream_flows(spark, folder, year=2024)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).select("id", "date", "ipsrc", "ipdst", "proto", "portdst", "action", "regle")


add(
    "stream_flows",
    _stream_flows,
    f"""with {RAW_SQL} select case when proto = 'ICMP' then event_id + 1 else event_id end as id, date, coalesce(ipsrc, '') as ipsrc, ipdst,
      proto, case when proto <> 'ICMP' then cast(portdst as bigint) end as portdst,
      case upper(trim(action)) when 'ACCEPT' then 'PERMIT' when 'DROP' then 'DENY' else upper(trim(action)) end as action,
      cast(regle as bigint) as regle from flows_raw""",
)
