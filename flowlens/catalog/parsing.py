"""Readers and writers: logs rendered from the tables, written as text, read back."""

from pyspark.sql import functions as F

from flowlens import fixtures, sinks, sources
from flowlens.catalog.base import FEATURE_COLUMNS_11, FEATURES, FLOWS_CTE, RAW_SQL, Query
from flowlens.catalog.feature_sets import labelled
from flowlens.operators import features as fs
from flowlens.operators.columns import normalize_log_columns
from flowlens.session import scratch_path
from flowlens.sources.delimited import dropped_lines

QUERIES: dict[str, Query] = {}
RAW = f"with {RAW_SQL}"


def add(name, run, sql=None):
    QUERIES[name] = Query(run, sql)


def written(spark, lines, name):
    """Writes text lines to shared scratch and returns the folder."""
    path = scratch_path(spark, name)
    lines.write.text(path)
    return path


def over_lines(name, render, read, sql):
    def run(spark, sf):
        lines = render(fixtures.flows_raw(spark, sf))
        return read(spark, written(spark, lines, name))

    add(name, run, f"{RAW} {sql}")


over_lines(
    "scan_kernel_log",
    fixtures.kernel_lines,
    lambda spark, path: sources.scan_kernel_log(spark, path, year=2024),
    """select date as timestamp, 'fw1' as hostname, upper(trim(action)) as action, event_id % 7 as fw,
      cast(regle as bigint) as rule, interface_in, '' as interface_out, coalesce(ipsrc, '') as src_ip,
      ipdst as dst_ip, 40 + event_id % 1400 as len, event_id % 256 as ttl,
      case when proto = 'ICMP' then event_id + 1 else event_id end as id, event_id % 3 = 0 as df, proto,
      case when proto <> 'ICMP' then cast(portsrc as bigint) end as src_port,
      case when proto <> 'ICMP' then cast(portdst as bigint) end as dst_port,
      case when proto = 'TCP' then cast(1024 as bigint) end as "window",
      case when proto <> 'TCP' then '' when event_id % 2 = 0 then 'SYN' else 'ACK,PSH' end as flags
      from flows_raw""",
)
over_lines(
    "skipped_lines",
    fixtures.kernel_lines,
    sources.skipped_lines,
    """select count(*) + count(*) filter (where event_id % 50 = 0) as n_lines, count(*) as matched,
      count(*) filter (where event_id % 50 = 0) as skipped from flows_raw""",
)


def _infer_log_year(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    first = orders.agg(F.year(F.min("o_orderdate"))).first()[0]
    path = written(spark, fixtures.yearless_lines(orders), "yearless")
    return sources.scan_kernel_log(spark, path, year=first, one_log=True).select("id", "timestamp")


add(
    "infer_log_year",
    _infer_log_year,
    "select o_orderkey as id, o_orderdate as timestamp from orders",
)
over_lines(
    "scan_firewall_export",
    fixtures.export_lines,
    sources.scan_firewall_export,
    """select date as timestamp, ipsrc as src_ip, ipdst as dst_ip, proto, cast(portsrc as bigint) as src_port,
      case when event_id % 17 <> 0 then cast(portdst as bigint) end as dst_port, cast(regle as bigint) as rule,
      upper(trim(action)) as action, interface_in, cast(null as varchar) as interface_out,
      case when event_id % 43 <> 0 then cast(6 as bigint) end as fw
      from flows_raw where event_id % 41 <> 0""",
)
over_lines(
    "bad_line_policy",
    fixtures.export_lines,
    lambda spark, path: sources.scan_firewall_export(spark, path).agg(
        F.count("*").alias("kept"), F.count_if(F.col("fw").isNull()).alias("padded")
    ),
    """select count(*) filter (where event_id % 41 <> 0) as kept,
      count(*) filter (where event_id % 41 <> 0 and event_id % 43 = 0) as padded from flows_raw""",
)
over_lines(
    "quoted_line_breaks",
    fixtures.noted_lines,
    lambda spark, path: sources.scan_csv(spark, path, columns=["event_id", "note", "portdst"], dtype={"event_id": "bigint", "portdst": "int"}),
    """select event_id, case when event_id % 2 = 0 then concat('rule ', cast(regle as varchar), ',', chr(10), 'said "', trim(action), '"',
      case when event_id % 3 = 0 then concat(chr(10), chr(10), 'end') else '' end) else 'no 5" note' end as note, portdst
      from flows_raw where event_id % 41 <> 0""",
)
over_lines(
    "dropped_lines",
    fixtures.noted_lines,
    lambda spark, path: dropped_lines(spark, path, ["event_id", "note", "portdst"]),
    """select count(*) as n_lines, count(*) filter (where event_id % 41 = 0) as too_long, cast(0 as bigint) as unbalanced from flows_raw""",
)
over_lines(
    "scan_firewall_csv",
    fixtures.legacy_lines,
    sources.scan_firewall_csv,
    """select ipsrc, ipdst, portdst, proto,
      concat(upper(substr(trim(action), 1, 1)), lower(substr(trim(action), 2))) as action, date,
      cast(regle as varchar) as regle from flows_raw""",
)


def _scan_kibana(spark, sf):
    path = scratch_path(spark, "kibana")
    rows = fixtures.kibana_rows(fixtures.flows_raw(spark, sf))
    rows.write.option("header", True).csv(path)
    return sources.scan_kibana_export(spark, path)


add(
    "scan_kibana_export",
    _scan_kibana,
    f"""{RAW} select date as timestamp, cast(null as varchar) as hostname, upper(trim(action)) as action,
      cast(null as bigint) as fw, cast(regle as bigint) as rule, interface_in, cast(null as varchar) as interface_out,
      ipsrc as src_ip, ipdst as dst_ip, cast(null as bigint) as len, cast(null as bigint) as ttl,
      cast(null as bigint) as id, false as df, proto, cast(portsrc as bigint) as src_port,
      cast(portdst as bigint) as dst_port, cast(null as bigint) as "window", cast(null as varchar) as flags,
      cast(event_id as varchar) as "offset" from flows_raw""",
)
over_lines(
    "scan_syslog",
    fixtures.syslog_lines,
    lambda spark, path: sources.scan_syslog(spark, path, year=2024, with_pid=True),
    """select case when event_id % 20 <> 0 then date end as timestamp,
      case when event_id % 20 <> 0 then concat('host', event_id % 3) end as hostname,
      case when event_id % 20 <> 0 then concat('sshd[', event_id, ']') end as process,
      case when event_id % 20 = 0 then concat('-- mark ', event_id) else concat('action ', trim(action)) end as message,
      case when event_id % 20 <> 0 then event_id end as pid from flows_raw""",
)
over_lines(
    "scan_csv",
    lambda raw: fixtures.legacy_lines(raw, "|"),
    lambda spark, path: sources.scan_csv(
        spark,
        path,
        columns=["src", "dst", "port", "proto", "action", "time", "rule"],
        separator="|",
        date_columns=["time"],
        date_format="yyyy-MM-dd HH:mm:ss",
        dtype={"port": "int", "rule": "bigint"},
        transformations={"action": lambda c: F.lower(F.trim(c))},
        na_values=["", "ICMP"],
    ),
    """select ipsrc as src, ipdst as dst, portdst as port, nullif(proto, 'ICMP') as proto,
      lower(trim(action)) as action, date as time, cast(regle as bigint) as rule from flows_raw""",
)

# --- tables ----------------------------------------------------------------------------


def _stored(spark, sf, name):
    """Canonical flows under log column names, stored by day."""
    names = {"ipsrc": "src_ip", "ipdst": "dst_ip", "portdst": "dst_port", "date": "timestamp", "regle": "rule"}
    path = scratch_path(spark, name)
    sinks.write_flows(fixtures.flows_raw(spark, sf).withColumnsRenamed(names), path, "timestamp")
    return path


add(
    "scan_parquet",
    lambda spark, sf: sources.scan_parquet(spark, f"{sf}/events.parquet", ["event_id", "event_type"]),
    "select event_id, event_type from events",
)
add(
    "load_flows_parquet",
    lambda spark, sf: sources.load_flows_parquet(
        spark, _stored(spark, sf, "flows"), ["portsrc", "fw", "day"], ("2024-01-03", "2024-01-09")
    ),
    f"""{RAW} select event_id, date as timestamp, ipsrc as src_ip, ipdst as dst_ip, portdst as dst_port, proto,
      action, regle as rule, interface_in from flows_raw
      where date between timestamp '2024-01-03' and timestamp '2024-01-09'""",
)
add(
    "scan_parquet_period",
    lambda spark, sf: sources.scan_parquet_period(
        spark, _stored(spark, sf, "flows"), "2024-01-03", "2024-01-20"
    ),
    f"""with {FLOWS_CTE} select date, ipsrc, ipdst, proto, portdst, regle, action from flows
      where date >= timestamp '2024-01-03' and date < timestamp '2024-01-20'""",
)
add(
    "parquet_profile",
    lambda spark, sf: sources.parquet_profile(spark, f"{sf}/events.parquet").select("file_name", "n_rows", "n_columns"),
    "select 'events.parquet' as file_name, count(*) as n_rows, cast(6 as int) as n_columns from events",
)


def _scan_labeled(spark, sf):
    path = scratch_path(spark, "labelled")
    table = labelled(fixtures.flows(spark, sf)).select("ipsrc", "total_flows", "deny", "risk")
    sinks.export_csv(table, path)
    return sources.scan_labeled(spark, path)


add(
    "scan_labeled",
    _scan_labeled,
    f"""{FEATURES} select ipsrc, total_flows::double as total_flows, deny::double as deny,
      case when deny_ratio > 0.42 then 'positive' else 'negative' end as risk from features""",
)


def _feature_store(spark, sf):
    folder = scratch_path(spark, "store")
    sinks.save_feature_set(fs.simple_features(fixtures.flows(spark, sf)), folder, "simple")
    stored = sinks.load_feature_set(spark, folder, "simple")
    return stored.with_constants().select(
        "ipsrc", "total_flows", "unique_dst_ports", F.lit(stored.metadata["num_samples"]).cast("bigint").alias("n")
    )


add(
    "feature_store",
    _feature_store,
    f"{FEATURES} select ipsrc, total_flows, unique_dst_ports, count(*) over () as n from base",
)


def _write_parquet(spark, sf):
    path = scratch_path(spark, "written")
    sinks.write_table(fixtures.flows(spark, sf), path, "parquet")
    return spark.read.parquet(path)


add("write_table", _write_parquet, f"with {FLOWS_CTE} select * from flows")


def _export_csv(spark, sf):
    path = scratch_path(spark, "exported")
    sinks.export_csv(fs.ip_features(fixtures.flows(spark, sf)), path)
    return sources.scan_csv(spark, path, dtype={c: "bigint" for c in FEATURE_COLUMNS_11})


add("export_csv", _export_csv, f"{FEATURES} select ipsrc, {', '.join(FEATURE_COLUMNS_11)} from base")


def _export_capped(spark, sf):
    path = scratch_path(spark, "capped")
    sinks.export_capped(fixtures.flows(spark, sf), path, "event_id", sinks.tables.EXPORT_CAP)
    return sources.scan_csv(spark, path, dtype={"event_id": "bigint"}).select("event_id", "ipsrc")


add(
    "export_capped",
    _export_capped,
    f"with {FLOWS_CTE} select event_id, ipsrc from flows order by event_id limit 100000",
)


def _scan_registry(spark, sf):
    """Two formats through the registry, united in canonical form."""
    raw = fixtures.flows_raw(spark, sf)
    kernel = sources.scan(spark, "kernel_firewall", written(spark, fixtures.kernel_lines(raw), "k"), year=2024)
    legacy = sources.scan(spark, "firewall", written(spark, fixtures.legacy_lines(raw), "l"))
    columns = ["ipdst", "action", "date"]
    return normalize_log_columns(kernel).select(columns).unionByName(normalize_log_columns(legacy).select(columns))


add(
    "scan",
    _scan_registry,
    f"""with {FLOWS_CTE} select ipdst, action, date from flows
      union all select ipdst, action, date from flows""",
)


def _registered_parser(spark, sf):
    """A format of one's own under a name, read through the registry."""

    def read_pipes(spark, path, upper=False):
        fields = F.split("value", "[|]")
        action = F.trim(fields[4])
        return spark.read.text(path).select(
            fields[1].alias("ipdst"), fields[2].try_cast("int").alias("portdst"), (F.upper(action) if upper else action).alias("action")
        )

    sources.register_parser("pipes", read_pipes)
    raw = fixtures.flows_raw(spark, sf)
    return sources.scan(spark, "pipes", written(spark, fixtures.legacy_lines(raw, "|"), "pipes"), upper=True)


add(
    "register_parser",
    _registered_parser,
    f"{RAW} select ipdst, cast(portdst as int) as portdst, upper(trim(action)) as action from flows_raw",
)


def _load_logs(spark, sf):
    """Strict loading: rows that pass the checks are returned, a file without them is an error."""
    raw = fixtures.flows_raw(spark, sf).filter("ipsrc is not null and date is not null and proto <> 'ICMP'")
    lines = fixtures.kernel_lines(raw)
    loaded = sources.load_logs(spark, "kernel_firewall", written(spark, lines, "strict"), year=2024)
    return loaded.select("id", "timestamp", "src_ip", "dst_port")


add(
    "load_logs",
    _load_logs,
    f"""{RAW} select event_id as id, date as timestamp, ipsrc as src_ip, cast(portdst as bigint) as dst_port from flows_raw
      where ipsrc is not null and date is not null and proto <> 'ICMP'""",
)
