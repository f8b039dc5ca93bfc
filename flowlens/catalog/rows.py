"""Row-level operators: projections, filters, joins, set operations, scalar functions."""

from pyspark.sql import functions as F

from flowlens import functions as fn
from flowlens.catalog.base import FEATURES, FLOWS, PORT_CATEGORY_SQL, RAW_SQL, Query, rounded
from flowlens.fixtures import flows, flows_raw
from flowlens.operators import columns, filters, joins, ordering, sets
from flowlens.operators.features import full_table, ip_features
from flowlens.operators.preparation import fit_scaler
from flowlens.plans import addresses, tables, traffic

QUERIES: dict[str, Query] = {}
RAW = f"with {RAW_SQL}"
DAY = "2024-01-15"
IP = "94.102.61.7"


def add(name, run, sql=None):
    QUERIES[name] = Query(run, sql)


def over_flows(name, build, sql=None):
    """A query whose input is the canonical flow table."""
    add(name, lambda spark, sf: build(flows(spark, sf)), sql and f"{FLOWS} {sql}")


# --- projections and casts -------------------------------------------------------------


def _as_kernel_names(raw):
    """The raw flows under the column names of a parsed kernel log."""
    return raw.withColumnsRenamed(
        {"ipsrc": "src_ip", "ipdst": "dst_ip", "portsrc": "src_port", "portdst": "dst_port",
         "date": "timestamp", "regle": "rule"}
    )


add(
    "normalize_log_columns",
    lambda spark, sf: columns.normalize_log_columns(_as_kernel_names(flows_raw(spark, sf))),
    f"{FLOWS} select * from flows",
)

LEGACY_NAMES = {
    "nombre": "total_flows", "cnbripdst": "unique_dst_ips", "cnportdst": "unique_dst_ports",
    "inf1024deny": "deny_low_port",
}

add(
    "normalize_feature_names",
    lambda spark, sf: columns.normalize_feature_names(
        ip_features(flows(spark, sf)).select(
            "ipsrc", *[F.col(new).alias(old) for old, new in LEGACY_NAMES.items()]
        )
    ),
    f"{FEATURES} select ipsrc, total_flows, unique_dst_ips, unique_dst_ports, deny_low_port from base",
)

add(
    "align_schema",
    lambda spark, sf: columns.align_schema(
        _as_kernel_names(flows_raw(spark, sf)).drop("src_port").withColumnRenamed("event_id", "extra")
    ),
    f"""{RAW} select date as timestamp, cast(null as varchar) as hostname, action,
      cast(null as bigint) as fw, cast(regle as bigint) as rule, interface_in,
      cast(null as varchar) as interface_out, ipsrc as src_ip, ipdst as dst_ip,
      cast(null as bigint) as len, cast(null as bigint) as ttl, cast(null as bigint) as id,
      false as df, proto, cast(null as bigint) as src_port, cast(portdst as bigint) as dst_port,
      cast(null as bigint) as "window", cast(null as varchar) as flags, event_id as extra
      from flows_raw""",
)

over_flows(
    "drop_columns",
    lambda df: columns.drop_columns(df, "fw", "interface_in", "portsrc"),
    "select event_id, date, ipsrc, ipdst, portdst, proto, action, regle from flows",
)
over_flows(
    "select_columns",
    lambda df: columns.select_columns(df, "event_id", "ipsrc", "portdst"),
    "select event_id, ipsrc, portdst from flows",
)
add(
    "select_features",
    lambda spark, sf: columns.select_features(ip_features(flows(spark, sf)), preset="simple"),
    f"{FEATURES} select ipsrc, total_flows, unique_dst_ips, unique_dst_ports from base",
)


def _feature_preset(spark, sf):
    df = full_table(flows(spark, sf))
    names = columns.feature_preset(df, "course")
    return df.select("ipsrc", *names)


add(
    "feature_preset",
    _feature_preset,
    f"{FEATURES} select ipsrc, total_flows, unique_dst_ips, unique_dst_ports, permit, "
    "permit_low_port, permit_high_port, permit_admin, deny, deny_low_port, deny_high_port, "
    "deny_admin from base",
)

# Text renderings with unreadable values, for the casts.
def _dirty_text():
    event = F.col("event_id")
    port = F.col("portdst").cast("string")
    return F.when(event % 11 == 0, "N/A").when(event % 13 == 0, "").otherwise(port)


_DIRTY_SQL = """case when event_id % 11 = 0 then 'N/A' when event_id % 13 = 0 then ''
  else cast(portdst as varchar) end"""

over_flows(
    "null_sentinels",
    lambda df: columns.null_sentinels(df.select("event_id", _dirty_text().alias("text"))),
    f"select event_id, case when t in ('', 'NA', 'N/A', '-', 'null', 'NULL') then null else t end as text "
    f"from (select event_id, {_DIRTY_SQL} as t from flows)",
)
over_flows(
    "to_number",
    lambda df: columns.numbers_from_text(
        df.select("event_id", _dirty_text().alias("number")), ["number"]
    ),
    f"select event_id, try_cast(t as bigint) as number from (select event_id, {_DIRTY_SQL} as t from flows)",
)
over_flows(
    "to_timestamp",
    lambda df: columns.timestamps_from_text(
        df.select(
            "event_id",
            F.when(F.col("event_id") % 3 == 0, F.date_format("date", "M-d-yyyy H:mm:ss"))
            .when(F.col("event_id") % 7 == 0, "not a date")
            .otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
            .alias("time"),
        ),
        ["time"],
        formats=("yyyy-MM-dd HH:mm:ss", "M-d-yyyy H:mm:ss"),
    ),
    "select event_id, case when event_id % 3 = 0 then date when event_id % 7 = 0 then null "
    "else date end as time from flows",
)

# --- filters ---------------------------------------------------------------------------

KEPT = "event_id, date, ipsrc, portdst, action"


def _kept(df):
    return df.select("event_id", "date", "ipsrc", "portdst", "action")


def filter_query(name, build, where):
    over_flows(name, lambda df: _kept(build(df)), f"select {KEPT} from flows where {where}")


filter_query(
    "filter_period_inclusive",
    lambda df: filters.filter_period_inclusive(df, "2024-01-05", "2024-01-20"),
    "date >= timestamp '2024-01-05' and date <= timestamp '2024-01-20'",
)
filter_query(
    "filter_dates",
    lambda df: filters.filter_dates(df, "2024-01-05", "2024-01-20"),
    "cast(date as date) between date '2024-01-05' and date '2024-01-20'",
)
filter_query(
    "filter_period",
    lambda df: filters.filter_period(df, "2024-01-05", "2024-01-20"),
    "date >= timestamp '2024-01-05' and date < timestamp '2024-01-20'",
)
filter_query(
    "filter_equals",
    lambda df: filters.filter_equals(df, proto="TCP", action="DENY", regle="All"),
    "proto = 'TCP' and action = 'DENY'",
)
filter_query(
    "filter_in",
    lambda df: filters.filter_in(
        df, ["TCP", "UDP"], ["PERMIT"], ["Well-known (0-1023)", "Registered (1024-49151)"]
    ),
    "proto in ('TCP', 'UDP') and action in ('PERMIT') and "
    f"({PORT_CATEGORY_SQL}) in ('Well-known (0-1023)', 'Registered (1024-49151)')",
)
filter_query(
    "filter_port_range",
    lambda df: filters.filter_port_range(df, 22, 1024),
    "portdst between 22 and 1024",
)
filter_query(
    "search",
    lambda df: filters.search(df, "61\\.1"),
    r"""coalesce(regexp_matches(ipsrc, '(?i)61\.1'), false)
      or coalesce(regexp_matches(ipdst, '(?i)61\.1'), false)
      or coalesce(regexp_matches(cast(portdst as varchar), '(?i)61\.1'), false)
      or coalesce(regexp_matches(cast(regle as varchar), '(?i)61\.1'), false)""",
)
filter_query(
    "search_column",
    lambda df: filters.search(df, "44", "portdst"),
    "regexp_matches(cast(portdst as varchar), '(?i)44')",
)
filter_query(
    "external_sources",
    filters.external_sources,
    "not coalesce(starts_with(ipsrc, '159.84.'), false)",
)
filter_query(
    "external_destinations",
    lambda df: filters.external_destinations(df, "159.84.146.1"),
    "not starts_with(ipdst, '159.84.146.1')",
)
filter_query("flows_of_ip", lambda df: filters.flows_of_ip(df, IP), f"ipsrc = '{IP}'")
over_flows(
    "min_flows",
    lambda df: filters.min_flows(addresses.ip_stats(df), 40).select("ipsrc", "total_flows"),
    "select ipsrc, count(*) as total_flows from flows where ipsrc is not null "
    "group by ipsrc having count(*) >= 40",
)
filter_query(
    "permitted_well_known",
    filters.permitted_well_known,
    "portdst < 1024 and action = 'PERMIT'",
)
filter_query(
    "drop_null_rows",
    lambda df: filters.drop_null_rows(df, "date", "portdst"),
    "date is not null and portdst is not null",
)
over_flows(
    "exclude_dominant",
    lambda df: _kept(filters.exclude_dominant(df)),
    f"""select {KEPT} from flows where coalesce(portdst <> 443, true) and coalesce(regle <> (
      select regle from flows where regle is not null and portdst is not null
        and action in ('PERMIT', 'DENY')
      group by regle, portdst order by count(*) desc, regle, portdst limit 1), true)""",
)
filter_query(
    "flows_of_day", lambda df: filters.flows_of_day(df, DAY), f"cast(date as date) = date '{DAY}'"
)
over_flows(
    "filter_options",
    filters.filter_options,
    """select distinct column_name, value from (
        select 'proto' as column_name, proto as value from flows
        union all select 'action', action from flows
        union all select 'regle', cast(regle as varchar) from flows
        union all select 'interface_in', interface_in from flows) where value is not null""",
)
over_flows(
    "sample_rows",
    lambda df: _kept(ordering.sample_rows(df, "event_id", 500)),
    f"select {KEPT} from flows order by md5(concat(cast(event_id as varchar), ':42')), event_id limit 500",
)

# --- joins -----------------------------------------------------------------------------


def _join_features(spark, sf):
    df = flows(spark, sf)
    return joins.join_features(
        ip_features(df).select("ipsrc", "total_flows"),
        addresses.ip_stats(df.filter(F.col("proto") == "TCP")).select("ipsrc", "unique_rules"),
    )


add(
    "join_features",
    _join_features,
    f"""{FLOWS} select a.ipsrc, total_flows, unique_rules from
      (select ipsrc, count(*) as total_flows from flows where ipsrc is not null group by ipsrc) a
      left join (select ipsrc, count(distinct regle) as unique_rules from flows
                 where proto = 'TCP' group by ipsrc) b on a.ipsrc = b.ipsrc""",
)


def _outer_align(df):
    def part(condition):
        kept = df.filter(condition & F.col("ipsrc").isNotNull())
        return kept.groupBy("ipsrc").agg(F.count("*").alias("value"))

    return joins.outer_align(
        {
            "night_denies": part((F.col("action") == "DENY") & fn.is_night(F.col("date"))),
            "ssh_flows": part(F.col("portdst") == 22),
            "icmp_flows": part(F.col("proto") == "ICMP"),
        }
    )


over_flows(
    "outer_align",
    _outer_align,
    """select coalesce(a.ipsrc, b.ipsrc, c.ipsrc) as ipsrc,
        coalesce(night_denies, 0) as night_denies, coalesce(ssh_flows, 0) as ssh_flows,
        coalesce(icmp_flows, 0) as icmp_flows
      from (select ipsrc, count(*) as night_denies from flows where action = 'DENY'
              and (hour(date) >= 22 or hour(date) < 6) and ipsrc is not null group by ipsrc) a
      full join (select ipsrc, count(*) as ssh_flows from flows where portdst = 22
              and ipsrc is not null group by ipsrc) b on a.ipsrc = b.ipsrc
      full join (select ipsrc, count(*) as icmp_flows from flows where proto = 'ICMP'
              and ipsrc is not null group by ipsrc) c on coalesce(a.ipsrc, b.ipsrc) = c.ipsrc""",
)


def _attach_results(spark, sf):
    features = ip_features(flows(spark, sf)).select("ipsrc", "total_flows", "deny")
    results = features.filter(F.col("deny") > 5).select(
        "ipsrc", (F.col("total_flows") % 3).cast("int").alias("cluster")
    )
    return joins.attach_results(features, results)


add(
    "attach_results",
    _attach_results,
    f"""{FEATURES} select ipsrc, total_flows, deny,
      case when deny > 5 then cast(total_flows % 3 as int) end as cluster from base""",
)
over_flows(
    "semi_top_n",
    lambda df: _kept(traffic.top_port_flows(df, 5)),
    f"""select {KEPT} from flows where portdst in (select portdst from flows
      where portdst is not null group by portdst order by count(*) desc, portdst limit 5)""",
)
SERVICE_SQL = """coalesce(map_extract(map {21: 'FTP', 22: 'SSH', 23: 'Telnet', 25: 'SMTP', 53: 'DNS',
  80: 'HTTP', 110: 'POP3', 143: 'IMAP', 443: 'HTTPS', 445: 'SMB', 993: 'IMAPS', 995: 'POP3S',
  3389: 'RDP'}, portdst)[1], '')"""
over_flows(
    "port_service",
    lambda df: joins.port_service(df.select("event_id", "portdst")),
    f"select event_id, portdst, {SERVICE_SQL} as service from flows",
)


def _fill_hours(df):
    night = filters.drop_null_rows(df, "date").filter(F.hour("date") < 7)
    counts = night.groupBy(F.hour("date").alias("hour")).agg(F.count("*").alias("count"))
    return joins.fill_hours(counts, ["count"])


over_flows(
    "fill_hours",
    _fill_hours,
    """select cast(h.hour as int) as hour, coalesce(n, 0) as count from range(24) h(hour)
      left join (select hour(date) as hour, count(*) as n from flows
                 where hour(date) < 7 group by 1) c on h.hour = c.hour""",
)
over_flows(
    "compare_ips",
    lambda df: joins.compare_ips(
        addresses.ip_stats(df).select("ipsrc", "total_flows", "permits", "denies"),
        [IP, "94.102.61.2", "159.84.0.4"],
    ),
    f"""select ipsrc, count(*) as total_flows, count(*) filter (where action = 'PERMIT') as permits,
      count(*) filter (where action = 'DENY') as denies from flows
      where ipsrc in ('{IP}', '94.102.61.2', '159.84.0.4') group by ipsrc""",
)

# --- set operations --------------------------------------------------------------------


def _union_flows(spark, sf):
    raw = flows_raw(spark, sf)
    first = _as_kernel_names(raw.filter(F.col("proto") == "TCP"))
    second = raw.filter(F.col("proto") != "TCP").drop("interface_in")
    return sets.union_flows(first, second)


add(
    "union_flows",
    _union_flows,
    f"""{FLOWS} select * replace (case when proto = 'TCP' then interface_in end as interface_in)
      from flows""",
)
add(
    "unexpected_values",
    lambda spark, sf: sets.unexpected_values(flows_raw(spark, sf), "action", ["PERMIT", "DENY"]),
    f"{RAW} select distinct action from flows_raw where action not in ('PERMIT', 'DENY')",
)

# --- scalar functions ------------------------------------------------------------------



def _pick(*values):
    """One of the values, by event number."""
    index = (F.col("event_id") % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


VARIANTS = ("Permit", " allow", "PASS", "1", "true", "Denied", "block", "0", "other")
over_flows(
    "normalize_action",
    lambda df: df.select("event_id", fn.normalize_action(_pick(*VARIANTS)).alias("action")),
    """select event_id, list_extract(['permit', 'permit', 'permit', 'permit', 'permit', 'deny', 'deny',
      'deny', 'other'], cast(event_id % 9 + 1 as int)) as action from flows""",
)
PROTOCOLS = ("6", " 17", "1", "58", "tcp", "Udp", "icmp", "gre")
over_flows(
    "normalize_protocol",
    lambda df: df.select("event_id", fn.normalize_protocol(_pick(*PROTOCOLS)).alias("protocol")),
    """select event_id, list_extract(['TCP', 'UDP', 'ICMP', 'ICMPv6', 'TCP', 'UDP', 'ICMP', 'GRE'],
      cast(event_id % 8 + 1 as int)) as protocol from flows""",
)


def _address():
    event = F.col("event_id")
    last = F.when(event % 7 == 0, "x").otherwise((event % 9).cast("string"))
    return F.concat(F.lit("159."), (event % 300).cast("string"), F.lit(".1."), last)


over_flows(
    "valid_ipv4",
    lambda df: df.select(
        "event_id", fn.valid_ipv4(_address()).alias("made"), fn.valid_ipv4(F.col("ipsrc")).alias("source")
    ),
    "select event_id, event_id % 300 <= 255 and event_id % 7 <> 0 as made, ipsrc is not null as source from flows",
)
over_flows(
    "valid_port",
    lambda df: df.select(
        "event_id",
        fn.valid_port(F.col("portdst") + 10000).alias("shifted"),
        fn.valid_port(F.col("portdst")).alias("plain"),
    ),
    """select event_id, coalesce(portdst + 10000 between 0 and 65535, false) as shifted,
      portdst is not null as plain from flows""",
)
over_flows(
    "safe_divide",
    lambda df: rounded(
        df.select(
            "event_id",
            fn.safe_divide(F.col("portsrc"), F.col("event_id") % 5, -1.0).alias("quotient"),
        )
    ),
    "select event_id, round(case when event_id % 5 = 0 then -1 else portsrc / (event_id % 5) end, 6) as quotient from flows",
)
over_flows(
    "port_category",
    lambda df: traffic.with_port_category(df).select("event_id", "port_category"),
    f"select event_id, {PORT_CATEGORY_SQL} as port_category from flows",
)
over_flows(
    "is_external",
    lambda df: df.select("event_id", fn.is_external(F.col("ipsrc")).alias("external")),
    "select event_id, not coalesce(starts_with(ipsrc, '159.84.'), false) as external from flows",
)


def _line():
    """Lines with flag words and repeated keys, built from the flow columns."""
    event = F.col("event_id")
    return F.concat(
        F.lit("IN=eth0 OUT= ID=1 SRC="),
        F.coalesce("ipsrc", F.lit("")),
        F.lit(" syn X-ID="),
        event.cast("string"),
        F.when(event % 2 == 0, " ACK SYNX ID=9 ").otherwise(" "),
        F.lit("Urg PSH=1"),
    )


over_flows(
    "tcp_flags",
    lambda df: df.select("event_id", fn.tcp_flags(_line()).alias("flags")),
    "select event_id, case when event_id % 2 = 0 then 'SYN,ACK,URG' else 'SYN,URG' end as flags from flows",
)


def _kv_extract(df):
    pairs = df.select("event_id", fn.pair_text(_line()).alias("pairs"))
    keys = {"interface_out": "OUT", "src_ip": "SRC", "id": "ID", "missing": "DST"}
    return pairs.select(
        "event_id", *[fn.key_value(F.col("pairs"), k).alias(n) for n, k in keys.items()]
    )


over_flows(
    "kv_extract",
    _kv_extract,
    """select event_id, '' as interface_out, coalesce(ipsrc, '') as src_ip,
      case when event_id % 2 = 0 then '9' else cast(event_id as varchar) end as id,
      cast(null as varchar) as missing from flows""",
)
over_flows(
    "date_parts",
    lambda df: df.select(
        "event_id",
        F.hour("date").alias("hour"),
        F.weekday("date").alias("weekday"),
        fn.is_weekend(F.col("date")).alias("weekend"),
        fn.is_night(F.col("date")).alias("night"),
        fn.floor_time(F.col("date"), "hour").alias("floor_hour"),
        F.date_format("date", "EEEE").alias("day_name"),
    ),
    """select event_id, cast(hour(date) as int) as hour, cast(isodow(date) - 1 as int) as weekday,
      coalesce(isodow(date) >= 6, false) as weekend,
      coalesce(hour(date) >= 22 or hour(date) < 6, false) as night,
      date_trunc('hour', date) as floor_hour, dayname(date) as day_name from flows""",
)
add(
    "string_basics",
    lambda spark, sf: flows_raw(spark, sf).select(
        "event_id",
        F.trim("action").alias("stripped"),
        F.upper("action").alias("uppered"),
        F.lower("action").alias("lowered"),
        fn.capitalize(F.concat_ws(" ", F.trim("action"), F.lit("ALL"))).alias("capitalized"),
        F.col("action").startswith("P").alias("starts"),
        F.col("action").rlike("(?i)er").alias("matches"),
    ),
    f"""{RAW} select event_id, trim(action) as stripped, upper(action) as uppered,
      lower(action) as lowered,
      concat(upper(substr(trim(action), 1, 1)), lower(substr(trim(action), 2)), ' all') as capitalized,
      starts_with(action, 'P') as starts, regexp_matches(action, '(?i)er') as matches
      from flows_raw""",
)
over_flows(
    "percent_rounding",
    lambda df: df.select(
        "event_id",
        fn.percent(F.col("portdst"), F.col("portsrc"), 1).alias("one"),
        fn.percent(F.col("portdst"), F.col("portsrc"), 2).alias("two"),
    ),
    """select event_id, round_even(portdst::double / portsrc::double * 100, 1) as one,
      round_even(portdst::double / portsrc::double * 100, 2) as two from flows""",
)


def _min_max(spark, sf):
    stats = addresses.ip_stats(flows(spark, sf)).select("ipsrc", "total_flows", "denies")
    scaler = fit_scaler(stats, ["total_flows", "denies"], "minmax")
    return rounded(scaler.transform(stats))


add(
    "min_max",
    _min_max,
    f"""{FLOWS}, s as (select ipsrc, count(*) as t, count(*) filter (where action = 'DENY') as d
      from flows where ipsrc is not null group by ipsrc)
      select ipsrc, round((t - min(t) over ()) / (max(t) over () - min(t) over ()), 6) as total_flows,
        round((d - min(d) over ()) / (max(d) over () - min(d) over ()), 6) as denies from s""",
)

# --- paging ----------------------------------------------------------------------------

over_flows(
    "browse_page",
    lambda df: _kept(tables.browse_page(df, "portdst", "event_id", page=4, rows_per_page=50)),
    f"select {KEPT} from flows order by portdst nulls last, event_id limit 50 offset 150",
)

def _deep_page(df):
    book = tables.page_directory(df, "portdst", "event_id", rows_per_page=50, ranges=16)
    return _kept(book.page(1 + book.pages // 2))


over_flows(
    "browse_deep",
    _deep_page,
    f"""select {KEPT} from (select *, row_number() over (order by portdst nulls last, event_id) as place,
      greatest(1, ceil(count(*) over () / 50)) as pages from flows)
      where place > 50 * floor(pages / 2) and place <= 50 * floor(pages / 2) + 50""",
)
over_flows(
    "browse_after",
    lambda df: _kept(tables.browse_after(df, "portdst", "event_id", 80, 100, 50)),
    f"""select {KEPT} from flows where portdst > 80 or (portdst = 80 and event_id > 100)
      or portdst is null order by portdst nulls last, event_id limit 50""",
)
over_flows(
    "total_pages",
    lambda df: tables.total_pages(filters.filter_equals(df, proto="UDP"), 50),
    """select count(*) as total_rows, cast(greatest(1, ceil(count(*) / 50)) as bigint) as total_pages
      from flows where proto = 'UDP'""",
)
over_flows(
    "preview",
    lambda df: _kept(tables.preview(df, "event_id", 20)),
    f"select {KEPT} from flows order by event_id limit 20",
)
over_flows(
    "head_of_ip",
    lambda df: _kept(addresses.head_of_ip(df, IP)),
    f"select {KEPT} from flows where ipsrc = '{IP}' order by date nulls first, event_id limit 100",
)
