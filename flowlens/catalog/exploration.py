"""The exploratory reports."""

from pyspark.sql import functions as F

from flowlens.catalog.base import (
    FEATURE_COLUMNS_11,
    FEATURES_CTE,
    FLOWS_CTE,
    PORT_CATEGORY_SQL,
    Query,
    rounded,
)
from flowlens.catalog.rows import DAY, IP, SERVICE_SQL
from flowlens.fixtures import flows
from flowlens.operators import filters, quality
from flowlens.operators.features import full_table
from flowlens.plans import addresses, rules, tables, traffic

QUERIES: dict[str, Query] = {}
P = "count(*) filter (where action = 'PERMIT')"
D = "count(*) filter (where action = 'DENY')"


def over_flows(name, build, sql=None, ctes=FLOWS_CTE):
    QUERIES[name] = Query(
        lambda spark, sf: build(flows(spark, sf)), sql and f"with {ctes} {sql}"
    )


# --- totals ----------------------------------------------------------------------------

over_flows(
    "overview_metrics",
    traffic.overview_metrics,
    f"""select count(*) as total, {P} as permits, {D} as denies,
      count(*) filter (where proto = 'TCP') as tcp, count(*) filter (where proto = 'UDP') as udp,
      round_even({P} / count(*) * 100, 1) as permit_pct,
      round_even({D} / count(*) * 100, 1) as deny_pct from flows""",
)
over_flows(
    "summary_metrics",
    traffic.summary_metrics,
    f"""select count(*) as total_flows, count(distinct ipsrc) as unique_src_ips,
      count(distinct ipdst) as unique_dst_ips, count(distinct portdst) as unique_ports,
      count(distinct regle) as unique_rules, {P} as permits, {D} as denies,
      count(*) filter (where proto = 'TCP') as tcp_flows,
      count(*) filter (where proto = 'UDP') as udp_flows,
      count(distinct case when not starts_with(ipsrc, '159.84.') then ipsrc end) as external_src_ips
      from flows""",
)
over_flows(
    "upload_stats",
    traffic.upload_stats,
    f"""select count(*) as n_rows, cast(10 as bigint) as n_columns,
      count(distinct ipsrc) as unique_ips, round_even({D} / count(*) * 100, 1) as deny_rate from flows""",
)
over_flows(
    "quick_stats",
    lambda df: traffic.quick_stats(filters.filter_equals(df, proto="TCP")),
    f"""select count(*) as records, count(distinct ipsrc) as unique_ips,
      count(distinct portdst) as unique_ports, {P} as permits, count(*) - {P} as others
      from flows where proto = 'TCP'""",
)
over_flows(
    "value_counts",
    lambda df: traffic.value_counts(df, "portdst"),
    "select portdst, count(*) as count from flows where portdst is not null group by portdst",
)

# --- protocols and ports ---------------------------------------------------------------

over_flows(
    "proto_action_counts",
    traffic.proto_action_counts,
    "select proto, action, count(*) as count from flows group by proto, action",
)
over_flows(
    "proto_action_pivot",
    traffic.proto_action_pivot,
    f"""select proto, {D} as "DENY", {P} as "PERMIT", count(*) as "Total",
      round_even({P} / count(*) * 100, 1) as permit_pct from flows group by proto""",
)
over_flows(
    "port_range_pivot",
    traffic.port_range_pivot,
    f"""select port_category, {D} as "DENY", {P} as "PERMIT", count(*) as "Total",
      round_even({P} / count(*) * 100, 1) as permit_pct, round_even({D} / count(*) * 100, 1) as deny_pct
      from (select *, {PORT_CATEGORY_SQL} as port_category from flows) group by port_category""",
)
over_flows(
    "port_range_counts",
    traffic.port_range_counts,
    f"""select port_category, count(*) as count from
      (select {PORT_CATEGORY_SQL} as port_category from flows where portdst > 0) group by port_category""",
)
over_flows(
    "flow_hierarchy",
    traffic.flow_hierarchy,
    f"""select proto, action, port_category,
      cast(3 - grouping(proto) - grouping(action) - grouping(port_category) as int) as level,
      count(*) as count
      from (select *, {PORT_CATEGORY_SQL} as port_category from flows)
      group by rollup (proto, action, port_category)""",
)
over_flows(
    "protocol_usage",
    traffic.protocol_usage,
    """select proto as protocol, count(*) as occurrences,
      round_even(count(*) / (select count(*) from flows) * 100, 2) as pct from flows group by proto""",
)
over_flows(
    "interface_stats",
    traffic.interface_stats,
    f"select interface_in, count(*) as total, {P} as permits, {D} as denies from flows group by interface_in",
)
over_flows(
    "top_permitted_ports",
    traffic.top_permitted_ports,
    f"""select portdst, count(*) as count, count(distinct ipsrc) as unique_src_ips,
      {SERVICE_SQL} as service from flows where portdst < 1024 and action = 'PERMIT'
      group by portdst order by count desc, portdst limit 10""",
)
over_flows(
    "top_well_known_ports",
    traffic.top_well_known_ports,
    """select portdst, count(*) as count from flows where portdst < 1024
      group by portdst order by count desc, portdst limit 20""",
)
over_flows(
    "top_ports",
    lambda df: traffic.top_ports(df),
    """select portdst, action, count(*) as count, total from flows join (
        select portdst, count(*) as total from flows where portdst is not null
        group by portdst order by total desc, portdst limit 20) t using (portdst)
      group by portdst, action, total""",
)

# --- time ------------------------------------------------------------------------------

LABELS = {
    "hour": "strftime(p, '%Y-%m-%d %H:00')",
    "day": "strftime(p, '%Y-%m-%d')",
    "week": "concat(strftime(p, '%Y-%m-%d'), '/', strftime(p + interval 6 day, '%Y-%m-%d'))",
    "month": "strftime(p, '%Y-%m')",
}
for _unit, _label in LABELS.items():
    over_flows(
        f"traffic_over_time_{_unit}",
        lambda df, unit=_unit: traffic.traffic_over_time(df, unit),
        f"""select cast(p as timestamp) as period, {_label} as label, action, count(*) as count
          from (select date_trunc('{_unit}', date) as p, action from flows where date is not null)
          group by p, action""",
    )
over_flows(
    "hour_of_day",
    traffic.hour_of_day,
    f"""select cast(hour(date) as int) as hour, {D} as "DENY", {P} as "PERMIT" from flows
      where date is not null group by 1""",
)
over_flows(
    "activity_heatmap",
    traffic.activity_heatmap,
    "select cast(isodow(date) - 1 as int) as weekday, any_value(dayname(date)) as day_name, "
    + ", ".join(f"count(*) filter (where hour(date) = {h}) as h{h:02d}" for h in range(24))
    + " from flows where date is not null group by 1",
)
over_flows(
    "spike_day_hours",
    lambda df: traffic.spike_day_hours(df, DAY),
    f"""select cast(h.hour as int) as hour, coalesce(d, 0) as "DENY", coalesce(p, 0) as "PERMIT"
      from range(24) h(hour) left join (select hour(date) as hour, {D} as d, {P} as p from flows
      where cast(date as date) = date '{DAY}' group by 1) c on h.hour = c.hour""",
)
over_flows(
    "spike_day_totals",
    lambda df: traffic.spike_day_totals(df, DAY),
    f"select action, count(*) as count from flows where cast(date as date) = date '{DAY}' group by action",
)
for _column in ("ipsrc", "portdst"):
    over_flows(
        f"spike_day_top_{_column}",
        lambda df, column=_column: traffic.spike_day_top(df, DAY, column),
        f"""select {_column}, count(*) as denies from flows where cast(date as date) = date '{DAY}'
          and action = 'DENY' and {_column} is not null group by {_column}
          order by denies desc, {_column} limit 10""",
    )
over_flows(
    "busiest_deny_days",
    traffic.busiest_deny_days,
    f"""select cast(date as date) as day, count(*) as total, {D} as denies, {P} as permits
      from flows where date is not null group by 1 order by denies desc, day limit 10""",
)

# --- rules -----------------------------------------------------------------------------

over_flows(
    "rule_usage",
    rules.rule_usage,
    """select regle, count(*) as occurrences,
      round_even(count(*) / (select count(*) from flows) * 100, 2) as pct from flows group by regle""",
)
over_flows(
    "top_rules",
    rules.top_rules,
    f"""select regle, count(*) as total, {P} as permits, {D} as denies,
      case when {P} > {D} then 'PERMIT' else 'DENY' end as dominant_action
      from flows group by regle order by total desc, regle limit 10""",
)
for _protocol, _n in (("UDP", 10), ("TCP", 5)):
    over_flows(
        f"top_rules_{_protocol.lower()}",
        lambda df, protocol=_protocol, n=_n: rules.top_rules_by_protocol(df, protocol, n),
        f"""select regle, count(*) as count from flows where proto = '{_protocol}'
          group by regle order by count desc, regle limit {_n}""",
    )
over_flows(
    "rule_port_action",
    rules.rule_port_action,
    f"""select regle, portdst, {D} as "DENY", {P} as "PERMIT", {D} + {P} as "Total" from flows
      where proto = 'TCP' and portdst is not null group by regle, portdst
      order by "Total" desc, regle, portdst limit 30""",
)
over_flows(
    "rule_port_matrix",
    rules.rule_port_matrix,
    """select regle, portdst, count(*) as count from flows
      where regle in (select regle from flows group by regle order by count(*) desc, regle limit 10)
        and portdst in (select portdst from flows where portdst is not null group by portdst
                        order by count(*) desc, portdst limit 10)
      group by regle, portdst""",
)

# --- addresses -------------------------------------------------------------------------

IP_STATS_SQL = f"""select ipsrc, count(*) as total_flows, {P} as permits, {D} as denies,
  count(distinct ipdst) as unique_dst_ips, count(distinct portdst) as unique_dst_ports,
  count(distinct regle) as unique_rules, round_even({P} / count(*) * 100, 1) as permit_ratio,
  round_even({D} / count(*) * 100, 1) as deny_ratio from flows where ipsrc is not null group by ipsrc"""

over_flows("ip_stats", addresses.ip_stats, IP_STATS_SQL)
over_flows(
    "top_sources",
    addresses.top_sources,
    f"""select ipsrc, total_flows, permits, denies, unique_dst_ports from ({IP_STATS_SQL})
      order by total_flows desc, ipsrc limit 5""",
)
for _sort in ("total_flows", "denies", "unique_ports"):
    over_flows(
        f"top_external_sources_by_{_sort}",
        lambda df, sort_by=_sort: addresses.top_external_sources(df, sort_by),
        f"""select ipsrc, total_flows, permits, denies, unique_dst_ips, unique_dst_ports as unique_ports
          from ({IP_STATS_SQL}) where not starts_with(ipsrc, '159.84.')
          order by {_sort} desc, ipsrc limit 20""",
    )
over_flows(
    "port_scanners",
    lambda df: rounded(addresses.port_scanners(df)),
    f"""select ipsrc, total_flows, unique_dst_ports, denies,
      round(unique_dst_ports / total_flows, 6) as scan_score
      from (select * from ({IP_STATS_SQL}) order by total_flows desc, ipsrc limit 100)
      order by unique_dst_ports / total_flows desc, ipsrc limit 10""",
)
over_flows(
    "ip_list_position",
    lambda df: addresses.ip_list_position(addresses.ip_stats(df), 7, "denies").select(
        "ipsrc", "denies", "position"
    ),
    f"""select ipsrc, denies, cast(7 as int) as position from ({IP_STATS_SQL})
      order by denies desc, ipsrc limit 1 offset 7""",
)
for _name, _build, _column, _n in (
    ("ip_destinations", addresses.ip_destinations, "ipdst", 20),
    ("ip_ports", addresses.ip_ports, "portdst", 20),
):
    over_flows(
        _name,
        lambda df, build=_build: build(df, IP),
        f"""select {_column}, count(*) as count, {P} as permits, {D} as denies from flows
          where ipsrc = '{IP}' and {_column} is not null group by {_column}
          order by count desc, {_column} limit {_n}""",
    )
over_flows(
    "ip_top_ports",
    lambda df: addresses.ip_top_ports(df, IP),
    f"""select portdst, count(*) as count from flows where ipsrc = '{IP}' and portdst is not null
      group by portdst order by count desc, portdst limit 10""",
)
over_flows(
    "ip_rules",
    lambda df: rules.ip_rules(filters.flows_of_ip(df, IP)),
    f"""select regle, sum(n)::bigint as count, first(action order by n desc, action) as action from (
        select regle, action, count(*) as n from flows where ipsrc = '{IP}' group by regle, action)
      group by regle order by count desc, regle limit 10""",
)
over_flows(
    "ip_timeline",
    lambda df: addresses.ip_timeline(df, IP),
    f"""select date_trunc('hour', date) as hour, action, count(*) as count from flows
      where ipsrc = '{IP}' and date is not null group by 1, 2""",
)
over_flows(
    "profile_scale",
    lambda df: rounded(addresses.profile_scale(addresses.ip_stats(df))),
    "select ipsrc, "
    + ", ".join(
        f"round({m} / max({m}) over () * 100, 6) as {m}" for m in addresses.PROFILE_METRICS
    )
    + f" from ({IP_STATS_SQL})",
)

# --- descriptive statistics ------------------------------------------------------------

DESCRIBED = ["portsrc", "portdst", "regle"]


def _describe_sql(columns, source):
    return " union all ".join(
        f"""select '{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean,
          round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as min,
          round(quantile_cont({c}::double, 0.25), 6) as p25, round(quantile_cont({c}::double, 0.5), 6) as p50,
          round(quantile_cont({c}::double, 0.75), 6) as p75, cast(max({c}) as double) as max from {source}"""
        for c in columns
    )


over_flows("describe", lambda df: rounded(tables.describe(df, DESCRIBED)), _describe_sql(DESCRIBED, "flows"))
over_flows(
    "describe_values",
    lambda df: tables.describe_values(df, ["proto", "action", "ipsrc"]),
    " union all ".join(
        f"""select '{c}' as column_name, count({c}) as count, count(distinct {c}) as unique,
          (select {c} from flows where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as top,
          (select count(*) from flows where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as freq
          from flows"""
        for c in ("proto", "action", "ipsrc")
    ),
)
TYPES = {
    "event_id": "bigint", "date": "timestamp_ntz", "ipsrc": "string", "ipdst": "string",
    "portsrc": "int", "portdst": "int", "proto": "string", "action": "string", "regle": "int",
    "interface_in": "string",
}
over_flows(
    "table_summary",
    quality.table_summary,
    " union all ".join(
        f"""select cast({i} as int) as position, '{c}' as column_name, '{t}' as type,
          count(*) as n_rows, count(*) - count({c}) as null_count from flows"""
        for i, (c, t) in enumerate(TYPES.items())
    ),
)

MEDIANS = ["total_flows", "deny", "access_rate", "avg_dst_port"]
over_flows(
    "feature_medians",
    lambda df: rounded(tables.feature_medians(full_table(df), MEDIANS)),
    " union all ".join(
        f"select '{c}' as feature, round(quantile_cont({c}::double, 0.5), 6) as median from features"
        for c in MEDIANS
    ),
    FEATURES_CTE,
)
over_flows(
    "feature_histogram",
    lambda df: rounded(
        tables.feature_histogram(
            full_table(df).withColumn("risk", F.when(F.col("deny_ratio") > 0.42, "positive").otherwise("negative")),
            "total_flows",
            by="risk",
        )
    ),
    """, h as (select case when deny_ratio > 0.42 then 'positive' else 'negative' end as risk,
        total_flows::double as v, min(total_flows) over ()::double as lo, max(total_flows) over ()::double as hi
        from features),
      b as (select risk, lo, hi, cast(least(49, floor((v - lo) / ((hi - lo) / 50))) as int) as bin from h)
      select risk, bin, round(lo + (hi - lo) / 50 * bin, 6) as bin_start, count(*) as count
      from b group by risk, bin, lo, hi""",
    FEATURES_CTE,
)
over_flows(
    "feature_box",
    lambda df: rounded(tables.feature_box(full_table(df), MEDIANS)),
    " union all ".join(
        f"""select '{c}' as feature,
          round(min({c}::double) filter (where {c} >= q1 - 1.5 * (q3 - q1)), 6) as whisker_low,
          round(any_value(q1), 6) as q1, round(any_value(q2), 6) as median, round(any_value(q3), 6) as q3,
          round(max({c}::double) filter (where {c} <= q3 + 1.5 * (q3 - q1)), 6) as whisker_high
          from features, (select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.5) as q2,
                          quantile_cont({c}::double, 0.75) as q3 from features)"""
        for c in MEDIANS
    ),
    FEATURES_CTE,
)


def _clustered(df):
    """Feature table with a cluster number derived from the port counts."""
    return full_table(df).withColumn("cluster", (F.col("unique_dst_ports") % 4).cast("int"))


CLUSTERED = f"{FEATURES_CTE}, clustered as (select *, cast(unique_dst_ports % 4 as int) as cluster from features)"
over_flows(
    "cluster_sizes",
    lambda df: tables.cluster_sizes(_clustered(df)),
    "select cluster, count(*) as count from clustered group by cluster",
    CLUSTERED,
)
over_flows(
    "cluster_stats",
    lambda df: rounded(tables.cluster_stats(_clustered(df), ["total_flows", "deny_ratio"])),
    """select cluster, round(avg(total_flows), 6) as total_flows_mean,
      round(stddev_samp(total_flows), 6) as total_flows_std, round(avg(deny_ratio), 6) as deny_ratio_mean,
      round(stddev_samp(deny_ratio), 6) as deny_ratio_std from clustered group by cluster""",
    CLUSTERED,
)


def _scored(df):
    """Feature table with results derived from the deny share."""
    return full_table(df).select(
        "ipsrc",
        *FEATURE_COLUMNS_11,
        F.col("deny_ratio").alias("anomaly_score"),
        (F.col("deny_ratio") > 0.45).alias("is_anomaly"),
        F.col("deny_ratio").alias("probability"),
        F.when(F.col("deny_ratio") > 0.42, "positive").otherwise("negative").alias("prediction"),
    )


over_flows(
    "anomaly_summary",
    lambda df: tables.anomaly_summary(_scored(df)),
    """select count(*) as total, count(*) filter (where deny_ratio > 0.45) as anomalies,
      count(*) filter (where not deny_ratio > 0.45) as normal,
      round_even(count(*) filter (where deny_ratio > 0.45) / count(*) * 100, 2) as anomaly_rate from features""",
    FEATURES_CTE,
)
over_flows(
    "prediction_summary",
    lambda df: tables.prediction_summary(_scored(df)),
    """select count(*) filter (where deny_ratio > 0.42) as positives, count(*) as total,
      round_even(count(*) filter (where deny_ratio > 0.42) / count(*) * 100, 2) as positive_rate from features""",
    FEATURES_CTE,
)
over_flows(
    "feature_totals",
    lambda df: tables.feature_totals(_scored(df)),
    """select count(*) as n_ips, cast(11 as bigint) as n_features, sum(total_flows)::bigint as total_flows,
      sum(deny)::bigint as total_denies, count(*) filter (where deny_ratio > 0.42) as threats from features""",
    FEATURES_CTE,
)
for _name, _build, _column in (
    ("top_anomalies", tables.top_anomalies, "anomaly_score"),
    ("top_predictions", tables.top_predictions, "probability"),
):
    over_flows(
        _name,
        lambda df, build=_build, column=_column: rounded(build(_scored(df), 20).select("ipsrc", column)),
        f"select ipsrc, round(deny_ratio, 6) as {_column} from features order by deny_ratio desc, ipsrc limit 20",
        FEATURES_CTE,
    )

# --- checks ----------------------------------------------------------------------------


def _validate_flows(df):
    export = df.withColumnsRenamed({"ipsrc": "src_ip", "ipdst": "dst_ip", "date": "timestamp"})
    return rounded(quality.validate_flows(export, "firewall_export"))


over_flows(
    "validate_flows",
    _validate_flows,
    """select 'missing_columns' as check_name, 0.0::double as value, 0.0::double as "limit", true as ok
      union all select 'null_time_percent', round(count(*) filter (where date is null) * 100.0::double / count(*), 6),
        5.0::double, count(*) filter (where date is null) * 100.0::double / count(*) <= 5 from flows
      union all select 'unexpected_actions', (count(*) filter (where action not in ('DENY', 'PERMIT')))::double,
        0.0::double, count(*) filter (where action not in ('DENY', 'PERMIT')) = 0 from flows
      union all select 'null_source_ips', (count(*) filter (where ipsrc is null))::double, 0.0::double,
        count(*) filter (where ipsrc is null) = 0 from flows""",
)
over_flows(
    "validate_features",
    lambda df: quality.validate_features(
        full_table(df).select("ipsrc", "total_flows", "port_min"), ["total_flows", "risk"]
    ),
    """select 'rows' as check_name, '' as detail, count(*) as value, count(*) > 0 as ok from features
      union all select 'missing_column', 'risk', cast(1 as bigint), false
      union all select 'nulls', 'ipsrc', count(*) filter (where ipsrc is null), count(*) filter (where ipsrc is null) = 0 from features
      union all select 'nulls', 'total_flows', count(*) filter (where total_flows is null), count(*) filter (where total_flows is null) = 0 from features
      union all select 'nulls', 'port_min', count(*) filter (where port_min is null), count(*) filter (where port_min is null) = 0 from features""",
    FEATURES_CTE,
)
over_flows(
    "export_page",
    lambda df: tables.browse_page(df, "date", "event_id", page=2, rows_per_page=25).select(
        "event_id", "date", "action"
    ),
    "select event_id, date, action from flows order by date nulls last, event_id limit 25 offset 25",
)
