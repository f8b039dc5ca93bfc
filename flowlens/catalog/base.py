"""Shared pieces of the query catalogue."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    """A Spark job over the tables of a folder, and its DuckDB counterpart if there is one."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column, as the SQL side does."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


PORT_LIST = (
    "[443,80,22,23,445,3389,3306,21,53,25,110,143,1024,1433,5432,8080,8728,49151,49152,60000]"
)

RAW_SQL = f"""
flows_raw as (
  select event_id,
    case when event_id % 97 = 0 then null else date_trunc('second', ts) end as date,
    case when event_id % 211 = 0 then null
         when least(user_id, event_id % 150) % 4 = 0
           then concat('159.84.0.', cast(least(user_id, event_id % 150) as varchar))
         else concat('94.102.61.', cast(least(user_id, event_id % 150) as varchar)) end as ipsrc,
    concat('159.84.146.', cast(event_id % 13 as varchar)) as ipdst,
    cast(1024 + event_id % 60000 as int) as portsrc,
    case when k % 10 = 9 then null
         else list_extract({PORT_LIST}, cast(k % (1 + user_id % 20) + 1 as int)) end as portdst,
    case when k % 10 = 9 then 'ICMP' when k % 3 = 0 then 'UDP' else 'TCP' end as proto,
    case event_type when 'error' then 'DROP' when 'signup' then 'deny'
                    when 'click' then ' Accept ' else 'PERMIT' end as action,
    cast(case when event_type in ('error', 'signup') then 999 - (event_id % 3)
              else 1 + event_id % 11 end as int) as regle,
    concat('eth', cast(event_id % 2 as varchar)) as interface_in
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) t
)"""

FLOWS_CTE = f"""{RAW_SQL},
flows as (
  select * replace (
    case upper(trim(action)) when 'ACCEPT' then 'PERMIT' when 'DROP' then 'DENY'
         when 'REJECT' then 'DENY' else upper(trim(action)) end as action)
  from flows_raw
)"""

FLOWS = f"with {FLOWS_CTE}"

PORT_CATEGORY_SQL = """case when portdst between 0 and 1023 then 'Well-known (0-1023)'
  when portdst between 1024 and 49151 then 'Registered (1024-49151)'
  when portdst between 49152 and 65535 then 'Dynamic/Private (49152-65535)' else 'Unknown' end"""

FEATURES_CTE = f"""{FLOWS_CTE},
base as (
  select ipsrc, count(*) as total_flows, count(distinct ipdst) as unique_dst_ips,
    count(distinct portdst) as unique_dst_ports,
    count(*) filter (where p) as permit,
    count(*) filter (where p and port <= 1024) as permit_low_port,
    count(*) filter (where p and port > 1024) as permit_high_port,
    count(*) filter (where p and port in (21, 22, 3306, 3389)) as permit_admin,
    count(*) filter (where d) as deny,
    count(*) filter (where d and port <= 1024) as deny_low_port,
    count(*) filter (where d and port > 1024) as deny_high_port,
    count(*) filter (where d and port in (21, 22, 3306, 3389)) as deny_admin
  from (select *, action in ('PERMIT', 'ALLOW', 'ACCEPT') as p,
               action in ('DENY', 'DROP', 'REJECT', 'BLOCK') as d,
               coalesce(portdst, 0) as port from flows where ipsrc is not null)
  group by ipsrc
),
timed as (
  select ipsrc, (epoch_us(max(date)) - epoch_us(min(date))) / 1000000.0::double as time_span_seconds,
    count(*) as n, count(distinct hour(date)) as unique_hours,
    avg(case when hour(date) >= 22 or hour(date) < 6 then 1 else 0 end) as night_ratio,
    avg(case when isodow(date) >= 6 then 1 else 0 end) as weekend_ratio
  from flows where ipsrc is not null group by ipsrc
),
ported as (
  select ipsrc, avg(portdst) as avg_dst_port, coalesce(stddev_samp(portdst), 0) as port_std,
    cast(min(portdst) as double) as port_min, cast(max(portdst) as double) as port_max,
    cast(max(portdst) - min(portdst) as double) as port_range
  from flows where ipsrc is not null group by ipsrc
),
features as (
  select base.*, time_span_seconds, total_flows / (time_span_seconds + 1) as access_rate,
    unique_hours, night_ratio, weekend_ratio,
    deny / (permit + deny + 1e-10) as deny_ratio,
    unique_dst_ports / (total_flows + 1e-10) as port_diversity,
    (permit_admin + deny_admin) / (total_flows + 1e-10) as admin_ratio,
    (permit_low_port + deny_low_port) / (total_flows + 1e-10) as system_port_ratio,
    avg_dst_port, port_std, port_min, port_max, port_range
  from base join timed using (ipsrc) join ported using (ipsrc)
)"""

FEATURES = f"with {FEATURES_CTE}"
FEATURE_COLUMNS_11 = (
    "total_flows unique_dst_ips unique_dst_ports permit permit_low_port permit_high_port "
    "permit_admin deny deny_low_port deny_high_port deny_admin"
).split()
FEATURE_COLUMNS_TIME = (
    "time_span_seconds access_rate unique_hours night_ratio weekend_ratio".split()
)
FEATURE_COLUMNS_RATIO = "deny_ratio port_diversity admin_ratio system_port_ratio".split()
FEATURE_COLUMNS_STAT = "avg_dst_port port_std port_min port_max port_range".split()
DOUBLES = (
    set(FEATURE_COLUMNS_TIME + FEATURE_COLUMNS_RATIO + FEATURE_COLUMNS_STAT) - {"unique_hours"}
)


def sql_columns(names) -> str:
    """Select list that rounds the double features."""
    return ", ".join(f"round({n}, 6) as {n}" if n in DOUBLES else n for n in names)
