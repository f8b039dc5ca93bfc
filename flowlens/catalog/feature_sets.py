"""Feature tables and their preparation."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.catalog.base import (
    FEATURE_COLUMNS_11,
    FEATURE_COLUMNS_RATIO,
    FEATURE_COLUMNS_STAT,
    FEATURE_COLUMNS_TIME,
    FEATURES,
    Query,
    rounded,
    sql_columns,
)
from flowlens.fixtures import flows, flows_large
from flowlens.operators import features as fs
from flowlens.operators import preparation as prep

QUERIES: dict[str, Query] = {}
ALL_FEATURES = (
    FEATURE_COLUMNS_11 + FEATURE_COLUMNS_TIME + FEATURE_COLUMNS_RATIO + FEATURE_COLUMNS_STAT
)


def over_flows(name, build, sql=None):
    QUERIES[name] = Query(lambda spark, sf: build(flows(spark, sf)), sql and f"{FEATURES} {sql}")


over_flows("ip_features", fs.ip_features, f"select ipsrc, {', '.join(FEATURE_COLUMNS_11)} from base")
over_flows(
    "time_features",
    lambda df: rounded(fs.time_features(df)),
    f"select ipsrc, {sql_columns(FEATURE_COLUMNS_TIME)} from features",
)
over_flows(
    "port_stats",
    lambda df: rounded(fs.port_stats(df)),
    f"select ipsrc, {sql_columns(FEATURE_COLUMNS_STAT)} from ported",
)
over_flows(
    "ratio_features",
    lambda df: rounded(fs.ratio_features(fs.ip_features(df))),
    f"select ipsrc, {', '.join(FEATURE_COLUMNS_11)}, {sql_columns(FEATURE_COLUMNS_RATIO)} from features",
)


def long_form(table, names):
    """One row per address and feature, so that which features were dropped is data."""
    cells = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    long = table.select("ipsrc", F.explode(F.array(*cells)).alias("c")).select("ipsrc", "c.*")
    return rounded(long.filter(F.col("value").isNotNull()))


def long_sql(names, source):
    """The same, without the features whose variance is 0."""
    doubles = ", ".join(f"{n}::double as {n}" for n in names)
    return f"""select ipsrc, feature, round(value, 6) as value from (
      select *, var_samp(value) over (partition by feature) as spread from (
        unpivot (select ipsrc, {doubles} from {source}) on {', '.join(names)} into name feature value value))
      where spread is null or spread <> 0"""


def _set(extract):
    def build(df):
        found = extract(df)
        return long_form(found.data, found.feature_names)

    return build


over_flows("course_features", _set(fs.course_features), long_sql(FEATURE_COLUMNS_11, "base"))
over_flows("full_features", _set(fs.full_features), long_sql(ALL_FEATURES, "features"))
over_flows("simple_features", _set(fs.simple_features), long_sql(FEATURE_COLUMNS_11[:3], "base"))
QUERIES["ip_features_large"] = Query(
    lambda spark, sf: fs.ip_features(flows_large(spark, sf)),
    """with flows as (
      select concat(case when l_suppkey % 4 = 0 then '159.84.' else '94.102.' end,
          cast(cast(floor(l_suppkey / 256) as bigint) as varchar), '.', cast(l_suppkey % 256 as varchar)) as ipsrc,
        concat('159.84.146.', cast(l_partkey % 13 as varchar)) as ipdst,
        list_extract([443,80,22,23,445,3389,3306,21,53,25,110,143,1024,1433,5432,8080,8728,49151,49152,60000],
          cast(l_partkey % (1 + l_suppkey % 20) + 1 as int)) as port,
        l_returnflag = 'R' as d, l_returnflag <> 'R' as p
      from lineitem)
    select ipsrc, count(*) as total_flows, count(distinct ipdst) as unique_dst_ips,
      count(distinct port) as unique_dst_ports,
      count(*) filter (where p) as permit, count(*) filter (where p and port <= 1024) as permit_low_port,
      count(*) filter (where p and port > 1024) as permit_high_port,
      count(*) filter (where p and port in (21, 22, 3306, 3389)) as permit_admin,
      count(*) filter (where d) as deny, count(*) filter (where d and port <= 1024) as deny_low_port,
      count(*) filter (where d and port > 1024) as deny_high_port,
      count(*) filter (where d and port in (21, 22, 3306, 3389)) as deny_admin
    from flows group by ipsrc""",
)

# --- preparation -----------------------------------------------------------------------

SCALED = ["total_flows", "deny_ratio", "avg_dst_port"]


def _scaled(method):
    def build(df):
        table = fs.full_table(df).select("ipsrc", *SCALED)
        return rounded(prep.fit_scaler(table, SCALED, method).transform(table))

    return build


def _unscaled(df):
    table = fs.full_table(df).select("ipsrc", *SCALED)
    scaler = prep.fit_scaler(table, SCALED, "robust")
    return rounded(scaler.inverse_transform(scaler.transform(table)))


def scale_sql(shift, scale):
    shifts = ", ".join(f"{shift.format(c=c)} as s_{c}, {scale.format(c=c)} as k_{c}" for c in SCALED)
    values = ", ".join(
        f"round(({c} - s_{c}) / (case when k_{c} = 0 then 1 else k_{c} end), 6) as {c}" for c in SCALED
    )
    return f"select ipsrc, {values} from features, (select {shifts} from features) limits"


over_flows("scale_standard", _scaled("standard"), scale_sql("avg({c})", "stddev_pop({c})"))
over_flows("scale_minmax", _scaled("minmax"), scale_sql("min({c})", "max({c}) - min({c})"))
over_flows(
    "scale_robust",
    _scaled("robust"),
    scale_sql(
        "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"
    ),
)
over_flows(
    "scale_inverse",
    _unscaled,
    "select ipsrc, "
    + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in SCALED)
    + " from features",
)


def _assemble(df):
    table = prep.assemble(fs.ip_features(df))
    return table.select("ipsrc", F.explode(vector_to_array("features")).alias("value"))


over_flows(
    "assemble",
    _assemble,
    f"select ipsrc, cast(value as double) as value from (unpivot base on {', '.join(FEATURE_COLUMNS_11)} "
    "into name n value value)",
)


def _with_constant(df):
    return fs.ip_features(df).withColumn("always", F.lit(7)).withColumn(
        "same", F.col("deny") * 0
    )


def _drop_constant(df):
    kept = prep.drop_constant(_with_constant(df))
    return long_form(kept, kept.columns[1:])


over_flows("drop_constant", _drop_constant, long_sql(FEATURE_COLUMNS_11, "base"))

# Two features tied to total_flows by construction: the lower-variance one goes.
over_flows(
    "drop_correlated",
    lambda df: prep.drop_correlated(
        fs.ip_features(df).select(
            "ipsrc",
            "total_flows",
            (F.col("total_flows") * 3 + 1).alias("triple"),
            (F.col("total_flows") * 2).alias("double"),
            (F.crc32(F.col("ipsrc")) % 97).alias("noise"),
        )
    ).drop("noise"),
    "select ipsrc, total_flows * 3 + 1 as triple from base",
)

def labelled(df):
    """Feature table with the label used by the classifiers."""
    risk = F.when(F.col("deny_ratio") > 0.42, "positive").otherwise("negative")
    return fs.full_table(df).withColumn("risk", risk)


over_flows(
    "encode_label",
    lambda df: prep.decode_label(
        prep.encode_label(labelled(df).select("ipsrc", "risk"))[0], ["negative", "positive"]
    ),
    """select ipsrc, risk, cast(risk = 'positive' as int)::double as label, risk as decoded
      from (select ipsrc, case when deny_ratio > 0.42 then 'positive' else 'negative' end as risk from features)""",
)

CORRELATED = ["total_flows", "unique_dst_ports", "deny", "deny_ratio", "avg_dst_port"]
over_flows(
    "correlation_matrix",
    lambda df: rounded(prep.correlation_matrix(fs.full_table(df), CORRELATED)),
    " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, "
        + ("any_value(1.0::double)" if a == b else f"round(corr({a}, {b}), 6)")
        + " as correlation from features"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
