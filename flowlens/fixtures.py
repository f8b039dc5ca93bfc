"""Flow tables derived from the supplied sample tables.

The sample data holds no firewall log, so the flow view is defined by integer
arithmetic over ``events`` (dirty values included) or ``lineitem`` (larger, clean).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import floor_time
from flowlens.operators.columns import normalize_log_columns

# Destination ports of the flow view, range boundaries included.
PORTS = (443, 80, 22, 23, 445, 3389, 3306, 21, 53, 25, 110, 143, 1024, 1433,
         5432, 8080, 8728, 49151, 49152, 60000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _port(index):
    return F.element_at(F.array(*[F.lit(p) for p in PORTS]), index.cast("int"))


def flows_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows over ``events``: null dates, addresses and ports, mixed-case actions."""
    event, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    host = F.least(user, event % 150)
    return table(spark, sf_dir, "events").select(
        event,
        F.when(event % 97 != 0, floor_time(F.col("ts"), "second")).alias("date"),
        F.when(
            event % 211 != 0,
            F.concat(
                F.when(host % 4 == 0, "159.84.0.").otherwise("94.102.61."), host.cast("string")
            ),
        ).alias("ipsrc"),
        F.concat(F.lit("159.84.146."), (event % 13).cast("string")).alias("ipdst"),
        (1024 + event % 60000).cast("int").alias("portsrc"),
        F.when(k % 10 != 9, _port(k % (1 + user % 20) + 1)).alias("portdst"),
        F.when(k % 10 == 9, "ICMP").when(k % 3 == 0, "UDP").otherwise("TCP").alias("proto"),
        F.when(F.col("event_type") == "error", "DROP")
        .when(F.col("event_type") == "signup", "deny")
        .when(F.col("event_type") == "click", " Accept ")
        .otherwise("PERMIT")
        .alias("action"),
        F.when(F.col("event_type").isin("error", "signup"), 999 - event % 3)
        .otherwise(1 + event % 11)
        .cast("int")
        .alias("regle"),
        F.concat(F.lit("eth"), (event % 2).cast("string")).alias("interface_in"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`flows_raw` with canonical actions."""
    return normalize_log_columns(flows_raw(spark, sf_dir))


def flows_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows over ``lineitem``."""
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    hours = F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate") + hours).alias("date"),
        F.concat(
            F.when(supp % 4 == 0, "159.84.").otherwise("94.102."),
            F.floor(supp / 256).cast("bigint").cast("string"),
            F.lit("."),
            (supp % 256).cast("string"),
        ).alias("ipsrc"),
        F.concat(F.lit("159.84.146."), (part % 13).cast("string")).alias("ipdst"),
        _port(part % (1 + supp % 20) + 1).alias("portdst"),
        F.when(F.col("l_linenumber") % 3 == 0, "UDP").otherwise("TCP").alias("proto"),
        F.when(F.col("l_returnflag") == "R", "DENY").otherwise("PERMIT").alias("action"),
        (1 + part % 50).cast("int").alias("regle"),
    )


# --- rendered logs ---------------------------------------------------------------------


def _text(column, missing=""):
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def kernel_lines(flows: DataFrame) -> DataFrame:
    """Flows as kernel log lines; a null date becomes January 32, ICMP repeats its ID.

    Every 50th event is followed by a line of another program.
    """
    event = F.col("event_id")
    head = F.concat(
        F.coalesce(F.date_format("date", "MMM d HH:mm:ss"), F.lit("Jan 32 00:00:00")),
        F.lit(" fw1 kernel: [123.456] "),
        F.upper(F.trim("action")),
        F.lit(" FW="), (event % 7).cast("string"),
        F.lit(" RULE="), _text("regle"),
        F.lit(" IN="), _text("interface_in"),
        F.lit(" OUT= MAC=aa:bb SRC="), _text("ipsrc"),
        F.lit(" DST="), _text("ipdst"),
        F.lit(" LEN="), (40 + event % 1400).cast("string"),
        F.lit(" TOS=0x00 TTL="), (event % 256).cast("string"),
        F.lit(" ID="), event.cast("string"),
        F.when(event % 3 == 0, " DF").otherwise(""),
        F.lit(" PROTO="), F.col("proto"),
    )
    tail = F.when(
        F.col("proto") == "TCP",
        F.concat(
            F.lit(" SPT="), _text("portsrc"), F.lit(" DPT="), _text("portdst"),
            F.lit(" WINDOW=1024 RES=0x00 "), F.when(event % 2 == 0, "SYN").otherwise("ACK PSH"), F.lit(" URGP=0"),
        ),
    ).when(
        F.col("proto") == "UDP",
        F.concat(F.lit(" SPT="), _text("portsrc"), F.lit(" DPT="), _text("portdst")),
    ).otherwise(F.concat(F.lit(" TYPE=8 ID="), (event + 1).cast("string")))
    other = F.when(event % 50 == 0, F.concat(F.lit("Jan 1 00:00:00 fw1 sshd[7]: login "), event.cast("string")))
    lines = F.array_compact(F.array(F.concat(head, tail), other))
    return flows.select(F.explode(lines).alias("value"))


def yearless_lines(orders: DataFrame) -> DataFrame:
    """Orders in date order as kernel log lines, which carry no year."""
    return orders.orderBy("o_orderdate", "o_orderkey").select(
        F.concat(
            F.date_format("o_orderdate", "MMM d HH:mm:ss"),
            F.lit(" fw1 kernel: [1.5] PERMIT IN=eth0 OUT= SRC=10.0.0.1 DST=10.0.0.2 ID="),
            F.col("o_orderkey").cast("string"),
            F.lit(" PROTO=TCP"),
        ).alias("value")
    )


def export_lines(flows: DataFrame) -> DataFrame:
    """Semicolon export lines in both date styles; some have one field too many or too few."""
    event = F.col("event_id")
    date = F.when(event % 2 == 0, F.date_format("date", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("date", "M-d-yyyy H:mm:ss")
    )
    fields = [
        F.coalesce(date, F.lit("")), _text("ipsrc"), _text("ipdst"), F.concat(F.lit(" "), F.col("proto")),
        _text("portsrc"), F.when(event % 17 == 0, "x").otherwise(_text("portdst")), _text("regle"),
        F.col("action"), _text("interface_in"),
    ]
    full = F.concat_ws(";", *fields, F.lit(""), F.lit("6"))
    line = F.when(event % 41 == 0, F.concat_ws(";", full, F.lit("extra"))).when(
        event % 43 == 0, F.concat_ws(";", *fields)
    )
    return flows.select(line.otherwise(full).alias("value"))


def legacy_lines(flows: DataFrame, separator: str = ",") -> DataFrame:
    fields = [
        _text("ipsrc"), _text("ipdst"), _text("portdst"), F.col("proto"), F.col("action"),
        F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("bad")), _text("regle"),
    ]
    return flows.select(F.concat_ws(separator, *fields).alias("value"))


def noted_lines(flows: DataFrame) -> DataFrame:
    """Records with a quoted note that holds separators, doubled quotes and line breaks, and some with one field too many."""
    event = F.col("event_id")
    note = F.concat(F.lit('"rule '), _text("regle"), F.lit(',\nsaid ""'), F.trim("action"), F.lit('""'), F.when(event % 3 == 0, '\n\nend"').otherwise('"'))
    plain = F.concat(F.lit("no "), F.lit('5" note'))
    fields = [event.cast("string"), F.when(event % 2 == 0, note).otherwise(plain), _text("portdst")]
    line = F.when(event % 41 == 0, F.concat_ws(",", *fields, F.lit("extra"))).otherwise(F.concat_ws(",", *fields))
    return flows.select(line.alias("value"))


def kibana_rows(flows: DataFrame) -> DataFrame:
    """Flows under the column names and spellings of the search-stack export."""
    mark = F.lit("(empty)")
    return flows.select(
        F.coalesce(F.date_format("date", "MMM d, yyyy @ HH:mm:ss.SSS"), mark).alias("@timestamp"),
        F.col("event_id").alias("_id"),
        F.lit("-").alias("_ignored"),
        F.lit("logs").alias("_index"),
        F.lit("1").alias("_score"),
        F.col("action"),
        F.col("action").alias("action.keyword"),
        F.lit("x").alias("datetime"),
        F.coalesce(F.col("portdst").cast("string"), mark).alias("dstport"),
        F.col("interface_in").alias("interface"),
        mark.alias("interface_out"),
        F.col("ipdst"),
        F.coalesce("ipsrc", mark).alias("ipsrc"),
        F.col("regle").alias("policyid"),
        F.col("proto"),
        F.col("portsrc").alias("srcport"),
        F.col("event_id").alias("offset"),
    )


def syslog_lines(flows: DataFrame) -> DataFrame:
    """Flows as syslog lines; every 20th is free text."""
    event = F.col("event_id")
    line = F.concat(
        F.coalesce(F.date_format("date", "MMM d HH:mm:ss"), F.lit("Foo 1 00:00:00")),
        F.lit(" host"), (event % 3).cast("string"), F.lit(" sshd["), event.cast("string"),
        F.lit("]: action "), F.trim("action"),
    )
    free = F.concat(F.lit("-- mark "), event.cast("string"))
    return flows.select(F.when(event % 20 == 0, free).otherwise(line).alias("value"))
