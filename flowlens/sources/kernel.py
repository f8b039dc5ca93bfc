"""Kernel netfilter log lines.

A line is taken apart with one pattern, one pair extraction and plain string functions;
no Python runs per line. Lines that do not match are skipped.
"""

from datetime import datetime
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions import key_value, pair_text, tcp_flags
from flowlens.schemas import FLOW_KERNEL
from flowlens.session import materialize
from flowlens.sources.lines import read_lines, stripped

# Header pattern of a kernel log line and month names.
HEADER = (
    r"^(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+kernel:\s+\[[\d.]+\]"
    r"\s+(DENY|PERMIT|ACCEPT|DROP|REJECT)\s+((?s:.+))$"
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Text keys ('' when absent) and integer keys (null when absent).
TEXT_KEYS = {"interface_in": "IN", "interface_out": "OUT", "src_ip": "SRC", "dst_ip": "DST", "proto": "PROTO"}
NUMBER_KEYS = {
    "fw": "FW",
    "rule": "RULE",
    "len": "LEN",
    "ttl": "TTL",
    "id": "ID",
    "src_port": "SPT",
    "dst_port": "DPT",
    "window": "WINDOW",
}

# Year changes and split summaries are broadcast up to this many entries.
BROADCAST_ENTRIES = 1_000_000

_MARK = "\u0001"


def month_number(name: Column) -> Column:
    numbers = chain.from_iterable((F.lit(m), F.lit(i)) for i, m in enumerate(MONTHS, 1))
    return F.try_element_at(F.create_map(*numbers), name)


def log_time(year: Column, month: Column, day: Column, clock) -> Column:
    """Zone-free time from its parts (``clock`` = hour, minute, second), null for no real date."""
    hour, minute, second = (part.try_cast("int") for part in clock)
    made = F.try_make_timestamp_ntz(
        year, month, day.try_cast("int"), hour, minute, second.cast("decimal(8,6)")
    )
    return F.when(second < 60, made)


def _headers(lines: DataFrame) -> DataFrame:
    """Matched lines split into month, day, clock, hostname, action and the rest."""
    marked = F.regexp_replace(
        stripped(F.replace(F.col("value"), F.lit(_MARK), F.lit(""))), HEADER, _MARK + _MARK.join(f"${i}" for i in range(1, 7))
    )
    extra = [c for c in lines.columns if c != "value"]
    # Exploding a one-element array keeps the filter behind the pattern: evaluated once.
    parts = lines.select(*extra, F.explode(F.array(F.split(marked, _MARK, 7))).alias("p")).filter(
        (F.size("p") == 7) & (F.col("p")[0] == "")
    )
    names = ("month", "day", "clock", "hostname", "action", "rest")
    parts = parts.select(*extra, *[F.col("p")[i].alias(n) for i, n in enumerate(names, 1)])
    return parts.withColumn("month", month_number(F.col("month")))


def _fields(rows: DataFrame) -> DataFrame:
    """Schema columns from matched lines that carry a ``_year``."""
    pairs = rows.withColumns({"_pairs": pair_text(F.col("rest"))})
    values = {
        "timestamp": log_time(
            F.col("_year"), F.col("month"), F.col("day"), [F.substring("clock", i, 2) for i in (1, 4, 7)]
        ),
        "hostname": F.col("hostname"),
        "action": F.col("action"),
        "df": F.array_contains(F.split(F.upper("rest"), r"\s+"), "DF"),
        "flags": tcp_flags(F.col("rest")),
    }
    for name, key in TEXT_KEYS.items():
        values[name] = F.coalesce(key_value(F.col("_pairs"), key), F.lit(""))
    for name, key in NUMBER_KEYS.items():
        values[name] = key_value(F.col("_pairs"), key).try_cast("bigint")
    return pairs.select(*[values[f.name].alias(f.name) for f in FLOW_KERNEL])


def parse_kernel_lines(lines: DataFrame, year: int) -> DataFrame:
    """Fields of the matching lines in column ``value``, all in one year.

    A plain projection and filter, so ``lines`` may also be a streaming frame.
    """
    return _fields(_headers(lines).withColumn("_year", F.lit(year)))


def _file_order(one_log) -> Column:
    """Position of a file in time: its place in a given list of names, else its name with numbers read as numbers."""
    name = F.element_at(F.split("_file", "/"), -1)
    if one_log is not True:
        place = F.array_position(F.array(*[F.lit(n) for n in one_log]), name)
        return F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("file missing in the order of one_log: "), name)))
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x))


def year_changes(headers: DataFrame, one_log=False) -> DataFrame:
    """Per split: years gained before it and the line numbers where a year starts in it.

    Only (file, split, line number, month) is shuffled. One row per split with its first and last month
    and its number of changes is then ordered, per file or, for a log rotated over several files, overall;
    the line numbers themselves are joined on afterwards.
    """
    split = W.partitionBy("_file", "_block").orderBy("_id")
    steps = (
        headers.filter(F.col("month").isNotNull())
        .select("_file", "_block", "_id", "month")
        .withColumn("_fell", F.col("month") < F.lag("month").over(split))
    )
    splits = materialize(
        steps.groupBy("_file", "_block").agg(
            F.min_by("month", "_id").alias("first"),
            F.max_by("month", "_id").alias("last"),
            F.sort_array(F.collect_list(F.when(F.col("_fell"), F.col("_id")))).alias("changes"),
        ),
        "log-splits",
    )
    ends = splits.select("_file", "_block", "first", "last", F.size("changes").alias("n"))
    order = W.orderBy(_file_order(one_log), "_block") if one_log else W.partitionBy("_file").orderBy("_block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    at_start = F.coalesce((F.col("first") < F.lag("last").over(order)).cast("int"), F.lit(0))
    gained = ends.withColumn("_at_start", at_start).withColumn(
        "gained", F.coalesce(F.sum(F.col("n") + F.col("_at_start")).over(earlier), F.lit(0)) + F.col("_at_start")
    )
    places = gained.select("_file", "_block", F.col("gained").cast("int").alias("gained"))
    return places.join(splits.select("_file", "_block", "changes"), ["_file", "_block"])


def infer_log_year(headers: DataFrame, year: int, one_log=False) -> DataFrame:
    """Adds ``_year``: the start year plus one at every fall of the month number.

    Counting restarts per file unless the files are parts of ``one_log``: True takes them by name, with
    numbers in names read as numbers; a list of file names gives their order (``["kern.log.1", "kern.log"]``
    for a rotated log). The table of changes is written once, measured, and broadcast only while it is
    small; the wide lines are not shuffled then. A line whose split was cut otherwise the first time is an error.
    """
    changes = materialize(year_changes(headers, one_log), "log-years")
    entries = changes.agg(F.sum(F.size("changes") + 1)).first()[0] or 0
    small = F.broadcast(changes) if entries <= BROADCAST_ENTRIES else changes
    within = F.size(F.filter("changes", lambda line: line <= F.col("_id")))
    joined = headers.join(small, ["_file", "_block"], "left")
    unknown = F.col("gained").isNull() & F.col("month").isNotNull()
    gained = F.when(unknown, F.raise_error(F.lit("the log was split differently on a second reading"))).otherwise(
        F.coalesce(F.col("gained") + within, F.lit(0))
    )
    return joined.withColumn("_year", F.lit(year) + gained)


def scan_kernel_log(
    spark: SparkSession,
    path,
    year: int | None = None,
    encoding: str = "utf-8",
    infer_year: bool = True,
    one_log=False,
) -> DataFrame:
    """Kernel log files in the 18-column schema.

    ``year`` is the year of the first line (default: the current one); with ``infer_year``
    it advances whenever the month falls.
    """
    year = year or datetime.now().year
    if not infer_year:
        return parse_kernel_lines(read_lines(spark, path, encoding), year)
    headers = _headers(read_lines(spark, path, encoding, positions=True))
    return _fields(infer_log_year(headers, year, one_log))


def skipped_lines(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """One row: non-blank lines, those that match, and those skipped."""
    line = stripped(F.col("value"))
    matched = F.count_if(line.rlike(HEADER))
    lines = read_lines(spark, path, encoding).filter(line != "")
    return lines.agg(
        F.count("*").alias("n_lines"), matched.alias("matched"), (F.count("*") - matched).alias("skipped")
    )
