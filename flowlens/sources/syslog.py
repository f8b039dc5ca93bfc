"""Syslog lines: ``time host process: message``."""

from datetime import datetime
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.kernel import log_time
from flowlens.sources.lines import read_lines, stripped

# Default line pattern and month words.
PATTERN = r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+):\s+(.*)$"
MONTH_WORDS = (
    ("jan", "january"),
    ("feb", "february"),
    ("mar", "march"),
    ("apr", "april"),
    ("may",),
    ("jun", "june"),
    ("jul", "july"),
    ("aug", "august"),
    ("sep", "sept", "september"),
    ("oct", "october"),
    ("nov", "november"),
    ("dec", "december"),
)


def parse_syslog_lines(
    lines: DataFrame, year: int, pattern: str = PATTERN, with_pid: bool = False
) -> DataFrame:
    """Fields of each line; a line that does not match keeps only its text as message."""
    text = lines.select(stripped(F.col("value")).alias("_line"))
    matched = F.col("_line").rlike(pattern)

    def group(number):
        return F.when(matched, F.regexp_extract("_line", pattern, number))

    words = chain.from_iterable(
        (F.lit(w), F.lit(number)) for number, names in enumerate(MONTH_WORDS, 1) for w in names
    )
    rows = text.select(
        "_line",
        F.split(group(1), r"\s+").alias("_time"),
        group(2).alias("hostname"),
        group(3).alias("process"),
        F.coalesce(group(4), F.col("_line")).alias("message"),
    )
    month = F.try_element_at(F.create_map(*words), F.lower(F.col("_time")[0]))
    clock = F.split(F.col("_time")[2], ":")
    rows = rows.select(
        log_time(F.lit(year), month, F.col("_time")[1], [clock[i] for i in range(3)]).alias("timestamp"),
        "hostname",
        "process",
        "message",
    )
    if with_pid:
        pid = F.regexp_extract("process", r"\[(\d+)\]$", 1).try_cast("bigint")
        rows = rows.withColumn("pid", pid)
    return rows


def scan_syslog(
    spark: SparkSession,
    path,
    year: int | None = None,
    pattern: str = PATTERN,
    encoding: str = "utf-8",
    with_pid: bool = False,
) -> DataFrame:
    """Syslog files; lines carry no year, so the given (default: current) one is used."""
    year = year or datetime.now().year
    return parse_syslog_lines(read_lines(spark, path, encoding), year, pattern, with_pid)
