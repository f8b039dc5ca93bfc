"""Delimited logs.

Records are put together from text lines (see ``records``) and split with ``from_csv``. Records
with too many fields are left out and short ones padded with nulls; the CSV source itself cannot
tell the two apart once columns are pruned, and reads a file whole if records may hold line breaks.
"""

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.errors import ParsingError
from flowlens.functions import blank_to_null, capitalize, to_timestamp
from flowlens.operators.columns import align_schema
from flowlens.schemas import (
    EMPTY_MARK,
    FLOW_EXPORT,
    FLOW_KERNEL,
    FLOW_LEGACY,
    KIBANA_META,
    KIBANA_RENAMES,
    NULL_SPELLINGS,
    TARGET,
)
from flowlens.session import materialize
from flowlens.sources.lines import read_lines
from flowlens.sources.records import field_count, opens, whole_records

# Time patterns of the formats.
EXPORT_TIMES = ("yyyy-MM-dd HH:mm:ss", "M-d-yyyy H:mm:ss")
KIBANA_TIME = "MMM d, yyyy @ HH:mm:ss.SSS"

# Line numbers to skip are broadcast up to this many.
BROADCAST_SKIPS = 1_000_000
# A folder's files are united over at most this many different headers.
MOST_HEADERS = 100


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _skip_first(lines: DataFrame, rows: int) -> DataFrame:
    """Without the first ``rows`` lines of every file."""
    firsts = lines.filter(F.col("_block") == 0).groupBy("_file").agg(F.min("_id").alias("first"))
    skipped = firsts.select(F.explode(F.sequence("first", F.col("first") + (rows - 1))).alias("_id"))
    skipped = materialize(skipped, "skipped-lines")
    small = F.broadcast(skipped) if skipped.count() <= BROADCAST_SKIPS else skipped
    return lines.join(small, "_id", "left_anti")


def read_delimited(
    spark: SparkSession,
    path,
    names=None,
    separator: str = ",",
    encoding: str = "utf-8",
    skiprows: int = 0,
    header: bool | None = None,
    multiline: bool = True,
) -> DataFrame:
    """All fields as text.

    Without ``names`` every file's first record names its columns; files with other columns are
    united by name. With names, a record that repeats them is dropped unless ``header`` is False.
    A quote inside quotes is written twice; a line whose quotes are never closed is left out. Quoted fields
    may hold line breaks, which costs one more pass that looks for them; ``multiline=False`` spares it
    where every record is known to end on its line.
    """
    lines = _records(spark, path, separator, encoding, skiprows, multiline, positions=names is None)
    if names is not None:
        if header is not False:
            lines = lines.filter(F.col("value") != separator.join(names))
        return _split(lines, names, separator)
    first = F.min_by("value", F.struct("_block", "_id"))
    heads = materialize(lines.groupBy("_file").agg(first.alias("_head")), "headers")
    kinds = [r[0] for r in heads.groupBy("_head").agg(F.count("_file").alias("n")).orderBy(F.desc("n"), "_head").limit(MOST_HEADERS + 1).collect()]
    if not kinds:
        raise ParsingError(f"no header line in {path}")
    if len(kinds) > MOST_HEADERS:
        raise ParsingError(f"more than {MOST_HEADERS} different header lines in {path}")
    if len(kinds) > 1:
        lines = lines.join(heads, "_file")
    parts = []
    for head in kinds:
        own = lines.filter(F.col("_head") == head) if len(kinds) > 1 else lines
        names = next(csv.reader([head], delimiter=separator))
        parts.append(_split(own.filter(F.col("value") != head), names, separator))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _records(spark, path, separator: str, encoding: str, skiprows: int = 0, multiline: bool = True, positions: bool = False) -> DataFrame:
    """Records that are not blank, without byte order marks."""
    lines = read_lines(spark, path, encoding, positions=positions or multiline or skiprows > 0)
    if skiprows:
        lines = _skip_first(lines, skiprows)
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    if multiline:
        lines = whole_records(lines, separator)
    return lines.filter(F.trim("value") != "")


def _split(records: DataFrame, names, separator: str) -> DataFrame:
    schema = ", ".join(f"{_quoted(n)} string" for n in names)
    value = F.col("value")
    kept = records.filter((field_count(value, separator) <= len(names)) & ~opens(value, separator))
    fields = F.from_csv("value", schema, {"sep": separator, "mode": "PERMISSIVE", "escape": '"'})
    return kept.select(fields.alias("r")).select("r.*")


def _whole(column):
    """Integer from text such as '443' or '443.0', else null."""
    number = column.try_cast("double")
    return F.coalesce(
        column.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint"))
    )


def scan_firewall_csv(
    spark: SparkSession, path, separator: str = ",", columns=None, parse_dates: bool = True,
    encoding: str = "utf-8", header: bool | None = None,
) -> DataFrame:
    """Seven-column legacy log; actions become 'Permit' / 'Deny'."""
    names = list(columns or FLOW_LEGACY.fieldNames())
    df = read_delimited(spark, path, names, separator, encoding, header=header)
    changes = {}
    if "portdst" in names:
        changes["portdst"] = _whole(F.col("portdst")).try_cast("int")
    if parse_dates and "date" in names:
        changes["date"] = to_timestamp(F.col("date"), *EXPORT_TIMES)
    if "action" in names:
        changes["action"] = capitalize(F.trim("action"))
    return df.withColumns(changes)


def scan_firewall_export(
    spark: SparkSession, path, parse_dates: bool = True, encoding: str = "utf-8"
) -> DataFrame:
    """Semicolon export without header, eleven columns."""
    df = read_delimited(spark, path, FLOW_EXPORT.fieldNames(), ";", encoding, header=False)
    changes = {c: _whole(F.col(c)) for c in ("src_port", "dst_port", "rule", "fw")}
    if parse_dates:
        changes["timestamp"] = to_timestamp(F.col("timestamp"), *EXPORT_TIMES)
    changes["action"] = F.upper(F.trim("action"))
    changes["proto"] = F.trim("proto")
    return df.withColumns(changes)


def scan_kibana_export(
    spark: SparkSession, path, parse_dates: bool = True, encoding: str = "utf-8"
) -> DataFrame:
    """Search-stack CSV export, brought to the kernel log schema."""
    df = read_delimited(spark, path, None, ",", encoding)
    dropped = [c for c in df.columns if c in KIBANA_META or c.endswith(".keyword")]
    # Dotted names are columns here, not nested fields.
    df = df.select(*[F.col(_quoted(c)) for c in df.columns if c not in dropped])
    df = df.withColumnsRenamed(KIBANA_RENAMES)
    cleaned = {c: blank_to_null(F.col(_quoted(c)), (EMPTY_MARK,)) for c in df.columns}
    df = df.select(*[cleaned[c].alias(c) for c in df.columns])
    changes = {c: _whole(F.col(c)) for c in ("src_port", "dst_port", "rule") if c in df.columns}
    if parse_dates and "timestamp" in df.columns:
        changes["timestamp"] = to_timestamp(F.col("timestamp"), KIBANA_TIME)
    if "action" in df.columns:
        changes["action"] = F.upper(F.trim("action"))
    if "proto" in df.columns:
        changes["proto"] = F.trim("proto")
    df = df.withColumns(changes)
    return align_schema(df, FLOW_KERNEL) if parse_dates else df


def scan_csv(
    spark: SparkSession, path, columns=None, separator: str = ",", encoding: str = "utf-8",
    skiprows: int = 0, date_columns=(), date_format: str | None = None, dtype=None,
    transformations=None, na_values=NULL_SPELLINGS,
) -> DataFrame:
    """Any delimited file: names, types, null spellings, dates and column functions.

    ``dtype`` maps columns to Spark type names, ``transformations`` maps columns to
    ``Column -> Column`` functions (a pandas UDF is one).
    """
    df = read_delimited(spark, path, columns, separator, encoding, skiprows, header=False)
    df = df.select(
        *[blank_to_null(F.col(_quoted(c)), tuple(na_values)).alias(c) for c in df.columns]
    )
    formats = (date_format,) if date_format else ()
    changes = {c: F.col(_quoted(c)).try_cast(t) for c, t in (dtype or {}).items() if c in df.columns}
    for c in date_columns:
        if c in df.columns:
            column = F.col(_quoted(c))
            changes[c] = (
                F.try_to_timestamp(column, F.lit(date_format)).cast("timestamp_ntz")
                if formats
                else to_timestamp(column, *EXPORT_TIMES)
            )
    df = df.withColumns(changes)
    return df.withColumns(
        {c: f(F.col(_quoted(c))) for c, f in (transformations or {}).items() if c in df.columns}
    )


def scan_labeled(spark: SparkSession, path, text_columns=(TARGET,), separator: str = ",") -> DataFrame:
    """Feature or labelled table: the first column is the key, the others are numbers."""
    df = read_delimited(spark, path, None, separator)
    key = df.columns[0]
    return df.select(
        *[
            F.col(_quoted(c)) if c == key or c in text_columns else F.col(_quoted(c)).try_cast("double").alias(c)
            for c in df.columns
        ]
    )


def dropped_lines(spark: SparkSession, path, names, separator: str = ",", encoding: str = "utf-8") -> DataFrame:
    """One row: non-blank records, those with too many fields, and lines whose quotes are never closed."""
    value = F.col("value")
    open_, long = opens(value, separator), field_count(value, separator) > len(names)
    return _records(spark, path, separator, encoding).agg(
        F.count("*").alias("n_lines"), F.count_if(~open_ & long).alias("too_long"), F.count_if(open_).alias("unbalanced")
    )
