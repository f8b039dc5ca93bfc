"""Records of delimited files whose quoted fields hold line breaks, found in parallel.

Whether a line ends inside quotes depends on how it begins, so a line is a function of one bit.
Functions of a split's lines combine to a function of the split, and those of a file's splits
combine in order from "outside"; with the state at each split's start every line knows its
own. Only lines of files in which some line opens quotes it does not close are looked at that way; all others stream on unchanged. The window
over lines runs split by split, the one over splits holds one row for each split of a file.

Quotes count as in the usual reading of such files: a field is quoted if it begins with a
quote, a quote inside is written twice, and a quote later in an unquoted field, or after the
closing one, is plain text. A quote that is never closed in its file makes a bad line of its line alone;
the lines after it stand for themselves.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.session import materialize

# Files with open quotes are named in a broadcast up to this many.
BROADCAST_FILES = 100_000
# A record over more lines is an error: a stray pair of quotes, not a field.
MOST_RECORD_LINES = 1_000_000

_QUOTED = r'(?:[^"]++|"")*+'


def _grammar(separator: str) -> tuple[str, str]:
    """Patterns of a whole field with its separator, and of what an unquoted stretch may hold."""
    mark = re.escape(separator)
    plain = rf"[^{mark}]*+" if len(separator) == 1 else rf"(?:(?!{mark})(?s:.))*+"
    first = rf'(?!"){plain}'
    return rf'(?:(?:"{_QUOTED}"{plain}|{first}){mark})*+', plain


def opens(line: Column, separator: str) -> Column:
    """Whether a line that begins outside quotes ends inside."""
    fields, _ = _grammar(separator)
    return line.contains('"') & line.rlike(rf'\A{fields}"{_QUOTED}\z')


def stays(line: Column, separator: str) -> Column:
    """Whether a line that begins inside quotes ends inside."""
    fields, plain = _grammar(separator)
    again = rf'\A{_QUOTED}"{plain}{re.escape(separator)}{fields}"{_QUOTED}\z'
    return ~line.contains('"') | line.rlike(rf"\A{_QUOTED}\z") | line.rlike(again)


def field_count(line: Column, separator: str) -> Column:
    """Number of fields of a record, separators inside quotes not counted."""
    mark = re.escape(separator)
    bare = F.when(
        line.contains('"'), F.regexp_replace(line, rf'(\A|{mark})"{_QUOTED}"', "$1")
    ).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def _with_states(df: DataFrame, part: list[str], order: str, f0: str, f1: str) -> DataFrame:
    """Adds the state before each row for either state before the partition: ``_b0`` and ``_b1``.

    A row whose function is constant settles the state; after it, and before the first one, only swaps count.
    """
    w = W.partitionBy(*part).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    swap = (F.col(f0) & ~F.col(f1)).cast("long")
    df = df.withColumn("_swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    settled = F.when(F.col(f0) == F.col(f1), F.col(f0).cast("long") + F.col("_swaps"))
    df = df.withColumn("_settled", F.last(settled, ignorenulls=True).over(before))
    # A settled state v after s swaps is v + s; with as many swaps again it is v.
    known = (F.col("_settled") + F.col("_swaps")) % 2 == 1
    odd = F.col("_swaps") % 2 == 1
    return df.withColumns({"_b0": F.coalesce(known, odd), "_b1": F.coalesce(known, ~odd)}).drop("_swaps", "_settled")


def _after(state: Column, f0: str = "_f0", f1: str = "_f1") -> Column:
    return F.when(state, F.col(f1)).otherwise(F.col(f0))


def whole_records(lines: DataFrame, separator: str) -> DataFrame:
    """Lines (``value``, ``_file``, ``_block``, ``_id``) put together where a record goes over several of them.

    A record carries the position of its first line; breaks inside it become line feeds.
    """
    columns = ["value", "_file", "_block", "_id"]
    lines = lines.select(*columns).withColumn("_f0", opens(F.col("value"), separator))
    files = materialize(lines.filter("_f0").select("_file").distinct(), "open-quotes")
    count = files.count()
    if not count:
        return lines.select(*columns)
    small = F.broadcast(files) if count <= BROADCAST_FILES else files
    own = lines.join(small, "_file", "left_semi").withColumn("_f1", stays(F.col("value"), separator))
    own = materialize(_with_states(own, ["_file", "_block"], "_id", "_f0", "_f1"), "quoted-lines")

    ends = own.groupBy("_file", "_block").agg(F.max_by(F.struct(_after(F.col("_b0")).alias("f0"), _after(F.col("_b1")).alias("f1")), "_id").alias("end"))
    splits = _with_states(ends.select("_file", "_block", F.col("end.f0").alias("_f0"), F.col("end.f1").alias("_f1")), ["_file"], "_block", "_f0", "_f1")
    splits = materialize(splits.select("_file", "_block", F.col("_b0").alias("_entry"), _after(F.col("_b0")).alias("_exit")), "quoted-splits")

    inside = F.when(F.col("_entry"), F.col("_b1")).otherwise(F.col("_b0"))
    own = own.join(splits.drop("_exit"), ["_file", "_block"]).withColumn("_inside", inside)
    # The first lines of the records over several lines, the last of each split carried into the next ones.
    heads = own.filter(~F.col("_inside")).groupBy("_file", "_block").agg(F.max("_id").alias("_last"))
    order = W.partitionBy("_file").orderBy("_block")
    carried = splits.join(heads, ["_file", "_block"], "left").select(
        "_file",
        "_block",
        F.last(F.when(F.col("_last").isNotNull(), F.struct("_block", "_last")), ignorenulls=True)
        .over(order.rowsBetween(W.unboundedPreceding, -1))
        .alias("_from"),
        F.last("_exit").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_unclosed"),
        F.last(F.when(F.col("_last").isNotNull(), F.struct("_block", "_last")), ignorenulls=True)
        .over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("_final"),
    )
    carried = materialize(carried, "quoted-heads")
    own = own.join(carried, ["_file", "_block"])
    local = F.when(~F.col("_inside"), F.struct(F.col("_block"), F.col("_id").alias("_last")))
    running = W.partitionBy("_file", "_block").orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("_head", F.coalesce(F.last(local, ignorenulls=True).over(running), F.col("_from")))
    broken = F.col("_inside") | F.col("_f0")
    unclosed = F.col("_unclosed") & (F.col("_head") == F.col("_final"))
    alone = own.filter(~broken | unclosed).select(*columns)
    ordered = F.sort_array(F.collect_list(F.struct("_block", "_id", "value")))
    joined = own.filter(broken & ~unclosed).groupBy("_file", "_head").agg(ordered.alias("_lines"))
    too_long = F.raise_error(F.concat(F.lit("a quoted record over more lines than MOST_RECORD_LINES in "), F.col("_file")))
    text = F.when(F.size("_lines") > MOST_RECORD_LINES, too_long).otherwise(F.array_join(F.col("_lines.value"), "\n"))
    records = joined.select(text.alias("value"), "_file", F.col("_head._block").alias("_block"), F.col("_head._last").alias("_id"))
    rest = lines.join(small, "_file", "left_anti").select(*columns)
    return rest.unionByName(alone).unionByName(records)
