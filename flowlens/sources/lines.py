"""Text lines with, on request, their position in the log."""

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\f\ufeff"
UTF8 = ("utf-8", "utf8")
LATIN1 = ("latin-1", "latin1", "iso-8859-1")


def read_lines(spark: SparkSession, path, encoding: str = "utf-8", positions: bool = False) -> DataFrame:
    """One row per line in ``value``.

    UTF-8 goes through the text source, which replaces bad bytes with U+FFFD. Other
    encodings go through the CSV source with a separator and a quote that never occur.
    ``auto`` reads as UTF-8 and every file with bad bytes as Latin-1, for one more pass.
    ``positions`` adds the file, the start of the split and a number that grows inside it.
    """
    if encoding.lower() == "auto":
        bad = _not_utf8(spark, path)
        good = sorted({unquote(f) for f in spark.read.text(path).inputFiles()} - set(bad))
        parts = [_located(spark, files, e, positions) for files, e in ((good, "utf-8"), (bad, "latin-1")) if files]
        lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    else:
        lines = _located(spark, path, encoding, positions)
    return lines.withColumn("_id", F.monotonically_increasing_id()) if positions else lines


def _located(spark: SparkSession, path, encoding: str, positions: bool) -> DataFrame:
    encoding = encoding.lower()
    if encoding in UTF8:
        lines = spark.read.text(path)
    else:
        encoding = "iso-8859-1" if encoding in LATIN1 else encoding
        lines = (
            spark.read.schema("value string")
            .options(sep="\u0001", quote="", escape="\u0002", encoding=encoding, maxCharsPerColumn=-1)
            .csv(path)
        )
    if not positions:
        return lines
    return lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def _not_utf8(spark: SparkSession, path) -> list[str]:
    """Files with lines that are no UTF-8."""
    lines = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    found = {unquote(r[0]).replace("file:///", "file:/") for r in lines.select("_metadata.file_path").distinct().toLocalIterator()}
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    return [f for f in files if f.replace("file:///", "file:/") in found]


def stripped(column):
    return F.btrim(column, F.lit(BLANKS))
