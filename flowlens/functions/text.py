"""String helpers and the key=value part of kernel log lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schemas import NULL_SPELLINGS

# TCP flag words that appear without a value.
TCP_FLAGS = ("SYN", "ACK", "FIN", "RST", "URG", "PSH", "ECE", "CWR")


def capitalize(column: Column) -> Column:
    """First character upper, the rest lower (not one capital per word)."""
    return F.concat(
        F.upper(F.substring(column, 1, 1)), F.lower(column.substr(F.lit(2), F.length(column)))
    )


def blank_to_null(column: Column, spellings=NULL_SPELLINGS) -> Column:
    return F.when(~column.isin(*spellings), column)


def pair_text(text: Column) -> Column:
    """The key=value pairs of a line as ' K=V K=V ', in line order."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\w+=\S*)"), F.lit(1))
    return F.concat(F.lit(" "), F.array_join(pairs, " "), F.lit(" "))


def key_value(pairs: Column, key: str) -> Column:
    """Value of the last ``key`` in a :func:`pair_text`, null when absent, '' when empty."""
    mark = f" {key}="
    after = F.substring_index(pairs, mark, -1)
    return F.when(F.contains(pairs, F.lit(mark)), F.substring_index(after, " ", 1))


def tcp_flags(text: Column) -> Column:
    """Flag words standing alone in the text, comma-joined in line order."""
    words = F.split(F.upper(text), r"\s+")
    return F.array_join(F.filter(words, lambda w: w.isin(*TCP_FLAGS)), ",")
