"""Order statistics that never sort a whole table in one task.

* :func:`exact_quantiles` brackets each quantile with Spark's sketch, cuts brackets of many rows
  down by exact counts, then ranks only the distinct values inside them.
* :func:`running_sums` cuts the order column into value ranges, sums each range, and adds
  the small table of range offsets to running sums inside the ranges.
* :func:`hash_rank` numbers rows in hash order, per group, through hash-prefix buckets.
"""

import struct

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SKETCH_ACCURACY = 10000
# Brackets that hold more rows than this are cut into ranges and counted again.
BRACKET_ROWS = 200_000
BRACKET_RANGES = 64


def exact_quantiles(df: DataFrame, columns, probabilities, extra=None):
    """``{column: [value, ...]}`` with linear interpolation between ranks, nulls ignored.

    One aggregation for the sketches and one for the values inside the brackets; only
    columns x probabilities numbers reach the driver. ``extra`` is a function from a
    column to more aggregates for the first pass; then ``(quantiles, row)`` is returned.
    """
    columns, probabilities = list(columns), list(probabilities)
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    slack = 2.0 / SKETCH_ACCURACY
    edges = [e for p in probabilities for e in (max(0.0, p - slack), min(1.0, p + slack))]
    aggregates = []
    for i in range(len(columns)):
        column = F.col(f"c{i}")
        aggregates += [
            F.count(column).alias(f"n{i}"),
            F.min(column).alias(f"lo{i}"),
            F.max(column).alias(f"hi{i}"),
            F.percentile_approx(column, edges, SKETCH_ACCURACY).alias(f"e{i}"),
        ]
        aggregates += [a.alias(f"{n}{i}") for n, a in (extra(column) if extra else {}).items()]
    sketch = values.agg(*aggregates).first()
    targets = []
    for i in range(len(columns)):
        n = sketch[f"n{i}"]
        for j, p in enumerate(probabilities if n else ()):
            position = (n - 1) * p
            first = int(position)
            low, high = sketch[f"e{i}"][2 * j], sketch[f"e{i}"][2 * j + 1]
            if n <= SKETCH_ACCURACY:
                low, high = sketch[f"lo{i}"], sketch[f"hi{i}"]
            targets.append((i, j, first, min(first + 1, n - 1), position - first, low, high))
    most = max((sketch[f"n{i}"] for i in range(len(columns))), default=0)
    large = max(most * 2 * slack, min(most, SKETCH_ACCURACY)) > BRACKET_ROWS
    found = _ranked_values(values, _halved(values, targets) if large else targets)
    missing = [t for t in targets if not {t[2], t[3]} <= set(found.get(t[:2], {}))]
    if missing:
        # A bracket that misses its rank starts again from the whole range; still exact.
        wide = [(*t[:5], sketch[f"lo{t[0]}"], sketch[f"hi{t[0]}"]) for t in missing]
        found.update(_ranked_values(values, _halved(values, wide)))
    result = {c: [None] * len(probabilities) for c in columns}
    for i, j, first, second, part, _, _ in targets:
        a, b = found[(i, j)][first], found[(i, j)][second]
        result[columns[i]][j] = a + (b - a) * part
    return (result, sketch) if extra else result


def _place(value: float) -> int:
    """Position of a double among all doubles: neighbours differ by one."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else -(1 << 63) - bits


def _double(place: int) -> float:
    return struct.unpack("<d", struct.pack("<q", place if place >= 0 else -(1 << 63) - place))[0]


def _halved(values: DataFrame, targets) -> list:
    """Targets whose brackets hold at most ``BRACKET_ROWS`` rows, or one value.

    Each round cuts the brackets that hold more into ranges of equally many doubles and counts the
    rows of each, so any column is settled in at most 11 rounds of one scan; only counts reach the
    driver. A target whose two ranks lie in different ranges becomes two. A bracket that
    does not hold its ranks is given back as it is and misses them.
    """
    settled, pending = [], list(targets)
    while pending:
        cuts = []
        for *_, low, high in pending:
            a, b = _place(low), _place(high) + 1
            cuts.append(sorted({a + (b - a) * i // BRACKET_RANGES for i in range(BRACKET_RANGES)}) + [b])
        counts, pending, asked = _range_counts(values, pending, cuts), [], pending
        for k, (i, j, first, second, part, low, high) in enumerate(asked):
            below, at = counts.get((k, -1), 0), {}
            for r in range(len(cuts[k]) - 1):
                held = counts.get((k, r), 0)
                for rank in {first, second}:
                    if below <= rank < below + held:
                        at[rank] = (r, held)
                below += held
            if len(at) < len({first, second}):
                settled.append((i, j, first, second, part, low, high))
                continue
            together = at[first] == at[second]
            for ranks in [(first, second)] if together else [(first, first), (second, second)]:
                r, held = at[ranks[0]]
                start, end = cuts[k][r], cuts[k][r + 1] - 1
                target = (i, j, *ranks, part, _double(start), _double(end))
                (settled if held <= BRACKET_ROWS or start == end else pending).append(target)
    return settled


def _range_counts(values: DataFrame, targets, cuts) -> dict:
    """``{(target, range): rows}``; range -1 holds the rows below a target's bracket."""
    cells = []
    for k, (i, *_, high) in enumerate(targets):
        value, starts = F.col(f"c{i}"), F.array(*[F.lit(_double(c)) for c in cuts[k][:-1]])
        place = F.size(F.filter(starts, lambda c: c <= value)) - 1
        cells.append(F.when(value <= F.lit(high), F.struct(F.lit(k).alias("k"), place.alias("r"))))
    counted = values.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.k", "x.r").count()
    return {(row["k"], row["r"]): row["count"] for row in counted.collect()}


def _ranked_values(values: DataFrame, targets) -> dict:
    """Values at the wanted ranks of each target that fall inside its bracket.

    Rows below a bracket are counted under a null value, which sorts first, so running
    counts are ranks in the whole column.
    """
    if not targets:
        return {}
    cells = []
    for k, (i, _, _, _, _, low, high) in enumerate(targets):
        value = F.col(f"c{i}")
        inside = F.struct(F.lit(k).alias("k"), F.when(value >= low, value).alias("v"))
        cells.append(F.when(value <= high, inside))
    counts = (
        values.select(F.explode(F.array_compact(F.array(*cells))).alias("x"))
        .groupBy("x.k", "x.v")
        .agg(F.count("*").alias("n"))
    )
    order = W.partitionBy("k").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("end", F.sum("n").over(order)).withColumn("start", F.col("end") - F.col("n"))
    ranks = F.array(*[F.array(F.lit(t[2]).cast("bigint"), F.lit(t[3]).cast("bigint")) for t in targets])
    wanted = F.exists(
        F.element_at(ranks, F.col("k") + 1), lambda r: (F.col("start") <= r) & (r < F.col("end"))
    )
    found = {}
    for row in ranked.filter(F.col("v").isNotNull() & wanted).collect():
        target = targets[row["k"]]
        for rank in (target[2], target[3]):
            if row["start"] <= rank < row["end"]:
                found.setdefault(target[:2], {})[rank] = row["v"]
    return found


def value_ranges(df: DataFrame, column: str, ranges: int | None = None) -> list:
    """Cut points that split ``column`` into about equally filled ranges."""
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.approxQuantile(column, steps, 0.25 / ranges)
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def running_sums(
    df: DataFrame, order_col: str, sums: dict, descending: bool = True, ranges: int | None = None
) -> DataFrame:
    """Adds inclusive running sums ``{output: input}`` in the order of a numeric column.

    Expects one row per distinct ``order_col`` value (aggregate first), so no range is
    dominated by a repeated value. The offsets table has one row per range.
    """
    cuts = value_ranges(df, order_col, ranges)
    bucketed = Bucketizer(splits=cuts, inputCol="_x", outputCol="_range").transform(
        df.withColumn("_x", F.col(order_col).cast("double"))
    )
    ordered = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = W.orderBy(ordered("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_range").agg(
        *[F.sum(source).alias(f"_s_{name}") for name, source in sums.items()]
    )
    offsets = offsets.select(
        "_range",
        *[
            F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    inside = (
        W.partitionBy("_range").orderBy(ordered(order_col)).rowsBetween(W.unboundedPreceding, 0)
    )
    # One offsets row per range, and the number of ranges is fixed above.
    joined = bucketed.join(F.broadcast(offsets), "_range")
    return joined.withColumns(
        {
            name: F.sum(source).over(inside) + F.col(f"_o_{name}")
            for name, source in sums.items()
        }
    ).drop("_x", "_range", *[f"_o_{name}" for name in sums])


def hash_key(key: str, seed: int):
    """Stable pseudo-random text per key: the same on any partitioning."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, key: str, group: str, seed: int, output: str = "rank") -> DataFrame:
    """1-based position of each row of its group in hash order.

    Rows are numbered inside 4096 hash-prefix buckets; bucket sizes give the offsets, so
    even a group holding every row is spread over 4096 windows. The offsets are joined on
    the buckets the rows are already partitioned by.
    """
    bucket = ["_g", "_b"]
    named = F.coalesce(F.col(group).cast("string"), F.lit("\u0000null"))
    hashed = df.withColumns({"_g": named, "_h": hash_key(key, seed)})
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 3))
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*bucket)
        .agg(F.count("*").alias("_n"))
        .select(*bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    )
    inside = W.partitionBy(*bucket).orderBy("_h", key)
    numbered = hashed.withColumn("_i", F.row_number().over(inside))
    ranked = numbered.join(offsets, bucket).withColumn(output, F.col("_i") + F.col("_o"))
    return ranked.drop("_g", "_h", "_b", "_i", "_o")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order of the key (all rows when there are fewer).

    The rows are counted first, so that only those whose hash is low enough for the sample, with
    some slack, are sorted and gathered, not ``n`` of every partition.
    """
    hashed, total = df.withColumn("_h", hash_key(key, seed)), df.count()
    wanted = n + 6 * n**0.5 + 10
    while wanted < total:
        low = hashed.filter(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") < int(wanted / total * 2**32))
        if low.count() >= n:
            return low.orderBy("_h", key).limit(n).drop("_h")
        wanted *= 2  # a key that repeats often may have a high hash
    return hashed.orderBy("_h", key).limit(n).drop("_h")
