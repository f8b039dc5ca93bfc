"""Projections, renames and schema alignment."""

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.errors import FeatureError
from flowlens.functions import blank_to_null, map_action, normalize_protocol, to_number, to_timestamp
from flowlens.schemas import CANONICAL_NAMES, FEATURE_RENAMES, FLOW_KERNEL, NULL_SPELLINGS, PRESETS

log = logging.getLogger(__name__)


def _rename_if_free(df: DataFrame, names: dict) -> DataFrame:
    have = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in have and b not in have})


def normalize_log_columns(df: DataFrame, vocabulary: str = "logs") -> DataFrame:
    """Log column names to canonical ones, actions to PERMIT / DENY."""
    df = _rename_if_free(df, CANONICAL_NAMES)
    if "action" in df.columns:
        df = df.withColumn("action", map_action(F.col("action"), vocabulary))
    return df


def normalize_feature_names(df: DataFrame) -> DataFrame:
    """Legacy feature names to current ones."""
    return _rename_if_free(df, FEATURE_RENAMES)


def with_protocol(df: DataFrame, column: str = "proto", output: str = "proto_norm") -> DataFrame:
    return df.withColumn(output, normalize_protocol(F.col(column)))


def align_schema(df: DataFrame, schema: T.StructType = FLOW_KERNEL, defaults: dict | None = None) -> DataFrame:
    """Known columns first and typed, missing ones added, extra ones last.

    ``defaults`` gives the value of a missing column; the ``df`` flag defaults to false.
    """
    defaults = {"df": False} if defaults is None else defaults
    known = [
        (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)))
        .cast(f.dataType)
        .alias(f.name)
        for f in schema
    ]
    names = set(schema.fieldNames())
    extra = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*known, *extra)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def select_features(df: DataFrame, features=None, preset: str | None = None, key: str = "ipsrc") -> DataFrame:
    """Key plus the requested features that exist; missing ones are reported, none is an error."""
    if preset is not None:
        if preset not in PRESETS:
            raise FeatureError(f"unknown preset: {preset}")
        features = PRESETS[preset]
    wanted = list(features or [])
    present = [f for f in wanted if f in df.columns]
    missing = [f for f in wanted if f not in df.columns]
    if missing:
        log.warning("features not in the table: %s", missing)
    if not present:
        raise FeatureError("none of the requested features is in the table")
    return df.select(*([key] if key in df.columns else []), *present)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def feature_preset(df: DataFrame, preset: str = "all", custom=(), target: str = "risk") -> list[str]:
    """Feature names of a preset: 'all', 'course', 'simple' or 'custom'."""
    numeric = numeric_columns(df, exclude=(target,))
    if preset == "all":
        return numeric
    if preset == "custom":
        return [c for c in custom if c in numeric]
    if preset in PRESETS:
        return [c for c in PRESETS[preset] if c in numeric] or numeric
    raise FeatureError(f"unknown preset: {preset}")


def null_sentinels(df: DataFrame, spellings=NULL_SPELLINGS, columns=None) -> DataFrame:
    """Marks such as 'N/A' in string columns become null."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in (columns or strings) if c in strings]
    return df.withColumns({c: blank_to_null(F.col(f"`{c}`"), spellings) for c in chosen})


def numbers_from_text(df: DataFrame, columns, type_name: str = "bigint") -> DataFrame:
    return df.withColumns(
        {c: to_number(F.col(c), type_name) for c in columns if c in df.columns}
    )


def timestamps_from_text(df: DataFrame, columns, formats=()) -> DataFrame:
    return df.withColumns(
        {c: to_timestamp(F.col(c), *formats) for c in columns if c in df.columns}
    )
