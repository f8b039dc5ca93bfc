"""Named feature sets on shared storage: Parquet data with JSON metadata beside it."""

import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from flowlens.errors import FeatureError
from flowlens.operators.features import FeatureSet


def _paths(folder: str, name: str):
    base = f"{folder.rstrip('/')}/{name}"
    return f"{base}/data", f"{base}/meta"


def _filesystem(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def save_feature_set(features: FeatureSet, folder: str, name: str, metadata: dict | None = None) -> str:
    """Writes the table, then its description (time, sizes, names, removed features)."""
    spark = features.data.sparkSession
    data_path, meta_path = _paths(folder, name)
    features.data.write.mode("overwrite").parquet(data_path)
    description = {
        "created_at": datetime.now(timezone.utc).isoformat(),
        "num_samples": spark.read.parquet(data_path).count(),
        "num_features": len(features.feature_names),
        "feature_names": features.feature_names,
        "index_column": features.key,
        **(metadata or {}),
        **features.metadata,
    }
    text = spark.createDataFrame([(json.dumps(description, default=str),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(meta_path)
    return data_path


def feature_set_metadata(spark: SparkSession, folder: str, name: str) -> dict:
    """Stored description, empty when there is none."""
    if name not in list_feature_sets(spark, folder):
        return {}
    return json.loads(spark.read.text(_paths(folder, name)[1]).first()["value"])


def load_feature_set(spark: SparkSession, folder: str, name: str) -> FeatureSet:
    metadata = feature_set_metadata(spark, folder, name)
    if not metadata:
        raise FeatureError(f"feature set '{name}' is not in {folder}")
    data = spark.read.parquet(_paths(folder, name)[0])
    return FeatureSet(data, metadata["feature_names"], metadata["index_column"], metadata)


def list_feature_sets(spark: SparkSession, folder: str) -> list[str]:
    filesystem, path = _filesystem(spark, folder)
    if not filesystem.exists(path):
        return []
    return sorted(s.getPath().getName() for s in filesystem.listStatus(path) if s.isDirectory())


def delete_feature_set(spark: SparkSession, folder: str, name: str) -> None:
    """Removes a stored set; unknown names are ignored."""
    if name in list_feature_sets(spark, folder):
        filesystem, _ = _filesystem(spark, folder)
        filesystem.delete(_filesystem(spark, f"{folder.rstrip('/')}/{name}")[1], True)
