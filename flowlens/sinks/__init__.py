"""Writers."""

from flowlens.sinks.feature_store import (
    delete_feature_set,
    feature_set_metadata,
    list_feature_sets,
    load_feature_set,
    save_feature_set,
)
from flowlens.sinks.tables import export_capped, export_csv, write_flows, write_parquet, write_table

__all__ = [name for name in dir() if not name.startswith("_")]
