"""The queries offered over the supplied tables, each with a DuckDB statement where SQL can say it."""

from flowlens.catalog import evaluations, exploration, feature_sets, models, parsing, rows, streams
from flowlens.catalog.base import Query

MODULES = (rows, feature_sets, exploration, parsing, evaluations, models, streams)


def catalog() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"duplicate query name: {name}")
            found[name] = query
    return found
