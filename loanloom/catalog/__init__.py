"""Named queries over the test tables, each with an independent SQL twin where SQL can say it."""

from loanloom.catalog.registry import REGISTRY, Query
from loanloom.catalog import (  # noqa: F401  (modules register their queries)
    aggregates,
    binned_models,
    blocks,
    cleaning,
    learning,
    profiles,
    scans,
)

__all__ = ["REGISTRY", "Query"]
