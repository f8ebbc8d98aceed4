"""Readers, persisted intermediates and storage types."""

from loanloom.sources.io import bucketed_or_load, cache_or_load, checkpoint, preview, read_csv, shape, shared_dir, tail
from loanloom.sources.narrow import narrow_types, narrowing_report

__all__ = [
    "bucketed_or_load",
    "cache_or_load",
    "checkpoint",
    "narrow_types",
    "narrowing_report",
    "preview",
    "read_csv",
    "shape",
    "shared_dir",
    "tail",
]
