"""Relational credit-risk features and table profiling as lazy Spark plans."""

from loanloom.functions import AggSpec, safe_div
from loanloom.operators.recency import Block, recency_features, roll_up
from loanloom.session import build_session

__all__ = ["AggSpec", "Block", "build_session", "recency_features", "roll_up", "safe_div"]
