"""Named queries over the warehouse tables, each with its SQL twin where one exists."""

from . import build_queries, example_queries, extension_queries, interval_queries, join_queries, machine_queries, metric_queries, nested_queries, precedence_queries, proposal_queries, sequence_queries, summary_queries, text_queries, verify_queries, view_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
