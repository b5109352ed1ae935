"""Queries over streams: an extension beside the batch engine, by Structured Streaming."""

from .rollup import rolled_up, rollup, run_query, start_ingest, start_rollup

__all__ = ["rolled_up", "rollup", "run_query", "start_ingest", "start_rollup"]
