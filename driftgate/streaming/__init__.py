"""Streaming entry points (the scheduled refresh as a Structured Streaming query)."""

from driftgate.streaming.refresh_stream import LANDING_SCHEMA, start_refresh_stream  # noqa: F401
