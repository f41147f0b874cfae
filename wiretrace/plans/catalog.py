"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    describe_queries,
    filter_queries,
    ingest_queries,
    param_queries,
    polled_queries,
    source_queries,
    stream_queries,
    timeline_queries,
    trace_queries,
)
from .base import ORACLES, QUERIES  # noqa: F401
