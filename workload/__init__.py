"""The registered queries over the given tables, each beside its SQL equivalent."""

from workload import (  # noqa: F401
    box_queries, document_queries, event_queries, flow_queries, frame_queries, geometry_queries,
    pixel_queries, report_queries, run_queries, telemetry_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
