"""All registered queries."""

from __future__ import annotations

from metricloom.plans import (
    analysis_queries,
    metric_queries,
    run_queries,
    security_queries,
    stream_queries,
    tensor_queries,
)
from metricloom.plans.common import Query

QUERIES: dict[str, Query] = {}
for _module in (
    metric_queries,
    run_queries,
    tensor_queries,
    analysis_queries,
    security_queries,
    stream_queries,
):
    for _name, _query in _module.REGISTRY.items():
        if _name in QUERIES:
            raise ValueError(f"query registered twice: {_name}")
        QUERIES[_name] = _query
