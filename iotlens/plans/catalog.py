"""All registered queries."""

from __future__ import annotations

from iotlens.plans import (  # noqa: F401
    queries_analytics,
    queries_evaluate,
    queries_models,
    queries_packets,
    queries_vectors,
)
from iotlens.plans.registry import ENTRIES, Entry


def entries() -> dict[str, Entry]:
    return dict(ENTRIES)
