"""Registered queries against their SQL on DuckDB, all rows and types.

The default run takes one query of every family; ``IOTLENS_ALL_QUERIES=1`` runs all of them
(``python tests/harness.py`` does the same and prints times).
"""

import os

import pytest

from harness import compare, connect
from iotlens.plans import catalog

FAMILIES = [
    "source_actions", "legacy_vector", "dataset_rows", "behavioral_vector", "session_duration", "size_std_30s", "decisions",
    "route_log", "mqtt_decode", "mqtt_named_sources", "mqtt_frames", "coap_decode", "request_response", "event_log_read",
    "traffic_counters", "snapshot_1s", "feature_stats", "coverage", "latency_summary", "path_overhead", "kl_alignment",
    "drift_bands", "score_distribution", "threshold_sweep", "box_stats", "mann_whitney", "group_folds", "results_table",
    "agreement", "champion",
]
ALL = catalog.entries()
NAMES = sorted(ALL) if os.environ.get("IOTLENS_ALL_QUERIES") else FAMILIES


@pytest.fixture(scope="module")
def duck(medium):
    return connect(medium)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, medium, name):
    result = compare(spark, duck, name, ALL[name], medium)
    assert result["status"] in ("ok", "rows-only"), result


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
