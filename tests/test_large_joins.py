"""Joins of tables that grow with the input don't go by broadcast, though Spark guesses tables of listed rows to be small."""

import re

import pytest

from polynet.operators import pixels, rules
from polynet.plans import catalogue, extraction, grown, holes, lookups, ruling  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = [
    "cluster_points",
    "pixel_junctions",
    "trace_lines",
    "spur_prune",
    "nearest_vertex",
    "vertex_touch_pairs",
    "best_candidates",
    "compare_all_features",
    "compare_results",
    "confusion_by_snapshot",
    "division_angles",
    "estimate_unconstrained",
    "feature_histogram",
    "feature_summary",
    "snapshot_counts",
    "single_cells",
    "label_repair",
    "rule_list_table",
    "rule_list_report",
    "holed_union_rings",
    "greedy_sweep",
    "network_issues",
    "element_counts",
]
#: Keys of joins whose smaller side has a row a rule or a flag, or one row.
FEW = {"rule_id", "_one", "_level", "_all", "real"}


def broadcast_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[(?:\w+\()*(\w+)#", plan)) - FEW


@pytest.fixture
def kept(monkeypatch):
    """Keys of broadcast joins in tables that operators write on their way."""
    seen = set()
    for module in (pixels, rules):
        for name in ("keep", "keep_observed"):
            if hasattr(module, name):
                plain = getattr(module, name)
                monkeypatch.setattr(module, name, lambda df, *a, plain=plain: seen.update(broadcast_keys(df)) or plain(df, *a))
    return seen


@pytest.mark.parametrize("name", NAMES)
def test_no_growing_table_is_broadcast(spark, kept, name):
    assert not broadcast_keys(catalogue.QUERIES[name](spark, SF)) | kept
