"""Driver contract, and a spread of registered jobs against their oracles at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUICK = ["profile_lineitem", "top_values_orders", "quality_overall", "fk_containment", "anomalies_all", "forecast_monthly", "pii_combined",
         "mask_formats", "policy_match", "policy_compliance", "fk_inferred", "entity_types", "sql_lineage_edges", "blast_radius_all",
         "lineage_cycles", "metric_revenue_by_region", "semantic_search", "recommendations", "agg_multi", "sql_asof", "sql_running_sum",
         "cdc_current_state", "stream_kpi_hourly", "json_recovery", "plan_bottlenecks", "documents_pii_hits"]
NAMES = sorted(entry.queries()) if os.environ.get("TEST_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    if name in entry.oracle_sql():
        assert compare(df, duck, entry.oracle_sql()[name]) is None
    else:
        assert df.count() >= 0
