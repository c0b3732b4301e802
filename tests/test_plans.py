"""Plans: no products of tables, columns pruned, filters pushed to the scan."""

import pytest
from oracle import SF

import corvata.plans.queries_more  # noqa: F401
from corvata.plans.queries import QUERIES

#: Queries that write rounds or count while they are built are left out here; the others are planned only.
PLANNED = sorted(set(QUERIES) - {"lineage_closure", "connected_components", "derived_tables", "quality_gate", "markup_round_trip", "ledger_search_page", "document_list"})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_and_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["ledger_reconciliation"](spark, SF))
    assert "p_retailprice" not in plan and "l_tax" not in plan and "p_name" not in plan
    plan = plan_of(QUERIES["profile_construction"](spark, SF))
    assert "l_extendedprice" not in plan
    plan = plan_of(QUERIES["cohort_containment"](spark, SF))
    assert "GreaterThan(l_quantity,49.0)" in plan and "GreaterThan(l_discount,0.05)" in plan


def test_python_only_where_it_must(spark):
    for name in ("ledger_reconciliation", "charge_policy", "field_metrics", "cohort_rollup", "drift_windows", "primary_total", "review_overlay", "rule_report", "authority_ratios", "money_parse", "date_parse", "schema_inheritance"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
