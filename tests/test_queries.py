"""Every registered query of the library against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from gridlore.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, sf_dir, same, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name])


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["conv_id", "message_count", "last_turn", "title"]
    assert out.count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_membership_join_is_no_cartesian_product(spark, sf_dir):
    plan = catalogue.membership_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_python_in_plans(spark, sf_dir):
    for name in ("thread_list", "history_tail", "entity_merge", "edges_cross_layer", "upsert_latest"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = catalogue.severity_counts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderpriority:string>" in plan
