import pytest
from oracles import compare

from tidewater import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_plans_have_no_global_sort(spark):
    plan = registry.queries()["vector_topk"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    scan = registry.queries()["facet_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in scan
