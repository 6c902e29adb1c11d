import pytest

import __spark_entry__
from oracle import check
from tiltwise.plans import queries as plan_queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(plan_queries.ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, plan_queries.QUERIES[name], plan_queries.ORACLES[name], FOLDER)


def test_flagship(spark):
    got = {r.metric: r for r in __spark_entry__.entry(spark).collect()}
    assert got["Brier score"].estimated == pytest.approx(got["Brier score"].external, abs=5e-4)
    assert got["AUROC"].internal == pytest.approx(0.646370) and got["AUROC"].external == pytest.approx(0.640710)
    assert got["AUROC"].estimated == pytest.approx(0.6517, abs=2e-4)


def test_registry_is_consistent():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_without_sql(spark):
    found = {r.field: r for r in plan_queries.est_end2end(spark, "/root/testdata/sf0.001").collect()}
    assert found["AUROC"].section == "estimation" and found["kl"].section == "extra" and found["preDiagnosisStatus"].value_str == "Success"
    assert plan_queries.int_performance(spark, "/root/testdata/sf0.001").count() == 22
