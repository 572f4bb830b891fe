"""Shapes of the physical plans of registered operators."""

import pytest

from tablelens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_joins(spark, name):
    plan = plan_of(spark, name)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["op5_winnowing", "op8_perspectives"])
def test_native_operators_use_built_in_functions(spark, name):
    plan = plan_of(spark, name)
    assert "Python" not in plan and "Arrow" not in plan
