"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, differences
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert differences(spark, con, FOLDER, name) == ""


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) - set(ORACLES) == {"lda_topics", "topic_share", "communities", "keyword_network"}
    assert entry_module.entry(spark).columns == ["segment", "n_customers", "pct", "avg_r", "avg_f", "avg_m"]


@pytest.mark.parametrize("name", ["category_distribution", "sentiment_scores", "monthly_revenue", "eda_profile", "word_freq", "bigrams"])
def test_plans_stay_in_the_engine(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_filters_reach_the_files(spark):
    plan = QUERIES["monthly_revenue"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,0.0)" in plan and "GreaterThan(p_retailprice,0.0)" in plan


def test_first_rows_are_cut_before_the_shuffle(spark):
    for name in ("category_examples", "last_turns", "representative_reviews"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2
