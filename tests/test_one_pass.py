"""Several learners on the same streams number, deal and sort them once."""

import pytest

from streamtrial.operators.fold import prequential, prequential_each
from streamtrial.plans.queries import QUERIES
from streamtrial.plans.streams import instances

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("proba", [False, True])
def test_members_equal_learners_on_their_own(spark, proba):
    algos = ("logistic", "hoeffding_tree")
    df = instances(spark, SMALL, "ev_users")
    got = prequential_each(df, algos, proba).collect()
    told = lambda r: (r.stream_id, r.seq, r.y, r.pred, *([sorted(r.proba.items())] if proba else []))
    for i, algo in enumerate(algos):
        assert sorted(told(r) for r in got if r.member == i) == sorted(map(told, prequential(df, algo, proba=proba).collect()))


@pytest.mark.parametrize("name", ["f2_probability_vote", "f6_best_member", "f4_mean_vote"])
def test_a_table_is_read_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation [") == 1
