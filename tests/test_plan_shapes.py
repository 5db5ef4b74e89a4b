"""Plan-shape checks: the properties the design relies on at scale, read from
the physical plan so that a change cannot quietly add a shuffle or a Python
hop."""

import contextlib
import os
import sys
import io

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import SF001

import __spark_entry__ as E

QUERIES = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def exchanges(text: str) -> int:
    return sum(1 for line in text.splitlines() if line.startswith("(") and " Exchange" in line
               and "BroadcastExchange" not in line)


@pytest.fixture(scope="module")
def plans(spark):
    names = ["basket_features", "split_exact", "score_baskets", "score_udf", "runs_in_window",
             "cast_and_clean", "eval_metrics", "run_outcomes"]
    return {n: plan(QUERIES[n](spark, SF001)) for n in names}


def test_basket_aggregation_prunes_and_shuffles_once(plans):
    p = plans["basket_features"]
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in p
    assert "partial_sum" in p and "FLOOR" in p.upper()
    assert exchanges(p) == 1


def test_split_and_expression_scoring_are_map_only(plans):
    for name in ("split_exact", "score_baskets"):
        assert exchanges(plans[name]) == 0, name
        assert "Python" not in plans[name] and "ArrowEval" not in plans[name]


def test_udf_scoring_is_arrow_batched(plans):
    assert "ArrowEvalPython" in plans["score_udf"] and "BatchEvalPython" not in plans["score_udf"]


def test_window_bounds_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plans["runs_in_window"]


def test_cleaning_is_one_projection(plans):
    assert exchanges(plans["cast_and_clean"]) == 0


def test_aggregates_are_partial(plans):
    assert "partial_" in plans["eval_metrics"]
    assert "partial_max(" in plans["run_outcomes"] and "SortAggregate" not in plans["run_outcomes"]
