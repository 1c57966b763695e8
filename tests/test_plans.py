"""Physical plans: pushdown, no Python rows, no cartesian product, one scan per source."""

import io
from contextlib import redirect_stdout

import pytest
from conftest import ROOT  # noqa: F401

from telerisk.catalog import QUERIES
from telerisk.catalog import views as V
from telerisk.operators import trajectory as T
from telerisk.operators.ordered import metric_quantiles

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["p1_canonical_events", "p7_increment_validity", "j4_anchor_event_counts", "a1_code_counts", "a13_landmark_summary",
                                  "a20_directed_followup", "a33_ranking_metrics", "w1_episode_starts", "w5_code_prefix_sums", "j17_landmark_grid"])
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(V.motion_daily(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text
    text = plan(V.table(spark, SF, "events").where("value > 60").select("user_id"))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,60.0)]" in text


def final_plan(df):
    df.collect()
    return plan(df)


def test_running_totals_reuse_the_cell_exchange(spark):
    li = V.table(spark, SF, "lineitem")
    text = final_plan(metric_quantiles(li, ["l_returnflag"], "l_extendedprice", {"p": 0.5}))
    assert "ReusedExchange" in text.split("Initial Plan")[0]


def test_step_features_sort_no_structs_and_read_the_fixes_once(spark):
    text = final_plan(T.with_steps(T.best_fix(V.trajectory(spark, SF))))
    final = text.split("Initial Plan")[0]
    assert "SortAggregate" not in final and "ReusedExchange" in final
