"""Registered queries against their oracle (a representative set; the rest via tools/check_queries.py)."""

import io
import sys
from contextlib import redirect_stdout

import duckdb
import pytest
from conftest import ROOT, rows

sys.path.insert(0, str(ROOT / "tools"))
import check_queries  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
CHOSEN = ["s1_scan_text", "s14_leaderboard", "p1_canonical_events", "p7_increment_validity", "p31_segment_hazards", "j5_label_index", "j7_future_outcomes",
          "j14_bag_tensor", "a2_event_day_totals", "a3_trajectory_day", "a4_motion_windows", "a13_landmark_summary", "a14_window_features",
          "a20_directed_followup", "a25_scaler_apply", "a34_auc_interval", "a36_ablation_summary", "w2_previous_fix", "w5_code_prefix_sums",
          "w12_midrank_zero_no_risk", "w17_stratified_split", "m7_scorecard_a", "m8_scorecard_b", "o2_top_fraction", "u3_split_audit",
          "q4_preprocessing_report", "st2_session_episodes", "st4_stream_distinct"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, con, name):
    with redirect_stdout(io.StringIO()):
        verdict = check_queries.compare(spark, con, name, SF)
    assert verdict.startswith("ok"), verdict


def test_every_inventory_id_has_a_query():
    names = {q.split("_")[0] for q in entry.queries()}
    wanted = {f"{k}{i}" for k, n in (("s", 14), ("p", 33), ("j", 18), ("a", 42), ("w", 17), ("o", 4), ("u", 5), ("st", 6), ("d", 3), ("q", 7), ("m", 8))
              for i in range(1, n + 1)}
    assert wanted - names == {"s5", "s6"}  # directory listings: they read no table
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_and_score_contract(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 89 and df.limit(1).count() == 1
    assert {r["violations"] for r in rows(entry.queries()["q5_score_contract"](spark, SF))} == {0}
