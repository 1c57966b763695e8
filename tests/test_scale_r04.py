"""Findings of the fourth review: what is shuffled and kept does not hold a row for each cell."""
import random

import pytest
from conftest import code_day_frame, rows
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.operators import daily as D
from telerisk.operators import masks


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(4)
    entries = {f"v{e}": {d: {f"event_{c}_count": 2, f"event_{c}_episodes": 1, "distance_km": rng.random() * 50}
                         for d in range(1, 31) for c in rng.sample(codes.EVENT_CODES, 2)} for e in range(6)}
    return D.day_table(code_day_frame(spark, entries, last_day=30, first="2024-01-01"), "2024-01-01").cache()


def entities(spark):
    """Three entities, one that comes twice, one without a calendar and one without a name."""
    return spark.createDataFrame([("v0",), ("v1",), ("v1",), ("v3",), ("none",), (None,)], "gpsno string")


def ordered_rows(df):
    return sorted(tuple(sorted(r.items())) for r in rows(df))


def shuffled_rows_have_codes(df):
    """Is any exchange below a join fed by an explosion into nodes?"""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    at = [k for k, line in enumerate(plan.splitlines()) if "Join " in line]
    nodes = [k for k, line in enumerate(plan.splitlines()) if "Generate explode(_nodes" in line]
    return bool(nodes) and max(nodes) > min(at)


@pytest.mark.parametrize("view", ["events", "states"])
def test_masks_join_days_and_not_nodes(spark, days, view):
    few = entities(spark)
    if view == "events":
        spans = masks.event_spans(few, 7, 30).unionByName(masks.event_spans(few, 8, 30))
        made = lambda x: masks.mask_events(x, spans, masks.masked_codes(few, 7))
    else:
        made = lambda x: masks.mask_states(x, masks.state_blocks(few, 7, 30))
    nodes = D.event_node_features(days.unionByName(days.where("gpsno = 'v0'")))
    want, got = made(nodes), made(days.unionByName(days.where("gpsno = 'v0'")))
    assert ordered_rows(got) == ordered_rows(want) and got.columns == want.columns
    assert 0 < got.where("masked = 1").count() < got.count()
    assert shuffled_rows_have_codes(want) and not shuffled_rows_have_codes(got)


def test_a_code_hidden_twice_gives_two_rows(spark, days):
    hidden = spark.createDataFrame([("v2", codes.EVENT_CODES[0]), ("v2", codes.EVENT_CODES[0]), ("v2", codes.EVENT_CODES[1])], "gpsno string, event_code int")
    none = masks.event_spans(entities(spark).limit(0), 7, 30)
    got, want = masks.mask_events(days, none, hidden), masks.mask_events(D.event_node_features(days), none, hidden)
    assert ordered_rows(got) == ordered_rows(want) and got.count() == days.count() * len(codes.EVENT_CODES) + 30


def test_registered_masks_join_days(spark, tmp_path):
    """The queries hand the operators days, so that no join is below the nodes."""
    from telerisk.catalog import QUERIES
    spark.createDataFrame([(1, "A"), (2, "B")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS event_id, id % 2 + 1 AS user_id, timestamp_ntz '2024-01-03 10:00:00' + make_dt_interval(0, id) AS ts, 'click' AS event_type, "
              "1.0D * id AS value FROM range(200)").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("m6_masked_events", "m6_masked_states", "m6_light_events"):
        df = QUERIES[name](spark, str(tmp_path))
        assert not shuffled_rows_have_codes(df)
        assert df.count() == 2 * 30 * len(codes.EVENT_CODES)
