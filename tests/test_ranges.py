"""Ranks over range partitions against plain Python, with one value or group on a third of the rows."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telerisk.operators import ordered as O
from telerisk.operators import ranges as R

SCHEMA = "id long, g string, value double, ref boolean"


def data(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        value = 2.5 if i % 3 == 0 else rng.choice([0.0, -0.0, -1.5, 7.0, rng.random(), rng.random() * 100])
        rows.append((i, "hot" if i % 3 else rng.choice("ab"), None if i % 37 == 1 else value, rng.random() < 0.4))
    return rows


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 4), (3, 23)])
def test_counts_equal_plain_counts(spark, seed, ranges):
    rows = data(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.when(F.col("ref") & F.col("value").isNotNull(), 1).otherwise(0))
    got = {r.id: r for r in R.merged_counts(df, ["g"], "value", ["n"], ranges).collect()}
    assert len(got) == len(rows)
    for i, g, v, _ in rows:
        reference = [w for _, h, w, is_ref in rows if h == g and is_ref and w is not None]
        want = (None,) * 3 if v is None else (sum(w < v for w in reference), sum(w == v for w in reference), len(reference))
        assert (got[i].n_before, got[i].n_here, got[i].n_total) == want


def test_hot_value_is_spread_over_ranges(spark):
    df = spark.range(9000).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id").cast("double")).alias("value"))
    sizes = [r["count"] for r in R.spread(df.withColumn("_salt", R.row_hash(df)), ["g", "value", "_salt"], "t", 12).groupBy(R.RANGE).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 9000 / 12
    plan = R.merged_counts(df.withColumn("n", F.lit(1)), ["g"], "value", ["n"], 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_numbers_run_through_all_ranges(spark, ranges):
    rows = data(5)
    df = spark.createDataFrame([(i, g, v) for i, g, v, _ in rows], "id long, g string, value double")
    got = R.numbered(df, ["g"], ["id"], "no", ranges).collect()
    place, want = Counter(), {}
    for i, g, _, _ in rows:
        place[g] += 1
        want[i] = place[g]
    assert {r.id: r.no for r in got} == want and len(got) == len(rows)


def test_percentiles_and_ranks_with_hot_values(spark, monkeypatch):
    rows = data(7)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for mid in (False, True):
            got = {r.id: r.percentile for r in O.percentile_against(df, ["g"], "value", "ref", mid_rank=mid, where=F.col("value") > 0).collect()}
            for i, g, v, _ in rows:
                reference = [w for _, h, w, is_ref in rows if h == g and is_ref and w is not None and w > 0]
                below, equal = (sum(w < v for w in reference), sum(w == v for w in reference)) if v and v > 0 else (0, 0)
                want = 0.0 if not v or v <= 0 else (below + (equal / 2 if mid else equal)) / len(reference)
                assert got[i] == pytest.approx(want)
        ranks = {r.id: r for r in O.rank_by_value(df, ["g"], "value").collect()}
        for i, g, v, _ in rows:
            peers = [w for _, h, w, _ in rows if h == g and w is not None]
            want = (None, None) if v is None else (1 + sum(w < v for w in peers), 1 + sum(w > v for w in peers))
            assert (ranks[i].rank_asc, ranks[i].rank_desc) == want
        top = O.top_fraction(df.where("value IS NOT NULL"), "value", 0.2, "id").collect()
        values = sorted((v for _, _, v, _ in rows if v is not None), reverse=True)
        assert sorted((r.value for r in top), reverse=True) == values[:len(values) // 5]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert O.percentile_against(none, ["g"], "value", "ref").count() == 0 and R.numbered(none, ["g"], ["id"]).count() == 0
