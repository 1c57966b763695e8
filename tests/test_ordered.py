import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and a third of them share one value."""
    rng = random.Random(7)
    data = [("hot", 0.0 if rng.random() < 0.4 else round(rng.lognormvariate(0, 2), 3)) for _ in range(3000)]
    data += [(f"g{i % 40}", round(rng.uniform(-50, 50), 2)) for i in range(800)]
    data += [("g1", float("nan")), ("g2", None), ("g3", float("inf"))]
    return spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v double, id int")


def finite(skewed):
    out = {}
    for r in skewed.collect():
        if r.v is not None and np.isfinite(r.v):
            out.setdefault(r.g, []).append(r.v)
    return out


@pytest.mark.parametrize("hot_cells", [0, 100, 10 ** 9])  # all ranked, only the hot group ranked, none ranked
def test_quantiles_match_numpy(skewed, hot_cells):
    specs = {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("v", 0.01)}
    got = {r["g"]: r for r in rows(ordered.grouped_quantiles(skewed, ["g"], specs, hot_cells))}
    assert set(got) == set(finite(skewed))
    for g, values in finite(skewed).items():
        assert np.allclose([got[g][k] for k in "abc"], np.quantile(values, [0.5, 0.9, 0.01]), atol=1e-9)


def test_summarise_equals_separate_aggregates(skewed):
    out = ordered.summarise(skewed, ["g"], ["v"], {"top": F.max("v"), "filled": F.count("v")}, {"p50": ("v", 0.5)})
    plain = {r["g"]: r for r in rows(skewed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.count("v").alias("filled")))}
    for r in rows(out):
        assert (r["n"], r["filled"]) == (plain[r["g"]]["n"], plain[r["g"]]["filled"])
        assert repr(r["top"]) == repr(plain[r["g"]]["top"])


@pytest.mark.parametrize("target", [5, 50])
def test_ranks_and_midranks(skewed, monkeypatch, target):
    monkeypatch.setattr(ordered, "BIN_CELLS", target)
    got = rows(ordered.rank_by_value(skewed.where("g = 'hot'"), ["g"], "v"))
    values = np.array([r["v"] for r in got])
    for r in got[:200]:
        less, same = (values < r["v"]).sum(), (values == r["v"]).sum()
        assert r["rank_asc"] == less + 1 and r["mid_rank"] == less + (same + 1) / 2
        assert r["rank_desc"] == (values > r["v"]).sum() + 1


def test_percentile_against_reference(spark):
    ref = [(0.0, True), (1.0, True), (2.0, True), (-1.0, False), (1.0, False), (3.0, False)]
    df = spark.createDataFrame([("m", v, r) for v, r in ref], "m string, v double, ref boolean")
    got = rows(ordered.percentile_against(df, ["m"], "v", "ref").where("not ref"), "v")
    assert [r["percentile"] for r in got] == pytest.approx([0, 2 / 3, 1])


def test_midrank_zero_is_no_risk(spark):
    df = spark.createDataFrame([("m", v, True) for v in (0.0, 0.0, 1.0, 2.0)], "m string, v double, ref boolean")
    got = rows(ordered.percentile_against(df, ["m"], "v", "ref", mid_rank=True, where=F.col("v") > 0), "v")
    assert [r["percentile"] for r in got] == [0, 0, 0.25, 0.75]


def test_lag_across_slices_equals_plain_lag(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), t, float(t % 17)) for t in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(data, "k string, t int, x double")
    sliced = ordered.lag_across_slices(df, ["k"], "t", F.floor(F.col("t") / 90), ["x"])
    plain = df.withColumn("p", F.lag("x").over(Window.partitionBy("k").orderBy("t")))
    assert rows(sliced.select("k", "t", F.col("_prev.x").alias("p")), "k", "t") == rows(plain.select("k", "t", "p"), "k", "t")


def test_number_by_hash_and_top_fraction(spark):
    df = spark.createDataFrame([(str(i), 1.0 if i % 3 else float(i)) for i in range(900)], "id string, v double").withColumn("one", F.lit(1))
    numbered = ordered.number_by_hash(df.withColumn("h", F.md5("id")), ["one"], "h")
    plain = df.withColumn("row_no", F.row_number().over(Window.partitionBy("one").orderBy(F.md5("id"))))
    assert rows(numbered.select("id", "row_no"), "id") == rows(plain.select("id", "row_no"), "id")
    for largest in (True, False):
        got = ordered.top_fraction(df, "v", 0.5, "id", largest)
        order = F.col("v").desc() if largest else F.col("v")
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("one").orderBy(order, F.md5("id")))).where("n <= 450")
        assert rows(got.select("id"), "id") == rows(want.select("id"), "id")


def test_parts_follow_the_data(spark):
    """Values inside one percent, some far outliers, and seconds of a month: no part is far above the mean."""
    n = 60_000
    narrow = spark.range(n).select(F.lit("narrow").alias("g"), (9.81 + F.col("id") * 0.02 / n).alias("v"))
    month = spark.range(n).select(F.lit("month"), (1.7e9 + F.col("id") * 43.2))
    odd = spark.createDataFrame([("narrow", 1e12), ("narrow", -5.0), ("month", 0.0)], "g string, v double")
    cells = narrow.union(month).union(odd).withColumn("n", F.lit(1).cast("long"))
    sizes = [r["count"] for r in rows(ordered.binned(cells, ["g"], "v", 1000).groupBy("g", "_bin", "_part").count())]
    assert sum(sizes) == 2 * n + 3 and max(sizes) <= 1100 and len(sizes) > 100
    got = {r["g"]: r for r in rows(ordered.metric_quantiles(cells, ["g"], "v", {"p50": 0.5}))}
    assert got["narrow"]["p50"] == pytest.approx(9.82, abs=1e-5) and got["month"]["n_values"] == n + 1


@pytest.mark.parametrize("hot", [10 ** 9, 100, 0])  # no key is hot, one is, all are
def test_staged_summary_equals_cells(spark, skewed, monkeypatch, hot):
    from telerisk.session import materialise
    monkeypatch.setattr(ordered, "HOT_CELLS", hot)
    args = (["g"], ["v"], {"top": F.max("v"), "filled": F.count("v")}, {"p50": ("v", 0.5), "p9": ("v", 0.9)})
    nobody = skewed.unionByName(skewed.limit(3).withColumn("g", F.lit(None).cast("string")), allowMissingColumns=True)
    want = {r["g"]: r for r in rows(ordered.summarise_cells(nobody, *args))}
    for reread in (False, True):
        out = ordered.summarise(nobody, *args, stage=materialise, reread=reread)
        got = {r["g"]: r for r in rows(out)}
        assert got.keys() == want.keys() and out.columns == ordered.summarise_cells(nobody, *args).columns
        for g, r in got.items():
            assert (r["n"], r["filled"], repr(r["top"])) == (want[g]["n"], want[g]["filled"], repr(want[g]["top"]))
            assert (r["p50"], r["p9"]) == pytest.approx((want[g]["p50"], want[g]["p9"]), nan_ok=True) if want[g]["p50"] is not None else r["p50"] is None


def test_ordinary_keys_are_dealt_once_as_rows(spark, skewed):
    """Disk: rows are not exploded into an entry for each quantile column before they are shuffled."""
    from telerisk.session import materialise
    out = ordered.summarise(skewed, ["g"], ["v"], {"top": F.max("v")}, {"p50": ("v", 0.5)}, materialise, reread=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate explode" not in plan and "Join" not in plan
