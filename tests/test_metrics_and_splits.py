import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from telerisk.operators import metrics as M
from telerisk.operators import splits
from telerisk.operators.quality import ContractError, require


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(5)
    data = [(str(i), rng.randrange(2), round(rng.random(), 1 if i % 2 else 3)) for i in range(200)]
    return spark.createDataFrame(data, "gpsno string, label int, probability double")


def pair_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def test_auc_and_average_precision(predictions):
    got = rows(M.ranking_metrics(predictions))[0]
    data = predictions.collect()
    y, p = np.array([r.label for r in data]), np.array([r.probability for r in data])
    assert got["roc_auc"] == pytest.approx(pair_auc(y, p))
    ap, seen = 0.0, 0
    for s in sorted(set(p), reverse=True):
        tp, fp = ((p >= s) & (y == 1)).sum(), ((p >= s) & (y == 0)).sum()
        ap += (tp - seen) / y.sum() * tp / (tp + fp)
        seen = tp
    assert got["pr_auc"] == pytest.approx(ap)


def test_one_class_has_no_auc(predictions):
    got = rows(M.ranking_metrics(predictions.where("label = 1")))[0]
    assert got["roc_auc"] is None and got["pr_auc"] == pytest.approx(1)


def test_bootstrap_interval_covers_the_estimate(predictions):
    auc = rows(M.ranking_metrics(predictions))[0]["roc_auc"]
    got = rows(M.auc_interval(predictions, samples=200))[0]
    assert got["auc_lower"] < auc < got["auc_upper"] and got["valid_bootstraps"] == 200


def test_paired_interval_of_equal_models_is_zero(predictions):
    pair = M.pair_predictions(predictions, predictions)
    got = rows(M.paired_interval(pair, samples=50))[0]
    assert got["delta_lower"] == got["delta_upper"] == 0
    assert rows(M.paired_auc(pair))[0]["delta_auc"] == 0


def test_binary_counts(predictions):
    r = rows(M.score_binary(predictions))[0]
    assert r["tp"] + r["fn"] == r["positive"] and r["tn"] + r["fp"] == r["negative"] and r["n"] == 200


def test_table_diff(spark, predictions):
    other = predictions.where("gpsno <> '3'").withColumn("probability", F.col("probability") + F.when(F.col("gpsno") == "7", 0.25).otherwise(0.0))
    r = rows(M.table_diff(predictions, other, ["gpsno"], ["probability"], ["label"]))[0]
    assert (r["matched"], r["only_official"], r["only_reproduced"], r["label_mismatches"]) == (199, 1, 0, 0)
    assert r["probability_max_error"] == pytest.approx(0.25)


def test_split_is_disjoint_complete_and_tamper_evident(spark):
    ref = spark.createDataFrame([(str(i), i % 2) for i in range(50)], "gpsno string, label int")
    split = splits.stratified_split(ref, 2026, 5, 0.2)
    got = rows(split)
    assert len(got) == 50 and sum(r["part"] == "holdout" for r in got) == 10
    for k in range(5):
        assert {r["label"] for r in got if r["fold"] == k} == {0, 1}
    require(splits.audit_split(ref, split, 5))
    flipped = ref.withColumn("label", F.when(F.col("gpsno") == "4", 1).otherwise(F.col("label")))
    assert rows(splits.label_fingerprint(ref)) != rows(splits.label_fingerprint(flipped))
    with pytest.raises(ContractError):
        require(splits.audit_split(flipped, split, 5))
    with pytest.raises(ContractError):
        require(splits.audit_split(ref, split.where("gpsno <> '8'"), 5))


def test_poisson_of_a_cell_has_the_moments_of_its_entities(spark):
    from telerisk.functions.columns import poisson_of, seeded_hex
    sizes = [0, 1, 2, 3, 7, 100, 1023, 1024, 2500]
    rows = spark.range(4000).select("id", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    drawn = rows.withColumn("w", poisson_of(F.col("n"), lambda *p: seeded_hex(7, "id", *p)))
    for r in drawn.groupBy("n").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.min("w").alias("low")).collect():
        assert r.low >= 0 and abs(r.m - r.n) <= 5 * (max(r.n, 1) / 4000) ** 0.5 and abs(r.v - r.n) <= 0.12 * r.n


def test_bootstrap_rows_follow_cells_and_not_entities(spark):
    from telerisk.operators import metrics as M
    df = spark.range(3000).select(F.col("id").cast("string").alias("gpsno"), (F.col("id") % 2).cast("int").alias("label"),
                                  ((F.col("id") * 7 % 5 + F.col("id") % 2) / 8).alias("probability"))
    cells = df.select("label", "probability").distinct().count()
    rows = M.bootstrap_cells(df, 1, 200, ["label", "probability"])
    assert rows.count() <= cells * 200
    total = rows.groupBy("replicate").agg(F.sum("weight").alias("w")).agg(F.avg("w"), F.stddev("w")).first()
    assert abs(total[0] - 3000) < 20 and 40 < total[1] < 72
    auc, box = M.ranking_metrics(df).first().roc_auc, M.auc_interval(df, seed=1, samples=200).first()
    assert box.valid_bootstraps == 200 and box.auc_lower < auc < box.auc_upper and box.auc_upper - box.auc_lower < 0.06


def test_bootstrap_of_the_auc_draws_every_entity(spark):
    import hashlib

    import numpy as np
    people = [(str(i), i % 2, (i // 2 % 3 + i % 2) / 4) for i in range(60)]  # many entities in each cell
    values = []
    for b in range(50):
        heads = {g: int(hashlib.md5(f"7:{b}:{g}".encode()).hexdigest()[:8], 16) / 2**32 for g, _, _ in people}
        draw = lambda u: next(k for k in range(20) if u < sum(np.exp(-1) / np.prod(np.arange(1, j + 1)) for j in range(k + 1)))
        w = {g: draw(u) for g, u in heads.items()}
        pairs = [(w[g] * w[h], (p > q) + (p == q) / 2) for g, y, p in people if y for h, z, q in people if not z]
        values.append(sum(n * s for n, s in pairs) / sum(n for n, _ in pairs))
    got = M.auc_interval(spark.createDataFrame(people, "gpsno string, label int, probability double"), seed=7, samples=50).first()
    assert got.valid_bootstraps == 50
    assert [got.auc_lower, got.auc_upper] == pytest.approx(np.quantile(values, [0.025, 0.975]).tolist(), abs=1e-9)


def test_digest_tree_follows_the_data_and_sees_changes(spark):
    ref = lambda n, flip=None: spark.range(n).select(F.col("id").cast("string").alias("gpsno"), F.when(F.col("id") == flip, 5).otherwise(F.col("id") % 2).cast("int").alias("label"))
    prints = {n: splits.label_fingerprint(ref(n)).first() for n in (0, 1, 16, 17, 300, 5000)}
    assert [p.entities for p in prints.values()] == [0, 1, 16, 17, 300, 5000] and len({p.label_fingerprint for p in prints.values()}) == 6
    assert [splits.digest_depth(n) for n in (0, 16, 17, 256, 257, 5000)] == [0, 0, 1, 1, 2, 3]
    for n in (17, 5000):
        assert splits.label_fingerprint(ref(n).repartition(7)).first() == prints[n]
        assert splits.label_fingerprint(ref(n, flip=3)).first().label_fingerprint != prints[n].label_fingerprint


def test_frozen_split_is_refused_on_any_change(spark, tmp_path):
    ref = spark.range(200).select(F.col("id").cast("string").alias("gpsno"), (F.col("id") % 2).cast("int").alias("label"))
    folder = f"file://{tmp_path}/split"
    first = rows(splits.frozen_split(ref, folder), "gpsno")
    assert rows(splits.frozen_split(ref.repartition(5), folder), "gpsno") == first and len(first) == 200
    for changed, args in ((ref.where("gpsno <> '7'"), {}), (ref.withColumn("label", F.when(F.col("gpsno") == "7", 0).otherwise(F.col("label"))), {}),
                          (ref, {"seed": 1}), (ref, {"folds": 4}), (ref, {"holdout": 0.25})):
        with pytest.raises(ContractError):
            splits.frozen_split(changed, folder, **args)
    assert rows(splits.frozen_split(ref, folder), "gpsno") == first
