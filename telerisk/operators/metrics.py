"""Evaluation of predictions, per group (model, anchor, fold, ...), ties handled exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk.functions.columns import poisson_of, poisson_one, seeded_hex
from telerisk.operators.ordered import metric_quantiles, rank_by_value, running_totals, top_fraction
from telerisk.session import materialise

ALL = "_all"


def _grouped(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(groups)) if groups else (df.withColumn(ALL, F.lit(0)), [ALL])


def binary_metrics(df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "probability",
                   threshold: float = 0.5) -> DataFrame:
    """Counts, confusion, accuracy, recall, specificity, F1 and Brier score in one aggregate."""
    df, keys = _grouped(df, groups)
    y, said = F.col(label) == 1, F.col(score) >= threshold
    raw = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("positive"), F.count_if(~y).alias("negative"),
        F.count_if(y & said).alias("tp"), F.count_if(~y & said).alias("fp"),
        F.count_if(~y & ~said).alias("tn"), F.count_if(y & ~said).alias("fn"),
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    guarded = lambda top, bottom, empty: F.when(bottom > 0, top / bottom).otherwise(empty)
    out = raw.select(*keys, "n", "positive", "negative", "tp", "fp", "tn", "fn", "brier",
                     ((tp + tn) / F.col("n")).alias("accuracy"),
                     guarded(tp, tp + fn, F.lit(0.0)).alias("recall"),
                     guarded(tn, tn + fp, F.lit(None).cast("double")).alias("specificity"),
                     guarded(2 * tp, 2 * tp + fp + fn, F.lit(0.0)).alias("f1"))
    return out.drop(ALL)


def ranking_metrics(df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "probability",
                    weight: str | None = None) -> DataFrame:
    """Tie-aware ROC-AUC and average precision from running totals over distinct scores.

    NULL where a class is missing.  ``weight`` holds replicate weights (bootstrap); their cells are written, so that
    nothing is drawn again for a second reading.
    """
    df, keys = _grouped(df, groups)
    w = F.col(weight) if weight else F.lit(1)
    cells = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg"))
    cells = materialise(cells, "replicates") if weight else cells
    r = running_totals(cells, keys, score, ["pos", "neg"])
    pos, neg, p, n = F.col("pos"), F.col("neg"), F.col("pos_total"), F.col("neg_total")
    caught, alarms = p - F.col("pos_before"), n - F.col("neg_before")
    wins = F.sum(pos * (F.col("neg_before") + neg / 2.0))
    gain = F.sum(F.when(pos > 0, pos * caught / (caught + alarms).cast("double")).otherwise(0.0))
    out = r.groupBy(*keys).agg(F.max(p).alias("positives"), F.max(n).alias("negatives"),
                               wins.alias("_wins"), gain.alias("_gain"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.select(*keys, "positives", "negatives",
                      F.when(both, F.col("_wins") / (F.col("positives").cast("double") * F.col("negatives"))).alias("roc_auc"),
                      F.when(F.col("positives") > 0, F.col("_gain") / F.col("positives")).alias("pr_auc")).drop(ALL)


def score_binary(df: DataFrame, groups: Sequence[str] = (), **names: str) -> DataFrame:
    counts, keys = _grouped(binary_metrics(df, groups, **names), groups)
    ranks, _ = _grouped(ranking_metrics(df, groups, **names), groups)
    return counts.join(ranks.select(*keys, "roc_auc", "pr_auc"), keys).drop(ALL)


def bootstrap_rows(df: DataFrame, seed: int, samples: int, key: str = "gpsno") -> DataFrame:
    """Every row with its own Poisson(1) weight in each replicate; zero weights are dropped before any shuffle."""
    drawn = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
    return drawn.withColumn("weight", poisson_one(seeded_hex(seed, "replicate", key))).where(F.col("weight") > 0)


def bootstrap_cells(df: DataFrame, seed: int, samples: int, cell: Sequence[str], key: str = "gpsno") -> DataFrame:
    """Replicate weights of cells: ``cell`` columns, ``replicate`` and ``weight`` (above 0).

    The n entities of a cell (equal in every column of ``cell``) weigh together as one Poisson(n) draw, so rows
    are bounded by the distinct cells and not by the entities.  The draw is keyed by the cell's smallest entity.
    The few cells are dealt to all partitions, since each becomes ``samples`` draws; by a hash, as dealing by the
    cell itself would be taken for the partitioning that the aggregate has, whose parts are put together again.
    """
    cells = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_key"))
    cells = cells.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cell))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
    weight = poisson_of(F.col("_n"), lambda *parts: seeded_hex(seed, "replicate", "_key", *parts))
    return drawn.withColumn("weight", weight).where(F.col("weight") > 0).drop("_n", "_key")


def interval(values: DataFrame, groups: Sequence[str], value: str, prefix: str) -> DataFrame:
    """95% interval of replicate values (at most ``samples`` per group)."""
    keep, keys = _grouped(values.where(F.col(value).isNotNull()), groups)
    q = metric_quantiles(keep, keys, value, {f"{prefix}_lower": 0.025, f"{prefix}_upper": 0.975})
    return q.withColumnRenamed("n_values", "valid_bootstraps").drop(ALL)


def auc_interval(df: DataFrame, groups: Sequence[str] = (), seed: int = 2026, samples: int = 1000,
                 key: str = "gpsno", **names: str) -> DataFrame:
    """Poisson bootstrap of the AUC, a draw for each row and replicate; replicates with one class are left out."""
    rows = bootstrap_rows(df, seed, samples, key)
    return interval(ranking_metrics(rows, [*groups, "replicate"], weight="weight", **names), groups, "roc_auc", "auc")


def pair_predictions(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Inner join on the entity with a label-equality flag."""
    return (current.select("gpsno", F.col("label").alias("label"), F.col("probability").alias("probability_new"))
            .join(prior.select("gpsno", F.col("label").alias("label_prior"),
                               F.col("probability").alias("probability_prior")), "gpsno")
            .withColumn("labels_agree", F.col("label") == F.col("label_prior")))


def _both_models(pair: DataFrame) -> DataFrame:
    models = F.explode(F.array(F.struct(F.lit("new").alias("model"), F.col("probability_new").alias("probability")),
                               F.struct(F.lit("prior").alias("model"), F.col("probability_prior").alias("probability"))))
    keep = [c for c in pair.columns if c not in ("probability_new", "probability_prior")]
    return pair.select(*keep, models.alias("_m")).select(*keep, "_m.*")


def _auc_by_model(auc: DataFrame, groups: Sequence[str]) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("roc_auc")))
    auc, keys = _grouped(auc, groups)
    return (auc.groupBy(*keys).agg(pick("new").alias("new_auc"), pick("prior").alias("prior_auc"))
            .withColumn("delta_auc", F.col("new_auc") - F.col("prior_auc")).drop(ALL))


def paired_auc(pair: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return _auc_by_model(ranking_metrics(_both_models(pair), [*groups, "model"]), groups)


def paired_interval(pair: DataFrame, seed: int = 2026, samples: int = 1000) -> DataFrame:
    """Interval of the AUC difference: both models share the weights of a replicate."""
    rows = _both_models(bootstrap_cells(pair, seed, samples, ["label", "probability_new", "probability_prior"]))
    delta = _auc_by_model(ranking_metrics(rows, ["replicate", "model"], weight="weight"), ["replicate"])
    return interval(delta, [], "delta_auc", "delta")


def ensemble_long(members: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation over members, keeping keys every member predicts."""
    tagged = [m.select(*keys, F.col(value), F.lit(i).alias("member")) for i, m in enumerate(members)]
    union = tagged[0]
    for m in tagged[1:]:
        union = union.unionByName(m)
    return (union.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.avg(value).alias(value),
                                     F.stddev_samp(value).alias(f"{value}_std"))
            .where(F.col("members") == len(members)))


def ensemble_join(members: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Member columns side by side and their mean (multi-way join on unique keys)."""
    names = [f"{value}_{i}" for i in range(len(members))]
    out = members[0].select(*keys, F.col(value).alias(names[0]))
    for name, m in zip(names[1:], members[1:]):
        out = out.join(m.select(*keys, F.col(value).alias(name)), list(keys))
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    return out.withColumn(value, mean)


def correlations(df: DataFrame, left: str, right: str, groups: Sequence[str] = ()) -> DataFrame:
    """Pearson, and Spearman on mid-ranks."""
    df, keys = _grouped(df, groups)
    a = rank_by_value(df, keys, left).withColumnRenamed("mid_rank", "_ra").drop("rank_asc", "rank_desc", "rank_pct")
    b = rank_by_value(a, keys, right).withColumnRenamed("mid_rank", "_rb")
    return b.groupBy(*keys).agg(F.corr(left, right).alias("pearson"), F.corr("_ra", "_rb").alias("spearman")).drop(ALL)


def overlap_share(df: DataFrame, risk: str, score: str, fraction: float, key: str = "gpsno") -> DataFrame:
    """Share of the top-risk entities that are also among the lowest scores."""
    top = top_fraction(df, risk, fraction, key).select(key)
    low = top_fraction(df, score, fraction, key, largest=False).select(key)
    both = top.join(low, key, "left_semi").agg(F.count(F.lit(1)).alias("_both"), F.lit(0).alias(ALL))
    size = df.agg(F.floor(F.count(F.lit(1)) * F.lit(float(fraction))).alias("selected"), F.lit(0).alias(ALL))
    return size.join(both, ALL).select(F.lit(float(fraction)).alias("fraction"), "selected",
                                       (F.col("_both") / F.col("selected")).alias("overlap"))


def share_by(df: DataFrame, groups: Sequence[str], **means: str) -> DataFrame:
    """Group summary with the share of the fleet; the total comes from the few group rows."""
    from pyspark.sql.window import Window
    out = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("vehicles"),
                                  *[F.avg(c).alias(n) for n, c in means.items()])
    return out.withColumn("share", F.col("vehicles") / F.sum("vehicles").over(Window.partitionBy(F.lit(0))))


def effect_gate(delta: Column, nonnegative_folds: Column, brier_change: Column, low: Column, high: Column) -> Column:
    """Accept a change only if it is positive, stable over folds, and not explained by noise."""
    noise = (delta < 0.01) & (low <= 0) & (high >= 0)
    return (delta > 0) & (nonnegative_folds >= 3) & (brier_change <= 0.005) & ~noise


def table_diff(official: DataFrame, reproduced: DataFrame, keys: Sequence[str], numbers: Sequence[str],
               classes: Sequence[str] = ()) -> DataFrame:
    """Full outer join: maximum absolute error, class mismatches and one-sided keys."""
    a = official.select(*keys, *[F.col(c).alias(f"{c}_a") for c in (*numbers, *classes)], F.lit(True).alias("_a"))
    b = reproduced.select(*keys, *[F.col(c).alias(f"{c}_b") for c in (*numbers, *classes)], F.lit(True).alias("_b"))
    joined = a.join(b, list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.agg(
        F.count_if(both).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_official"),
        F.count_if(F.col("_a").isNull()).alias("only_reproduced"),
        *[F.max(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))).alias(f"{c}_max_error") for c in numbers],
        *[F.count_if(both & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_mismatches") for c in classes])


def same_keys(left: DataFrame, right: DataFrame, key: str = "gpsno") -> DataFrame:
    """Keys on one side only, as counts (both zero when the populations are equal)."""
    a = left.select(key).exceptAll(right.select(key)).agg(F.count(F.lit(1)).alias("violations"))
    b = right.select(key).exceptAll(left.select(key)).agg(F.count(F.lit(1)).alias("violations"))
    return (a.select(F.lit("missing_right").alias("rule"), "violations")
            .unionByName(b.select(F.lit("missing_left").alias("rule"), "violations")))
