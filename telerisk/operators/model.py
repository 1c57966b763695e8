"""Distributed risk models on landmark rows (Spark ML), out-of-fold scoring and occlusion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.functions.columns import clip, horizon_probability, is_finite, seeded_hex, signed_log
from telerisk.operators.scaling import feature_frame, fit_std_scaler
from telerisk.session import materialise

KEYS = ["gpsno", "anchor_day"]


def _sum(terms: Sequence[Column]) -> Column:
    """Sum in pairs, so that the expression stays shallow."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
    return terms[0]


def _curvature(rows: DataFrame, names: Sequence[str], at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the weighted log loss at intercept and coefficients ``at``: one pass, (features + 1)^2 numbers.

    ``rows`` holds the features and the weights ``w0`` and ``w1`` of both outcomes.  A row becomes one vector; the Gram
    matrix of all vectors holds the three.
    """
    eta = F.col("_eta")
    p, total = 1 / (1 + F.exp(-eta)), F.col("w0") + F.col("w1")
    loss = F.col("w0") * F.greatest(eta, F.lit(0.0)) + F.col("w1") * F.greatest(-eta, F.lit(0.0)) + total * F.log1p(F.exp(-F.abs(eta)))
    terms = [F.lit(float(at[0])), *[F.lit(float(b)) * F.col(n) for n, b in zip(names, at[1:]) if b]]
    scored = rows.withColumn("_eta", _sum(terms))
    scored = scored.select(*names, (total * p - F.col("w1")).alias("_off"), F.sqrt(loss).alias("_loss"),
                           F.sqrt(F.greatest(total * p * (1 - p), F.lit(1e-30))).alias("_root"))
    root = F.col("_root")
    vector = array_to_vector(F.array(root, *[root * F.col(n) for n in names], F.col("_off") / root, F.col("_loss"))).alias("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(scored.select(vector), "v"), 0, len(names) + 3).computeGramianMatrix().toArray()
    k = len(names) + 1
    return float(gram[-1, -1]), gram[:k, k], gram[:k, :k]


def _penalised_minimum(hessian: np.ndarray, linear: np.ndarray, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
    """The u with the least u'Hu / 2 - u'linear + l1 |u| + l2 u'u / 2; the first entry has no penalty.

    Coordinate descent finds which entries are zero; an active-set search over their signs ends at the exact minimum.
    """
    u, k = start.copy(), len(start)
    first, ridge = np.full(k, l1), np.full(k, l2)
    first[0] = ridge[0] = 0.0
    whole = hessian + np.diag(ridge)
    usable = np.diag(whole) > 0
    u[~usable] = 0.0
    for _ in range(20):
        left = linear - whole @ u
        for j in np.flatnonzero(usable).tolist() * 20:
            z = left[j] + whole[j, j] * u[j]
            new = np.sign(z) * max(abs(z) - first[j], 0.0) / whole[j, j]
            if new != u[j]:
                left -= whole[:, j] * (new - u[j])
                u[j] = new
        sign = np.sign(u)
        for _ in range(4 * k):
            active = np.flatnonzero(usable & ((sign != 0) | (np.arange(k) == 0)))
            best = np.zeros(k)
            best[active] = np.linalg.lstsq(whole[np.ix_(active, active)], linear[active] - first[active] * sign[active], rcond=None)[0]
            crossed = active[(first[active] > 0) & (best[active] * sign[active] < 0)]
            if len(crossed):  # go as far as the first entry that reaches zero, and leave it there
                share = u[crossed] / (u[crossed] - best[crossed])
                u = u + share.min() * (best - u)
                u[crossed[share.argmin()]] = sign[crossed[share.argmin()]] = 0.0
                continue
            u, slope = best, linear - whole @ best
            over = np.where(usable & (sign == 0) & (np.arange(k) > 0), np.abs(slope) - first, -1.0)
            if over.max(initial=-1.0) <= 1e-9 * max(l1, 1e-300):
                return u
            sign[over.argmax()] = np.sign(slope[over.argmax()])
    return u


@dataclass(frozen=True)
class HazardModel:
    """Elastic-net daily hazard: signed log, 1%..99% clip, median fill, missing flags, standardise."""

    columns: list[str]
    bounds: dict[str, tuple[float, float, float]]
    flagged: list[str]
    centre: list[float]
    factor: list[float]
    coefficients: list[float]
    intercept: float
    strength: float
    mixed: float

    @staticmethod
    def _base(df: DataFrame, columns: Sequence[str], bounds: Mapping[str, tuple], flagged: Sequence[str],
              keep: Sequence[str]) -> DataFrame:
        values, flags = [], []
        for c in columns:
            low, high, median = bounds[c]
            v = clip(signed_log(c), low, high)
            values.append(F.coalesce(v, F.lit(median)).alias(f"x_{c}"))
            if c in flagged:
                flags.append(v.isNull().cast("double").alias(f"m_{c}"))
        return df.select(*keep, *values, *flags)

    @classmethod
    def fit(cls, landmarks: DataFrame, compressed: DataFrame, columns: Sequence[str], c: float = 1.0,
            elastic: float = 0.2, max_iter: int = 100) -> "HazardModel":
        """``landmarks`` unique on (gpsno, anchor_day); ``compressed`` holds y and weight per landmark.

        Newton steps with the penalty: each takes one pass over the standardised rows, which are written once, and ends
        when every slope is within a thousandth of the penalty's own.  Only fitted parameters and the Hessian (one row
        per feature) come to the driver.
        """
        columns = list(columns)
        params = fit_std_scaler(landmarks, columns).collect()  # one row per feature
        rows = landmarks.count()
        bounds = {r["feature"]: (r["low"], r["high"], r["median"]) for r in params}
        seen = {r["feature"]: r["observed"] for r in params}
        flagged = [c for c in columns if seen[c] < rows]
        base = cls._base(landmarks, columns, bounds, flagged, KEYS)
        names = [n for n in base.columns if n not in KEYS]
        moments = base.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp))]).first()
        centre = [float(moments[f"mean_{n}"] or 0.0) for n in names]
        factor = [1.0 / moments[f"std_{n}"] if (moments[f"std_{n}"] or 0) > 0 else 0.0 for n in names]
        of = lambda y: F.sum(F.when(F.col("y") == y, F.col("weight")).otherwise(0.0)).cast("double").alias(f"w{y}")
        weights = compressed.groupBy(*KEYS).agg(of(0), of(1))
        train = materialise(base.join(weights, KEYS).select("w0", "w1", *[((F.col(n) - m) * f).alias(n) for n, m, f in zip(names, centre, factor)]), "fit-rows")
        weight = compressed.agg(F.sum("weight")).first()[0]
        w0, w1 = train.agg(F.sum("w0"), F.sum("w1")).first()
        strength = 1.0 / (c * weight)
        l1, l2 = strength * elastic, strength * (1 - elastic)
        at = np.zeros(len(names) + 1)
        if min(w0, w1) > 0:
            at[0] = np.log(w1 / w0)
            at = cls._descend(train, names, at, w0 + w1, l1, l2, max_iter)
        else:  # one outcome only
            at[0] = np.inf if w1 > 0 else -np.inf
        return cls(columns, bounds, flagged, centre, factor, at[1:].tolist(), float(at[0]), strength, elastic)

    @staticmethod
    def _descend(train: DataFrame, names: Sequence[str], at: np.ndarray, weight: float, l1: float, l2: float, max_iter: int) -> np.ndarray:
        def state(u):
            loss, slope, hessian = (x / weight for x in _curvature(train, names, u))
            return loss + l1 * np.abs(u[1:]).sum() + l2 / 2 * (u[1:] ** 2).sum(), slope, hessian

        value, slope, hessian = state(at)
        for _ in range(max_iter):
            full = slope + np.concatenate([[0.0], l2 * at[1:]])
            rest = np.where(at == 0, np.maximum(np.abs(full) - l1, 0.0), np.abs(full + l1 * np.sign(at)))
            rest[0] = abs(slope[0])
            if rest.max() <= 1e-3 * (l1 + l2):
                break
            goal = _penalised_minimum(hessian, hessian @ at - slope, l1, l2, at)
            for share in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001):
                new = at + share * (goal - at) if share < 1 else goal
                found = state(new)
                if found[0] <= value + 1e-13 * abs(value):
                    break
            else:
                break
            at, (value, slope, hessian) = new, found
        return at

    def _scaled(self) -> list[Column]:
        return [(F.col(n) - F.lit(m)) * F.lit(f) for n, m, f in zip(self.names(), self.centre, self.factor)]

    def _probability(self) -> Column:
        logit = _sum([F.lit(self.intercept), *[F.lit(b) * x for b, x in zip(self.coefficients, self._scaled()) if b]])
        return 1 / (1 + F.exp(-logit))

    def daily_hazard(self, landmarks: DataFrame, out: str = "daily_hazard") -> DataFrame:
        base = self._base(landmarks, self.columns, self.bounds, self.flagged, landmarks.columns)
        return base.select(*landmarks.columns, F.greatest(F.least(self._probability(), F.lit(1 - 1e-12)), F.lit(1e-12)).alias(out))

    def names(self) -> list[str]:
        return [f"x_{c}" for c in self.columns] + [f"m_{c}" for c in self.flagged]

    def parameters(self, spark) -> DataFrame:
        """One row per feature with all that its term of the logit takes, as ``feature_term`` reads it."""
        rows = {n: (m, f, w) for n, m, f, w in zip(self.names(), self.centre, self.factor, self.coefficients)}
        out = [(c, *map(float, self.bounds[c]), *rows[f"x_{c}"], *rows.get(f"m_{c}", (0.0, 0.0, 0.0))) for c in self.columns]
        return spark.createDataFrame(out, ", ".join(f"{n} {'string' if n == 'feature' else 'double'}" for n in PARAMETERS))

    def optimality(self, landmarks: DataFrame, compressed: DataFrame) -> DataFrame:
        """How far the fit is from the optimum of its own objective: ``feature``, ``coefficient``, ``residual``, ``allowed``.

        The residual is the gradient of the mean weighted loss with its penalty, at zero coefficients what of it the
        absolute penalty leaves; 0 for all features and the intercept means that no other coefficients are better.
        ``allowed`` is a hundredth of the penalty's own slope.
        """
        base = self._base(landmarks, self.columns, self.bounds, self.flagged, KEYS)
        names, x = self.names(), self._scaled()
        rows = base.withColumn("_p", self._probability()).join(compressed, KEYS).withColumn("_off", F.col("weight") * (F.col("_p") - F.col("y")))
        off = F.col("_off")
        sums = rows.agg(F.sum("weight").alias("w"), F.sum(off).alias("g"), *[F.sum(off * x[i]).alias(f"g{i}") for i in range(len(names))]).first()
        strength, mixed = self.strength, self.mixed
        out, allowed = [("(intercept)", self.intercept, abs(sums["g"]) / sums["w"])], 0.01 * strength
        for i, name in enumerate(names):
            beta = self.coefficients[i]
            slope = sums[f"g{i}"] / sums["w"] + strength * (1 - mixed) * beta
            rest = abs(slope + strength * mixed * (1 if beta > 0 else -1)) if beta else max(0.0, abs(slope) - strength * mixed)
            out.append((name, beta, float(rest)))
        return landmarks.sparkSession.createDataFrame([(*r, allowed) for r in out], "feature string, coefficient double, residual double, allowed double")


#: one row per feature: clip bounds and fill, then centre, 1 / spread and coefficient of the value and of its missing flag
PARAMETERS = ("feature", "low", "high", "median", "mean", "factor", "coefficient", "flag_mean", "flag_factor", "flag_coefficient")


def feature_term(value: str) -> Column:
    """What a feature's value adds to the logit, from the columns PARAMETERS beside it."""
    c = F.col
    v = clip(signed_log(value), c("low"), c("high"))
    own = c("coefficient") * (F.coalesce(v, c("median")) - c("mean")) * c("factor")
    return own + c("flag_coefficient") * (v.isNull().cast("double") - c("flag_mean")) * c("flag_factor")


def model_logits(long: DataFrame, parameters: DataFrame, intercept: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Logits of a fitted model from long (keys, feature, value) rows with every feature: one join, one aggregate."""
    rows = long.join(parameters, "feature")
    return rows.groupBy(*keys).agg((F.lit(float(intercept)) + F.sum(feature_term("value"))).alias("logit"))


def code_terms(masked: DataFrame, parameters: DataFrame) -> DataFrame:
    """What each code's events add to the logit: gpsno, anchor_day, event_code, term.

    ``masked`` holds the features with and without the code (``landmarks.without_code``); the model is scored
    again on both, not fitted again.
    """
    change = feature_term("value") - feature_term("masked")
    return masked.join(parameters, "feature").groupBy(*KEYS, "event_code").agg(F.sum(change).alias("term"))


def validation_share(key: str = "gpsno", seed: int = 2026, percent: int = 20) -> Column:
    """Marks about ``percent`` of the entities for validation, by the hash of their id."""
    return F.conv(F.substring(seeded_hex(seed, F.lit("validation"), key), 1, 8), 16, 10).cast("long") % 100 < percent


def boosted_pair(train: DataFrame, full: Sequence[str], fallback: Sequence[str], label: str = "label",
                 iterations: int = 400, depth: int = 4, step: float = 0.03, seed: int = 2026, validation: str | None = None,
                 tolerance: float = 1e-3) -> tuple[PipelineModel, PipelineModel]:
    """Gradient-boosted trees on all columns and on the columns usable without an event feed.

    Rows with ``validation`` true are not fitted: trees are added, up to ``iterations``, as long as the loss on
    those rows falls by more than ``tolerance`` of itself, and the best number of them is kept.
    """
    stop = {} if validation is None else {"validationIndicatorCol": validation, "validationTol": tolerance}

    def fit(columns: Sequence[str]) -> PipelineModel:
        filled = [f"f_{c}" for c in columns]
        stages = [Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
                  VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
                  GBTClassifier(featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth,
                                stepSize=step, seed=seed, **stop)]
        return Pipeline(stages=stages).fit(train)
    return fit(usable(train, full)), fit(usable(train, fallback))


def usable(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one finite value (an all-missing column has no median)."""
    row = train.agg(*[F.max(is_finite(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


def positive_probability(scored: DataFrame, keep: Sequence[str], out: str = "probability") -> DataFrame:
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def out_of_fold(rows: DataFrame, folds: int, fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Fit on the other folds, predict the held one, union all predictions.

    The folds' jobs run side by side: a fit takes thousands of short passes, which one after another leave cores idle.
    """
    one = lambda k: fit_predict(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linear_hazard(long: DataFrame, coefficients: DataFrame, intercept: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sigmoid of the weighted feature sum: scoring as one join and one aggregate."""
    terms = long.join(coefficients, "feature")
    logit = F.lit(intercept) + F.sum(F.col("value") * F.col("coefficient"))
    return terms.groupBy(*keys).agg(logit.alias("logit")).withColumn("daily_hazard", 1 / (1 + F.exp(-F.col("logit"))))


def occlusion(scores: DataFrame, terms: DataFrame, days: int, wanted: Sequence[int]) -> DataFrame:
    """Probability with and without the terms of each code.

    ``scores``: key columns and ``logit``; ``terms``: gpsno, event_code, term (only codes the
    entity has).  Codes without terms leave the probability unchanged.
    """
    grid = scores.select("*", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("event_code"))
    joined = grid.join(terms, ["gpsno", "event_code"], "left")
    term = F.coalesce("term", F.lit(0.0))
    hazard = lambda z: 1 / (1 + F.exp(-z))
    return joined.select(*scores.columns, "event_code", F.col("term").isNotNull().alias("active"),
                         horizon_probability(hazard(F.col("logit")), F.lit(days)).alias("baseline_probability"),
                         horizon_probability(hazard(F.col("logit") - term), F.lit(days)).alias("masked_probability"))


def sensitivity(occluded: DataFrame, code_name: Column, states: DataFrame) -> DataFrame:
    """Mean signed and absolute probability change per code, over active entities (or all if none)."""
    delta = F.col("baseline_probability") - F.col("masked_probability")
    on = F.col("active")
    any_on = F.count_if(on) > 0
    mean = lambda x: F.when(any_on, F.avg(F.when(on, x))).otherwise(F.avg(x))
    out = occluded.groupBy("event_code").agg(
        F.count_if(on).alias("active_vehicles"), mean(delta).alias("mean_signed_probability_delta"),
        mean(F.abs(delta)).alias("mean_abs_probability_delta"))
    return out.join(states.select("event_code", "state"), "event_code").select(
        "event_code", code_name.alias("event_name"), "state", "active_vehicles", "mean_signed_probability_delta",
        "mean_abs_probability_delta")


def route_probability(df: DataFrame, prior: Column) -> DataFrame:
    """Full model with a feed, fallback model with other evidence, else the prior; class at 0.5."""
    feed = F.col("has_event_feed")
    seen = (F.col("trajectory_coverage") > 0) | (F.col("imu_coverage") > 0)
    p = F.when(feed, F.col("full_probability")).when(seen, F.col("fallback_probability")).otherwise(prior)
    name = (F.when(feed, "full").when(seen, "fallback_no_matched_event_record")
            .otherwise("prior_no_observed_behavior"))
    return df.withColumn("route", name).withColumn("probability", p).withColumn(
        "prediction_at_0_5", (F.col("probability") >= 0.5).cast("int"))


def cumulative_segments(hazards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monotone cumulative probability over discrete segments, clamped away from 0 and 1."""
    w = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    p = 1 - F.exp(F.sum(F.log1p(-F.col("hazard"))).over(w))
    return hazards.withColumn("probability", F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))


__all__ = ["HazardModel", "PARAMETERS", "feature_term", "model_logits", "code_terms", "validation_share", "boosted_pair", "out_of_fold", "linear_hazard", "occlusion", "sensitivity", "feature_frame",
           "route_probability", "cumulative_segments", "positive_probability", "doubles", "usable"]
