"""Sorts, top fractions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.joins import BAG_CTES, OUTCOME_CTES, outcomes
from telerisk.catalog.occlusion import IMPORTANCE_BY_AUC, OCCLUSION_CTES, occluded
from telerisk.catalog.registry import query
from telerisk.catalog.windows import REFERENCE, SPLIT, reference
from telerisk.operators import daily as D
from telerisk.operators import labels as L
from telerisk.operators import metrics as M
from telerisk.operators import quality, splits
from telerisk.operators.ordered import top_fraction
from telerisk.session import materialise


@query("o1_ordered_output", Q.shape("SELECT gpsno, event_ts, event_type FROM targets ORDER BY gpsno, event_ts", b=["event_type"],
                                    ctes=f"{Q.CLEAN}, {Q.TARGETS}", t=["event_ts"]))
def o1(spark, sf):
    return V.targets(spark, sf).orderBy("gpsno", "event_ts", "event_type")


_K = "CAST(FLOOR((SELECT COUNT(*) FROM at20) * {f}::DOUBLE) AS BIGINT)"
AT20 = "at20 AS (SELECT *, 100 - 100 * prior_probability AS safety_score FROM predictions WHERE anchor_day = 20)"


def overlap_sql(f):
    k = _K.format(f=f)
    return f"""SELECT {f}::DOUBLE AS fraction, {k} AS selected, COUNT(*) / CAST({k} AS DOUBLE) AS overlap
    FROM (SELECT gpsno FROM (SELECT gpsno, ROW_NUMBER() OVER (ORDER BY probability DESC, md5(gpsno)) AS r FROM at20) t WHERE r <= {k}) a
    JOIN (SELECT gpsno FROM (SELECT gpsno, ROW_NUMBER() OVER (ORDER BY safety_score, md5(gpsno)) AS r FROM at20) t WHERE r <= {k}) b USING (gpsno)"""


@query("o2_top_overlap", Q.shape(" UNION ALL ".join(overlap_sql(f) for f in (0.1, 0.2, 0.3)), ["fraction", "overlap"], ctes=f"{Q.PREDICTIONS}, {AT20}"))
def o2(spark, sf):
    p = V.predictions(spark, sf).where("anchor_day = 20").withColumn("safety_score", 100 - 100 * F.col("prior_probability"))
    return quality.union_all([M.overlap_share(p, "probability", "safety_score", f) for f in (0.1, 0.2, 0.3)])


@query("o2_top_fraction", Q.shape("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, ROW_NUMBER() OVER (
    ORDER BY l_extendedprice DESC, md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR))) AS r FROM lineitem) t
    WHERE r <= FLOOR((SELECT COUNT(*) FROM lineitem) * 0.2::DOUBLE)""", ["l_extendedprice"], ["l_linenumber"]))
def o2_fraction(spark, sf):
    li = V.table(spark, sf, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return top_fraction(li.withColumn("key", key), "l_extendedprice", 0.2, "key").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("o3_mixed_sort", Q.shape("""SELECT fold, anchor_day, COUNT(*) AS n, MAX(first_event_day) AS latest FROM predictions GROUP BY fold, anchor_day
    ORDER BY anchor_day ASC, latest DESC NULLS LAST""", b=["fold", "anchor_day", "latest"], ctes=Q.PREDICTIONS))
def o3(spark, sf):
    return (V.predictions(spark, sf).groupBy("fold", "anchor_day").agg(F.count(F.lit(1)).alias("n"), F.max("first_event_day").alias("latest"))
            .orderBy(F.col("anchor_day").asc(), F.col("latest").desc_nulls_last(), F.col("fold")))


@query("o4_two_descending_keys", Q.shape("""SELECT event_code, AVG(baseline_probability - masked_probability) AS mean_change,
    AVG(ABS(baseline_probability - masked_probability)) AS mean_abs_change FROM ablation GROUP BY event_code ORDER BY mean_change DESC, mean_abs_change DESC""",
    ["mean_change", "mean_abs_change"], ["event_code"], f"{OCCLUSION_CTES}, {Q.PREDICTIONS}, {IMPORTANCE_BY_AUC}"))
def o4(spark, sf):
    labels = V.predictions(spark, sf).where("anchor_day = 20").select("gpsno")
    delta = F.col("baseline_probability") - F.col("masked_probability")
    return (occluded(spark, sf).join(labels, "gpsno").groupBy("event_code")
            .agg(F.avg(delta).alias("mean_change"), F.avg(F.abs(delta)).alias("mean_abs_change"))
            .orderBy(F.col("mean_change").desc(), F.col("mean_abs_change").desc()))


@query("u1_union_of_folds", Q.shape("SELECT gpsno, anchor_day, fold, probability FROM predictions", ["probability"], ["anchor_day", "fold"], Q.PREDICTIONS))
def u1(spark, sf):
    p = V.predictions(spark, sf)
    return quality.union_all([p.where(F.col("fold") == k).select("gpsno", "anchor_day", "fold", "probability") for k in range(5)])


@query("u2_same_population", """WITH ids AS (SELECT CAST(c_custkey AS VARCHAR) AS gpsno FROM customer), seen AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS gpsno FROM orders)
    SELECT 'missing_right' AS rule, COUNT(*) AS violations FROM ids WHERE gpsno NOT IN (SELECT gpsno FROM seen)
    UNION ALL SELECT 'missing_left', COUNT(*) FROM seen WHERE gpsno NOT IN (SELECT gpsno FROM ids)""")
def u2(spark, sf):
    seen = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("gpsno")).dropDuplicates()
    return M.same_keys(V.profile(spark, sf).select("gpsno"), seen)


@query("u3_split_audit", f"""WITH {BAG_CTES}, {REFERENCE}, {SPLIT}
    SELECT 'unassigned' AS rule, COUNT(*) AS violations FROM reference WHERE gpsno NOT IN (SELECT gpsno FROM split)
    UNION ALL SELECT 'unknown_entity', COUNT(*) FROM split WHERE gpsno NOT IN (SELECT gpsno FROM reference)
    UNION ALL SELECT 'label_changed', COUNT(*) FROM split JOIN reference r USING (gpsno) WHERE split.label <> r.label
    UNION ALL SELECT 'development_without_fold', COUNT(*) FROM split WHERE part = 'development' AND fold IS NULL
    UNION ALL SELECT 'holdout_in_fold', COUNT(*) FROM split WHERE part = 'holdout' AND fold IS NOT NULL
    UNION ALL SELECT 'assigned_twice', COUNT(*) FROM (SELECT gpsno FROM split GROUP BY gpsno HAVING COUNT(*) > 1) t
    UNION ALL SELECT 'fold_missing_class', 5 - COUNT(*) FROM (SELECT fold FROM split WHERE fold IS NOT NULL GROUP BY fold HAVING COUNT(DISTINCT label) = 2) t""")
def u3(spark, sf):
    ref = materialise(reference(spark, sf), "reference")
    return splits.audit_split(ref, splits.stratified_split(ref, 2026, 5, 0.2), 5)


@query("u4_survival_rows", Q.shape("""SELECT gpsno, anchor_day, y, weight FROM (
    SELECT gpsno, anchor_day, 0 AS y, COALESCE(first_event_day - 1, horizon_days) / CAST(k AS DOUBLE) AS weight FROM (SELECT *, COUNT(*) OVER (PARTITION BY gpsno) AS k FROM outcomes) a
    UNION ALL SELECT gpsno, anchor_day, 1, 1.0::DOUBLE / k FROM (SELECT *, COUNT(*) OVER (PARTITION BY gpsno) AS k FROM outcomes) b WHERE first_event_day IS NOT NULL) u
    WHERE weight > 0""", ["weight"], ["anchor_day", "y"], OUTCOME_CTES))
def u4(spark, sf):
    return L.compress_outcomes(outcomes(spark, sf))


@query("u5_unpivot_codes", Q.shape("SELECT * FROM long_codes WHERE n > 0 OR episodes > 0", ["n", "episodes"], ["day_index", "event_code"],
                                   f"{Q.DAILY_CTES}, {Q.LONG_CODES}"))
def u5(spark, sf):
    return D.unpivot_codes(V.daily(spark, sf), codes.EVENT_CODES, only_active=True)
