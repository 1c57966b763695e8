"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.registry import query
from telerisk.catalog.sqlmetrics import auc_sql, binary_sql
from telerisk.functions.columns import is_finite
from telerisk.operators import labels as L
from telerisk.operators import metrics as M
from telerisk.operators import quality
from telerisk.operators.scaling import long_features
from telerisk.session import shared_folder
from telerisk.sources import files


def write_text(df, columns, folder, **options):
    writer = (df.select(*columns).write.option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "")
              .option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.mode("errorifexists").csv(folder)
    return folder


def raw_event_files(spark, sf, purpose):
    return write_text(V.raw_events(spark, sf), codes.EVENT_COLUMNS, shared_folder(spark, purpose))


@query("s1_scan_text", Q.shape("""
    SELECT NULLIF(gpsno, '') AS gpsno, lat, lng, NULLIF(event_type, '') AS event_type, event_name, speed, start_time,
           TRUE AS has_source_file FROM raw""", ctes=Q.RAW))
def s1(spark, sf):
    raw = files.scan_tsv(spark, raw_event_files(spark, sf, "s1"), codes.EVENT_COLUMNS)
    return raw.select(*codes.EVENT_COLUMNS, (F.col("source_file") != "").alias("has_source_file"))


def imu_text(spark, sf):
    t = lambda c: F.col(c).cast("string")
    axes = [t(f"{k[0]}{a}").alias(f"{k}_{a}_raw") for k in ("accel", "gyro") for a in "xyz"]
    return V.imu(spark, sf).select("gpsno", "imei", t("ts").alias("data_time"), t("data_date").alias("data_date"),
                                   t("ems_speed").alias("ems_speed"), t("gps_speed").alias("gps_speed"), *axes)


@query("s2_scan_gzip", Q.shape("""
    SELECT gpsno, imei, COUNT(*) AS n, COUNT(ems_speed) AS with_ems, COUNT(ax) AS with_accel,
           SUM(CAST(gps_speed AS DOUBLE)) AS gps_total, SUM(ABS(ax)) AS accel_total
    FROM imu GROUP BY gpsno, imei""", ["gps_total", "accel_total"], ctes=Q.IMU))
def s2(spark, sf):
    folder = write_text(imu_text(spark, sf), codes.IMU_COLUMNS, shared_folder(spark, "s2"), compression="gzip")
    raw = files.scan_tsv(spark, folder, codes.IMU_COLUMNS)
    return raw.groupBy("gpsno", "imei").agg(
        F.count(F.lit(1)).alias("n"), F.count("ems_speed").alias("with_ems"), F.count("accel_x_raw").alias("with_accel"),
        F.sum(F.col("gps_speed").cast("double")).alias("gps_total"),
        F.sum(F.abs(F.col("accel_x_raw").cast("double"))).alias("accel_total"))


@query("s3_scan_many_parquet", """SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS distinct_events
    FROM (SELECT * FROM events UNION ALL SELECT * FROM events) u GROUP BY event_type""")
def s3(spark, sf):
    path = f"{sf}/events.parquet"
    return (files.scan_parquet(spark, path, path).groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("distinct_events")))


def profile_sheet(spark, sf):
    c = V.table(spark, sf, "customer")
    numbers = [(F.col("c_nationkey") * (i + 1) / 8.0).alias(n) for i, n in enumerate(codes.PROFILE_HEADER[2:])]
    return c.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0")).alias(codes.PROFILE_HEADER[0]),
                    F.concat(F.col("c_mktsegment"), F.lit(" ")).alias(codes.PROFILE_HEADER[1]), *numbers)


@query("s4_load_profile", "SELECT CAST(c_custkey AS VARCHAR) AS gpsno, c_mktsegment AS energy_type, " + ", ".join(
    f"c_nationkey * {i + 1} / 8.0::DOUBLE AS {n}" for i, n in enumerate(codes.PROFILE_COLUMNS[2:])) + " FROM customer")
def s4(spark, sf):
    return files.load_profile(profile_sheet(spark, sf))


@query("s7_parquet_sink", Q.shape("SELECT gpsno, day, event_total_count, event_total_episodes, event_other_count FROM event_daily",
                                  ctes=Q.EVENT_CTES, t=["day"]))
def s7(spark, sf):
    path = shared_folder(spark, "s7")
    df = V.event_daily(spark, sf).select("gpsno", "day", "event_total_count", "event_total_episodes", "event_other_count")
    files.write_parquet(df.repartition("day"), path, "day")
    return spark.read.parquet(path).select(*df.columns)


DELIVERY = """SELECT gpsno, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction, probability
    FROM predictions WHERE anchor_day = 20"""


@query("s8_delivery_csv", Q.shape(DELIVERY, ["probability"], ["prediction"], Q.PREDICTIONS))
def s8(spark, sf):
    path = shared_folder(spark, "s8")
    p = V.predictions(spark, sf).where("anchor_day = 20")
    files.write_delivery(p.withColumn("prediction", (F.col("probability") >= 0.5).cast("int")), path)
    return spark.read.option("header", True).schema("gpsno string, prediction int, probability double").csv(path)


EVENT_COUNTERS = """SELECT COUNT(*) AS raw_rows, COUNT(DISTINCT gpsno) AS raw_vehicles,
    COUNT(CASE WHEN gpsno = '' OR event_ts IS NULL OR event_type IS NULL THEN 1 END) AS invalid_key_or_time_rows,
    COUNT(CASE WHEN CAST(event_ts AS DATE) > DATE '2024-01-25' THEN 1 END) AS after_rule_end_rows,
    COUNT(CASE WHEN bad_lat OR bad_lng THEN 1 END) AS bad_coordinate_rows, COUNT(CASE WHEN bad_speed THEN 1 END) AS bad_speed_rows FROM canon"""


@query("s9_json_report", f"WITH {Q.RAW}, {Q.CANON} {EVENT_COUNTERS}")
def s9(spark, sf):
    from telerisk.sources.canon import canonical_events
    path = shared_folder(spark, "s9")
    report = quality.event_counters(canonical_events(V.raw_events(spark, sf)), "2024-01-25")
    files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("s10_incremental_ingest", """SELECT event_type AS event_name, COUNT(*) AS n FROM events GROUP BY event_type""")
def s10(spark, sf):
    """Two runs over a growing folder: the second run reads only the new parts."""
    from telerisk.sources.canon import canonical_events
    from telerisk.sources.ingest import Ingest
    folder, out = (shared_folder(spark, f"s10-{k}") for k in ("in", "out"))
    raw = V.raw_events(spark, sf)
    parse = lambda paths: canonical_events(files.scan_tsv(spark, list(paths), codes.EVENT_COLUMNS))
    for part in ("part-0", "part-1"):
        write_text(raw.where(F.col("source_file") == part), codes.EVENT_COLUMNS, f"{folder}/{part}")
        job = Ingest(spark, folder, out, parse, "part-*")
        job.run()
    rows = job.rows(parse([f"{folder}/part-1"]).schema)
    return rows.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


def bags(spark, sf):
    p = V.PERIOD
    return L.label_index(V.coverage(spark, sf), V.targets(spark, sf), p.anchors, p.final_anchor, p.first_day, p.horizon, p.lookback)


@query("s11_load_model_tables", Q.shape("""
    SELECT d.energy_type, COUNT(*) AS daily_rows, COUNT(DISTINCT gpsno) AS vehicles,
           SUM(distance_km) AS distance_km, SUM(COALESCE(event_total_count, 0)) AS events
    FROM daily d GROUP BY d.energy_type""", ["distance_km"], ["events"], Q.DAILY_CTES))
def s11(spark, sf):
    daily, _, profile = files.load_model_tables(V.daily(spark, sf), bags(spark, sf), V.profile(spark, sf),
                                                V.PERIOD.first_day, V.PERIOD.last_day)
    return (daily.join(profile.select("gpsno"), "gpsno").groupBy("energy_type")
            .agg(F.count(F.lit(1)).alias("daily_rows"), F.countDistinct("gpsno").alias("vehicles"),
                 F.sum("distance_km").alias("distance_km"), F.sum(F.coalesce("event_total_count", F.lit(0))).alias("events")))


def _family(name):
    return next(k for k, v in files.feature_families(V.MODEL_FEATURES).items() if name in v)


@query("s12_numeric_features", f"WITH {Q.DAILY_CTES} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{_family(f)}' AS family, COUNT({f}) AS observed FROM daily" for f in V.MODEL_FEATURES))
def s12(spark, sf):
    daily = V.daily(spark, sf).drop("day_index")
    features = files.numeric_features(daily)
    family = F.create_map(*[F.lit(x) for k, v in files.feature_families(features).items() for f in v for x in (f, k)])
    finite = daily.agg(*[F.count_if(is_finite(F.col(f).cast("double"))).alias(f) for f in features])  # the one row of counts is unpivoted
    return long_features(finite, [], features).select("feature", family[F.col("feature")].alias("family"), F.col("value").cast("long").alias("observed"))


@query("s13_read_predictions", Q.shape("SELECT gpsno, label, probability FROM predictions WHERE anchor_day = 20",
                                       ["probability"], ["label"], Q.PREDICTIONS))
def s13(spark, sf):
    path = shared_folder(spark, "s13")
    files.write_parquet(V.predictions(spark, sf), path)
    return files.read_predictions(spark, path, 20)


@query("s14_leaderboard", Q.shape(f"""
    SELECT 'run-' || CAST(r.fold AS VARCHAR) || '-' || CAST(r.anchor_day AS VARCHAR) AS run_id, '2024-01-31' AS created_utc,
           'landmark' AS model, 'split-' || CAST(r.anchor_day AS VARCHAR) AS split_version, 'fp' AS data_fingerprint,
           'v1' AS evaluation_version, r.roc_auc, b.accuracy AS accuracy_at_0_5, r.pr_auc, b.brier
    FROM ({auc_sql('predictions', ['fold', 'anchor_day'])}) r JOIN ({binary_sql('predictions', ['fold', 'anchor_day'])}) b
      USING (fold, anchor_day) WHERE r.fold <> 4""", ["roc_auc", "accuracy_at_0_5", "pr_auc", "brier"], ctes=Q.PREDICTIONS))
def s14(spark, sf):
    """Metrics and manifests of runs as JSON files, joined on run_id; unfinished runs are left out."""
    scores = M.score_binary(V.predictions(spark, sf), ["fold", "anchor_day"])
    run = F.concat_ws("-", F.lit("run"), F.col("fold").cast("string"), F.col("anchor_day").cast("string"))
    metrics = scores.select(run.alias("run_id"), "roc_auc", F.col("accuracy").alias("accuracy_at_0_5"), "pr_auc", "brier")
    manifests = scores.select(
        run.alias("run_id"), F.lit("2024-01-31").alias("created_utc"), F.lit("landmark").alias("model"),
        F.concat(F.lit("split-"), F.col("anchor_day").cast("string")).alias("split_version"),
        F.lit("fp").alias("data_fingerprint"), F.lit("v1").alias("evaluation_version"), F.lit("runs").alias("run_dir"),
        F.when(F.col("fold") == 4, "running").otherwise("completed").alias("status"))
    folder = shared_folder(spark, "s14")
    files.write_report(metrics, f"{folder}/metrics")
    files.write_report(manifests, f"{folder}/manifests")
    board = files.leaderboard(spark.read.schema(manifests.schema).json(f"{folder}/manifests"),
                              spark.read.schema(metrics.schema).json(f"{folder}/metrics"))
    return board.drop("run_dir")
