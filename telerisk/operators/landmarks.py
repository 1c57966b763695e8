"""Landmark features: everything here reads only days up to and including the anchor.

Inputs are dense entity-day tables (``day_index`` 1..N), so a window per entity sorts at
most N rows and prefix frames answer all anchors at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from telerisk import codes
from telerisk.functions.columns import counted_sql, is_finite, ratio, sum_of, zero
from telerisk.operators.daily import unpivot_codes
from telerisk.operators.labels import group_active
from telerisk.session import large

def by_day() -> WindowSpec:
    return Window.partitionBy("gpsno").orderBy("day_index")


def history() -> WindowSpec:
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def last_days(n: int, skip: int = 0) -> WindowSpec:
    return by_day().rowsBetween(-(n + skip - 1), -skip)


# the same frames as SQL text, for the wide per-code features
_BY_DAY = "OVER (PARTITION BY gpsno ORDER BY day_index ROWS BETWEEN {} PRECEDING AND {})"
HISTORY = _BY_DAY.format("UNBOUNDED", "CURRENT ROW")
RECENT = _BY_DAY.format(6, "CURRENT ROW")
PREVIOUS = _BY_DAY.format(13, "7 PRECEDING")
KM = "if(abs(distance_km) < double('Infinity'), cast(distance_km as double), 0D)"
HOURS = "if(abs(drive_hours) < double('Infinity'), cast(drive_hours as double), 0D)"


def total(c: Column | str, frame: WindowSpec | None = None) -> Column:
    return F.sum(zero(c)).over(frame or history())


def landmark_summary(daily: DataFrame, anchors: Sequence[int],
                     event_fields: Sequence[str] = codes.LANDMARK_EVENT_FIELDS,
                     recency_codes: Sequence[int] = codes.TARGET_CODES) -> DataFrame:
    """Exposure, quality, motion and event features of each (entity, anchor day)."""
    t = F.col("day_index")
    recent, previous = last_days(7), last_days(7, skip=7)
    share = lambda c: F.avg(F.coalesce(F.col(c).cast("int"), F.lit(0))).over(history())
    mean = lambda c, frame: F.avg(F.when(is_finite(F.col(c).cast("double")), F.col(c))).over(frame)
    step = lambda c: (total(c, recent) - F.coalesce(total(c, previous), F.lit(0.0))) / 7
    km = total("distance_km")
    bad, good = total("distance_invalid_rows"), total("distance_valid_rows")
    features = {
        "exposure_km_per_day": km / t,
        "exposure_hours_per_day": total("drive_hours") / t,
        "exposure_driving_fraction": F.avg((zero("distance_km") > 0).cast("int")).over(history()),
        "exposure_trajectory_fraction": share("trajectory_recorded_today"),
        "exposure_imu_fraction": share("imu_recorded_today"),
        "exposure_night_share": ratio(total("night_distance_km"), km),
        "exposure_km_recent7": total("distance_km", recent) / 7,
        "exposure_hours_recent7": total("drive_hours", recent) / 7,
        "exposure_km_delta7": step("distance_km"),
        "exposure_hours_delta7": step("drive_hours"),
        "quality_invalid_distance_share": ratio(bad, bad + good),
        "quality_long_gap_per_day": total("long_gap_rows") / t,
        "imu_accel_peak_mean": mean("imu_accel_peak_p99", history()),
        "imu_gyro_peak_mean": mean("imu_gyro_peak", history()),
        "imu_accel_recent7": mean("imu_accel_peak_p99", recent),
        "imu_accel_delta7": mean("imu_accel_peak_p99", recent) - mean("imu_accel_peak_p99", previous),
        "imu_valid_windows_per_day": total("imu_valid_windows") / t,
    }
    for f in event_fields:
        n = counted_sql(f)
        features[f"{f}_per_day"] = F.expr(f"sum({n}) {HISTORY} / day_index")
        features[f"{f}_per_100km"] = F.expr(f"if(sum({KM}) {HISTORY} > 0, 100 * sum({n}) {HISTORY} / sum({KM}) {HISTORY}, null)")
        features[f"{f}_recent7_per_day"] = F.expr(f"sum({n}) {RECENT} / 7")
        features[f"{f}_delta7_per_day"] = F.expr(f"(sum({n}) {RECENT} - coalesce(sum({n}) {PREVIOUS}, 0D)) / 7")
    for c in recency_codes:
        features[f"event_{c}_recency_days"] = F.expr(
            f"cast(day_index - max(if(event_{c}_count > 0, day_index, null)) {HISTORY} as double)")
    return (daily.select("gpsno", t.alias("anchor_day"), *[e.alias(n) for n, e in features.items()])
            .where(F.col("anchor_day").isin(*anchors)))


def code_dependencies(wanted: Sequence[int] = codes.EVENT_CODES, event_fields: Sequence[str] = codes.LANDMARK_EVENT_FIELDS,
                      recency_codes: Sequence[int] = codes.TARGET_CODES) -> list[tuple[int, str, str, str]]:
    """(event code, landmark feature, measure, form) of every feature that changes when a code's events are taken away.

    ``measure`` is what of the code enters the feature (count or episode); ``form`` is how.
    """
    out = []
    for c in wanted:
        for f in event_fields:
            own = {f"event_{c}_count": "count", f"event_{c}_episodes": "episode", "event_total_count": "count", "event_total_episodes": "episode"}
            if f in own:
                out += [(c, f"{f}_{form}", own[f], form) for form in ("per_day", "per_100km", "recent7_per_day", "delta7_per_day")]
        if c in recency_codes:
            out.append((c, f"event_{c}_recency_days", "count", "recency_days"))
    return out


def without_code(daily: DataFrame, landmarks: DataFrame, anchors: Sequence[int], wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    """Landmark features as they would be without one code: gpsno, anchor_day, event_code, feature, value, masked.

    One row for each feature that depends on a code the entity has had by the anchor.  All of them are linear in the
    code's counts, but for the recency, which is unknown without the code; so they come from the sums of the active
    code-days, and no entity-day is built again.
    """
    spark = daily.sparkSession
    items = code_dependencies(wanted)
    features = list(dict.fromkeys(f for _, f, _, _ in items))
    table = spark.createDataFrame(items, "event_code int, feature string, measure string, form string")
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    km = F.col("exposure_km_per_day") * F.col("anchor_day")
    known = landmarks.select("gpsno", "anchor_day", km.alias("_km"), values.alias("_values"))
    sums = code_totals(active_code_days(daily, wanted), anchors)
    rows = sums.join(large(known), ["gpsno", "anchor_day"]).join(F.broadcast(table), "event_code")  # a fixed table of a few hundred rows
    take = lambda span: F.when(F.col("measure") == "count", F.col(f"count_{span}")).otherwise(F.col(f"episode_{span}"))
    value, form = F.element_at("_values", F.col("feature")), F.col("form")
    less = (F.when(form == "per_day", take("total") / F.col("anchor_day")).when(form == "per_100km", 100 * take("total") / F.col("_km"))
            .when(form == "recent7_per_day", take("recent7") / 7).when(form == "delta7_per_day", (take("recent7") - take("previous7")) / 7))
    return rows.select("gpsno", "anchor_day", "event_code", "feature", value.alias("value"), (value - less).alias("masked"))


def landmark_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(all features, features usable without an event feed)."""
    full = [c for c in df.columns if c not in ("gpsno", "anchor_day")]
    return full, [c for c in full if not c.startswith("event_")]


def window_features(daily: DataFrame, anchors: Sequence[int], windows: Sequence[int] = (7, 14, 20),
                    event_fields: Sequence[str] = codes.WINDOW_EVENT_FIELDS, near_miss_code: int = 11804) -> DataFrame:
    """Per-window features in which "no feed" is NULL and "feed, no event" is a true zero."""
    t = F.col("day_index")
    feed = F.coalesce(F.col("has_event_feed"), F.lit(False))
    moved = F.coalesce(F.col("trajectory_recorded_today"), F.lit(False)).cast("int")
    near = F.when(feed, F.col(f"event_{near_miss_code}_count"))
    out = [F.coalesce(F.col("has_event_feed"), F.lit(False)).cast("int").alias("event_feed_at_anchor"),
           F.coalesce(F.col("has_trajectory"), F.lit(False)).cast("int").alias("trajectory_at_anchor")]
    for w in windows:
        frame = last_days(w)
        km, hours = F.sum("distance_km").over(frame), F.sum("drive_hours").over(frame)
        days, feeds = F.sum(moved).over(frame), F.sum(feed.cast("int")).over(frame)
        out += [days.alias(f"trajectory_recorded_days_{w}"), km.alias(f"distance_km_{w}"),
                hours.alias(f"drive_hours_{w}"), (km / w).alias(f"km_per_calendar_day_{w}"),
                (hours / w).alias(f"hours_per_calendar_day_{w}"), ratio(km, days).alias(f"km_per_recorded_day_{w}"),
                feeds.alias(f"event_feed_days_{w}")]
        for f in event_fields:
            n = F.sum(F.when(feed, F.col(f).cast("double"))).over(frame)
            out += [n.alias(f"{f}_{w}"), ratio(n, km, 100.0).alias(f"{f}_per_100km_{w}"),
                    ratio(n, hours).alias(f"{f}_per_hour_{w}")]
        hit_days = F.sum(F.when(near > 0, 1).otherwise(0)).over(frame)
        out += [F.when(feeds > 0, hit_days).alias(f"near_miss_days_{w}"),
                (t - F.max(F.when(near > 0, t)).over(frame)).alias(f"near_miss_recency_{w}")]
    change = lambda c: F.sum(c).over(last_days(7)) - F.sum(c).over(last_days(7, skip=7))
    out += [change("distance_km").alias("distance_change_7d"), change("drive_hours").alias("hours_change_7d")]
    return daily.select("gpsno", t.alias("anchor_day"), *out).where(F.col("anchor_day").isin(*anchors))


def window_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    full = [c for c in df.columns if c not in ("gpsno", "anchor_day", "anchor_date")]
    return full, [c for c in full if not c.startswith(("event_", "near_miss_"))]


def anchors_from(day: Column | str, anchors: Sequence[int]) -> Column:
    """The anchors that may see a given day."""
    d = F.col(day) if isinstance(day, str) else day
    return F.filter(F.array(*[F.lit(a) for a in anchors]), lambda a: a >= d)


def landmark_grid(entities: DataFrame, anchors: Sequence[int]) -> DataFrame:
    return entities.select("gpsno", F.explode(F.array(*[F.lit(a) for a in anchors])).alias("anchor_day"))


def exposure_totals(daily: DataFrame, anchors: Sequence[int]) -> DataFrame:
    """Non-negative distance/time sums and coverage shares of each (entity, anchor)."""
    share = lambda c: F.avg(F.coalesce(F.col(c).cast("int"), F.lit(0))).over(history())
    signals = [F.col(c).cast("double") for c in codes.IMU_SIGNALS]
    logs = sum_of([F.when(is_finite(s), F.log1p(F.abs(s))).otherwise(0.0) for s in signals])
    cells = sum_of([F.when(is_finite(s), 1.0).otherwise(0.0) for s in signals])
    clipped = lambda c: F.sum(F.greatest(zero(c), F.lit(0.0))).over(history())
    return (daily.select("gpsno", F.col("day_index").alias("anchor_day"),
                         clipped("distance_km").alias("km"), clipped("drive_hours").alias("hours"),
                         share("trajectory_recorded_today").alias("trajectory_coverage"),
                         share("imu_recorded_today").alias("imu_coverage"),
                         (F.sum(logs).over(history()) / F.greatest(F.sum(cells).over(history()), F.lit(1.0))).alias("control_imu"))
            .where(F.col("anchor_day").isin(*anchors)))


def active_code_days(daily: DataFrame, wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    return unpivot_codes(daily, wanted, only_active=True)


def code_totals(active: DataFrame, anchors: Sequence[int], recent_days: int = 14) -> DataFrame:
    """History sums per (entity, code, anchor) from the active code-days only."""
    d, t = F.col("day_index"), F.col("anchor_day")
    back = t - d
    n, e = F.col("n"), F.col("episodes")
    pick = lambda value, lo, hi: F.sum(F.when(back.between(lo, hi), value).otherwise(0.0))
    return (active.select("*", F.explode(anchors_from("day_index", anchors)).alias("anchor_day"))
            .groupBy("gpsno", "event_code", "anchor_day").agg(
                F.sum(n).alias("count_total"), F.sum(e).alias("episode_total"),
                pick(e, 0, 6).alias("episode_recent7"), pick(e, 7, 13).alias("episode_previous7"),
                pick(n, 0, 6).alias("count_recent7"), pick(n, 7, 13).alias("count_previous7"),
                pick(n, 0, recent_days - 1).alias("count_recent"),
                F.count_if(n > 0).alias("active_days"),
                F.max(F.when(n > 0, d)).alias("last_count_day"), F.max(F.when(e > 0, d)).alias("last_episode_day")))


def code_landmarks(daily: DataFrame, anchors: Sequence[int], wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    """Nine metrics of every (entity, anchor, code), dense and long."""
    sums = code_totals(active_code_days(daily, wanted), anchors)
    km = exposure_totals(daily, anchors).select("gpsno", "anchor_day", "km")
    grid = km.select("*", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("event_code"))
    t = F.col("anchor_day")
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (grid.join(sums, ["gpsno", "event_code", "anchor_day"], "left").select(
        "gpsno", "anchor_day", "event_code",
        (v("episode_total") / t).alias("episodes_per_day"),
        (100 * v("episode_total") / (F.col("km") + 100)).alias("episodes_per_100km"),
        (v("episode_recent7") / 7).alias("recent7_per_day"), (v("episode_previous7") / 7).alias("previous7_per_day"),
        F.coalesce(F.exp(-(t - F.col("last_episode_day")) / 14.0), F.lit(0.0)).alias("recency_proximity"),
        (v("count_total") / t).alias("counts_per_day"),
        F.when(F.col("km") > 0, 100 * v("count_total") / F.col("km")).otherwise(0.0).alias("counts_per_100km"),
        (v("count_recent7") / 7).alias("counts_recent7_per_day"),
        (v("count_previous7") / 7).alias("counts_previous7_per_day")))


def code_landmarks_wide(long: DataFrame, wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    """One row per (entity, anchor) with ``event_{code}_{metric}`` columns."""
    picks = [F.expr(f"max(if(event_code = {c}, {m}, null)) AS event_{c}_{m}") for c in wanted for m in codes.CODE_METRICS]
    return long.groupBy("gpsno", "anchor_day").agg(*picks)


def role_landmarks(daily: DataFrame, anchors: Sequence[int],
                   roles: Mapping[str, Sequence[int]] = codes.ROLES) -> DataFrame:
    """Ten measures per role; a code-level prefix tells which types were ever active."""
    km, hours = f"sum({KM}) {HISTORY}", f"sum({HOURS}) {HISTORY}"
    rate = lambda top, bottom: f"if({bottom} > 0, 100 * {top} / {bottom}, null)"
    out = []
    for role, members in roles.items():
        add = lambda kind: "(" + " + ".join(counted_sql(f"event_{c}_{kind}") for c in members) + ")"
        n, e = add("count"), add("episodes")
        all_n, all_e = f"sum({n}) {HISTORY}", f"sum({e}) {HISTORY}"
        near, old = f"sum({n}) {RECENT}", f"coalesce(sum({n}) {PREVIOUS}, 0D)"
        types = " + ".join(f"if(max(event_{c}_count) {HISTORY} > 0, 1D, 0D)" for c in members)
        last = f"max(if({e} > 0, day_index, null)) {HISTORY}"
        measures = {"count_per_day": f"{all_n} / day_index", "count_per_100km": rate(all_n, km),
                    "count_per_100hours": rate(all_n, hours), "episodes_per_day": f"{all_e} / day_index",
                    "episodes_per_100km": rate(all_e, km), "recent7_per_day": f"{near} / 7",
                    "previous7_per_day": f"{old} / 7", "delta7_per_day": f"({near} - {old}) / 7",
                    "active_type_fraction": f"({types}) / {len(members)}",
                    "recency_proximity": f"coalesce(1D / (1 + day_index - {last}), 0D)"}
        out += [f"{text} AS role_{role}_{name}" for name, text in measures.items()]
    return daily.selectExpr("gpsno", "day_index AS anchor_day", *out).where(F.col("anchor_day").isin(*anchors))


def chain_landmarks(daily: DataFrame, anchors: Sequence[int], chains: Mapping[str, tuple] = codes.CHAINS,
                    lags: tuple[int, int] = (3, 7)) -> DataFrame:
    """Same-day co-occurrence and directed follow-up of each chain, dense and long.

    The next target day after each source day is found once; an anchor accepts it only if it
    lies inside both the lag and the history.
    """
    ahead = by_day().rowsBetween(1, Window.unboundedFollowing)
    d = F.col("day_index")
    items = [F.struct(F.lit(name).alias("chain"), group_active(src).alias("src"), group_active(dst).alias("dst"),
                      F.min(F.when(group_active(dst), d)).over(ahead).alias("next"))
             for name, (src, dst) in chains.items()]
    source_days = (daily.select("gpsno", "day_index", F.array(*items).alias("_c"))
                   .select("gpsno", "day_index", F.explode(F.filter("_c", lambda x: x["src"])).alias("_x"))
                   .select("gpsno", "day_index", "_x.*"))
    t = F.col("anchor_day")
    within = lambda lag: F.count_if(F.col("next") <= F.least(d + lag, t))
    sums = (source_days.select("*", F.explode(anchors_from("day_index", anchors)).alias("anchor_day"))
            .groupBy("gpsno", "anchor_day", "chain").agg(
                F.count(F.lit(1)).alias("source_days"), F.count_if(F.col("dst")).alias("both_days"),
                within(lags[0]).alias("near"), within(lags[1]).alias("far")))
    grid = (daily.where(d.isin(*anchors)).select(
        "gpsno", d.alias("anchor_day"), F.explode(F.array(*[F.lit(c) for c in chains])).alias("chain")))
    v = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    share = lambda c: v(c) / F.greatest(v("source_days"), F.lit(1.0))
    return grid.join(sums, ["gpsno", "anchor_day", "chain"], "left").select(
        "gpsno", "anchor_day", "chain", (v("both_days") / t).alias("cooccur_per_day"),
        share("both_days").alias("cooccur_given_source"),
        share("near").alias(f"within{lags[0]}_given_source"), share("far").alias(f"within{lags[1]}_given_source"))


def chain_landmarks_wide(long: DataFrame, chains: Mapping[str, tuple] = codes.CHAINS,
                         lags: tuple[int, int] = (3, 7)) -> DataFrame:
    names = {"cooccur_per_day": "cooccur_{}_per_day", "cooccur_given_source": "cooccur_{}_given_source",
             f"within{lags[0]}_given_source": "chain_{}_within%d_given_source" % lags[0],
             f"within{lags[1]}_given_source": "chain_{}_within%d_given_source" % lags[1]}
    picks = [F.max(F.when(F.col("chain") == c, F.col(m))).alias(n.format(c)) for c in chains for m, n in names.items()]
    return long.groupBy("gpsno", "anchor_day").agg(*picks)


def causal_landmarks(daily: DataFrame, anchors: Sequence[int]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Base features plus roles, co-occurrence and chains, with the nested feature sets."""
    keys = ["gpsno", "anchor_day"]
    base = landmark_summary(daily, anchors)
    df = (base.join(role_landmarks(daily, anchors), keys, "left")
          .join(chain_landmarks_wide(chain_landmarks(daily, anchors)), keys, "left"))
    return df, nested_feature_sets(df.columns, landmark_columns(base)[0])


def nested_feature_sets(columns: Sequence[str], base: Sequence[str]) -> dict[str, list[str]]:
    pick = lambda p: [c for c in columns if c.startswith(p)]
    sets, so_far = {}, list(base)
    sets["base"] = list(so_far)
    for name, prefix in (("roles", "role_"), ("cooccurrence", "cooccur_"), ("directed_chains", "chain_")):
        so_far = so_far + pick(prefix)
        sets[name] = list(so_far)
    return sets


def longest_streak(daily: DataFrame, active: Column) -> DataFrame:
    """Longest run of consecutive active days up to each day."""
    d = F.col("day_index")
    flagged = daily.select("gpsno", "day_index", active.cast("int").alias("active"))
    quiet = F.coalesce(F.max(F.when(F.col("active") == 0, d)).over(history()), F.lit(0))
    run = flagged.withColumn("run", F.when(F.col("active") == 1, d - quiet).otherwise(0))
    return run.select("gpsno", "day_index", "active", F.max("run").over(history()).alias("streak"))
