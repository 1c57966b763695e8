"""Dimension tables of the fleet-risk domain.

Everything here is configuration: operators take these values as arguments, so the same
operators serve any event log.  The values are fixed because results depend on them.
"""

from __future__ import annotations

# --- fixed values: raw column layouts -------------------------------------------------
EVENT_COLUMNS = ("gpsno", "lat", "lng", "event_type", "event_name", "speed", "start_time")
TRAJECTORY_COLUMNS = ("gpsno", "distance", "run_time", "trigger_time", "speed", "course", "lat", "lng")
IMU_COLUMNS = (
    "gpsno", "imei", "data_time", "data_date", "ems_speed", "gps_speed",
    "accel_x_raw", "accel_y_raw", "accel_z_raw", "gyro_x_raw", "gyro_y_raw", "gyro_z_raw",
)
PROFILE_HEADER = (
    "设备号", "能源类型", "月均行驶里程", "月均行驶时长", "月平均停留次数",
    "高速里程占比", "早晨行驶时长占比", "黄昏行驶时长占比", "夜间里程占比", "夜间行驶时长占比",
)
PROFILE_COLUMNS = (
    "gpsno", "energy_type", "monthly_km", "monthly_drive_hours", "monthly_stops",
    "highway_km_share", "morning_hours_share", "dusk_hours_share",
    "night_km_share", "night_hours_share",
)

# --- fixed values: event codes and their names ----------------------------------------
EVENT_NAMES = {
    11401: "路口超速",
    11402: "主路弯道超速",
    11403: "危险路段超速报警",
    11405: "匝道超速",
    11406: "高速长下坡超速",
    30000: "前碰撞预警",
    30002: "左车道偏移",
    30003: "右车道偏移",
    30005: "车距过近",
    30017: "长时间压线",
    41001: "疲劳（闭眼）",
    41002: "打哈欠",
    41003: "注意力分散",
    41004: "打电话",
    41005: "抽烟",
    41006: "摄像头遮挡",
    41009: "频繁低头",
    41021: "摄像头角度扭转",
    41023: "看手机",
    41029: "困倦",
    60292: "后盲区报警",
    60294: "右盲区报警",
    11803: "事故",
    11804: "未遂事故",
}
EVENT_CODES = tuple(EVENT_NAMES)
TARGET_CODES = (11803, 11804)
QUALITY_CODES = (41006, 41021)

# --- fixed values: code groups --------------------------------------------------------
FAMILIES = {
    "speed": (11401, 11402, 11403, 11405, 11406),
    "proximity_lane": (30000, 30002, 30003, 30005, 30017),
    "fatigue_distraction": (41001, 41002, 41003, 41004, 41005, 41009, 41023, 41029),
    "blind_spot": (60292, 60294),
    "history_target": (11803, 11804),
    "device_quality": (41006, 41021),
}
ROLES = {
    "severe": (11803, 11804),
    "proximal": (30000, 30005),
    "dangerous": (11401, 11402, 11403, 11405, 11406, 41001, 41003, 41023, 41029),
    "control": (30002, 30003, 30017, 41002, 41004, 41005, 41009),
    "environment": (60292, 60294),
    "quality": (41006, 41021),
}
CHAINS = {
    "fatigue_to_control": ((41001, 41002, 41029), (30002, 30003, 30017)),
    "distraction_to_control": ((41003, 41004, 41009, 41023), (30002, 30003, 30017)),
    "speed_to_proximity": ((11401, 11402, 11403, 11405, 11406), (30000, 30005)),
    "close_to_fcw": ((30005,), (30000,)),
    "control_to_severe": ((30002, 30003, 30017), (11803, 11804)),
}
STATES = {
    "exposure": (60292, 60294),
    "upstream": (11401, 11402, 11403, 11405, 11406, 41001, 41003, 41023, 41029),
    "control": (30002, 30003, 30017, 41002, 41004, 41005, 41009),
    "proximal": (30000, 30005),
    "history": (11803, 11804),
    "quality": (41006, 41021),
}
CHAIN_STATES = ("upstream", "control", "proximal")
AUX_GROUPS = {
    "control": (30002, 30003, 30017, 41002, 41004, 41005, 41009),
    "proximal": (30000, 30005),
    "severe": (11803, 11804),
}
DIMENSIONS = {
    "history": (11803, 11804),
    "collision": (30000, 30005, 60292, 60294),
    "attention": (41001, 41002, 41003, 41004, 41005, 41009, 41023, 41029),
    "speed": (11401, 11402, 11403, 11405, 11406),
    "control": (30002, 30003, 30017),
}
STATE_CONTEXT = {
    "exposure": ("distance_km", "drive_hours", "night_distance_km", "trip_starts",
                 "speed_p50", "speed_p90"),
    "control": ("speed_change_p90", "turn_rate_p90", "imu_valid_windows", "imu_accel_peak_p99",
                "imu_accel_variability_p90", "imu_gyro_peak"),
    "quality": ("distance_invalid_rows", "long_gap_rows", "trajectory_recorded_today",
                "imu_recorded_today", "observed_stationary_day"),
}
STATE_MASK_PROBABILITY = {
    "exposure": 0.15, "upstream": 0.23, "control": 0.22,
    "proximal": 0.18, "history": 0.05, "quality": 0.17,
}

# --- fixed values: feature columns ----------------------------------------------------
LANDMARK_DAYS = (14, 20, 30, 40, 50, 53)
SEQUENCE_ANCHORS = (20, 30, 39, 46, 53)
LABEL_HORIZONS = (7, 14, 21, 30, 40)
LANDMARK_EVENT_FIELDS = (
    "event_11803_count", "event_11804_count", "event_11401_count",
    "event_11402_count", "event_11403_count", "event_30000_count",
    "event_30002_count", "event_30003_count", "event_total_episodes",
)
CONTEXT_FEATURES = (
    "exposure_km_per_day", "exposure_hours_per_day", "exposure_driving_fraction",
    "exposure_trajectory_fraction", "exposure_imu_fraction", "exposure_night_share",
    "exposure_km_recent7", "exposure_hours_recent7", "exposure_km_delta7",
    "exposure_hours_delta7", "quality_invalid_distance_share", "quality_long_gap_per_day",
    "imu_accel_peak_mean", "imu_gyro_peak_mean", "imu_accel_recent7", "imu_accel_delta7",
    "imu_valid_windows_per_day",
)
CODE_METRICS = (
    "episodes_per_day", "episodes_per_100km", "recent7_per_day", "previous7_per_day",
    "recency_proximity", "counts_per_day", "counts_per_100km", "counts_recent7_per_day",
    "counts_previous7_per_day",
)
WINDOW_EVENT_FIELDS = (
    "event_11804_count", "event_11803_count", "event_total_count", "event_total_episodes",
)
DAY_NUMERIC = (
    "distance_km", "drive_hours", "night_distance_km", "trip_starts",
    "speed_p50", "speed_p90", "speed_change_p90", "turn_rate_p90",
    "imu_valid_windows", "imu_accel_peak_p99", "imu_accel_variability_p90",
    "imu_gyro_peak", "distance_invalid_rows", "long_gap_rows",
)
DAY_QUALITY = ("trajectory_recorded_today", "imu_recorded_today", "observed_stationary_day")
IMU_SIGNALS = ("imu_accel_peak_p99", "imu_accel_variability_p90", "imu_gyro_peak")

# --- fixed values: scorecards ---------------------------------------------------------
SCORE_A_POINTS = {
    "model": 50.0, "upstream": 14.0, "control": 10.0,
    "proximal": 10.0, "history": 12.0, "quality": 4.0,
}
SCORE_A_LABELS = {
    "model": "V12未来风险", "upstream": "危险驾驶行为", "control": "车辆控制稳定性",
    "proximal": "近端险情", "history": "事故与未遂历史", "quality": "管理配合度",
}
SCORE_A_GRADES = (
    ("A", 85.0, "低风险", "保持常规月度复盘，可纳入安全激励"),
    ("B", 75.0, "较低风险", "每周反馈主要扣分项，保持常规管理"),
    ("C", 65.0, "中风险", "安排针对性培训，两周后复评"),
    ("D", 50.0, "高风险", "24小时内人工复核，进行专项培训和重点监控"),
    ("E", None, "极高风险", "立即人工核查，暂停高风险任务并制定整改计划"),
)
SCORE_A_UNRATED = ("U", "证据不足", "检查事件源、轨迹和IMU设备；补齐数据前暂缓奖惩")
SCORE_A_EVIDENCE = (0.60, 0.30, 0.10)
SCORE_B_POINTS = {
    "history": 30.0, "collision": 20.0, "attention": 15.0,
    "speed": 15.0, "control": 15.0, "trend": 5.0,
}
SCORE_B_LABELS = {
    "history": "事故与未遂事故", "collision": "碰撞与周边冲突", "attention": "疲劳与注意力",
    "speed": "超速行为", "control": "车辆控制稳定性", "trend": "风险持续与恶化",
}
SCORE_B_MIX = {"rate_km": 0.35, "rate_hour": 0.25, "active_share": 0.20, "recency": 0.20}
SCORE_B_GRADES = (
    ("A", 90.0, "低风险", "正常月度复盘，可进入安全驾驶奖励候选"),
    ("B", 80.0, "较低风险", "每周反馈主要扣分项，保持常规管理"),
    ("C", 70.0, "中风险", "安排针对性培训，14天后重新评价"),
    ("D", 60.0, "高风险", "24小时内人工复核，专项培训并加强监控"),
    ("E", None, "极高风险", "立即人工核查，必要时暂停高风险任务"),
)
SCORE_B_UNRATED = ("U", "证据不足", "检查设备和数据链路，补齐证据前暂缓奖惩")
SCORE_B_EVIDENCE = (0.50, 0.30, 0.20)
CONFIDENCE_HIGH, CONFIDENCE_MID, CONFIDENCE_LOW = "高", "中", "低"
NO_EVENTS_A = "无明显行为事件"
NO_EVENTS_B = "无明显风险事件"
ROUTE_FULL = "full"
ROUTE_CONTEXT = "context_only_no_matched_event"
ROUTE_PRIOR = "prior_no_observed_behavior"
ALIGNMENT_GATE = {"spearman": 0.55, "top20_overlap": 0.50, "e_minus_a": 0.40}
HAZARD_SEGMENTS = ((1, 7), (8, 14), (15, 21), (22, 30), (31, 40))
