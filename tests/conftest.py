import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from telerisk.session import local_session
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, "telerisk-tests", spark__checkpoint__dir=f"file://{folder}")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as dictionaries in a fixed order (test-sized frames only)."""
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def code_day_frame(spark, entries, last_day=60, first="2026-06-01", km=1.0, hours=1.0):
    """Dense entity-day frame: entries = {entity: {day_index: {column: value}}}; events default to 0."""
    import datetime as dt

    from telerisk import codes
    start = dt.date.fromisoformat(first)
    kinds = {f"event_{c}_{k}": "bigint" for c in codes.EVENT_CODES for k in ("count", "episodes")}
    kinds |= {"event_total_count": "bigint", "event_total_episodes": "bigint"}
    numbers = {c: "double" for c in (*codes.DAY_NUMERIC, "distance_valid_rows")}
    flags = {c: "boolean" for c in (*codes.DAY_QUALITY, "has_event_feed", "has_trajectory", "has_imu")}
    data = []
    for entity, days in entries.items():
        for i in range(1, last_day + 1):
            row = {**{c: 0 for c in kinds}, **{c: 1.0 for c in numbers}, **{c: True for c in flags}}
            row |= {"distance_km": km, "drive_hours": hours}
            row |= days.get(i, {})
            data.append((entity, start + dt.timedelta(days=i - 1), i, *[row[c] for c in (*kinds, *numbers, *flags)]))
    schema = "gpsno string, day date, day_index int, " + ", ".join(f"{c} {t}" for c, t in {**kinds, **numbers, **flags}.items())
    return spark.createDataFrame(data, schema)
