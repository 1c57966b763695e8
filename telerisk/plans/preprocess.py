"""Canonical sources to entity-day tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from telerisk import codes
from telerisk.operators import daily as D
from telerisk.operators import episodes as E
from telerisk.operators import imu as I
from telerisk.operators import labels as L
from telerisk.operators import trajectory as T
from telerisk.operators.ordered import Stage, staged
from telerisk.session import materialise


@dataclass(frozen=True)
class Period:
    """Calendar and anchors of one analysis."""

    first_day: str
    last_day: str
    anchors: tuple[str, ...]
    final_anchor: str
    horizon: int = 40
    lookback: int = 20


# fixed values: the published analysis period
PUBLISHED = Period("2026-06-01", "2026-07-30",
                   ("2026-06-14", "2026-06-15", "2026-06-16", "2026-06-17", "2026-06-18", "2026-06-19", "2026-06-20",
                    "2026-07-30"), "2026-07-30")


@dataclass(frozen=True)
class EntityDays:
    clean_events: DataFrame
    targets: DataFrame
    event_daily: DataFrame
    trajectory_daily: DataFrame
    imu_daily: DataFrame
    coverage: DataFrame
    daily: DataFrame
    bags: DataFrame


def build(profile: DataFrame, events: DataFrame, trajectory: DataFrame, imu: DataFrame, period: Period = PUBLISHED,
          gap_s: int = 60, wanted: Sequence[int] = codes.EVENT_CODES, stage: Stage | None = materialise) -> EntityDays:
    """All derived tables from the canonical sources.

    Each raw source is scanned once: tables that feed several branches (quantile cells, sensor
    windows, entity-days) are written to the shared folder by ``stage``.  ``stage=None`` keeps
    the plan lazy, for small inputs.
    """
    clean = staged(E.clean_events(events, period.first_day, period.last_day), stage, "clean-events")
    by_event = staged(E.event_daily(E.mark_episodes(clean, gap_s=gap_s), wanted, stage=stage), stage, "event-daily")
    fixes = T.best_fix(E.in_rule_window(trajectory, "ts", period.first_day, period.last_day))
    by_trajectory = staged(T.trajectory_daily(T.with_steps(fixes), stage=stage), stage, "trajectory-daily")
    samples = I.motion_samples(E.in_rule_window(imu, "ts", period.first_day, period.last_day))
    windows = staged(I.imu_windows(samples, stage=stage), stage, "imu-windows")
    by_imu = staged(I.imu_daily(windows, stage), stage, "imu-daily")
    cover = staged(D.coverage(profile, clean, by_trajectory, by_imu), stage, "coverage")
    daily = D.assemble(cover, by_event, by_trajectory, by_imu, period.first_day, period.last_day, wanted)
    targets = E.target_events(clean)
    bags = L.label_index(cover, targets, period.anchors, period.final_anchor, period.first_day, period.horizon,
                         period.lookback)
    return EntityDays(clean, targets, by_event, by_trajectory, by_imu, cover, daily, bags)
