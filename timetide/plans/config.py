"""Thresholds of the checks. They stay literals of the plans, so cached inputs survive another configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import date


@dataclass(frozen=True)
class Config:
    # The defaults of the thresholds.
    today: date = field(default_factory=date.today)
    source_url: str = ""
    stop_name_best_practices: bool = False
    max_speed_bus_kmh: float = 120.0
    max_speed_tram_kmh: float = 100.0
    max_speed_metro_kmh: float = 150.0
    max_speed_rail_kmh: float = 300.0
    max_speed_ferry_kmh: float = 80.0
    max_speed_cablecar_kmh: float = 30.0
    max_transfer_distance_m: float = 500.0
    max_shape_jump_km: float = 10.0
    max_shape_jump_km_rail: float = 30.0
    stop_too_close_m: float = 5.0
    stop_far_from_shape_m: float = 100.0
    stop_far_from_parent_m: float = 150.0
    feed_expiry_warning_days: int = 30
    feed_info_expiry_warning_days: int = 7
    service_gap_days: int = 7
    big_gap_days: int = 14
    upcoming_service_days: int = 7
    max_trip_duration_hours: float = 24.0
    max_trip_duration_hours_rail: float = 48.0
    min_trip_duration_sec: int = 60
    max_headway_warning_min: int = 240
    bunching_threshold_min: int = 2
    rail_stop_distance_km: float = 500.0
    max_trips_per_route: int = 500
    max_shape_points: int = 5_000
    max_stops_per_trip: int = 200
    max_total_stop_times: int = 2_000_000
    max_file_rows: int = 1_000_000
    duration_outlier_sigma: float = 3.5
    headway_outlier_sigma: float = 2.5
    service_day_start_hour: int = 3
    max_calendar_future_years: int = 3
    disabled_rule_ids: tuple[str, ...] = ()

    def merged(self, delta: str | dict) -> Config:
        """This configuration with known keys replaced; unknown keys, negative numbers and Spec rules to disable raise ValueError."""
        delta = json.loads(delta) if isinstance(delta, str) else dict(delta)
        known = {f.name: f.type for f in fields(self)}
        if unknown := sorted(set(delta) - set(known)):
            raise ValueError(f"unknown keys: {unknown}")
        if bad := sorted(k for k, v in delta.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and v < 0):
            raise ValueError(f"below 0: {bad}")
        if isinstance(delta.get("today"), str):
            delta["today"] = date.fromisoformat(delta["today"])
        if "disabled_rule_ids" in delta:
            delta["disabled_rule_ids"] = tuple(delta["disabled_rule_ids"])
        return replace(self, **delta)

    def literals(self) -> dict[str, str]:
        """Names as they stand in the SQL of a rule, and their literals."""
        out = {}
        for k, v in asdict(self).items():
            if isinstance(v, date):
                out[k] = f"DATE'{v.isoformat()}'"
            elif isinstance(v, bool):
                out[k] = str(v).lower()
            elif isinstance(v, (int, float)):
                out[k] = repr(v) + ("D" if isinstance(v, float) else "")
            elif isinstance(v, str):
                out[k] = "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return out
