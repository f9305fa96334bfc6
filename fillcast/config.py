"""Settings of the library: one frozen dataclass, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Thresholds, window lengths and defaults that decide the results.


@dataclass(frozen=True)
class Settings:
    # reproducibility
    seed: int = 42
    stability_seeds: tuple[int, ...] = (42, 123, 456, 789, 1011)

    # splits
    folds: int = 5
    tuning_folds: int = 3
    fold_kind: str = "container_holdout"
    test_fraction: float = 0.20
    validation_fraction: float = 0.15

    # how much history an entity needs
    min_events: int = 10
    min_grid_rows: int = 100

    # capacity classes
    capacity_low_max: float = 2150.0
    capacity_high_min: float = 2500.0
    capacity_segments: tuple[str, ...] = ("low", "high")
    min_segment_containers: int = 10

    # spatial features
    center_lat: float = 50.0812
    center_lon: float = 14.4269
    geo_clusters: int = 60
    geo_min_containers: int = 1

    # emptying detection
    drop_threshold: float = -30.0
    low_after: float = 50.0
    high_before: float = 40.0
    max_gap_hours: float = 168.0
    use_future_check: bool = False
    grid_drop_thresholds: tuple[float, ...] = (-20.0, -25.0, -30.0, -35.0, -40.0)
    grid_low_after: tuple[float, ...] = (40.0, 45.0, 50.0, 55.0, 60.0)

    # time to threshold
    fill_threshold: float = 85.0
    max_days: int = 14
    scan_rows: int = 99
    scan_drop: float = 25.0

    # lags, rolling windows and grid step
    event_lags: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    event_windows: tuple[int, ...] = (3, 5, 7)
    interval_lags: tuple[int, ...] = (1, 2, 3)
    grid_lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24, 48)
    grid_windows: tuple[int, ...] = (6, 12, 24)
    weekly_harmonics: int = 3
    daily_harmonics: int = 2
    step_hours: int = 6
    fill_limit: int = 2

    # evaluation
    bootstrap_rounds: int = 1000
    ci_level: float = 0.95
    trials: int = 50
    fits_at_once: int = 4
    tuning_seconds: int | None = None
    importance_rows: int | None = None
    correlation_threshold: float = 0.95

    # category encoding
    low_cardinality: int = 10
    top_categories: int = 8

    # weather
    weather_override: bool = True
    weather_broadcast_rows: int = 1_000_000  # longer weather tables are merged along time
    temp_freezing: float = 0.0
    temp_cold: float = 5.0
    temp_warm: float = 20.0
    temp_hot: float = 30.0
    rain_light: float = 2.5
    rain_moderate: float = 7.5
    wind_calm: float = 2.0
    wind_moderate: float = 8.0
    humidity_low: float = 40.0
    humidity_high: float = 80.0
    pressure_low: float = 1000.0
    pressure_high: float = 1020.0
    weather_lags: tuple[int, ...] = (1, 6, 12, 24)
    weather_windows: tuple[int, ...] = (6, 12, 24, 48)
    weather_event_lags: tuple[int, ...] = (1, 2, 3)

    # per-series forecasters: None is everything
    forecast_containers: int | None = None
    rolling_containers: int | None = None
    rolling_origins: int | None = None
    forecast_head: int | None = None

    # a series longer than this is cut into blocks of this many rows, so
    # that no task ever sorts more than one block (plus its overlap)
    block_rows: int = 1_000_000

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
