"""Settings of every operator.

The defaults are fixed values: thresholds, frames, dates and name tables that results depend on.
Multipliers are whole percents so that comparisons of rounded averages stay exact.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

# Spelling variants of an entity -> published name.
NAME_VARIANTS = {
    "United States": "US",
    "United States of America": "US",
    "Korea, Republic of": "Korea, South",
    "Korea, North": "Korea, North",
    "Iran, Islamic Republic of": "Iran",
    "Russian Federation": "Russia",
}

# Raw names kept at ingestion.
TRACKED_NAMES = (
    "Australia", "Brazil", "France", "Germany", "India", "Iran, Islamic Republic of", "Italy",
    "Japan", "Korea, Republic of", "Mexico", "Nigeria", "South Africa", "Turkey",
    "United Kingdom", "Russian Federation", "US", "United States", "United States of America",
)

# The same two tables for the vaccination source.
VACCINATION_NAME_VARIANTS = {"United States": "US", "South Korea": "Korea, South"}
VACCINATION_NAMES = (
    "United States", "Brazil", "Mexico", "United Kingdom", "France", "Germany", "Italy", "India",
    "Japan", "South Korea", "Australia", "South Africa", "Nigeria", "Turkey", "Iran",
)

# Names kept from the mobility source (already in published spelling).
MOBILITY_NAMES = (
    "US", "Brazil", "Mexico", "United Kingdom", "France", "Germany", "Italy", "India", "Japan",
    "Korea, South", "Australia", "South Africa", "Nigeria", "Turkey", "Iran",
)


@dataclass(frozen=True)
class Columns:
    """Names of the two key columns of a panel."""

    series: str = "country_region"
    ts: str = "date"


@dataclass(frozen=True)
class IngestConfig:
    """``tracked=None`` keeps every name."""

    variants: dict = field(default_factory=lambda: dict(NAME_VARIANTS))
    tracked: tuple | None = TRACKED_NAMES
    confirmed_type: str = "Confirmed"
    deaths_type: str = "Deaths"


@dataclass(frozen=True)
class FeatureConfig:
    week: int = 7
    fortnight: int = 14
    month: int = 28
    serial_interval: int = 5
    min_rt_denominator: int = 10
    trend_up_pct: int = 110
    trend_down_pct: int = 90
    exp_growth_fortnight_pct: int = 120
    exp_growth_month_pct: int = 130
    lin_growth_pct: int = 105
    plateau_band_pct: int = 5
    lin_decline_pct: int = 95
    decline_month_pct: int = 70


@dataclass(frozen=True)
class EndemicConfig:
    days: int = 60
    decline_phases: tuple = ("EXPONENTIAL_DECLINE", "LINEAR_DECLINE")


@dataclass(frozen=True)
class ForecastConfig:
    """``min_rows``: shorter series get bounds equal to the point.

    ``backtest``: error metrics come from holding out the last ``periods`` training days instead of
    from the actual days that follow the training range.
    """

    train_start: str = "2020-03-15"
    train_end: str = "2022-03-31"
    history_start: str = "2020-03-15"
    periods: int = 30
    prediction_interval: float = 0.95
    winkler_alpha: float = 0.05
    min_rows: int = 14
    backtest: bool = False


@dataclass(frozen=True)
class OriginConfig:
    """Cut-off dates of a rolling evaluation: ``count`` of them, ``step`` days apart, the last on ``last``."""

    last: str = "2022-03-01"
    step: int = 30
    count: int = 12

    def dates(self) -> list[str]:
        end = datetime.date.fromisoformat(self.last)
        return [str(end - datetime.timedelta(days=self.step * k)) for k in reversed(range(self.count))]


@dataclass(frozen=True)
class AnomalyConfig:
    start: str = "2020-03-15"
    window: int = 14
    threshold: float = 2.5


@dataclass(frozen=True)
class RiskConfig:
    """Ladders are ``((threshold, points), ...)``, first match wins."""

    rt: tuple = ((1.5, 25), (1.0, 15), (0.8, 5))
    forecast: tuple = ((1.5, 20), (1.1, 10))
    accel_points: int = 15
    doubling: tuple = ((14.0, 15), (30.0, 8))
    wow: tuple = ((50.0, 10), (20.0, 5))
    cfr: tuple = ((3.0, 10), (1.5, 5))
    volume: tuple = ((50000.0, 5), (10000.0, 2))
    anomaly_points: int = 5
    score_cap: int = 100
    tiers: tuple = ((50, "HIGH"), (25, "MODERATE"))
    lowest_tier: str = "LOW"
    recent_days: int = 7
    mobility_days: int = 14
    confidence: tuple = ((10.0, "HIGH"), (25.0, "MODERATE"))


@dataclass(frozen=True)
class ReportConfig:
    start: str = "2020-06-01"
    history_rows: int = 120
    history_rows_without_forecast: int = 180
    max_selected: int = 5
    top_n: int = 15
    preview_rows: int = 20
    explain_per_series: int = 3
    history_messages: int = 6
    triage_budget: int = 16_000  # characters of the lines in one triage prompt


@dataclass(frozen=True)
class PanelConfig:
    columns: Columns = Columns()
    ingest: IngestConfig = field(default_factory=IngestConfig)
    features: FeatureConfig = FeatureConfig()
    endemic: EndemicConfig = EndemicConfig()
    forecast: ForecastConfig = ForecastConfig()
    anomaly: AnomalyConfig = AnomalyConfig()
    risk: RiskConfig = RiskConfig()
    report: ReportConfig = ReportConfig()
