"""Eight-factor composite risk of each series at its own latest row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.config import Columns, RiskConfig
from panelloom.functions.numeric import ladder, ratio, scaled
from panelloom.operators.anomaly import recent_flag, trailing_max
from panelloom.operators.forecast import forecast_summary
from panelloom.operators.windows import latest_per_series

SNAPSHOT_COLUMNS = (
    "rolling_avg_7d_cases", "rt_effective", "doubling_time_days", "epidemic_phase",
    "case_fatality_rate", "wow_change_pct", "acceleration", "trend_direction", "endemic_flag",
    "signal_to_noise", "cumulative_confirmed", "cumulative_deaths",
)
FACTORS = (
    "f1_rt", "f2_forecast", "f3_accel", "f4_doubling", "f5_wow", "f6_cfr", "f7_volume", "f8_anomaly",
)


def data_gap() -> Column:
    """TRUE when the 7-row average is missing or 0."""
    return F.coalesce("rolling_avg_7d_cases", F.lit(0.0)) == 0


def forecast_trend_pct() -> Column:
    """Change from first to last forecast day in percent, at least -100; 0 without a start."""
    start, end = scaled("fc_start", 2), scaled("fc_end", 2)
    change = ratio((end - start) * F.lit(100), start, 1)
    known = (F.col("fc_start") > 0) & F.col("fc_end").isNotNull()
    return F.greatest(F.when(known, change).otherwise(0.0), F.lit(-100.0))


def f1_rt(config: RiskConfig) -> Column:
    return ladder("rt_effective", config.rt, 0)


def f2_forecast(config: RiskConfig) -> Column:
    """Growth within the forecast window; needs a positive first value."""
    start, end = F.col("fc_start"), F.col("fc_end")
    out = None
    for factor, points in config.forecast:
        grows = (start > 0) & (end > start * F.lit(factor))
        out = F.when(grows, points) if out is None else out.when(grows, points)
    return out.otherwise(0)


def f3_accel(config: RiskConfig) -> Column:
    rising = (F.col("acceleration") > 0) & (F.col("trend_direction") == "ACCELERATING")
    return F.when(rising, config.accel_points).otherwise(0)


def f4_doubling(config: RiskConfig) -> Column:
    return ladder("doubling_time_days", config.doubling, 0, op="<")


def f5_wow(config: RiskConfig) -> Column:
    return ladder("wow_change_pct", config.wow, 0)


def f6_cfr(config: RiskConfig) -> Column:
    return ladder("case_fatality_rate", config.cfr, 0)


def f7_volume(config: RiskConfig) -> Column:
    return ladder("rolling_avg_7d_cases", config.volume, 0)


def f8_anomaly(config: RiskConfig) -> Column:
    return F.when(F.col("has_recent_anomaly") == 1, config.anomaly_points).otherwise(0)


def factor_columns(config: RiskConfig) -> dict[str, Column]:
    built = (f1_rt, f2_forecast, f3_accel, f4_doubling, f5_wow, f6_cfr, f7_volume, f8_anomaly)
    return {name: build(config).cast("int") for name, build in zip(FACTORS, built)}


def factor_total() -> Column:
    return reduce(add, [F.col(name) for name in FACTORS])


def risk_score(total: str, config: RiskConfig) -> Column:
    """Sum of the factors, capped; the factor maxima add up to more than the cap."""
    return F.least(F.col(total), F.lit(config.score_cap)).cast("int")


def risk_tier(total: str, config: RiskConfig) -> Column:
    """Tier of the uncapped sum."""
    return ladder(total, config.tiers, config.lowest_tier, op=">=")


def snapshot(
    features: DataFrame,
    forecasts: DataFrame,
    anomalies: DataFrame,
    mobility: DataFrame,
    config: RiskConfig = RiskConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """Latest row of each series beside its forecast summary, recent-anomaly flag and mobility.

    Every side is one row per series. No broadcast is forced: the optimizer picks it by size.
    """
    key = columns.series
    return (
        latest_per_series(features, columns)
        .select(key, columns.ts, *SNAPSHOT_COLUMNS)
        .join(forecast_summary(forecasts, columns), key, "left")
        .join(recent_flag(anomalies, config.recent_days, columns), key, "left")
        .join(trailing_max(mobility, "mobility_index", config.mobility_days, columns=columns), key, "left")
    )


def score(sides: DataFrame, config: RiskConfig = RiskConfig(), columns: Columns = Columns()) -> DataFrame:
    """The 29-column risk table from the joined snapshot."""
    factors = sides.withColumns(
        {
            "data_gap": data_gap(),
            "forecast_trend_pct": forecast_trend_pct(),
            "mobility_index": F.coalesce("mobility_index", F.lit(0.0)),
            **factor_columns(config),
        }
    ).withColumn("__total", factor_total())
    return factors.withColumns(
        {"risk_score": risk_score("__total", config), "risk_tier": risk_tier("__total", config)}
    ).select(
        columns.series, columns.ts, *SNAPSHOT_COLUMNS, "fc_end", "fc_peak", "data_gap",
        "forecast_trend_pct", *FACTORS, "mobility_index", "risk_score", "risk_tier",
    )


def risk_tiers(
    features: DataFrame,
    forecasts: DataFrame,
    anomalies: DataFrame,
    mobility: DataFrame,
    config: RiskConfig = RiskConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    return score(snapshot(features, forecasts, anomalies, mobility, config, columns), config, columns)


def risk_breakdown(risk: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Tier, score and factors, riskiest first."""
    return risk.select(columns.series, "risk_tier", "risk_score", *FACTORS).orderBy(
        F.col("risk_score").desc(), columns.series
    )
