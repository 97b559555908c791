"""One row per series with everything known about it, and what is derived from that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.config import Columns, RiskConfig
from panelloom.functions.numeric import ladder, ratio, scaled
from panelloom.operators.anomaly import anomaly_stats
from panelloom.operators.forecast import forecast_trajectory, peak_date, peak_key, peak_value, unquoted
from panelloom.operators.risk import FACTORS
from panelloom.operators.windows import latest_per_series

FEATURE_COLUMNS = (
    "rolling_avg_7d_cases", "rolling_avg_14d_cases", "rolling_avg_7d_deaths", "daily_new_cases",
    "cumulative_confirmed", "cumulative_deaths", "rt_effective", "doubling_time_days",
    "case_fatality_rate", "acceleration", "wow_change_pct", "signal_to_noise", "volatility_14d",
    "epidemic_phase", "trend_direction", "endemic_flag",
)
TRAJECTORY_COLUMNS = (
    "forecast_day1", "forecast_day30", "forecast_avg", "forecast_peak_value", "forecast_peak_date",
    "ci_lower_min", "ci_upper_max", "ci_avg_width", "forecast_end_date",
)


def model_confidence(mape: str, config: RiskConfig = RiskConfig()) -> Column:
    known = ladder(mape, config.confidence, "LOW", op="<")
    return F.when(F.col(mape).isNull(), "UNKNOWN").otherwise(known)


def wave_context(features: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """All-time peak of the 7-row average, its latest date, and the number of phases seen.

    Two aggregates with map-side partials: by (series, phase) first, then by series, so that the
    distinct count needs no expansion of the rows.
    """
    by_phase = features.groupBy(columns.series, "epidemic_phase").agg(
        peak_key("rolling_avg_7d_cases", columns).alias("peak")
    )
    by_series = by_phase.groupBy(columns.series).agg(
        F.max("peak").alias("peak"), F.count("epidemic_phase").alias("phases_observed")
    )
    return by_series.select(
        columns.series,
        peak_value("peak").alias("all_time_peak_cases"),
        peak_date("peak").alias("all_time_peak_date"),
        "phases_observed",
    )


def pct_of_peak(value: str, peak: str) -> Column:
    """Rounded average as a percentage of the peak, 1 decimal; NULL for a zero peak."""
    return ratio(scaled(value, 2) * F.lit(100), scaled(peak, 2), 1)


def model_quality(metrics: DataFrame, columns: Columns = Columns()) -> DataFrame:
    def of(name: str) -> Column:
        return F.max(F.when(F.col("error_metric") == name, F.col("metric_value")))

    return metrics.groupBy(unquoted("series").alias(columns.series)).agg(
        of("MAPE").alias("model_mape"), of("MAE").alias("model_mae")
    )


def context_view(
    features: DataFrame,
    risk: DataFrame,
    forecasts: DataFrame,
    metrics: DataFrame,
    anomalies: DataFrame,
    config: RiskConfig = RiskConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """The 50-column grounding row of each series: five left joins of one-row-per-series frames."""
    key = columns.series
    risk_columns = ("risk_score", "risk_tier", "forecast_trend_pct", *FACTORS)
    joined = (
        latest_per_series(features, columns)
        .select(key, F.col(columns.ts).alias("data_date"), *FEATURE_COLUMNS)
        .join(risk.select(key, *risk_columns), key, "left")
        .join(forecast_trajectory(forecasts, columns).select(key, *TRAJECTORY_COLUMNS), key, "left")
        .join(model_quality(metrics, columns), key, "left")
        .join(anomaly_stats(anomalies, columns), key, "left")
        .join(wave_context(features, columns), key, "left")
    )
    return joined.select(
        key,
        "data_date",
        *FEATURE_COLUMNS,
        *risk_columns,
        *TRAJECTORY_COLUMNS,
        "model_mape",
        "model_mae",
        model_confidence("model_mape", config).alias("model_confidence"),
        F.coalesce("total_anomalies", F.lit(0)).alias("total_anomalies"),
        F.coalesce("spike_count", F.lit(0)).alias("anomaly_spikes"),
        F.coalesce("drop_count", F.lit(0)).alias("anomaly_drops"),
        "max_deviation_pct",
        "avg_deviation_pct",
        "last_anomaly_date",
        "all_time_peak_cases",
        "all_time_peak_date",
        pct_of_peak("rolling_avg_7d_cases", "all_time_peak_cases").alias("pct_of_all_time_peak"),
    )


def scenario_rt() -> dict[str, Column]:
    """What-if reproduction numbers: 40 % up for a new variant, 25 % down for an intervention."""
    rt = scaled("rt_effective", 3)
    return {
        "rt_variant": ratio(rt * F.lit(140), F.lit(100_000), 2),
        "rt_intervention": ratio(rt * F.lit(75), F.lit(100_000), 2),
    }


def scenario_inputs(context: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """The numbers a scenario text needs for each series."""
    return context.withColumns(scenario_rt()).select(
        columns.series, "rt_effective", "rt_variant", "rt_intervention", "forecast_day30",
        "all_time_peak_cases", "model_confidence",
    )
