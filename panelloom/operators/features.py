"""The feature store: rolling, lagged, derived and classified columns of a daily panel.

Rounded averages and deviations travel as integer hundredths until the last step, because later
features are defined on the rounded values and integer comparisons have no representation error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.config import Columns, EndemicConfig, FeatureConfig
from panelloom.functions.numeric import ratio, ratio_wide, reround, unscale
from panelloom.operators.ingest import series_window
from panelloom.operators.windows import Running, days_since_first

BASE_COLUMNS = (
    "rolling_avg_7d_cases", "rolling_avg_14d_cases", "rolling_avg_28d_cases",
    "rolling_avg_7d_deaths", "rolling_avg_14d_deaths",
    "sum_7d_cases", "prev_sum_7d_cases", "sum_30d_cases", "cases_7d_ago", "confirmed_7d_ago",
    "volatility_14d", "case_fatality_rate", "day_of_week", "days_since_first_case",
    "rt_numerator", "rt_denominator",
)
DERIVED_COLUMNS = (
    "rt_effective", "doubling_time_days", "wow_change_pct", "weekly_growth_rate", "signal_to_noise",
)
CLASS_COLUMNS = ("acceleration", "trend_direction", "epidemic_phase")


def case_fatality_rate(deaths: str, confirmed: str) -> Column:
    """Deaths per hundred confirmed, 4 decimals; 0 while nothing is confirmed."""
    rate = ratio_wide(F.col(deaths).cast("decimal(20,0)") * F.lit(100), confirmed, 4)
    return F.when(F.col(confirmed) > 0, rate).otherwise(0.0)


def day_of_week(ts: str) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - F.lit(1)


def rt_effective(config: FeatureConfig = FeatureConfig()) -> Column:
    """Cases of the last serial interval over those of the one before."""
    enough = F.col("rt_denominator") > config.min_rt_denominator
    return F.when(enough, ratio("rt_numerator", "rt_denominator", 3))


def doubling_time(config: FeatureConfig = FeatureConfig()) -> Column:
    """Days until the cumulative count doubles at last week's pace; NULL unless it grows."""
    now, before = F.col("cumulative_confirmed"), F.col("confirmed_7d_ago")
    days = F.lit(config.week * math.log(2.0)) / F.ln(now.cast("double") / before.cast("double"))
    rounded = F.floor(days * F.lit(10.0) + F.lit(0.5)).cast("double") / F.lit(10.0)
    return F.when((before > 0) & (now > before), rounded)


def percent_change(now: str, before: str) -> Column:
    """Change in percent of ``before``, 2 decimals; 0 without a positive base."""
    change = ratio(f"({now} - {before}) * 100", before, 2)
    return F.when(F.col(before) > 0, change).otherwise(0.0)


def signal_to_noise() -> Column:
    """Rounded 14-row mean over rounded 14-row deviation; NULL for a flat series."""
    return F.when(F.col("__vol14") > 0, ratio("__avg14", "__vol14", 2))


def trend_direction(config: FeatureConfig = FeatureConfig()) -> Column:
    """Rounded 7-row mean against the rounded 14-row mean."""
    up = F.expr(f"__avg7 * 100 > __avg14 * {config.trend_up_pct}")
    down = F.expr(f"__avg7 * 100 < __avg14 * {config.trend_down_pct}")
    return F.when(up, "ACCELERATING").when(down, "DECELERATING").otherwise("STABLE")


def epidemic_phase(config: FeatureConfig = FeatureConfig()) -> Column:
    """Six classes from the three rounded means; a missing mean falls through to TRANSITION."""
    week, fortnight, month = "__avg7 * 100", "__avg14", "__avg28"
    steep = f"{week} > {fortnight} * {config.exp_growth_fortnight_pct} AND {week} > {month} * {config.exp_growth_month_pct}"
    rising = f"{week} > {fortnight} * {config.lin_growth_pct}"
    flat = f"abs({week} - {fortnight} * 100) <= {fortnight} * {config.plateau_band_pct}"
    floor = f"{month} * {config.decline_month_pct}"
    falling = f"{week} < {fortnight} * {config.lin_decline_pct} AND {week} > {floor}"
    return (
        F.when(F.expr(steep), "EXPONENTIAL_GROWTH")
        .when(F.expr(rising), "LINEAR_GROWTH")
        .when(F.expr(flat), "PLATEAU")
        .when(F.expr(falling), "LINEAR_DECLINE")
        .when(F.expr(f"{week} < {floor}"), "EXPONENTIAL_DECLINE")
        .otherwise("TRANSITION")
    )


def base(daily: DataFrame, config: FeatureConfig = FeatureConfig(), columns: Columns = Columns()) -> DataFrame:
    """Trailing frames and lags; rounded means stay integer hundredths in ``__`` columns.

    Cases and deaths are looked up in two windows over the same sorted rows. Besides the sort they
    share, a second window is nearly free, and it parts the arithmetic into two generated methods
    that are small enough for the JVM to compile; as one method it ran several times slower.
    """
    w = series_window(columns)
    cases = Running("daily_new_cases", columns, squares=True)
    deaths = Running("daily_new_deaths", columns)
    week, fortnight, month, serial = config.week, config.fortnight, config.month, config.serial_interval
    case_frames = [(week, 0), (fortnight, 0), (month, 0), (week, week), (serial, 0), (serial, serial)]
    death_frames = [(week, 0), (fortnight, 0)]
    case_columns = {
        "__avg7": cases.mean_scaled(week, 2),
        "__avg14": cases.mean_scaled(fortnight, 2),
        "__avg28": cases.mean_scaled(month, 2),
        "__avg7_before": cases.mean_scaled(week, 2, skip=week),
        "__vol14": cases.sample_deviation_scaled(fortnight, 2),
        "sum_7d_cases": cases.sum(week),
        "prev_sum_7d_cases": cases.sum(week, week),
        "sum_30d_cases": cases.sum(month),
        "rt_numerator": cases.sum(serial),
        "rt_denominator": cases.sum(serial, serial),
    }
    lags = {
        "cases_7d_ago": F.lag("daily_new_cases", week).over(w),
        "confirmed_7d_ago": F.lag("cumulative_confirmed", week).over(w),
    }
    death_columns = {
        "__davg7": deaths.mean_scaled(week, 2),
        "__davg14": deaths.mean_scaled(fortnight, 2),
        "case_fatality_rate": case_fatality_rate("cumulative_deaths", "cumulative_confirmed"),
        "day_of_week": day_of_week(columns.ts),
    }
    return (
        daily.withColumns({**cases.totals(), **deaths.totals(), "days_since_first_case": days_since_first(columns)})
        .withColumns(cases.lookups(case_frames, (fortnight,)))
        .withColumns(cases.frames(case_frames, (fortnight,)))
        .withColumns(case_columns)
        .withColumns({**deaths.lookups(death_frames), **lags})
        .withColumns(deaths.frames(death_frames))
        .withColumns(death_columns)
    )


def derived(frames: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    return frames.withColumns(
        {
            "rt_effective": rt_effective(config),
            "doubling_time_days": doubling_time(config),
            "wow_change_pct": percent_change("sum_7d_cases", "prev_sum_7d_cases"),
            "weekly_growth_rate": percent_change("daily_new_cases", "cases_7d_ago"),
            "signal_to_noise": signal_to_noise(),
        }
    )


def acceleration() -> Column:
    """Rounded 7-row mean minus the one a week of rows earlier, which is the previous week's mean."""
    return unscale("(__avg7 - __avg7_before)", 2)


def classified(frames: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    return frames.withColumns(
        {
            "acceleration": acceleration(),
            "trend_direction": trend_direction(config),
            "epidemic_phase": epidemic_phase(config),
        }
    )


def published(frames: DataFrame) -> DataFrame:
    """Integer hundredths back to doubles, working columns dropped."""
    doubles = {
        "rolling_avg_7d_cases": unscale("__avg7", 2),
        "rolling_avg_14d_cases": unscale("__avg14", 2),
        "rolling_avg_28d_cases": unscale("__avg28", 2),
        "rolling_avg_7d_deaths": unscale("__davg7", 2),
        "rolling_avg_14d_deaths": unscale("__davg14", 2),
        "volatility_14d": unscale("__vol14", 2),
    }
    out = frames.withColumns(doubles)
    return out.select(*[c for c in out.columns if not c.startswith("__")])


def features_without_flag(
    daily: DataFrame, config: FeatureConfig = FeatureConfig(), columns: Columns = Columns()
) -> DataFrame:
    """All row-wise features: chained windows over one shuffle and one sort."""
    frames = published(classified(derived(base(daily, config, columns), config), config))
    lead = [columns.series, columns.ts, "cumulative_confirmed", "cumulative_deaths", "daily_new_cases", "daily_new_deaths"]
    return frames.select(*lead, *BASE_COLUMNS, *DERIVED_COLUMNS, *CLASS_COLUMNS)


def endemic_flag(
    features: DataFrame,
    dates: DataFrame,
    config: EndemicConfig = EndemicConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """TRUE on every row of a series whose rows of the closing period are all in decline.

    ``dates`` supplies the global last date, usually the narrow table the features came from. The
    series-wide test is a window over the partitioning the features already have, so flagging needs
    no second pass, no join and no update in place.
    """
    whole = Window.partitionBy(columns.series)
    cutoff = F.date_sub(dates.select(F.max(columns.ts).alias("last")).scalar(), config.days)
    declining = F.col("epidemic_phase").isin(*config.decline_phases)
    last_other = F.max(F.when(~declining, F.col(columns.ts))).over(whole)
    last_row = F.max(columns.ts).over(whole)
    return (
        features.withColumns({"__last": last_row, "__last_other": last_other})
        .withColumn(
            "endemic_flag",
            (F.col("__last") >= cutoff) & F.coalesce(F.col("__last_other") < cutoff, F.lit(True)),
        )
        .drop("__last", "__last_other")
    )


def endemic_series(
    features: DataFrame,
    dates: DataFrame,
    config: EndemicConfig = EndemicConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """Names of the series whose rows since the cutoff all satisfy the decline test."""
    cutoff = F.date_sub(dates.select(F.max(columns.ts).alias("last")).scalar(), config.days)
    declining = F.col("epidemic_phase").isin(*config.decline_phases)
    return (
        features.filter(F.col(columns.ts) >= cutoff)
        .groupBy(columns.series)
        .agg(F.count(F.when(declining, 1)).alias("n_decline"), F.count(F.lit(1)).alias("n_rows"))
        .filter("n_decline = n_rows")
    )


def feature_store(
    daily: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    endemic: EndemicConfig = EndemicConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """The full 31-column store."""
    return endemic_flag(features_without_flag(daily, config, columns), daily, endemic, columns)


def global_latest_snapshot(features: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Rows at the last date of the whole table, coarsely rounded, largest first."""
    last = features.select(F.max(columns.ts).alias("last")).scalar()
    return (
        features.filter(F.col(columns.ts) == last)
        .select(
            columns.series,
            columns.ts,
            reround("rolling_avg_7d_cases", 2, 0).alias("avg7d"),
            reround("rt_effective", 3, 2).alias("rt"),
            reround("doubling_time_days", 1, 1).alias("dbl_time"),
            "epidemic_phase",
            "endemic_flag",
        )
        .orderBy(F.col("avg7d").desc(), columns.series)
    )
