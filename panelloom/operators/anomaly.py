"""Anomaly detection by rolling z-score or by a fitted model, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.config import AnomalyConfig, Columns, ForecastConfig
from panelloom.functions.numeric import half_up, normal_cdf, ratio
from panelloom.operators.forecast import fit_forecaster, interval_multiplier, point_at
from panelloom.operators.projections import filter_date_range
from panelloom.operators.windows import rolling_moments


def _direction(observed: Column, expected: Column) -> Column:
    return F.when(observed > expected, "SPIKE").when(observed < expected, "DROP").otherwise("NEUTRAL")


def anomaly_input(
    daily: DataFrame, config: AnomalyConfig = AnomalyConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Rows the detectors look at; frames start anew at the first kept row."""
    kept = filter_date_range(daily, columns.ts, config.start)
    return kept.select(columns.series, columns.ts, "daily_new_cases").dropna(subset=["daily_new_cases"])


def zscore_anomalies(
    daily: DataFrame, config: AnomalyConfig = AnomalyConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Distance from the trailing mean in population deviations, flagged beyond the threshold.

    The frame includes the current row, so with n rows the distance cannot exceed sqrt(n-1): at the
    default threshold nothing can be flagged before the eighth row of a series.
    """
    rows = anomaly_input(daily, config, columns)
    moments = rolling_moments(rows, "daily_new_cases", config.window, columns, keep=("daily_new_cases",))
    x, n, total = F.col("daily_new_cases"), F.col("moment_n"), F.col("moment_sum")
    spread = F.col("moment_spread")
    excess = n * x - total
    scored = moments.withColumn(
        "__z", F.when(spread > 0, excess.cast("double") / F.sqrt(spread)).otherwise(0.0)
    )
    return scored.select(
        columns.series,
        columns.ts,
        "daily_new_cases",
        ratio("moment_sum", "moment_n", 2).alias("expected"),
        (F.abs("__z") > config.threshold).alias("is_anomaly"),
        F.lit(None).cast("double").alias("percentile"),
        half_up("__z", 3).alias("distance"),
        F.when(total > 0, ratio("(moment_n * daily_new_cases - moment_sum) * 100", "moment_sum", 1)).otherwise(0.0).alias("deviation_pct"),
        _direction(excess, F.lit(0)).alias("anomaly_direction"),
    )


def model_anomalies(
    daily: DataFrame,
    config: AnomalyConfig = AnomalyConfig(),
    prediction_interval: float = 0.95,
    columns: Columns = Columns(),
) -> DataFrame:
    """Same columns from the closed-form model: outside the in-sample interval is an anomaly."""
    rows = anomaly_input(daily, config, columns)
    settings = ForecastConfig(train_start=config.start)
    model = fit_forecaster(rows, settings, columns, target="daily_new_cases", digits=0)
    fitted = rows.join(model, columns.series).withColumn("__point", point_at(columns.ts, config.start))
    y, point, sigma = F.col("daily_new_cases").cast("double"), F.col("__point"), F.col("sigma")
    scored = fitted.withColumn(
        "__d", F.when(sigma > 0, (y - point) / F.nullif(sigma, F.lit(0.0))).otherwise(0.0)
    )
    change = (y - point) * F.lit(100.0) / F.nullif(point, F.lit(0.0))
    return scored.select(
        columns.series,
        columns.ts,
        "daily_new_cases",
        half_up(point, 2).alias("expected"),
        (F.abs("__d") > interval_multiplier(prediction_interval)).alias("is_anomaly"),
        half_up(normal_cdf("__d"), 6).alias("percentile"),
        half_up("__d", 3).alias("distance"),
        F.when(point > 0, half_up(change, 1)).otherwise(0.0).alias("deviation_pct"),
        _direction(y, point).alias("anomaly_direction"),
    )


def empirical_percentiles(
    anomalies: DataFrame, prediction_interval: float = 0.95, clip: float = 20.0, columns: Columns = Columns()
) -> DataFrame:
    """Rows of a detector with ``rank_percentile`` and ``is_rare``, from how often such distances were seen.

    The percentile of a row is the share of its series' rows whose distance is at most its own; a row is rare where
    fewer than half of what the interval leaves out lie as far, or farther, on its side. Unlike the normal formula
    this needs no shape of the residuals. A series is summed up by its distances in thousandths, clipped: at
    most ``2000 * clip + 1`` counts, whatever the number of its rows, and counts of later rows can be added.
    """
    series, ts = columns.series, columns.ts
    far = round(clip * 1000)
    steps = F.greatest(F.lit(-far), F.least(F.lit(far), F.round(F.col("distance") * 1000).cast("int"))).alias("__step")
    rows = anomalies.filter("distance IS NOT NULL").select("*", steps)
    counts = rows.groupBy(series, "__step").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(series)
    upto = Window.partitionBy(series).orderBy("__step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = counts.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(whole)})
    # In millionths of the rows: either tail holds at most so many.
    tail = round((1 - prediction_interval) / 2 * 10**6)
    at_least = F.col("__all") - F.col("__upto") + F.col("__n")
    rare = F.least("__upto", at_least) * 10**6 <= F.col("__all") * tail
    shares = summary.select(series, "__step", ratio("__upto", "__all", 6).alias("rank_percentile"), rare.alias("is_rare"))
    return rows.join(shares, [series, "__step"]).drop("__step").select(series, ts, *[c for c in anomalies.columns if c not in (series, ts)], "rank_percentile", "is_rare")


def flagged(anomalies: DataFrame) -> DataFrame:
    return anomalies.filter("is_anomaly")


def flagged_split(anomalies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All flagged rows, the spikes among them, the drops among them."""
    rows = flagged(anomalies)
    return rows, rows.filter("anomaly_direction = 'SPIKE'"), rows.filter("anomaly_direction = 'DROP'")


def _is(direction: str) -> Column:
    return F.col("is_anomaly") & (F.col("anomaly_direction") == direction)


def _deviation() -> Column:
    return F.when(F.col("is_anomaly"), F.abs("deviation_pct"))


def anomaly_summary(anomalies: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Flagged rows, spikes, drops and the largest deviation of each series."""
    return anomalies.groupBy(columns.series).agg(
        F.count_if("is_anomaly").alias("total_anomalies"),
        F.count_if(_is("SPIKE")).alias("spikes"),
        F.count_if(_is("DROP")).alias("drops"),
        F.max(_deviation()).alias("max_deviation"),
    )


def anomaly_stats(anomalies: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """The summary plus the last flagged date and the mean deviation."""
    mean = F.sum(_deviation().cast("decimal(28,1)")).cast("double")
    return anomalies.groupBy(columns.series).agg(
        F.count_if("is_anomaly").alias("total_anomalies"),
        F.count_if(_is("SPIKE")).alias("spike_count"),
        F.count_if(_is("DROP")).alias("drop_count"),
        F.max(_deviation()).alias("max_deviation_pct"),
        F.max(F.when(F.col("is_anomaly"), F.col(columns.ts))).alias("last_anomaly_date"),
        (mean / F.nullif(F.count_if("is_anomaly"), F.lit(0)).cast("double")).alias("avg_deviation_pct"),
    )


def anomaly_kpis(anomalies: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Flagged count of each series, of all series, and the mean deviation of the series."""
    total = anomalies.select(F.count_if("is_anomaly").alias("n")).scalar()
    return anomaly_stats(anomalies, columns).select(
        columns.series,
        F.col("total_anomalies").alias("series_anomalies"),
        total.alias("all_anomalies"),
        F.col("avg_deviation_pct").alias("avg_deviation"),
    )


def recent_rows(anomalies: DataFrame, days: int = 7, columns: Columns = Columns()) -> DataFrame:
    """Rows of the closing period of each series: an equi join plus a range on its own last date."""
    latest = anomalies.groupBy(F.col(columns.series).alias("__s")).agg(F.max(columns.ts).alias("__last"))
    inside = (F.col(columns.series) == F.col("__s")) & (F.col(columns.ts) >= F.date_sub("__last", days))
    return anomalies.join(latest, inside).drop("__s", "__last")


def recent_flag(anomalies: DataFrame, days: int = 7, columns: Columns = Columns()) -> DataFrame:
    """1 when a row of the closing period is flagged.

    That holds exactly when the last flagged date lies in the period, so two maxima in one
    aggregate replace the self join.
    """
    last = F.max(columns.ts)
    last_flagged = F.max(F.when(F.col("is_anomaly"), F.col(columns.ts)))
    return anomalies.groupBy(columns.series).agg(
        F.when(last_flagged >= F.date_sub(last, days), 1).otherwise(0).alias("has_recent_anomaly")
    )


def trailing_max(
    df: DataFrame,
    value: str,
    days: int,
    output: str | None = None,
    columns: Columns = Columns(),
    today: str | None = None,
) -> DataFrame:
    """Series maximum over the last days of the whole table (today's date for an empty table)."""
    today_date = F.current_date() if today is None else F.lit(today).cast("date")
    last = F.coalesce(df.select(F.max(columns.ts).alias("last")).scalar(), today_date)
    return (
        df.filter(F.col(columns.ts) >= F.date_sub(last, days))
        .groupBy(columns.series)
        .agg(F.max(value).alias(output or value))
    )
