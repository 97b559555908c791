"""One independent forecast model per series, its predictions, metrics and display tables.

The model is a closed form over sufficient statistics: a least-squares trend on the day index, a
mean residual per weekday, and a residual deviation for textbook prediction intervals. Fitting is
one aggregate by (series, weekday) plus seven rows of arithmetic per series, so it scales with rows
and never holds a series in memory. Sums are exact integers; only the final divisions are floating.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.config import Columns, ForecastConfig, OriginConfig, ReportConfig
from panelloom.functions.numeric import (
    WIDE,
    clip_low_double,
    exact_avg,
    half_up_scaled,
    ratio,
    ratio_wide,
    scaled,
    square,
    unscale,
)
from panelloom.operators.features import day_of_week
from panelloom.operators.projections import filter_date_range, literal_tag

# Names of the error metrics, in display order; MAPE feeds the confidence label.
METRIC_ORDER = ("MAE", "SMAPE", "MDA", "MSE", "WINKLER_ALPHA=0.05", "MAPE")


def training_view(
    features: DataFrame, config: ForecastConfig = ForecastConfig(), columns: Columns = Columns()
) -> DataFrame:
    """One calendar split for all series; the range filter reaches the scan."""
    kept = filter_date_range(features, columns.ts, config.train_start, config.train_end)
    return kept.select(columns.series, columns.ts, F.col("rolling_avg_7d_cases").alias("target")).dropna(
        subset=["target"]
    )


def train_coverage(train: DataFrame, columns: Columns = Columns()) -> DataFrame:
    return train.groupBy(columns.series).agg(
        F.count(F.lit(1)).alias("train_days"),
        F.min(columns.ts).alias("start_dt"),
        F.max(columns.ts).alias("end_dt"),
    )


def _day_index(ts: str, origin: str) -> Column:
    return F.datediff(F.col(ts), F.lit(origin).cast("date"))


def _statistics(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Sums over ``(t, y)`` that a least-squares line and its residuals need, by ``keys``."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("t").alias("t1"),
        F.sum(F.col("t") * F.col("t")).alias("t2"),
        F.sum("y").alias("y1"),
        F.sum(F.col("t").cast("decimal(19,0)") * F.col("y").cast("decimal(19,0)")).cast("decimal(38,0)").alias("ty"),
        F.sum(square("y")).cast("decimal(38,0)").alias("y2"),
        F.max(ts).alias("last_date"),
    )


def _fit_rows(train: DataFrame, config: ForecastConfig, columns: Columns, target: str, digits: int) -> DataFrame:
    return train.select(
        columns.series,
        columns.ts,
        day_of_week(columns.ts).alias("dow"),
        _day_index(columns.ts, config.train_start).cast("bigint").alias("t"),
        scaled(target, digits).alias("y"),
    )


def fit_forecaster(
    train: DataFrame,
    config: ForecastConfig = ForecastConfig(),
    columns: Columns = Columns(),
    target: str = "target",
    digits: int = 2,
) -> DataFrame:
    """One model row per series; ``digits`` is the number of decimals the target carries.

    Model values are in units of ``10**-digits``. ``offsets`` maps a weekday to its mean residual
    and holds at most seven entries. Short or flat series get ``sigma = 0``.
    """
    rows = _fit_rows(train, config, columns, target, digits)
    return _models(_statistics(rows, [columns.series, "dow"], columns.ts), [columns.series], config)


def fit_origins(
    train: DataFrame,
    origins: OriginConfig = OriginConfig(),
    config: ForecastConfig = ForecastConfig(),
    columns: Columns = Columns(),
    target: str = "target",
    digits: int = 2,
) -> DataFrame:
    """One model row per series and origin, each fitted to the rows up to its origin, in one pass.

    Rows are summed by the stretch between origins that they lie in; running totals of those sums are the
    statistics of every origin, so no row is read twice and none is refitted. A weekday without rows in
    a stretch carries the totals of the one before. Origins before a series begins have no model.
    """
    series, first, last = columns.series, origins.dates()[0], origins.dates()[-1]
    rows = _fit_rows(train.filter(F.col(columns.ts) <= F.lit(last).cast("date")), config, columns, target, digits)
    after = F.greatest(F.datediff(F.col(columns.ts), F.lit(first).cast("date")), F.lit(0))
    stretch = F.ceil(after / F.lit(origins.step)).cast("int")
    sums = _statistics(rows.withColumn("at", stretch), [series, "dow", "at"], columns.ts)
    upto = Window.partitionBy(series, "dow").orderBy("at")
    running = {c: F.sum(c).over(upto) for c in ("n", "t1", "t2", "y1")}
    running |= {c: F.sum(c).over(upto).cast("decimal(38,0)") for c in ("ty", "y2")}
    following = F.coalesce(F.lead("at").over(upto), F.lit(origins.count))
    totals = sums.withColumns({**running, "last_date": F.max("last_date").over(upto), "__next": following})
    each = totals.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("__next") - 1))).drop("__next")
    dated = each.withColumn("origin", F.date_add(F.lit(first).cast("date"), (F.col("at") * origins.step).cast("int")))
    return _models(dated.drop("at"), [series, "origin"], config)


def _models(by_day: DataFrame, keys: list[str], config: ForecastConfig) -> DataFrame:
    """Statistics by ``keys`` and weekday to one model row for each combination of ``keys``."""
    whole = Window.partitionBy(*keys)
    total = {f"all_{c}": F.sum(c).over(whole) for c in ("n", "t1", "t2", "y1")}
    total["all_ty"] = F.sum("ty").over(whole).cast("decimal(38,0)")
    total["n_days"] = F.count(F.lit(1)).over(whole)

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    def real(c: str) -> Column:
        return F.col(c).cast("double")

    trend = (
        by_day.withColumns(total)
        .withColumns(
            {
                "spread": F.col("all_n") * F.col("all_t2") - F.col("all_t1") * F.col("all_t1"),
                "cross": (wide("all_n") * F.col("all_ty") - wide("all_t1") * wide("all_y1")).cast("double"),
            }
        )
        .withColumn("slope", F.when(F.col("spread") > 0, F.col("cross") / real("spread")).otherwise(0.0))
        .withColumn("intercept", (real("all_y1") - F.col("slope") * real("all_t1")) / real("all_n"))
    )
    day_yy = (wide("n") * F.col("y2") - wide("y1") * wide("y1")).cast("double")
    day_ty = (wide("n") * F.col("ty") - wide("t1") * wide("y1")).cast("double")
    day_tt = (F.col("n") * F.col("t2") - F.col("t1") * F.col("t1")).cast("double")
    slope, intercept = F.col("slope"), F.col("intercept")
    squares = (day_yy - F.lit(2.0) * slope * day_ty + slope * slope * day_tt) / real("n")
    per_day = trend.withColumns(
        {
            "offset": (real("y1") - intercept * real("n") - slope * real("t1")) / real("n"),
            "squares": F.greatest(squares, F.lit(0.0)).cast("decimal(38,6)"),
        }
    )

    model = per_day.groupBy(*keys).agg(
        F.max("all_n").alias("n_train"),
        F.max("last_date").alias("last_date"),
        F.max("n_days").alias("n_days"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.max(real("all_t1") / real("all_n")).alias("t_mean"),
        F.max(real("spread") / real("all_n")).alias("t_spread"),
        F.sum("squares").cast("double").alias("sse"),
        F.map_from_entries(F.collect_list(F.struct("dow", "offset"))).alias("offsets"),
    )
    freedom = F.col("n_train") - F.col("n_days") - F.lit(1)
    usable = (F.col("n_train") >= config.min_rows) & (freedom > 0)
    sigma = F.when(usable, F.sqrt(F.col("sse") / F.nullif(freedom, F.lit(0)).cast("double"))).otherwise(0.0)
    return model.withColumn("sigma", sigma).drop("sse", "n_days")


def interval_multiplier(prediction_interval: float) -> float:
    return NormalDist().inv_cdf((1.0 + prediction_interval) / 2.0)


def point_at(ts: str, origin: str) -> Column:
    """Model value at a date, in model units."""
    offset = F.coalesce(F.col("offsets")[day_of_week(ts)], F.lit(0.0))
    return F.col("intercept") + F.col("slope") * _day_index(ts, origin).cast("double") + offset


def _half_width(ts: str, origin: str, z: float) -> Column:
    gap = _day_index(ts, origin).cast("double") - F.col("t_mean")
    far = F.when(F.col("t_spread") > 0, gap * gap / F.nullif(F.col("t_spread"), F.lit(0.0))).otherwise(0.0)
    return F.lit(z) * F.col("sigma") * F.sqrt(F.lit(1.0) + F.lit(1.0) / F.col("n_train").cast("double") + far)


def forecast(
    model: DataFrame,
    config: ForecastConfig = ForecastConfig(),
    columns: Columns = Columns(),
    digits: int = 2,
    keep: tuple = (),
) -> DataFrame:
    """``periods`` days past the last training date of each model, with a two-sided interval.

    ``keep``: further key columns of the model, such as its origin.
    """
    z = interval_multiplier(config.prediction_interval)
    steps = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(config.periods)))).withColumn(
        columns.ts, F.date_add("last_date", F.col("step"))
    )
    steps = steps.withColumns(
        {
            "__point": point_at(columns.ts, config.train_start),
            "__half": _half_width(columns.ts, config.train_start, z),
        }
    )

    def cents(x: Column) -> Column:
        return unscale(half_up_scaled(x, 2 - digits), 2)

    return steps.select(
        columns.series,
        *keep,
        columns.ts,
        cents(F.col("__point")).alias("forecasted_cases"),
        cents(F.col("__point") - F.col("__half")).alias("forecast_lower"),
        cents(F.col("__point") + F.col("__half")).alias("forecast_upper"),
        F.lit("FORECAST").alias("type"),
    )


def fit_forecaster_custom(
    train: DataFrame,
    forecaster: Callable,
    config: ForecastConfig = ForecastConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """Any per-series model: ``forecaster(frame, periods, prediction_interval)``.

    It receives the ``(series, ts, target)`` rows of one series as a pandas frame sorted by date
    and returns ``(ts, point, lower, upper)`` rows. A training view has one row per date, so a
    group never exceeds the days of the training range.
    """
    series, ts = columns.series, columns.ts
    periods, interval = config.periods, config.prediction_interval

    def run(frame):
        frame = frame.sort_values(ts)
        out = forecaster(frame, periods, interval)
        out = out.set_axis([ts, "forecasted_cases", "forecast_lower", "forecast_upper"], axis=1)
        out.insert(0, series, frame[series].iloc[0])
        return out.round(2).assign(type="FORECAST")

    return train.groupBy(series).applyInPandas(
        run,
        f"{series} string, {ts} date, forecasted_cases double, forecast_lower double, "
        "forecast_upper double, type string",
    )


def forecast_coverage(forecasts: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Horizon, range, mean forecast and mean interval width of each series."""
    width = scaled("forecast_upper", 2) - scaled("forecast_lower", 2)
    units = F.count("forecasted_cases") * F.lit(100)
    return forecasts.groupBy(columns.series).agg(
        F.count(F.lit(1)).alias("days"),
        F.min(columns.ts).alias("fc_start"),
        F.max(columns.ts).alias("fc_end"),
        ratio(F.sum(scaled("forecasted_cases", 2)), units, 0).alias("avg_fc"),
        ratio(F.sum(width), F.count(width) * F.lit(100), 0).alias("avg_ci_width"),
    )


def history_forecast(
    features: DataFrame,
    forecasts: DataFrame,
    config: ForecastConfig = ForecastConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """Actual rows and forecast rows in one table; a date may appear once per type."""
    shape = [columns.series, columns.ts, "val", "lower_bound", "upper_bound", "type"]
    actual = literal_tag(
        filter_date_range(features, columns.ts, config.history_start).withColumnRenamed("rolling_avg_7d_cases", "val"),
        {"type": "ACTUAL"},
        {"lower_bound": "double", "upper_bound": "double"},
    ).select(*shape)
    predicted = forecasts.withColumnsRenamed(
        {"forecasted_cases": "val", "forecast_lower": "lower_bound", "forecast_upper": "upper_bound"}
    ).select(*shape)
    return actual.unionByName(predicted)


def overlap(
    features: DataFrame, forecasts: DataFrame, columns: Columns = Columns(), keep: tuple = ()
) -> DataFrame:
    """Forecast rows that have an actual value on the same day."""
    actual = features.select(columns.series, columns.ts, F.col("rolling_avg_7d_cases").alias("actual"))
    predicted = forecasts.select(columns.series, *keep, columns.ts, "forecasted_cases", "forecast_lower", "forecast_upper")
    return predicted.join(actual.dropna(subset=["actual"]), [columns.series, columns.ts])


def backtest(
    train: DataFrame, config: ForecastConfig = ForecastConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Forecast and actual over the last ``periods`` training days of each series, held out of the fit.

    Same columns as ``overlap``. The last date is a window over the partitioning by series that the
    training rows already have.
    """
    last = F.max(columns.ts).over(Window.partitionBy(columns.series))
    marked = train.withColumn("__last", last)
    fitted = marked.filter(F.col(columns.ts) <= F.date_sub("__last", config.periods)).drop("__last")
    predicted = forecast(fit_forecaster(fitted, config, columns), config, columns)
    return overlap(train.withColumnRenamed("target", "rolling_avg_7d_cases"), predicted, columns)


def rolling_origin_metrics(
    train: DataFrame,
    origins: OriginConfig = OriginConfig(),
    config: ForecastConfig = ForecastConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """``(series, origin, error_metric, metric_value)``: the metrics of a forecast from each of many origins.

    For every origin the model of the rows up to it forecasts ``periods`` days, which are compared with
    the training rows that follow.
    """
    keep = ("origin",)
    predicted = forecast(fit_origins(train, origins, config, columns), config, columns, keep=keep)
    pairs = overlap(train.withColumnRenamed("target", "rolling_avg_7d_cases"), predicted, columns, keep)
    return forecast_metrics(pairs, config, columns, keep)


def forecast_metrics(
    pairs: DataFrame, config: ForecastConfig = ForecastConfig(), columns: Columns = Columns(), keep: tuple = ()
) -> DataFrame:
    """Long ``(series, error_metric, metric_value)`` table over the overlap of forecast and actual.

    ``keep``: further key columns, such as the origin; each combination has metrics of its own.
    Values are rounded to 4 decimals; sums run over integer hundredths or fixed decimals, so they
    do not depend on row order.
    """
    keys = [columns.series, *keep]
    w = Window.partitionBy(*keys).orderBy(columns.ts)
    rows = pairs.select(
        *keys,
        columns.ts,
        scaled("actual", 2).alias("y"),
        scaled("forecasted_cases", 2).alias("p"),
        scaled("forecast_lower", 2).alias("lo"),
        scaled("forecast_upper", 2).alias("hi"),
    ).withColumn("before", F.lag("y").over(w))
    y, p, lo, hi, before = (F.col(c) for c in ("y", "p", "lo", "hi", "before"))
    error = F.abs(y - p)

    def share(num: Column, den: Column) -> Column:
        return (num.cast("double") / F.nullif(den, F.lit(0)).cast("double")).cast("decimal(38,12)")

    size = F.abs(y) + F.abs(p)
    relative = F.when(y != 0, share(error, F.abs(y)))
    symmetric = F.when(size == 0, F.lit(0).cast("decimal(38,12)")).otherwise(share(F.lit(2) * error, size))
    hit = F.when(before.isNotNull(), (F.signum(y - before) == F.signum(p - before)).cast("int"))
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(F.lit(0))
    n = F.count(F.lit(1))

    def percent(total: Column, count: Column) -> Column:
        return ratio_wide((total * F.lit(10**12)).cast(WIDE), count * F.lit(10**10), 4)

    # Nine decimals of 2 / alpha, so that the whole sum is an integer.
    penalty = round(2.0 / config.winkler_alpha * 10**9)
    interval = (F.sum(hi - lo).cast(WIDE) * F.lit(10**9)).cast(WIDE) + (F.sum(miss).cast(WIDE) * F.lit(penalty)).cast(WIDE)
    wide = rows.groupBy(*keys).agg(
        ratio(F.sum(error), n * F.lit(100), 4).alias("MAE"),
        ratio_wide(F.sum(square(error)), n * F.lit(10_000), 4).alias("MSE"),
        percent(F.sum(relative), F.count(relative)).alias("MAPE"),
        percent(F.sum(symmetric), n).alias("SMAPE"),
        ratio(F.sum(hit), F.count(hit), 4).alias("MDA"),
        ratio_wide(interval, n * F.lit(10**11), 4).alias(winkler_name(config)),
    )
    metrics = [F.col(f"`{c}`") for c in wide.columns if c not in keys]
    return wide.unpivot(keys, metrics, "error_metric", "metric_value").withColumnRenamed(
        columns.series, "series"
    )


def winkler_name(config: ForecastConfig) -> str:
    return f"WINKLER_ALPHA={config.winkler_alpha}"


def metric_names(config: ForecastConfig = ForecastConfig()) -> tuple[str, ...]:
    """Display order of the metrics that ``forecast_metrics`` gives under a configuration."""
    return tuple(winkler_name(config) if name.startswith("WINKLER") else name for name in METRIC_ORDER)


def unquoted(series: str) -> Column:
    return F.regexp_replace(series, '^"+|"+$', "")


def metric_pivot(metrics: DataFrame, names: tuple = METRIC_ORDER) -> DataFrame:
    """One row per series and one column per metric of ``names``; quotes around series names are stripped.

    A metric that is not listed stops the job, so that none is ever dropped: list further ones in ``names``.
    """
    name = F.col("error_metric")
    unlisted = F.raise_error(F.concat(F.lit("metric missing from the pivot's names: "), F.coalesce(name, F.lit("NULL"))))
    return (
        metrics.withColumn("series", unquoted("series"))
        .withColumn("error_metric", F.when(name.isin(*names), name).otherwise(unlisted.cast("string")))
        .groupBy("series")
        .pivot("error_metric", list(names))
        .agg(F.first("metric_value", ignorenulls=True))
    )


def forecast_summary(forecasts: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """First, last, peak and mean forecast of each series, never below 0; one hash aggregate."""
    value = "forecasted_cases"
    return forecasts.groupBy(columns.series).agg(
        clip_low_double(F.max_by(value, columns.ts)).alias("fc_end"),
        clip_low_double(F.min_by(value, columns.ts)).alias("fc_start"),
        clip_low_double(F.max(value)).alias("fc_peak"),
        clip_low_double(exact_avg(value, 2)).alias("fc_avg"),
    )


# A peak is one number, hundredths above and the day below, which a hash aggregate can hold.
DAYS, FIRST_DAY = 10**7, 4 * 10**6


def peak_key(value: str, columns: Columns = Columns()) -> Column:
    """Aggregate: the group maximum and, on equal values, its latest date, as one number."""
    day = F.unix_date(columns.ts) + F.lit(FIRST_DAY)
    return F.max((scaled(value, 2).cast("decimal(28,0)") * F.lit(DAYS) + day).cast(WIDE))


def peak_date(key: str) -> Column:
    return F.date_from_unix_date((F.pmod(F.col(key), F.lit(DAYS).cast(WIDE)) - F.lit(FIRST_DAY)).cast("int"))


def peak_value(key: str) -> Column:
    day = F.pmod(F.col(key), F.lit(DAYS).cast(WIDE))
    return unscale(F.call_function("div", F.col(key) - day, F.lit(DAYS).cast(WIDE)), 2)


def forecast_trajectory(forecasts: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Range, path, peak and interval figures of each series, in one aggregate."""
    value = "forecasted_cases"
    width = (F.col("forecast_upper").cast("decimal(28,2)") - F.col("forecast_lower").cast("decimal(28,2)"))
    summed = forecasts.groupBy(columns.series).agg(
        F.min(value).alias("forecast_min"),
        F.max(value).alias("forecast_max"),
        exact_avg(value, 2).alias("forecast_avg"),
        F.min_by(value, columns.ts).alias("forecast_day1"),
        F.max_by(value, columns.ts).alias("forecast_day30"),
        peak_key(value, columns).alias("__peak"),
        F.min("forecast_lower").alias("ci_lower_min"),
        F.max("forecast_upper").alias("ci_upper_max"),
        (F.sum(width).cast("double") / F.nullif(F.count(width), F.lit(0)).cast("double")).alias("ci_avg_width"),
        F.max(columns.ts).alias("forecast_end_date"),
    )
    named = {"forecast_peak_date": peak_date("__peak"), "forecast_peak_value": peak_value("__peak")}
    return summed.withColumns(named).drop("__peak")


def forecast_display_split(
    history: DataFrame, config: ReportConfig = ReportConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Chart rows of each series: the run-up to the forecast, the forecast, and what happened.

    ``segment`` is HISTORY (last rows before the forecast), VALIDATION (actual rows inside the
    forecast window) or FORECAST. Values are clipped at 0.
    """
    whole = Window.partitionBy(columns.series)
    predicted = F.when(F.col("type") == "FORECAST", F.col(columns.ts))
    marked = history.withColumns(
        {"__start": F.min(predicted).over(whole), "__end": F.max(predicted).over(whole), "val": clip_low_double("val")}
    )
    ts = F.col(columns.ts)
    segment = (
        F.when(F.col("type") == "FORECAST", "FORECAST")
        .when(F.col("__start").isNull() | (ts < F.col("__start")), "HISTORY")
        .when(ts <= F.col("__end"), "VALIDATION")
    )
    limit = F.when(F.col("__start").isNull(), config.history_rows_without_forecast).otherwise(config.history_rows)
    newest = Window.partitionBy(columns.series, "segment").orderBy(F.col(columns.ts).desc())
    return (
        marked.withColumn("segment", segment)
        .filter(F.col("segment").isNotNull())
        .withColumn("__rn", F.row_number().over(newest))
        .filter((F.col("segment") != "HISTORY") | (F.col("__rn") <= limit))
        .select(columns.series, columns.ts, "val", "lower_bound", "upper_bound", "segment")
    )


def forecast_kpis(risk: DataFrame, forecasts: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Current average, forecast end and peak (never below 0), trend over the horizon."""
    path = forecasts.groupBy(columns.series).agg(
        F.coalesce(clip_low_double(F.max_by("forecasted_cases", columns.ts)), F.lit(0.0)).alias("forecast_end"),
        F.coalesce(clip_low_double(F.max("forecasted_cases")), F.lit(0.0)).alias("forecast_peak"),
    )
    return risk.join(path, columns.series, "left").select(
        columns.series,
        F.col("rolling_avg_7d_cases").alias("current_avg_7d"),
        "forecast_end",
        "forecast_peak",
        "forecast_trend_pct",
        F.col("endemic_flag").alias("low_confidence"),
    )


def interval_band(history: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Rows with both bounds, clipped at 0."""
    return history.dropna(subset=["lower_bound", "upper_bound"]).select(
        columns.series,
        columns.ts,
        clip_low_double("lower_bound").alias("lower_bound"),
        clip_low_double("upper_bound").alias("upper_bound"),
    )
