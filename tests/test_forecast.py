import datetime
import random

import numpy as np
import pandas as pd
import pytest
from conftest import FORECASTS, by_key, day

from panelloom.config import Columns, ForecastConfig, OriginConfig, ReportConfig
from panelloom.operators import forecast

CONFIG = ForecastConfig(train_start=str(day(0)), train_end=str(day(200)), history_start=str(day(0)))
FEATURES = "country_region string, date date, rolling_avg_7d_cases double"
HISTORY = "country_region string, date date, val double, lower_bound double, upper_bound double, type string"


def frame(spark, series):
    rows = [(n, day(i), float(v)) for n, vs in series.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, FEATURES)


def reference(values, periods=30, z=forecast.interval_multiplier(0.95)):
    """Two-pass least squares with weekday means, in numpy."""
    t = np.array([i for i, v in enumerate(values) if v is not None], float)
    y = np.array([v for v in values if v is not None], float)
    n = len(y)
    slope = ((t - t.mean()) * (y - y.mean())).sum() / ((t - t.mean()) ** 2).sum() if n > 1 else 0.0
    resid = y - (y.mean() + slope * (t - t.mean()))
    dow = t.astype(int) % 7
    offsets = {d: resid[dow == d].mean() for d in set(dow)}
    final = resid - np.array([offsets[d] for d in dow])
    free = n - len(offsets) - 1
    sigma = np.sqrt((final**2).sum() / free) if n >= 14 and free > 0 else 0.0
    out = []
    for h in range(1, periods + 1):
        x = t[-1] + h
        point = y.mean() + slope * (x - t.mean()) + offsets.get(int(x) % 7, 0.0)
        spread = ((t - t.mean()) ** 2).sum()
        half = z * sigma * np.sqrt(1 + 1 / n + ((x - t.mean()) ** 2 / spread if spread else 0))
        out.append((point, point - half, point + half))
    return out


def test_forecast_matches_two_pass_least_squares(spark):
    rng = random.Random(4)
    panel = {
        "trend": [100 + 3 * i for i in range(60)],
        "noisy": [round(200 - 1.5 * i + 20 * (i % 7 == 0) + rng.gauss(0, 9), 2) for i in range(90)],
        "large": [round(5e6 + 1e4 * i + rng.gauss(0, 1e5), 2) for i in range(70)],
        "gappy": [round(50 + rng.random() * 30, 2) if i % 5 else None for i in range(50)],
        "short": [3, 9, 4],
        "one": [7],
    }
    train = forecast.training_view(frame(spark, panel), CONFIG)
    got = by_key(
        forecast.forecast(forecast.fit_forecaster(train, CONFIG), CONFIG),
        "forecasted_cases", "forecast_lower", "forecast_upper",
    )
    assert len(got) == 30 * len(panel)
    for name, values in panel.items():
        last = max(i for i, v in enumerate(values) if v is not None)
        for h, want in enumerate(reference(values), start=1):
            row = got[(name, day(last + h))]
            assert row == pytest.approx(want, abs=0.0101, rel=1e-9), (name, h)
            assert row[1] <= row[0] <= row[2]
    assert all(got[("short", day(3 + h))][0] == got[("short", day(3 + h))][1] for h in range(30))


def test_flat_series_has_a_closed_interval(spark):
    train = forecast.training_view(frame(spark, {"flat": [5] * 40}), CONFIG)
    rows = forecast.forecast(forecast.fit_forecaster(train, CONFIG), CONFIG).collect()
    assert {(r["forecasted_cases"], r["forecast_lower"], r["forecast_upper"]) for r in rows} == {(5.0, 5.0, 5.0)}


def test_wider_interval_for_higher_confidence(spark):
    assert forecast.interval_multiplier(0.95) == pytest.approx(1.959964, abs=1e-6)
    assert forecast.interval_multiplier(0.99) > forecast.interval_multiplier(0.95)


def test_train_split_and_coverage(spark):
    rows = [("a", day(i), float(i)) for i in range(10)] + [("a", day(20), None), ("b", day(3), 1.0)]
    features = spark.createDataFrame(rows, FEATURES)
    config = ForecastConfig(train_start=str(day(2)), train_end=str(day(5)))
    train = forecast.training_view(features, config)
    cover = {r[0]: tuple(r)[1:] for r in forecast.train_coverage(train).collect()}
    assert cover == {"a": (4, day(2), day(5)), "b": (1, day(3), day(3))}


def forecasts(spark, rows):
    return spark.createDataFrame([(*r, "FORECAST") for r in rows], FORECASTS)


def test_metrics_against_hand_computation(spark):
    fc = forecasts(
        spark,
        [("a", day(0), 10.0, 5.0, 12.0), ("a", day(1), 20.0, 18.0, 22.0), ("a", day(2), 20.0, 19.0, 21.0), ("a", day(9), 1.0, 0.0, 2.0)],
    )
    actual = frame(spark, {"a": [8, 25, 0]})
    pairs = forecast.overlap(actual, fc)
    assert pairs.count() == 3
    got = {r["error_metric"]: r["metric_value"] for r in forecast.forecast_metrics(pairs, CONFIG).collect()}
    assert got["MAE"] == 9.0  # 2, 5, 20
    assert got["MSE"] == 143.0
    assert got["MAPE"] == 22.5  # 25 %, 20 %, zero skipped
    assert got["SMAPE"] == round(100 * (4 / 18 + 10 / 45 + 2) / 3, 4)
    assert got["MDA"] == 1.0  # up, up; down, down
    widths, miss = (7 + 4 + 2) / 3, 40 * (0 + 3 + 19) / 3
    assert got["WINKLER_ALPHA=0.05"] == pytest.approx(widths + miss, abs=1e-4)


def test_metric_pivot_strips_quotes(spark):
    rows = [('"a"', "MAPE", 9.0), ('"a"', "MAE", 1.0), ("b", "MAE", 2.0)]
    metrics = spark.createDataFrame(rows, "series string, error_metric string, metric_value double")
    wide = forecast.metric_pivot(metrics)
    assert wide.columns == ["series", "MAE", "SMAPE", "MDA", "MSE", "WINKLER_ALPHA=0.05", "MAPE"]
    got = {r["series"]: (r["MAPE"], r["MAE"], r["MSE"]) for r in wide.collect()}
    assert got == {"a": (9.0, 1.0, None), "b": (None, 2.0, None)}


def test_metric_pivot_drops_nothing(spark):
    rows = [("a", "MAE", 1.0), ("a", "RMSE", 2.0), ("a", "WINKLER_ALPHA=0.1", 3.0)]
    metrics = spark.createDataFrame(rows, "series string, error_metric string, metric_value double")
    with pytest.raises(Exception, match="metric missing from the pivot's names"):
        forecast.metric_pivot(metrics).collect()
    names = (*forecast.metric_names(ForecastConfig(winkler_alpha=0.1)), "RMSE")
    row = forecast.metric_pivot(metrics, names).first()
    assert (row["MAE"], row["RMSE"], row["WINKLER_ALPHA=0.1"]) == (1.0, 2.0, 3.0)


def test_errors_round_exact_ties_up(spark):
    # Errors of 0.01 and 0.03: the mean square is 0.0005 exactly; of 0.01 and 0.00: 0.00005, a tie.
    def mse(*errors):
        rows = [("a", day(i), 1.0 + e, 1.0, 0.0, 2.0) for i, e in enumerate(errors)]
        schema = "country_region string, date date, actual double, forecasted_cases double, forecast_lower double, forecast_upper double"
        got = forecast.forecast_metrics(spark.createDataFrame(rows, schema), CONFIG).filter("error_metric = 'MSE'")
        return got.first()["metric_value"]

    assert mse(0.01, 0.03) == 0.0005 and mse(0.01, 0.0) == 0.0001


def test_summary_clamps_and_trajectory_takes_latest_peak(spark):
    fc = forecasts(
        spark,
        [("a", day(2), -4.0, -9.0, 1.0), ("a", day(0), 7.0, 2.0, 12.0), ("a", day(1), 7.0, 3.0, 11.0), ("n", day(0), -1.0, -2.0, 0.0)],
    )
    got = {r[0]: tuple(r)[1:] for r in forecast.forecast_summary(fc).collect()}
    assert got["a"] == (0.0, 7.0, 7.0, 10.0 / 3) and got["n"] == (0.0, 0.0, 0.0, 0.0)
    row = {r["country_region"]: r for r in forecast.forecast_trajectory(fc).collect()}["a"]
    assert (row["forecast_peak_value"], row["forecast_peak_date"]) == (7.0, day(1))
    assert (row["forecast_day1"], row["forecast_day30"], row["forecast_min"], row["forecast_end_date"]) == (7.0, -4.0, -4.0, day(2))
    assert (row["ci_lower_min"], row["ci_upper_max"], row["ci_avg_width"]) == (-9.0, 12.0, 28.0 / 3)
    cover = {r[0]: tuple(r)[1:] for r in forecast.forecast_coverage(fc).collect()}
    assert cover["a"] == (3, day(0), day(2), 3.0, 9.0)


def test_history_keeps_overlapping_dates(spark):
    fc = forecasts(spark, [("a", day(2), 1.0, 0.0, 2.0)])
    config = ForecastConfig(history_start=str(day(1)))
    rows = forecast.history_forecast(frame(spark, {"a": [5, 6, 7]}), fc, config).collect()
    assert sorted((r["date"], r["type"], r["val"], r["lower_bound"]) for r in rows if r["type"] == "ACTUAL") == [
        (day(1), "ACTUAL", 6.0, None), (day(2), "ACTUAL", 7.0, None),
    ]
    assert [tuple(r) for r in rows if r["type"] == "FORECAST"] == [("a", day(2), 1.0, 0.0, 2.0, "FORECAST")]


def test_display_split(spark):
    rows = [("a", day(i), float(i - 1), None, None, "ACTUAL") for i in range(10)]
    rows += [("a", day(i), 1.0, -1.0, 2.0, "FORECAST") for i in (6, 7)]
    rows += [("b", day(i), 1.0, None, None, "ACTUAL") for i in range(10)]
    config = ReportConfig(history_rows=3, history_rows_without_forecast=4)
    got = forecast.forecast_display_split(spark.createDataFrame(rows, HISTORY), config).collect()
    segments = {}
    for r in got:
        segments.setdefault((r["country_region"], r["segment"]), []).append(r["date"])
    assert {k: sorted(v) for k, v in segments.items()} == {
        ("a", "HISTORY"): [day(3), day(4), day(5)],
        ("a", "VALIDATION"): [day(6), day(7)],
        ("a", "FORECAST"): [day(6), day(7)],
        ("b", "HISTORY"): [day(6), day(7), day(8), day(9)],
    }
    band = forecast.interval_band(spark.createDataFrame(rows, HISTORY)).collect()
    assert {(r["lower_bound"], r["upper_bound"]) for r in band} == {(0.0, 2.0)} and len(band) == 2


def test_kpis(spark):
    risk = spark.createDataFrame(
        [("a", 3.0, 5.0, False), ("none", 1.0, 0.0, True)],
        "country_region string, rolling_avg_7d_cases double, forecast_trend_pct double, endemic_flag boolean",
    )
    fc = forecasts(spark, [("a", day(0), 4.0, 0.0, 0.0), ("a", day(1), -2.0, 0.0, 0.0)])
    got = {r[0]: tuple(r)[1:] for r in forecast.forecast_kpis(risk, fc).collect()}
    assert got == {"a": (3.0, 0.0, 4.0, 5.0, False), "none": (1.0, None, None, 0.0, True)}


def test_custom_forecaster(spark):
    def last_value(rows: pd.DataFrame, periods, interval):
        assert list(rows.columns) == ["country_region", "date", "target"] and rows["date"].is_monotonic_increasing
        ahead = [rows["date"].iloc[-1] + datetime.timedelta(days=h + 1) for h in range(periods)]
        point = float(rows["target"].iloc[-1])
        return pd.DataFrame({"d": ahead, "p": point, "l": point - 1, "u": point + 1})

    train = forecast.training_view(frame(spark, {"a": [1, 2, 3], "b": [9]}), CONFIG)
    out = forecast.fit_forecaster_custom(train, last_value, CONFIG)
    got = by_key(out, "forecasted_cases", "forecast_lower", "type")
    assert len(got) == 60 and got[("a", day(3))] == (3.0, 2.0, "FORECAST") and got[("b", day(30))][0] == 9.0


def test_other_column_names(spark):
    names = Columns(series="shop", ts="d")
    train = frame(spark, {"a": range(20)}).toDF("shop", "d", "rolling_avg_7d_cases")
    out = forecast.forecast(forecast.fit_forecaster(forecast.training_view(train, CONFIG, names), CONFIG, names), CONFIG, names)
    assert out.columns[:2] == ["shop", "d"] and out.count() == 30


def test_backtest_holds_out_the_last_training_days(spark):
    import dataclasses

    config = dataclasses.replace(CONFIG, periods=10, backtest=True)
    features = frame(spark, {"line": [100 + 2 * i for i in range(60)], "tiny": [5, 6, 7]})
    pairs = forecast.backtest(forecast.training_view(features, config), config)
    rows = {r["date"]: r for r in pairs.collect() if r["country_region"] == "line"}
    assert sorted(rows) == [day(i) for i in range(50, 60)] and pairs.count() == 10
    assert all(r["forecasted_cases"] == r["actual"] for r in rows.values())
    got = {r["error_metric"]: r["metric_value"] for r in forecast.forecast_metrics(pairs, config).collect()}
    assert got["MAE"] == 0.0 and got["MAPE"] == 0.0 and got["MDA"] == 1.0


def rolling_panel():
    rng = random.Random(9)
    return {
        "trend": [100 + 3 * i + 5 * (i % 7) for i in range(200)],
        "noisy": [round(200 + 20 * (i % 7 == 0) + rng.gauss(0, 9), 2) for i in range(180)],
        "gappy": [round(50 + rng.random() * 30, 2) if i % 5 and not 60 < i < 120 else None for i in range(190)],
        "mondays": [round(10 + rng.random(), 2) if i % 7 == 1 else None for i in range(200)],
        "late": [None] * 130 + [7.5, 8.25] + [round(9 + rng.random(), 2) for _ in range(50)],
        "zero": [0] * 200,
    }


@pytest.mark.parametrize("step, count", [(11, 13), (1, 5), (60, 3), (17, 1)])
def test_rolling_origins_equal_a_refit_for_each(spark, step, count):
    """Prefix sums of the statistics give what filtering, fitting and comparing for every origin gives."""
    origins = OriginConfig(last=str(day(170)), step=step, count=count)
    train = forecast.training_view(frame(spark, rolling_panel()), CONFIG)
    got = forecast.rolling_origin_metrics(train, origins, CONFIG)
    assert got.columns == ["series", "origin", "error_metric", "metric_value"]
    got = sorted((r["series"], str(r["origin"]), r["error_metric"], r["metric_value"]) for r in got.collect())
    want = []
    actual = train.withColumnRenamed("target", "rolling_avg_7d_cases")
    for origin in origins.dates():
        model = forecast.fit_forecaster(train.filter(f"date <= '{origin}'"), CONFIG)
        pairs = forecast.overlap(actual, forecast.forecast(model, CONFIG))
        want += [(r["series"], origin, r["error_metric"], r["metric_value"]) for r in forecast.forecast_metrics(pairs, CONFIG).collect()]
    assert repr(got) == repr(sorted(want)) and got
    assert len({o for _, o, _, _ in got}) == count


def test_origin_dates_and_models(spark):
    origins = OriginConfig(last=str(day(100)), step=10, count=3)
    assert origins.dates() == [str(day(80)), str(day(90)), str(day(100))]
    train = forecast.training_view(frame(spark, {"a": list(range(85)), "b": [None] * 95 + [1.0, 2.0]}), CONFIG)
    models = {(r["country_region"], str(r["origin"])): r["n_train"] for r in forecast.fit_origins(train, origins, CONFIG).collect()}
    assert models == {("a", str(day(80))): 81, ("a", str(day(90))): 85, ("a", str(day(100))): 85, ("b", str(day(100))): 2}


def test_rolling_origins_read_the_training_rows_once(spark, tmp_path):
    train = forecast.training_view(frame(spark, rolling_panel()), CONFIG)
    train.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = forecast.fit_origins(stored, OriginConfig(last=str(day(170)), step=5, count=30), CONFIG)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1
