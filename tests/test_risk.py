import pytest
from conftest import ANOMALIES, FORECASTS, day
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.config import RiskConfig
from panelloom.operators import context, features, forecast, risk

CONFIG = RiskConfig()


def column(spark, kind, values, build, name):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return [r[0] for r in df.select(build(CONFIG)).collect()]


@pytest.mark.parametrize(
    "name, build, values, points",
    [
        ("rt_effective", risk.f1_rt, [0.8, 0.801, 1.0, 1.001, 1.5, 1.501, None], [0, 5, 5, 15, 15, 25, 0]),
        ("doubling_time_days", risk.f4_doubling, [13.9, 14.0, 29.9, 30.0, None], [15, 8, 8, 0, 0]),
        ("wow_change_pct", risk.f5_wow, [20.0, 20.01, 50.0, 50.01, None], [0, 5, 5, 10, 0]),
        ("case_fatality_rate", risk.f6_cfr, [1.5, 1.5001, 3.0, 3.0001, None], [0, 5, 5, 10, 0]),
        ("rolling_avg_7d_cases", risk.f7_volume, [10000.0, 10000.01, 50000.0, 50000.01, None], [0, 2, 2, 5, 0]),
    ],
)
def test_factor_boundaries(spark, name, build, values, points):
    assert column(spark, "double", values, build, name) == points


def test_forecast_factor_and_trend(spark):
    rows = [(100.0, 110.0), (100.0, 111.0), (100.0, 150.0), (100.0, 151.0), (0.0, 50.0), (100.0, 0.0), (None, None), (3.0, 4.0)]
    df = spark.createDataFrame(rows, "fc_start double, fc_end double")
    assert [r[0] for r in df.select(risk.f2_forecast(CONFIG)).collect()] == [0, 10, 10, 20, 0, 0, 0, 10]
    assert [r[0] for r in df.select(risk.forecast_trend_pct()).collect()] == [10.0, 11.0, 50.0, 51.0, 0.0, -100.0, 0.0, 33.3]


def test_acceleration_and_anomaly_factors(spark):
    rows = [(0.01, "ACCELERATING"), (0.0, "ACCELERATING"), (5.0, "STABLE"), (None, "ACCELERATING")]
    df = spark.createDataFrame(rows, "acceleration double, trend_direction string")
    assert [r[0] for r in df.select(risk.f3_accel(CONFIG)).collect()] == [15, 0, 0, 0]
    assert column(spark, "int", [1, 0, None], risk.f8_anomaly, "has_recent_anomaly") == [5, 0, 0]


def test_gap(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.01,)], "rolling_avg_7d_cases double")
    assert [r[0] for r in df.select(risk.data_gap()).collect()] == [True, True, False]


SIDES = (
    "country_region string, date date, rolling_avg_7d_cases double, rt_effective double, doubling_time_days double, "
    "epidemic_phase string, case_fatality_rate double, wow_change_pct double, acceleration double, trend_direction string, "
    "endemic_flag boolean, signal_to_noise double, cumulative_confirmed bigint, cumulative_deaths bigint, fc_end double, "
    "fc_start double, fc_peak double, fc_avg double, has_recent_anomaly int, mobility_index double"
)


def test_score_is_capped_and_tier_is_not(spark):
    worst = ("max", day(0), 60000.0, 2.0, 5.0, "EXPONENTIAL_GROWTH", 4.0, 80.0, 9.0, "ACCELERATING", False, 1.0, 9, 1, 30.0, 10.0, 30.0, 20.0, 1, 2.5)
    bare = ("bare", day(0), None, None, None, "TRANSITION", 0.0, 0.0, None, "STABLE", False, None, 0, 0, None, None, None, None, None, None)
    edge = ("edge", day(0), 1.0, 1.2, None, "PLATEAU", 4.0, 0.0, None, "STABLE", False, None, 9, 1, 10.0, 10.0, 10.0, 10.0, 0, None)
    got = {r["country_region"]: r for r in risk.score(spark.createDataFrame([worst, bare, edge], SIDES)).collect()}
    assert sum(got["max"][f] for f in risk.FACTORS) == 105
    assert (got["max"]["risk_score"], got["max"]["risk_tier"], got["max"]["mobility_index"]) == (100, "HIGH", 2.5)
    assert (got["bare"]["risk_score"], got["bare"]["risk_tier"], got["bare"]["data_gap"]) == (0, "LOW", True)
    assert (got["bare"]["fc_end"], got["bare"]["forecast_trend_pct"], got["bare"]["mobility_index"]) == (None, 0.0, 0.0)
    assert (got["edge"]["risk_score"], got["edge"]["risk_tier"]) == (25, "MODERATE")
    assert len(got["max"].asDict()) == 29


@pytest.mark.parametrize("total, tier", [(24, "LOW"), (25, "MODERATE"), (49, "MODERATE"), (50, "HIGH"), (105, "HIGH")])
def test_tier_boundaries(spark, total, tier):
    df = spark.createDataFrame([(total,)], "t int")
    assert df.select(risk.risk_tier("t", CONFIG), risk.risk_score("t", CONFIG)).first()[:] == (tier, min(total, 100))


def test_every_series_gets_one_row_without_any_side(spark, daily_frame):
    store = features.feature_store(daily_frame({"a": [5] * 30, "stopped": [9] * 10}))
    empty = [spark.createDataFrame([], s) for s in (FORECASTS, ANOMALIES)]
    rows = risk.risk_tiers(store, *empty, spark.createDataFrame([], schemas.MOBILITY)).collect()
    assert {(r["country_region"], r["date"]) for r in rows} == {("a", day(29)), ("stopped", day(9))}
    assert all(r["f2_forecast"] == r["f8_anomaly"] == 0 and r["fc_peak"] is None for r in rows)


@pytest.mark.parametrize("mape, label", [(9.99, "HIGH"), (10.0, "MODERATE"), (24.99, "MODERATE"), (25.0, "LOW"), (None, "UNKNOWN")])
def test_confidence(spark, mape, label):
    assert spark.createDataFrame([(mape,)], "m double").select(context.model_confidence("m")).first()[0] == label


def test_waves_take_the_latest_peak(spark):
    rows = [("a", day(0), 9.0, "P"), ("a", day(1), 9.0, "Q"), ("a", day(2), 1.0, "P"), ("z", day(0), 0.0, "P"), ("n", day(0), None, "P")]
    df = spark.createDataFrame(rows, "country_region string, date date, rolling_avg_7d_cases double, epidemic_phase string")
    got = {r[0]: tuple(r)[1:] for r in context.wave_context(df).collect()}
    assert got == {"a": (9.0, day(1), 2), "z": (0.0, day(0), 1), "n": (None, None, 1)}
    share = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0), (None, 3.0)], "v double, p double")
    assert [r[0] for r in share.select(context.pct_of_peak("v", "p")).collect()] == [33.3, None, None]


def test_context_has_one_row_per_series_and_50_columns(spark, daily_frame):
    store = features.feature_store(daily_frame({"a": list(range(30)), "b": [3] * 12}))
    fc = spark.createDataFrame([("a", day(30), 5.0, 1.0, 9.0, "FORECAST")], FORECASTS)
    anomalies = spark.createDataFrame([("a", day(3), 1, 1.0, True, None, 3.0, -20.0, "DROP")], ANOMALIES)
    metrics = spark.createDataFrame([("a", "MAPE", 12.0), ("a", "MAE", 2.0)], schemas.METRICS)
    tiers = risk.risk_tiers(store, fc, anomalies, spark.createDataFrame([], schemas.MOBILITY))
    df = context.context_view(store, tiers, fc, metrics, anomalies)
    assert len(df.columns) == 50
    rows = {r["country_region"]: r for r in df.collect()}
    assert (rows["a"]["model_confidence"], rows["a"]["anomaly_drops"], rows["a"]["forecast_day1"]) == ("MODERATE", 1, 5.0)
    assert (rows["b"]["model_confidence"], rows["b"]["total_anomalies"], rows["b"]["forecast_day1"]) == ("UNKNOWN", 0, None)
    scenario = context.scenario_inputs(df.withColumn("rt_effective", F.lit(0.875)))
    assert scenario.select("rt_variant", "rt_intervention").first()[:] == (1.23, 0.66)
    assert forecast.forecast_kpis(tiers, fc).count() == 2
