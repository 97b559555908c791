"""What the physical plans must look like."""

import re

import pytest

from panelloom.operators import anomaly, features, forecast, ingest, text, windows
from panelloom.plans.stages import PanelStages
from test_stages import CONFIG, fact  # noqa: F401


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan(df)))


@pytest.fixture(scope="module")
def daily(spark, fact, tmp_path_factory):  # noqa: F811
    return PanelStages(fact, CONFIG, root=str(tmp_path_factory.mktemp("t")), cut=("daily",)).daily()


def test_all_features_share_one_shuffle_and_one_sort(daily):
    df = features.features_without_flag(daily, CONFIG.features)
    assert exchanges(df) == 1 and len(re.findall(r"\bSort \[", plan(df))) == 1


def test_endemic_flag_adds_no_join_and_no_shuffle_of_rows(daily):
    df = features.feature_store(daily, CONFIG.features)
    assert not re.search(r"(Hash|Merge|Loop)Join", plan(df))
    assert len(re.findall(r"Exchange hashpartitioning", plan(df))) == 1


def test_fit_reuses_the_partitioning_of_the_features(daily):
    train = forecast.training_view(features.features_without_flag(daily, CONFIG.features), CONFIG.forecast)
    df = forecast.forecast(forecast.fit_forecaster(train, CONFIG.forecast), CONFIG.forecast)
    assert exchanges(df) == 1 and "Python" not in plan(df)


def test_anomalies_are_one_shuffle_with_pushed_filter(daily):
    df = anomaly.zscore_anomalies(daily, CONFIG.anomaly)
    assert exchanges(df) == 1
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date", plan(df))
    assert "ReadSchema: struct<country_region:string,date:date,daily_new_cases:bigint>" in plan(df)


def test_pivot_aggregates_before_its_shuffle(spark, fact):  # noqa: F811
    text_plan = plan(ingest.combine(fact, CONFIG.ingest))
    assert text_plan.index("HashAggregate") < text_plan.index("Exchange") < text_plan.rindex("HashAggregate")


def test_top_k_prunes_before_the_shuffle(daily):
    for df in (windows.latest_per_series(daily), text.top_anomalies(anomaly.zscore_anomalies(daily, CONFIG.anomaly))):
        assert "WindowGroupLimit" in plan(df)


def test_no_window_runs_in_a_single_partition(spark, fact, caplog):  # noqa: F811
    stages = PanelStages(fact, CONFIG)
    for df in (stages.context(), stages.anomaly_explanations(), stages.history_forecast()):
        windows_seen = re.findall(r"Window(?:GroupLimit)? \[.*", plan(df))
        assert all(re.search(r"\], \[\w+", w) or "Limit" in w for w in windows_seen)


def test_python_runs_only_in_the_two_hooks(spark, fact):  # noqa: F811
    stages = PanelStages(fact, CONFIG)
    for df in (stages.context(), stages.forecast_metrics(), anomaly.model_anomalies(stages.daily(), CONFIG.anomaly)):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)
    narratives = plan(stages.narratives())
    assert len(re.findall(r"ArrowEvalPython", narratives)) >= 1


def test_generated_methods_are_small_enough_to_be_compiled(spark, daily):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (
            features.features_without_flag(daily, CONFIG.features),
            anomaly.zscore_anomalies(daily, CONFIG.anomaly),
            forecast.fit_forecaster(
                forecast.training_view(features.features_without_flag(daily, CONFIG.features), CONFIG.forecast), CONFIG.forecast
            ),
        ):
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
            assert sizes and max(sizes) < 8000, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_peaks_need_no_sort_aggregate(daily):
    from panelloom.operators import context

    rows = features.features_without_flag(daily, CONFIG.features)
    train = forecast.training_view(rows, CONFIG.forecast)
    predicted = forecast.forecast(forecast.fit_forecaster(train, CONFIG.forecast), CONFIG.forecast)
    for df in (context.wave_context(rows), forecast.forecast_trajectory(predicted)):
        assert "SortAggregate" not in plan(df)


def test_narratives_are_one_python_pass(daily, spark, fact, tmp_path):  # noqa: F811
    stages = PanelStages(fact, CONFIG, root=str(tmp_path), cut=("daily", "features", "forecasts", "anomalies", "risk_tiers", "context"), parallelism=2)
    assert plan(stages.narratives()).count("ArrowEvalPython") == 1
    assert "SortAggregate" not in plan(stages.context())
