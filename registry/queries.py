"""One registered query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelloom import schemas
from panelloom.config import Columns, EndemicConfig
from panelloom.functions.numeric import clip_low_double, half_up, ladder
from panelloom.operators import (
    anomaly,
    context,
    features,
    forecast,
    ingest,
    packing,
    projections,
    refresh,
    report,
    responses,
    risk,
    text,
    windows,
)
from panelloom.sources import sinks, tables
from registry import bindings as b
from registry.bindings import CONFIG

KEY = Columns().series

# Stages with more than one consumer are written once per run.
FEATURES = ("daily",)
AVERAGES = ("averages",)
RISK = ("daily", "features")
RISK_AND_FORECASTS = (*RISK, "forecasts")
CONTEXT = ("daily", "features", "forecasts", "anomalies")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def over_daily(name: str, build, cut: tuple = ()):
    """A query over the daily panel."""
    QUERIES[name] = lambda spark, sf: build(b.stages(spark, sf, cut).daily())


def over_features(name: str, build):
    """A query over the row-wise features, which need no written stage."""
    QUERIES[name] = lambda spark, sf: build(
        features.features_without_flag(b.stages(spark, sf).daily(), CONFIG.features)
    )


def over_stages(name: str, build, cut: tuple = ()):
    QUERIES[name] = lambda spark, sf: build(b.stages(spark, sf, cut))


def cols(*names):
    return lambda df: df.select(KEY, "date", *names)


# Scans, sources, sinks

QUERIES["s01_scan_table"] = b.panel_fact


@query("s02_scan_optional")
def _(spark, sf):
    declared = schemas.schema("conv_id bigint, turn bigint, role string, text string, lang string")
    return tables.scan_optional(spark, f"{sf}/conversations.parquet", declared)


QUERIES["s03_load_vaccinations"] = b.vaccinations
QUERIES["s04_load_mobility"] = b.mobility


@query("s05_write_table")
def _(spark, sf):
    return b.stages(spark, sf, cut=("daily",)).daily()


@query("s05_publish_version")
def _(spark, sf):
    """A catalog table published twice, the second time with corrected rows, as its readers see it."""
    sinks.create_namespaces(spark, "panel_")
    daily = b.stages(spark, sf, ("daily",)).daily()
    sinks.publish_version(daily.withColumn("daily_new_cases", F.lit(0).cast("bigint")), "panel_raw.daily_versions")
    return sinks.publish_version(daily, "panel_raw.daily_versions", KEY, 8)


@query("s06_append_rows")
def _(spark, sf):
    declared = schemas.VACCINATIONS
    return tables.append_rows(spark.createDataFrame([], declared), b.vaccinations(spark, sf), declared)


def view(name: str, cut: tuple = ()):
    def run(spark, sf):
        b.stages(spark, sf, cut).register_views("panel_")
        return spark.sql(f"SELECT * FROM panel_{name}")

    return run


QUERIES["s08_view_training"] = view("forecast_training", CONTEXT)
QUERIES["s08_view_anomaly_input"] = view("anomaly_input", CONTEXT)
QUERIES["s08_view_context"] = view("context_view", CONTEXT)


def stored_view(name: str, cut: tuple = ()):
    """A view kept in the catalog, read by another session than the one that made it."""

    def run(spark, sf):
        b.stages(spark, sf, cut).store_views("panel_")
        return spark.newSession().table(f"panel_analytics.{name}")

    return run


QUERIES["s08_stored_training"] = stored_view("forecast_training", CONTEXT)
QUERIES["s08_stored_anomaly_input"] = stored_view("anomaly_input", CONTEXT)
QUERIES["s08_stored_context"] = stored_view("context_view", CONTEXT)


@query("s09_load_all")
def _(spark, sf):
    st = b.stages(spark, sf, RISK_AND_FORECASTS)
    names = ("risk_tiers", "features", "history_forecast", "forecasts", "anomalies", "vaccinations", "forecast_metrics")
    loaded = tables.load_all({name: getattr(st, name)() for name in names})
    counts = [df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("row_count")) for name, df in loaded.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


# Projections, filters, predicates

QUERIES["p01_canonicalise_names"] = lambda spark, sf: projections.canonicalise_names(
    b.panel_fact(spark, sf), KEY, b.VARIANTS
)


@query("p01_canonicalise_by_table")
def _(spark, sf):
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("raw_name"), F.col("r_name").alias("name")
    )
    return projections.canonicalise_names(b.panel_fact(spark, sf), KEY, names)


QUERIES["p02_filter_in_list"] = lambda spark, sf: projections.filter_in_list(
    b.table(spark, sf, "events"), "event_type", ["view", "click", "purchase"]
).select("event_id", "event_type", "value")


@query("p02_filter_in_table")
def _(spark, sf):
    nation, customer = b.table(spark, sf, "nation"), b.table(spark, sf, "customer")
    allowed = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n >= 6")
        .select("n_name")
    )
    return projections.filter_in_list(b.panel_fact(spark, sf), KEY, allowed)


@query("p03_clustered_range")
def _(spark, sf):
    """A series and a month of the features, read from a table whose row groups are ranged by both."""
    st = b.stages(spark, sf, ("daily",))
    rows = features.features_without_flag(st.daily(), CONFIG.features)
    stored = sinks.write_clustered(rows, f"{b.folder(spark)}/features", KEY, "date", row_group=64 * 1024)
    month = projections.filter_date_range(stored, "date", "1997-03-01", "1997-03-31")
    return month.filter(F.col(KEY) == b.SELECTED)


QUERIES["p03_filter_date_range"] = lambda spark, sf: projections.filter_date_range(
    b.panel_fact(spark, sf), "date", b.TRAIN_START, b.TRAIN_END
)
over_features(
    "p04_filter_null",
    lambda df: cols("rt_effective", "doubling_time_days", "signal_to_noise")(
        projections.filter_null(df, ["rt_effective", "doubling_time_days", "signal_to_noise"])
    ),
)
over_features(
    "p04_filter_is_null",
    lambda df: cols("daily_new_cases")(projections.filter_null(df, ["rt_effective"], keep_null=True)),
)
over_daily(
    "p05_star_extend",
    lambda df: df.withColumns(
        {
            "case_fatality_rate": features.case_fatality_rate("cumulative_deaths", "cumulative_confirmed"),
            "day_of_week": features.day_of_week("date"),
        }
    ),
)
over_daily(
    "p06_literal_tag",
    lambda df: projections.literal_tag(
        df.select(KEY, "date", "daily_new_cases"),
        {"type": "ACTUAL", "endemic_flag": False},
        {"lower_bound": "double"},
    ),
)
over_features(
    "p07_case_tier",
    lambda df: df.select(
        KEY,
        "date",
        ladder("rolling_avg_7d_cases", b.VOLUME, 0).cast("int").alias("volume_points"),
        ladder("case_fatality_rate", ((3.0, "HIGH"), (1.5, "MODERATE")), "LOW", op=">=").alias("fatality_tier"),
    ),
)
over_features("p08_boolean_expr", lambda df: df.select(KEY, "date", risk.data_gap().alias("data_gap")))
over_stages(
    "p09_rename_fill_display",
    lambda st: projections.rename_fill_display(st.risk_tiers(), report.risk_labels()),
    RISK,
)
over_features(
    "p10_label_map", lambda df: df.select(KEY, "date", projections.label_map("epidemic_phase").alias("phase_label"))
)
over_stages(
    "p11_clip_nonnegative",
    lambda st: st.history_forecast().select(
        KEY, "date", *[clip_low_double(c).alias(c) for c in ("val", "lower_bound", "upper_bound")], "type"
    ),
    AVERAGES,
)

# Joins

over_stages(
    "j01_left_join_chain",
    lambda st: risk.snapshot(st.features(), st.forecasts(), st.anomalies(), st.mobility(), CONFIG.risk),
    RISK,
)
over_stages("j02_context_join", lambda st: st.context(), CONTEXT)
over_stages("j03_recent_range_join", lambda st: anomaly.recent_rows(st.anomalies()), ("anomalies",))


@query("j04_semi_in_subquery")
def _(spark, sf):
    st = b.stages(spark, sf, FEATURES)
    rows = features.features_without_flag(st.daily(), CONFIG.features)
    chosen = features.endemic_series(rows, st.daily(), EndemicConfig(days=3))
    return projections.filter_in_list(rows, KEY, chosen.select(KEY)).select(KEY, "date", "epidemic_phase")


@query("j05_scalar_subquery_filter")
def _(spark, sf):
    daily = b.stages(spark, sf, FEATURES).daily()
    last = daily.select(F.max("date").alias("last")).scalar()
    return daily.filter(F.col("date") >= F.date_sub(last, 14)).select(KEY, "date", "daily_new_cases")


over_stages("j06_overlap_join", lambda st: st.overlap(), AVERAGES)

# Aggregations

over_stages("a01_conditional_pivot", lambda st: st.combined())
over_stages("a02_table_summary", lambda st: ingest.table_summary(st.combined(), "combined"))
over_daily("a03_series_profile", ingest.series_profile)
over_stages("a04_train_coverage", lambda st: forecast.train_coverage(st.training()))
over_stages("a05_forecast_coverage", lambda st: forecast.forecast_coverage(st.forecasts()))
over_stages("a06_anomaly_summary", lambda st: anomaly.anomaly_summary(st.anomalies()))
over_stages("a07_anomaly_stats", lambda st: anomaly.anomaly_stats(st.anomalies()))
over_features("a08_first_last_by_order", lambda df: windows.first_last(df, "rolling_avg_7d_cases"))


@query("a09_peak_with_date")
def _(spark, sf):
    rows = features.features_without_flag(b.stages(spark, sf).daily(), CONFIG.features)
    peaks = rows.groupBy(KEY).agg(forecast.peak_key("rolling_avg_7d_cases").alias("peak"))
    return peaks.select(KEY, forecast.peak_value("peak").alias("peak_value"), forecast.peak_date("peak").alias("peak_date"))


@query("a10_having_all")
def _(spark, sf):
    st = b.stages(spark, sf, FEATURES)
    rows = features.features_without_flag(st.daily(), CONFIG.features)
    return features.endemic_series(rows, st.daily(), EndemicConfig(days=3))


over_features("a11_count_distinct", lambda df: df.groupBy(KEY).agg(F.countDistinct("epidemic_phase").alias("phases")))
over_stages("a12_metric_pivot", lambda st: forecast.metric_pivot(st.forecast_metrics()), AVERAGES)


@query("a12_metric_pivot_extra")
def _(spark, sf):
    """A metric of one's own beside the listed ones."""
    metrics = b.stages(spark, sf, (*AVERAGES, "forecast_metrics")).forecast_metrics()
    root = metrics.filter("error_metric = 'MSE'").select(
        "series", F.lit("RMSE").alias("error_metric"), half_up(F.sqrt("metric_value"), 4).alias("metric_value")
    )
    return forecast.metric_pivot(metrics.unionByName(root), (*forecast.METRIC_ORDER, "RMSE"))


over_stages("a13_global_kpis", lambda st: report.global_kpis(st.risk_tiers()), RISK)


@query("a14_list_agg")
def _(spark, sf):
    st = b.stages(spark, sf, (*RISK, "risk_tiers"))
    return text.triage_prompts(text.triage_lines(st.risk_tiers()), b.folder(spark), CONFIG.report.triage_budget)


over_stages("a15_anomaly_kpis", lambda st: anomaly.anomaly_kpis(st.anomalies()), ("anomalies",))
over_stages("a16_recent_flag", lambda st: anomaly.recent_flag(st.anomalies()))
QUERIES["a17_trailing_max"] = lambda spark, sf: anomaly.trailing_max(b.mobility(spark, sf), "mobility_index", 14)

# Windows

over_daily("w01_daily_delta", lambda df: df)
over_daily(
    "w02_rolling_avg",
    lambda df: windows.rolling_avg(
        df,
        "daily_new_cases",
        {"rolling_avg_7d_cases": 7, "rolling_avg_14d_cases": 14, "rolling_avg_28d_cases": 28},
    ),
)
over_daily(
    "w02_rolling_avg_deaths",
    lambda df: windows.rolling_avg(
        df, "daily_new_deaths", {"rolling_avg_7d_deaths": 7, "rolling_avg_14d_deaths": 14}
    ),
)
over_daily(
    "w03_rolling_sum",
    lambda df: windows.rolling_sum(df, "daily_new_cases", {"sum_7d_cases": (7, 0), "sum_30d_cases": (28, 0)}),
)
over_daily(
    "w04_offset_frame_sum", lambda df: windows.rolling_sum(df, "daily_new_cases", {"prev_sum_7d_cases": (7, 7)})
)
over_daily(
    "w05_lag_n",
    lambda df: windows.lag_n(
        df, {"cases_7d_ago": ("daily_new_cases", 7), "confirmed_7d_ago": ("cumulative_confirmed", 7)}
    ),
)
over_daily("w06_rolling_stddev", lambda df: windows.rolling_stddev(df, "daily_new_cases", 14, "volatility_14d"))
over_daily(
    "w07_first_value_datediff",
    lambda df: df.select(KEY, "date", windows.days_since_first().alias("days_since_first_case")),
)
over_daily(
    "w08_rt_windows",
    lambda df: windows.rolling_sum(df, "daily_new_cases", {"rt_numerator": (5, 0), "rt_denominator": (5, 5)}),
)
over_daily(
    "w09_rolling_moments",
    lambda df: windows.rolling_moments(
        anomaly.anomaly_input(df, CONFIG.anomaly), "daily_new_cases", CONFIG.anomaly.window
    ).withColumn("moment_sum_sq", F.col("moment_sum_sq").cast("double")),
)
over_stages("w10_row_number_top1", lambda st: windows.latest_per_series(st.features()), FEATURES)
over_stages(
    "w11_row_number_asc_desc",
    lambda st: windows.row_number_both_ways(st.forecasts().select(KEY, "date", "forecasted_cases")),
)
over_features(
    "w12_partition_max",
    lambda df: windows.partition_max(
        df.select(KEY, "date", "rolling_avg_7d_cases"), "rolling_avg_7d_cases", "series_peak"
    ),
)
over_stages("w13_topk_per_group", lambda st: cols("deviation_pct", "rnk")(text.top_anomalies(st.anomalies())))

# Features

for _key, _column in {
    "i01_case_fatality_rate": "case_fatality_rate",
    "i02_day_of_week": "day_of_week",
    "i03_rt_effective": "rt_effective",
    "i04_doubling_time": "doubling_time_days",
    "i05_wow_change_pct": "wow_change_pct",
    "i06_weekly_growth_rate": "weekly_growth_rate",
    "i07_signal_to_noise": "signal_to_noise",
    "i08_trend_direction": "trend_direction",
    "i09_acceleration": "acceleration",
    "i10_epidemic_phase": "epidemic_phase",
}.items():
    over_features(_key, cols(_column))
over_stages("i11_endemic_flag", lambda st: cols("endemic_flag")(st.features()), FEATURES)
over_stages("i12_feature_store", lambda st: st.features(), FEATURES)


@query("i12_incremental_refresh")
def _(spark, sf):
    """The store of a panel from which some days were missing or wrong, brought up to date."""
    st = b.stages(spark, sf, ("combined",))
    now = st.combined()
    late, wrong = b.late_rows(), b.wrong_rows()
    before = now.filter(~late).withColumn("cumulative_confirmed", F.col("cumulative_confirmed") + F.when(wrong, 40).otherwise(0))
    old = features.feature_store(ingest.daily_delta(before), CONFIG.features, CONFIG.endemic)
    old = sinks.write_table(old, f"{b.folder(spark)}/features")
    changes = now.filter(late | wrong).select(KEY, "date")
    return refresh.refresh_features(old, now, changes, CONFIG.features, CONFIG.endemic)


over_stages("i13_global_latest_snapshot", lambda st: features.global_latest_snapshot(st.features()), ("daily", "features"))
QUERIES["i14_mobility_index"] = lambda spark, sf: b.mobility(spark, sf).select(KEY, "date", "mobility_index")

# Forecast and anomalies

over_stages("f01_train_split", lambda st: st.training())


@query("f02_fit_forecaster")
def _(spark, sf):
    offsets = [half_up(F.col("offsets")[F.lit(d)], 4).alias(f"offset_{d}") for d in range(7)]
    return b.stages(spark, sf).model().select(
        KEY,
        "n_train",
        "last_date",
        half_up("slope", 6).alias("slope"),
        half_up("intercept", 4).alias("intercept"),
        half_up("sigma", 4).alias("sigma"),
        *offsets,
    )


over_stages("f03_forecast", lambda st: st.forecasts())
over_stages("f04_history_forecast", lambda st: st.history_forecast(), AVERAGES)
over_stages("f05_forecast_metrics", lambda st: st.forecast_metrics(), AVERAGES)
over_stages(
    "f05_backtest_metrics",
    lambda st: forecast.forecast_metrics(forecast.backtest(st.training(), CONFIG.forecast), CONFIG.forecast),
    AVERAGES,
)
over_stages(
    "f05_rolling_origins",
    lambda st: forecast.rolling_origin_metrics(st.training(), b.ORIGINS, CONFIG.forecast),
    AVERAGES,
)
over_stages("f06_forecast_summary", lambda st: forecast.forecast_summary(st.forecasts()))
over_stages("f07_forecast_trajectory", lambda st: forecast.forecast_trajectory(st.forecasts()))
over_stages(
    "f08_forecast_display_split",
    lambda st: forecast.forecast_display_split(st.history_forecast(), CONFIG.report),
    AVERAGES,
)
over_stages("f09_forecast_kpis", lambda st: forecast.forecast_kpis(st.risk_tiers(), st.forecasts()), RISK_AND_FORECASTS)
over_stages("f10_interval_band", lambda st: forecast.interval_band(st.history_forecast()), AVERAGES)


def same_weekday_forecaster(frame, periods, prediction_interval):
    """Sample plug-in model: the mean of the last four values of the same weekday, in whole hundredths."""
    import math
    from statistics import NormalDist

    days = pd.to_datetime(frame["date"])
    values = (frame["target"].astype(float) * 100).round().astype("int64")
    ahead = pd.date_range(days.iloc[-1] + pd.Timedelta(days=1), periods=periods)
    by_day = {d: g.tail(4) for d, g in values.groupby(days.dt.dayofweek.to_numpy())}
    last = values.tail(28)

    def mean(rows):
        return (2 * int(rows.sum()) + len(rows)) // (2 * len(rows))

    point = [mean(by_day.get(d.dayofweek, last)) for d in ahead]
    n, spread = len(last), len(last) * sum(int(x) ** 2 for x in last) - int(last.sum()) ** 2
    z = NormalDist().inv_cdf((1 + prediction_interval) / 2)
    half = math.floor(z * math.sqrt(float(spread) / float(n * (n - 1))) + 0.5) if n > 1 else 0
    return pd.DataFrame(
        {"date": ahead.date, "point": [p / 100 for p in point], "lower": [(p - half) / 100 for p in point],
         "upper": [(p + half) / 100 for p in point]}
    )


over_stages(
    "f11_fit_forecaster_custom",
    lambda st: forecast.fit_forecaster_custom(st.training(), same_weekday_forecaster, CONFIG.forecast),
)
over_stages("n01_zscore_anomalies", lambda st: st.anomalies())
over_daily("n02_model_anomalies", lambda df: anomaly.model_anomalies(df, CONFIG.anomaly), FEATURES)


over_daily(
    "n02_rank_percentiles",
    lambda df: anomaly.empirical_percentiles(anomaly.model_anomalies(df, CONFIG.anomaly)).select(
        KEY, "date", "distance", "is_anomaly", "percentile", "rank_percentile", "is_rare"
    ),
    FEATURES,
)


@query("n03_flagged_split")
def _(spark, sf):
    rows, _spikes, _drops = anomaly.flagged_split(b.stages(spark, sf).anomalies())
    return rows.select(
        KEY,
        "date",
        (F.col("anomaly_direction") == "SPIKE").alias("is_spike"),
        (F.col("anomaly_direction") == "DROP").alias("is_drop"),
    )


# Risk and context

over_features(
    "k01_latest_per_series",
    lambda df: windows.latest_per_series(df).select(KEY, "date", "rolling_avg_7d_cases", "rt_effective", "epidemic_phase"),
)
over_stages("k02_data_gap_flag", lambda st: st.risk_tiers().select(KEY, "data_gap"), RISK)
over_stages(
    "k03_forecast_trend_pct",
    lambda st: forecast.forecast_summary(st.forecasts()).select(KEY, risk.forecast_trend_pct().alias("forecast_trend_pct")),
)
for _key, _name, _build in (
    ("k04_f1_rt", "f1_rt", risk.f1_rt),
    ("k06_f3_accel", "f3_accel", risk.f3_accel),
    ("k07_f4_doubling", "f4_doubling", risk.f4_doubling),
    ("k08_f5_wow", "f5_wow", risk.f5_wow),
    ("k09_f6_cfr", "f6_cfr", risk.f6_cfr),
    ("k10_f7_volume", "f7_volume", risk.f7_volume),
):
    over_features(
        _key, lambda df, name=_name, build=_build: df.select(KEY, "date", build(CONFIG.risk).cast("int").alias(name))
    )
over_stages(
    "k05_f2_forecast",
    lambda st: forecast.forecast_summary(st.forecasts()).select(
        KEY, risk.f2_forecast(CONFIG.risk).cast("int").alias("f2_forecast")
    ),
)
over_stages(
    "k11_f8_anomaly",
    lambda st: anomaly.recent_flag(st.anomalies()).select(
        KEY, risk.f8_anomaly(CONFIG.risk).cast("int").alias("f8_anomaly")
    ),
)
over_stages("k12_risk_score", lambda st: st.risk_tiers().select(KEY, "risk_score"), RISK)
over_stages("k13_risk_tier", lambda st: st.risk_tiers().select(KEY, "risk_tier"), RISK)
over_stages("k14_risk_tiers", lambda st: st.risk_tiers(), RISK)
over_stages(
    "k15_model_confidence",
    lambda st: context.model_quality(st.forecast_metrics()).select(
        KEY, "model_mape", context.model_confidence("model_mape").alias("model_confidence")
    ),
    AVERAGES,
)
over_features("k16_wave_context", context.wave_context)


@query("k17_pct_of_peak")
def _(spark, sf):
    st = b.stages(spark, sf, ("daily", "features"))
    latest = windows.latest_per_series(st.features()).select(KEY, "rolling_avg_7d_cases")
    peaks = context.wave_context(st.features())
    share = context.pct_of_peak("rolling_avg_7d_cases", "all_time_peak_cases")
    return latest.join(peaks, KEY).select(KEY, share.alias("pct_of_all_time_peak"))


over_stages("k18_context_view", lambda st: st.context(), CONTEXT)
over_stages("k19_scenario_inputs", lambda st: context.scenario_inputs(st.context()), CONTEXT)

# Text

for _key, _template in (
    ("t01_prompt_metric_explainer", text.METRIC_EXPLAINER),
    ("t02_prompt_situation_summary", text.SITUATION_SUMMARY),
    ("t03_prompt_preventive", text.PREVENTIVE_MEASURES),
    ("t05_prompt_scenarios", text.SCENARIO_PROMPT),
):
    over_stages(_key, lambda st, template=_template: text.prompts(st.context(), {"prompt": template}), CONTEXT)
over_stages("t04_prompt_anomaly", lambda st: cols("day_of_week", "prompt")(text.anomaly_prompts(st.anomalies())))


@query("t06_batch_generate")
def _(spark, sf):
    return text.batch_generate(b.table(spark, sf, "conversations"), "text", "answer").select("conv_id", "turn", "answer")


def stored_twice(spark, sf):
    """Two runs over one store: the users' turns, then all turns. Equal texts are asked once."""
    store = responses.ResponseStore(f"{b.folder(spark)}/responses")
    turns = b.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    first = store.generate(turns.filter("role = 'user'"), "text", "answer", run="first")
    second = store.generate(turns, "text", "answer", run="second", waves=2)
    return store, {"first": first, "second": second}


@query("t06_stored_answers")
def _(spark, sf):
    _, runs = stored_twice(spark, sf)
    return runs["second"].select("conv_id", "turn", "answer", "error")


@query("t06_stored_calls")
def _(spark, sf):
    """Rows, different prompts and calls of each run."""
    store, runs = stored_twice(spark, sf)
    counts = [
        df.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_prompts"))
        for run, df in runs.items()
    ]
    calls = store.calls(spark).select("run", "n_calls", "n_failed")
    return counts[0].unionByName(counts[1]).join(calls, "run", "left").na.fill(0)


QUERIES["t07_batch_summarise"] = lambda spark, sf: text.batch_summarise(
    b.table(spark, sf, "documents"), "text", "brief"
).select("doc_id", "brief")
over_stages("t08_anomaly_explanations", lambda st: st.anomaly_explanations())
over_stages("t09_global_triage", lambda st: st.global_triage().drop("generated_at"), (*RISK, "risk_tiers"))
over_stages("t10_narratives", lambda st: st.narratives().drop("generated_at"), CONTEXT)
over_stages(
    "t11_text_length_check",
    lambda st: text.text_lengths(
        st.narratives(),
        {f"{c}_len": c for c in ("metric_explainer", "situation_summary", "preventive_measures", "executive_brief")},
        [KEY, "risk_tier"],
    ),
    CONTEXT,
)
over_stages("t12_policy_simulations", lambda st: st.policy_simulations().drop("generated_at"), CONTEXT)
QUERIES["t13_conversation_context"] = lambda spark, sf: text.conversation_context(b.table(spark, sf, "conversations"))
QUERIES["t14_extract_select"] = lambda spark, sf: b.responses(spark, sf).select(
    "conv_id", "turn", "role", text.extract_select("response").alias("query")
)
QUERIES["t14_extract_select_words"] = lambda spark, sf: b.responses(spark, sf).select(
    "conv_id", "turn", "role", text.extract_select("response", word_boundary=True).alias("query")
)
QUERIES["t15_strip_fence"] = lambda spark, sf: b.responses(spark, sf).select(
    "conv_id", "turn", text.strip_fence("response").alias("clean")
)


@query("t17_chat_prompts")
def _(spark, sf):
    """The prompt of each user turn, about the series its conversation is dealt to."""
    st = b.stages(spark, sf, (*RISK, "risk_tiers"))
    lines = packing.numbered(text.series_context_line(st.risk_tiers()), [KEY], "n", f"{b.folder(spark)}/lines")
    history = text.conversation_context(b.table(spark, sf, "conversations"))
    dealt = history.withColumn("n", F.pmod("conv_id", lines.select(F.count(F.lit(1))).scalar()))
    return text.chat_prompts(dealt.join(lines, "n"), F.col("context_line"))


@query("t18_result_prompts")
def _(spark, sf):
    """The prompt that explains the rows after each user's question, here the turn that follows it."""
    turns = b.table(spark, sf, "conversations")
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.withColumn("preview", answer).filter("role = 'user'")
    return text.result_prompts(asked.select("conv_id", "turn", F.col("text").alias("question"), "preview")).select(
        "conv_id", "turn", "prompt"
    )


over_stages("t16_series_context_line", lambda st: text.series_context_line(st.risk_tiers()), (*RISK, "risk_tiers"))

# Reports

over_stages("r01_risk_ranking", lambda st: report.risk_ranking(st.risk_tiers()), RISK)
over_stages("r02_rt_score_scatter", lambda st: report.rt_score_scatter(st.risk_tiers()), RISK)
over_stages("r03_risk_table", lambda st: report.risk_table(st.risk_tiers()), RISK)
over_features("r04_epi_profile", lambda df: report.epi_profile(df, config=CONFIG.report))
over_features("r04_epi_profile_selected", lambda df: report.epi_profile(df, [b.SELECTED], CONFIG.report))
QUERIES["r05_vaccination_series"] = lambda spark, sf: report.vaccination_series(b.vaccinations(spark, sf))


@query("r06_comparison")
def _(spark, sf):
    st = b.stages(spark, sf, RISK)
    chosen = report.default_selection(st.risk_tiers())
    return report.comparison_trends(st.features(), chosen, CONFIG.report)


@query("r06_comparison_risk")
def _(spark, sf):
    st = b.stages(spark, sf, (*RISK, "risk_tiers"))
    return report.comparison_risk(st.risk_tiers(), report.default_selection(st.risk_tiers()), CONFIG.report)


over_stages("r07_default_selection", lambda st: report.default_selection(st.risk_tiers()), RISK)
over_stages("r07_selected_and_riskiest", lambda st: report.default_selection(st.risk_tiers(), b.SELECTED), (*RISK, "risk_tiers"))
over_stages("r08_anomaly_chart_data", lambda st: report.anomaly_chart(st.anomalies()))
over_stages("r09_top_n_signed", lambda st: report.top_n_signed(st.anomalies()))
over_stages("r09_top_n_per_series", lambda st: report.top_n_signed_per_series(st.anomalies()))
over_stages("r10_preview_limit", lambda st: report.preview_limit(st.anomalies(), order=(KEY, "date")))

# Order and set operations

over_stages("o01_order_by", lambda st: risk.risk_breakdown(st.risk_tiers()), RISK)
over_daily(
    "o02_last_rows_per_series",
    lambda df: windows.topk_per_group(
        df.select(KEY, "date", "daily_new_cases"), CONFIG.report.history_rows, [F.col("date").desc()], KEY
    ),
)
over_stages("o03_union_all", lambda st: cols("type", "val")(st.history_forecast()), AVERAGES)
