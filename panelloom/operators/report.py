"""Ranked, filtered and pivoted tables behind a dashboard.

Filters and top-n run on Spark; callers decide what to fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.config import Columns, ReportConfig
from panelloom.functions.numeric import exact_avg
from panelloom.operators.projections import filter_date_range, filter_in_list, filter_null, rename_fill_display
from panelloom.operators.windows import topk_per_group

# Labels of the risk table on display; the series comes first.
SERIES_LABEL = "Country"
RISK_LABELS = {
    "risk_tier": "Risk",
    "risk_score": "Score",
    "rolling_avg_7d_cases": "7-Day Avg",
    "rt_effective": "Rt",
    "doubling_time_days": "Doubling (d)",
    "epidemic_phase": "Phase",
    "forecast_trend_pct": "Forecast %",
}


def riskiest_first(columns: Columns = Columns()) -> list[Column]:
    return [F.col("risk_score").desc(), F.col(columns.series)]


def global_kpis(risk: DataFrame) -> DataFrame:
    """Series count, mean score, mean Rt of the series that have one, series per tier."""
    n = F.count(F.lit(1))
    return risk.agg(
        n.alias("n_series"),
        (F.sum("risk_score").cast("double") / F.nullif(n, F.lit(0)).cast("double")).alias("avg_score"),
        exact_avg("rt_effective", 3).alias("avg_rt"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("n_high"),
        F.count_if(F.col("risk_tier") == "MODERATE").alias("n_moderate"),
        F.count_if(F.col("risk_tier") == "LOW").alias("n_low"),
    )


def risk_ranking(risk: DataFrame, ascending: bool = False, columns: Columns = Columns()) -> DataFrame:
    score = F.col("risk_score")
    order = [score.asc() if ascending else score.desc(), F.col(columns.series)]
    return risk.select(columns.series, "risk_tier", "risk_score").orderBy(*order)


def rt_score_scatter(risk: DataFrame, columns: Columns = Columns()) -> DataFrame:
    needed = ["rt_effective", "risk_score", "rolling_avg_7d_cases"]
    return filter_null(risk, needed).select(columns.series, "risk_tier", *needed)


def risk_labels(columns: Columns = Columns()) -> dict[str, str]:
    return {columns.series: SERIES_LABEL, **RISK_LABELS}


def risk_table(risk: DataFrame, labels: dict | None = None, columns: Columns = Columns()) -> DataFrame:
    return rename_fill_display(risk.orderBy(*riskiest_first(columns)), labels or risk_labels(columns))


def epi_profile(
    features: DataFrame,
    series: list[str] | None = None,
    config: ReportConfig = ReportConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """Chart rows from a start date on: of the chosen series in date order, or unordered of all when None."""
    rows = features if series is None else filter_in_list(features, columns.series, series)
    chart = filter_date_range(rows, columns.ts, config.start).select(
        columns.series, columns.ts, "rt_effective", "rolling_avg_7d_cases", "rolling_avg_14d_cases",
        "rolling_avg_7d_deaths",
    )
    return chart if series is None else chart.orderBy(columns.series, columns.ts)


def vaccination_series(vaccinations: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """All rows of the series that have any coverage figure: one window over one pass of the source."""
    covered = F.max(F.col("vaccinated_per_100").isNotNull()).over(Window.partitionBy(columns.series))
    return vaccinations.withColumn("__covered", covered).filter("__covered").select(
        columns.series, columns.ts, "vaccinated_per_100", "fully_vaccinated_per_100"
    )


def default_selection(risk: DataFrame, selected: str | None = None, columns: Columns = Columns()) -> DataFrame:
    """The selected series (the riskiest when None) and the first two others of the top four."""
    key = columns.series
    top = risk.select(key, "risk_score").orderBy(*riskiest_first(columns)).limit(4)
    if selected is None:
        return top.orderBy(*riskiest_first(columns)).limit(3).select(key)
    others = top.filter(F.col(key) != selected).orderBy(*riskiest_first(columns)).limit(2)
    return risk.filter(F.col(key) == selected).select(key).unionByName(others.select(key))


def _selection(selection, columns: Columns, config: ReportConfig):
    """At most ``max_selected`` series, given as a list or as a frame; more raise."""
    limit = config.max_selected
    count = selection.limit(limit + 1).count() if isinstance(selection, DataFrame) else len(selection)
    if count > limit:
        raise ValueError(f"at most {limit} series can be compared")
    return selection


def comparison_trends(
    features: DataFrame, selection, config: ReportConfig = ReportConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Averages and Rt of the selected series since the start date."""
    chosen = filter_in_list(features, columns.series, _selection(selection, columns, config))
    return filter_date_range(chosen, columns.ts, config.start).select(
        columns.series, columns.ts, "rolling_avg_7d_cases", "rt_effective"
    )


def comparison_risk(
    risk: DataFrame, selection, config: ReportConfig = ReportConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Risk rows of the selected series as display text."""
    chosen = filter_in_list(risk, columns.series, _selection(selection, columns, config))
    shown = [columns.series, "risk_tier", "risk_score", "rt_effective", "epidemic_phase", "forecast_trend_pct"]
    return rename_fill_display(chosen, {c: c for c in shown})


def anomaly_chart(anomalies: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Observed and expected values with the observed value repeated under its marker."""
    observed = F.col("daily_new_cases")

    def marker(direction: str) -> Column:
        return F.when(F.col("is_anomaly") & (F.col("anomaly_direction") == direction), observed)

    return anomalies.select(
        columns.series,
        columns.ts,
        observed.alias("observed"),
        "expected",
        marker("SPIKE").alias("spike"),
        marker("DROP").alias("drop"),
    )


TOP_COLUMNS = ("daily_new_cases", "expected", "deviation_pct", "anomaly_direction")


def top_n_signed(anomalies: DataFrame, n: int = ReportConfig().top_n, columns: Columns = Columns()) -> DataFrame:
    """Flagged rows with the largest signed deviation, spikes first; earlier dates win ties."""
    order = [F.col("deviation_pct").desc(), F.col(columns.ts), F.col(columns.series)]
    return anomalies.filter("is_anomaly").select(columns.series, columns.ts, *TOP_COLUMNS).orderBy(*order).limit(n)


def top_n_signed_per_series(
    anomalies: DataFrame, n: int = ReportConfig().top_n, columns: Columns = Columns()
) -> DataFrame:
    order = [F.col("deviation_pct").desc(), F.col(columns.ts)]
    rows = topk_per_group(anomalies.filter("is_anomaly"), n, order, columns.series)
    return rows.select(columns.series, columns.ts, *TOP_COLUMNS, "rnk")


def preview_limit(df: DataFrame, n: int = ReportConfig().preview_rows, order: tuple = ()) -> DataFrame:
    """The first rows by ``order``, or any rows without one."""
    return (df.orderBy(*order) if order else df).limit(n)
