import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.config import ReportConfig
from panelloom.operators import report

RISK = (
    "country_region string, risk_tier string, risk_score int, rt_effective double, rolling_avg_7d_cases double, "
    "epidemic_phase string, forecast_trend_pct double"
)


@pytest.fixture(scope="module")
def risk(spark):
    rows = [
        ("d", "LOW", 10, 0.5, 1.0, "PLATEAU", 0.0),
        ("b", "HIGH", 70, 1.25, 9.0, "PLATEAU", 1.5),
        ("a", "HIGH", 70, None, 3.0, "TRANSITION", None),
        ("e", "LOW", 0, 1.0, None, "PLATEAU", 0.0),
        ("c", "MODERATE", 30, 1.0, 2.0, "PLATEAU", 0.0),
    ]
    return spark.createDataFrame(rows, RISK)


def names(df):
    return [r[0] for r in df.collect()]


def test_ranking_order(risk):
    assert names(report.risk_ranking(risk)) == ["a", "b", "c", "d", "e"]
    assert names(report.risk_ranking(risk, ascending=True)) == ["e", "d", "c", "a", "b"]


def test_kpis(risk):
    assert tuple(report.global_kpis(risk).first()) == (5, 36.0, 0.9375, 2, 1, 2)


def test_scatter_needs_all_three(risk):
    assert sorted(names(report.rt_score_scatter(risk))) == ["b", "c", "d"]


def test_table_labels(risk):
    df = report.risk_table(risk)
    assert df.columns == ["Country", "Risk", "Score", "7-Day Avg", "Rt", "Phase", "Forecast %"]
    assert tuple(df.first()) == ("a", "HIGH", "70", "3.0", "—", "TRANSITION", "—")


def test_default_selection(risk):
    assert sorted(names(report.default_selection(risk, "e"))) == ["a", "b", "e"]
    assert sorted(names(report.default_selection(risk, "a"))) == ["a", "b", "c"]
    assert names(report.default_selection(risk)) == ["a", "b", "c"]


def test_comparison(spark, risk):
    rows = [(s, day(i), float(i), None) for s in "abc" for i in range(4)]
    features = spark.createDataFrame(rows, "country_region string, date date, rolling_avg_7d_cases double, rt_effective double")
    config = ReportConfig(start=str(day(2)))
    for selection in (["a", "c"], spark.createDataFrame([("a",), ("c",)], "country_region string")):
        got = by_key(report.comparison_trends(features, selection, config), "rolling_avg_7d_cases")
        assert sorted(got) == [(s, day(i)) for s in "ac" for i in (2, 3)]
    table = {r[0]: r["forecast_trend_pct"] for r in report.comparison_risk(risk, ["a", "b"]).collect()}
    assert table == {"a": "—", "b": "1.5"}
    with pytest.raises(ValueError):
        report.comparison_risk(risk, list("abcdef"))


def test_profile_is_ordered_and_filtered(spark):
    columns = "country_region string, date date, rt_effective double, rolling_avg_7d_cases double, rolling_avg_14d_cases double, rolling_avg_7d_deaths double"
    rows = [(s, day(i), None, 1.0, 1.0, 0.0) for i in (3, 1, 2) for s in "ba"]
    df = report.epi_profile(spark.createDataFrame(rows, columns), ["a"], ReportConfig(start=str(day(2))))
    assert [r["date"] for r in df.collect()] == [day(2), day(3)]
    everyone = report.epi_profile(spark.createDataFrame(rows, columns), None, ReportConfig(start=str(day(2))))
    assert sorted(names(everyone)) == ["a", "a", "b", "b"]


def test_vaccination_rows_need_some_coverage(spark):
    rows = [("a", day(0), 1, 1, 1, 1.0, None, None), ("a", day(1), 1, 1, 1, 1.0, 5.0, None), ("b", day(0), 1, 1, 1, 1.0, None, 9.0)]
    df = report.vaccination_series(spark.createDataFrame(rows, schemas.VACCINATIONS))
    assert sorted((r["country_region"], r["date"]) for r in df.collect()) == [("a", day(0)), ("a", day(1))]


def test_preview(spark):
    assert report.preview_limit(spark.range(100)).count() == 20


def test_preview_in_order(spark):
    rows = report.preview_limit(spark.range(100).repartition(3), 3, ("id",)).collect()
    assert [r["id"] for r in rows] == [0, 1, 2]


def test_selection_limit_holds_for_lists_and_frames(spark, risk):
    six = spark.createDataFrame([(x,) for x in "abcdef"], "country_region string")
    for chosen in (six, list("abcdef")):
        with pytest.raises(ValueError):
            report.comparison_risk(risk, chosen)
    assert report.comparison_risk(risk, six.limit(5)).count() <= 5


def test_vaccination_series_is_one_pass(spark):
    rows = [("a", None, 1.0), ("a", 2.0, None), ("b", None, 3.0)]
    df = spark.createDataFrame(rows, "country_region string, vaccinated_per_100 double, fully_vaccinated_per_100 double")
    out = report.vaccination_series(df.withColumn("date", F.current_date()))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r["country_region"] for r in out.collect()] == ["a", "a"]
