import pytest
from conftest import COMBINED, by_key, day

from panelloom import schemas
from panelloom.config import IngestConfig
from panelloom.operators import ingest, projections
from panelloom.sources import tables


def fact(spark, rows):
    return spark.createDataFrame(rows, schemas.FACT)


def test_pivot_sums_variants_and_drops_untracked(spark):
    rows = [
        ("United States", day(0), "Confirmed", 5),
        ("US", day(0), "Confirmed", 7),
        ("US", day(0), "Deaths", 1),
        ("US", day(0), "Recovered", 99),
        ("Iran, Islamic Republic of", day(0), "Deaths", 2),
        ("Korea, North", day(0), "Confirmed", 4),
        ("Atlantis", day(0), "Confirmed", 3),
    ]
    got = by_key(ingest.combine(fact(spark, rows)), "cumulative_confirmed", "cumulative_deaths")
    assert got == {("US", day(0)): (12, 1), ("Iran", day(0)): (0, 2)}


def test_tracking_everything_and_no_variants(spark):
    rows = [("x", day(0), "c", 1), ("y", day(0), "d", 2)]
    config = IngestConfig(variants={}, tracked=None, confirmed_type="c", deaths_type="d")
    got = by_key(ingest.combine(fact(spark, rows), config), "cumulative_confirmed", "cumulative_deaths")
    assert got == {("x", day(0)): (1, 0), ("y", day(0)): (0, 2)}


def test_daily_delta_clips_and_keeps_first_day(spark):
    totals = [10, 15, 12, 12, 30]
    rows = [("a", day(i), t, t // 5) for i, t in enumerate(totals)] + [("b", day(3), 4, 0)]
    df = ingest.daily_delta(spark.createDataFrame(rows, COMBINED))
    got = by_key(df, "daily_new_cases", "daily_new_deaths")
    assert [got[("a", day(i))] for i in range(5)] == [(10, 2), (5, 1), (0, 0), (0, 0), (18, 4)]
    assert got[("b", day(3))] == (4, 0)
    assert df.columns == ["country_region", "date", "cumulative_confirmed", "cumulative_deaths", "daily_new_cases", "daily_new_deaths"]


def test_profile_and_summary(spark, daily_frame):
    daily = daily_frame({"a": [4, 0, 0, 8], "z": [0, 0]}, deaths_every=4)
    profile = {r["country_region"]: r.asDict() for r in ingest.series_profile(daily).collect()}
    assert profile["a"]["days"] == 4 and profile["a"]["zero_days"] == 2 and profile["a"]["zero_pct"] == 50.0
    assert profile["a"]["cfr_pct"] == 25.0 and profile["a"]["total_cases"] == 12
    assert profile["z"]["cfr_pct"] is None and profile["z"]["zero_pct"] == 100.0
    summary = ingest.table_summary(daily, "daily").first()
    assert tuple(summary) == ("daily", 6, 2, day(0), day(3))


def test_names_by_frame_equal_names_by_dict(spark):
    df = spark.createDataFrame([("p",), ("q",), (None,)], "country_region string")
    variants = {"p": "P"}
    frame = spark.createDataFrame(list(variants.items()), "raw_name string, name string")
    for given in (variants, frame):
        got = projections.canonicalise_names(df, "country_region", given)
        assert {r[0] for r in got.collect()} == {"P", "q", None}


def test_vaccinations_and_mobility(spark):
    vax = spark.createDataFrame(
        [("South Korea", day(0), 1, 2, 3, 0.5, 1.5, None), ("Nowhere", day(0), 1, 2, 3, 0.5, 1.5, 2.5)],
        schemas.VACCINATION_SOURCE,
    )
    rows = tables.load_vaccinations(vax).collect()
    assert [tuple(r) for r in rows] == [("Korea, South", day(0), 1, 2, 3, 0.5, 1.5, None)]
    mob = spark.createDataFrame(
        [
            ("US", None, day(0), 10.0, 1.0, None, -3.0, 5.0),
            ("US", "Ohio", day(0), 10.0, 1.0, 1.0, 1.0, 1.0),
            ("Nowhere", None, day(0), 1.0, 1.0, 1.0, 1.0, 1.0),
        ],
        schemas.MOBILITY_SOURCE,
    )
    rows = tables.load_mobility(mob).collect()
    assert [(r["country_region"], r["mobility_index"]) for r in rows] == [("US", 2.33)]
    assert rows[0].asDict().keys() == {f.name for f in schemas.MOBILITY.fields}


def test_missing_optional_source_is_empty_with_schema(spark, tmp_path):
    df = tables.scan_optional(spark, str(tmp_path / "none.parquet"), schemas.MOBILITY)
    assert df.schema == schemas.MOBILITY and df.count() == 0
    assert tables.scan_optional(spark, "no_such_table", schemas.MOBILITY).count() == 0
    assert tables.scan_optional(spark, None, schemas.VACCINATIONS).schema == schemas.VACCINATIONS


def test_append_conforms(spark):
    declared = schemas.METRICS
    first = spark.createDataFrame([("a", "MAE", 1.0)], declared)
    second = spark.createDataFrame([(2, "b")], "metric_value int, series string")
    got = sorted(map(tuple, tables.append_rows(first, second, declared).collect()), key=str)
    assert got == [("a", "MAE", 1.0), ("b", None, 2.0)]


def test_filters_tags_and_display(spark):
    df = spark.createDataFrame(
        [("a", day(0), 1.0), ("b", day(5), None), ("c", day(9), 3.0)], "country_region string, date date, v double"
    )
    keys = lambda x: [r[0] for r in x.orderBy("country_region").collect()]
    assert keys(projections.filter_in_list(df, "country_region", ["a", "c"])) == ["a", "c"]
    allowed = spark.createDataFrame([("b",), ("b",)], "n string")
    assert keys(projections.filter_in_list(df, "country_region", allowed)) == ["b"]
    assert keys(projections.filter_date_range(df, "date", str(day(5)), str(day(9)))) == ["b", "c"]
    assert keys(projections.filter_date_range(df, "date", None, str(day(5)))) == ["a", "b"]
    assert keys(projections.filter_null(df, ["v"])) == ["a", "c"]
    assert keys(projections.filter_null(df, ["v"], keep_null=True)) == ["b"]
    tagged = projections.literal_tag(df, {"type": "ACTUAL"}, {"bound": "double"})
    assert dict(tagged.dtypes)["bound"] == "double" and tagged.first()["type"] == "ACTUAL"
    shown = projections.rename_fill_display(df, {"country_region": "Country", "missing": "Gone", "v": "Value"})
    assert shown.columns == ["Country", "Value"]
    assert [tuple(r) for r in shown.orderBy("Country").collect()] == [("a", "1.0"), ("b", "—"), ("c", "3.0")]


@pytest.mark.parametrize(
    "code, label",
    [("EXPONENTIAL_GROWTH", "Exp. Growth"), ("PLATEAU", "Plateau"), ("TRANSITION", "Transition"), ("A_B", "A B"), (None, "—")],
)
def test_labels(spark, code, label):
    df = spark.createDataFrame([(code,)], "epidemic_phase string")
    assert df.select(projections.label_map("epidemic_phase")).first()[0] == label


def test_mobility_index_rounds_decimals(spark):
    rows = [(0.855, None, 0.0), (1.725, 0.0, None), (-0.855, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "retail_and_recreation double, transit_stations double, workplaces double")
    assert [r[0] for r in df.select(tables.mobility_index()).collect()] == [0.29, 0.58, -0.29]


def test_an_empty_folder_is_not_an_absent_source(spark, tmp_path):
    from pyspark.errors import AnalysisException

    declared = schemas.VACCINATIONS
    assert tables.scan_optional(spark, str(tmp_path / "none"), declared).count() == 0
    with pytest.raises(AnalysisException):
        tables.scan_optional(spark, str(tmp_path), declared)
