import os

import pytest
from conftest import day
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.config import AnomalyConfig, ForecastConfig, IngestConfig, PanelConfig
from panelloom.plans.stages import TABLES, PanelStages
from panelloom.sources import sinks, tables

CONFIG = PanelConfig(
    ingest=IngestConfig(variants={}, tracked=None),
    forecast=ForecastConfig(train_start=str(day(0)), train_end=str(day(59)), history_start=str(day(0))),
    anomaly=AnomalyConfig(start=str(day(0))),
)


@pytest.fixture(scope="module")
def fact(spark):
    rows = []
    for name, step in (("a", 7), ("b", 30)):
        total = 0
        for i in range(80):
            total += step + i % 7 + (400 if i == 40 else 0)
            rows += [(name, day(i), "Confirmed", total), (name, day(i), "Deaths", total // 50)]
    return spark.createDataFrame(rows, schemas.FACT)


def test_publish_writes_every_table_under_its_namespace(spark, fact, tmp_path):
    stages = PanelStages(fact, CONFIG, root=str(tmp_path), generated_at=F.lit("2024-01-01").cast("timestamp"))
    published = stages.publish()
    assert set(published) == set(TABLES)
    for name, namespace in TABLES.items():
        assert os.path.isdir(tmp_path / namespace / name), name
        again = spark.read.schema(published[name].schema).parquet(str(tmp_path / namespace / name))
        assert again.count() == published[name].count()
    assert published["features"].count() == 160 and len(published["features"].columns) == 31
    assert published["risk_tiers"].count() == 2 and published["context"].count() == 2
    assert published["forecasts"].count() == 60
    # 80 actual rows and 30 forecast rows per series
    assert published["history_forecast"].count() == 220
    assert published["forecast_metrics"].count() == 12
    assert published["vaccinations"].count() == 0 and published["mobility"].count() == 0
    lengths = published["narratives"].select(F.min(F.length("situation_summary"))).first()[0]
    assert lengths > 0 and published["global_triage"].count() == 1
    assert published["policy_simulations"].first()["generated_at"].year == 2024
    loaded = tables.load_all(published)
    assert dict(loaded["anomalies"].dtypes)["date"] == "date"


def test_lazy_and_cut_stages_agree(fact, tmp_path):
    lazy = PanelStages(fact, CONFIG)
    cut = PanelStages(fact, CONFIG, root=str(tmp_path), cut=("daily", "features", "forecasts"))
    for name in ("features", "forecasts", "forecast_metrics", "risk_tiers", "context"):
        assert sorted(map(str, getattr(lazy, name)().collect())) == sorted(map(str, getattr(cut, name)().collect()))
    assert sorted(os.listdir(tmp_path)) == ["features", "ml", "raw"]


def test_views_are_queryable(spark, fact):
    PanelStages(fact, CONFIG).register_views("v_")
    assert spark.sql("SELECT count(*) FROM v_forecast_training").first()[0] == 120
    assert spark.sql("SELECT count(*) FROM v_anomaly_input").first()[0] == 160
    assert spark.sql("SELECT count(*) FROM v_context_view").first()[0] == 2


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert sinks.shared_folder(spark) == named
    first, second = sinks.run_folder(spark), sinks.run_folder(spark)
    assert first != second and first.startswith(named)


def test_writing_without_a_shared_folder_raises(fact, monkeypatch):
    def nowhere(spark):
        raise ValueError("no folder")

    monkeypatch.setattr(sinks, "shared_folder", nowhere)
    for use in (lambda s: s.daily(), lambda s: s.publish()):
        with pytest.raises(ValueError):
            use(PanelStages(fact, CONFIG, cut=("daily",)))
    assert PanelStages(fact, CONFIG).daily().count() == 160


def test_publish_after_lazy_use_writes_every_table(spark, fact, tmp_path):
    stages = PanelStages(fact, CONFIG, root=str(tmp_path))
    assert stages.risk_tiers().count() == 2 and not os.listdir(tmp_path)
    published = stages.publish()
    assert len(TABLES) == 15
    for name, namespace in TABLES.items():
        folder = str(tmp_path / namespace / name)
        assert spark.read.schema(published[name].schema).parquet(folder).count() == published[name].count(), name
        assert not published[name].inputFiles() or all(folder in f for f in published[name].inputFiles()), name
    stages.close()
    assert os.path.isdir(tmp_path / "raw")


def test_own_folder_is_removed(spark, fact):
    with PanelStages(fact, CONFIG, cut=("daily",)) as stages:
        assert stages.daily().count() == 160
        folder = stages._own
        assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_forecast_consumers_cut_three_columns(fact, tmp_path):
    stages = PanelStages(fact, CONFIG, root=str(tmp_path), cut=("averages",))
    full = PanelStages(fact, CONFIG)
    full.cut = frozenset()
    assert sorted(map(str, stages.forecast_metrics().collect())) == sorted(map(str, full.forecast_metrics().collect()))
    assert stages.averages().columns == ["country_region", "date", "rolling_avg_7d_cases"]
    assert os.listdir(tmp_path / "features") == ["averages"]
    rows = full.features().select(*stages.averages().columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, stages.averages().collect()))


def test_other_column_names_through_the_whole_chain(fact, tmp_path):
    import dataclasses

    from panelloom.config import Columns
    from panelloom.operators import report

    names = Columns(series="shop", ts="d")
    config = dataclasses.replace(CONFIG, columns=names)
    renamed = fact.withColumnsRenamed({"country_region": "shop", "date": "d"})
    stages = PanelStages(renamed, config, root=str(tmp_path))
    published = stages.publish()
    plain = PanelStages(fact, CONFIG)
    for name in ("risk_tiers", "context", "forecast_metrics", "history_forecast", "anomalies"):
        here = published[name].withColumnsRenamed({"shop": "country_region", "d": "date"}).select(*getattr(plain, name)().columns)
        assert sorted(map(str, here.collect())) == sorted(map(str, getattr(plain, name)().collect())), name
    assert {"shop", "d"} <= set(published["mobility"].columns) and published["global_triage"].count() == 1
    table = report.risk_table(published["risk_tiers"], columns=names)
    assert table.columns[0] == report.SERIES_LABEL and {r[0] for r in table.collect()} == {"a", "b"}


def test_bucketed_table_needs_no_shuffle_for_windows(spark, fact):
    from panelloom.operators import windows

    sinks.create_namespaces(spark)
    assert {"raw", "features", "ml", "analytics"} <= {d.name for d in spark.catalog.listDatabases()}
    daily = PanelStages(fact, CONFIG).daily()
    rows = sinks.clustered(daily, "country_region", 4)
    stored = sinks.write_catalog_table(rows, "raw.daily_bucketed", bucket_by="country_region", buckets=4)
    out = windows.rolling_avg(stored, "daily_new_cases", {"m": 7})
    assert out.count() == 160
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    plain = sinks.write_catalog_table(daily, "raw.daily_plain")
    assert plain.count() == 160 and tables.scan_table(spark, "raw.daily_plain").count() == 160
    for name in ("daily_bucketed", "daily_plain"):
        spark.sql(f"DROP TABLE raw.{name}")


def test_bucketed_stages_agree_and_shuffle_the_panel_once(spark, fact):
    cut = ("daily", "features", "anomalies")
    stages = PanelStages(fact, CONFIG, cut=cut, buckets=3, database_prefix="t_")
    lazy = PanelStages(fact, CONFIG)
    for name in ("features", "anomalies", "forecasts", "risk_tiers"):
        assert sorted(map(str, getattr(stages, name)().collect())) == sorted(map(str, getattr(lazy, name)().collect()))
    again = PanelStages(fact, CONFIG)
    again._done["daily"] = stages.daily()
    for df in (again.anomalies(), stages.forecasts()):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(spark.table("t_raw.daily").inputFiles()) <= 3
    for name, namespace in (("daily", "raw"), ("features", "features"), ("anomalies", "ml")):
        spark.sql(f"DROP TABLE t_{namespace}.{name}")


def test_publish_to_catalog_and_again(spark, fact):
    for _ in range(2):
        published = PanelStages(fact, CONFIG, buckets=2, database_prefix="p_").publish()
    assert set(published) == set(TABLES)
    for name, namespace in TABLES.items():
        assert spark.table(f"p_{namespace}.{name}").count() == published[name].count()
    assert spark.table("p_features.features").count() == 160
    for name, namespace in TABLES.items():
        spark.sql(f"DROP TABLE p_{namespace}.{name}")


def test_publish_versions_and_a_run_that_fails(spark, fact):
    cut = ("daily", "features")
    first = PanelStages(fact, CONFIG, buckets=2, database_prefix="w_", cut=cut, versions=True)
    assert first.features().count() == 160
    again = PanelStages(fact, CONFIG)
    again._done["daily"] = first.daily()
    assert "Exchange hashpartitioning" not in again.anomalies()._jdf.queryExecution().executedPlan().toString()
    broken = fact.withColumn("cases", F.when(F.col("date") < str(day(70)), F.col("cases")).otherwise(F.raise_error(F.lit("cut off")).cast("bigint")))
    failing = PanelStages(broken, CONFIG, buckets=2, database_prefix="w_", cut=cut, versions=True)
    with pytest.raises(Exception, match="cut off"):
        failing.daily()
    assert spark.table("w_raw.daily").count() == 160 and spark.table("w_features.features").count() == 160
    for database in ("raw", "features", "ml", "analytics"):
        spark.sql(f"DROP DATABASE w_{database} CASCADE")


def test_invariants(fact, tmp_path):
    from panelloom.operators.risk import FACTORS

    st = PanelStages(fact, CONFIG, root=str(tmp_path), cut=("daily", "features", "forecasts", "anomalies", "risk_tiers"))
    series = st.features().select("country_region").distinct().count()
    assert st.daily().filter("daily_new_cases < 0 OR daily_new_deaths < 0").count() == 0
    assert st.forecasts().filter("NOT (forecast_lower <= forecasted_cases AND forecasted_cases <= forecast_upper)").count() == 0
    assert st.forecasts().count() == 30 * series
    total = " + ".join(FACTORS)
    wrong = f"risk_score <> least({total}, 100) OR risk_tier <> CASE WHEN {total} >= 50 THEN 'HIGH' WHEN {total} >= 25 THEN 'MODERATE' ELSE 'LOW' END"
    assert st.risk_tiers().count() == series and st.risk_tiers().filter(wrong).count() == 0
    assert st.context().count() == series
    early = st.anomalies().filter(F.col("is_anomaly") & (F.col("date") < F.lit(day(7))))
    assert early.count() == 0 and st.anomalies().filter("is_anomaly").count() > 0
    kept = st.features().filter(F.col("date") >= F.lit(CONFIG.forecast.history_start).cast("date")).count()
    assert st.history_forecast().count() == kept + st.forecasts().count()


def test_a_failing_build_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5).toDF("x"), path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_table(broken, path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    # A table may be built from itself, with another schema.
    grown = sinks.write_table(spark.read.parquet(path).select((F.col("x") + 1).alias("x"), F.lit("new").alias("y")), path)
    assert sorted(map(tuple, grown.collect())) == [(k, "new") for k in range(1, 6)]
    assert sorted(os.listdir(tmp_path)) == ["t"]


def test_versions_switch_when_complete(spark):
    sinks.create_namespaces(spark, "ver_")
    name = "ver_ml.table1"
    first = sinks.publish_version(spark.range(3).toDF("x"), name)
    assert first.count() == 3
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.publish_version(broken, name)
    assert spark.table(name).count() == 3
    reader = spark.table(name)  # has begun before the switch
    second = sinks.publish_version(spark.range(7).selectExpr("id AS x", "'z' AS y"), name, "x", 4)
    assert second.count() == 7 and spark.table(name).columns == ["x", "y"] and reader.count() == 3
    for n in (8, 9, 10):
        sinks.publish_version(spark.range(n).toDF("x"), name)
    assert spark.table(name).count() == 10 and len(sinks.versions(spark, name)) == 2
    spark.sql(f"DROP VIEW {name}")


def test_clustered_tables_skip_row_groups(spark, tmp_path):
    """One series and one month of a table with 40 series and two years: under a twentieth of its row groups."""
    import pyarrow.parquet as pq

    rows = spark.range(40 * 730).selectExpr(
        "concat('s', lpad(id % 40, 2, '0')) AS country_region", "date_add(DATE '2021-01-01', CAST(id DIV 40 AS INT)) AS date",
        "CAST(rand(3) * 1000000 AS BIGINT) AS v", "rand(4) AS w",
    ).repartition(4)
    path = str(tmp_path / "t")
    stored = sinks.write_clustered(rows, path, "country_region", "date", row_group=16 * 1024)
    assert stored.count() == 40 * 730
    wanted = ("s17", str(day(60)), str(day(90)))
    groups = hit = 0
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{path}/{name}").metadata
            for g in range(meta.num_row_groups):
                series, date = (meta.row_group(g).column(c).statistics for c in (0, 1))
                groups += 1
                hit += series.min <= wanted[0] <= series.max and not (str(date.max) < wanted[1] or str(date.min) > wanted[2])
    assert groups >= 40 and 0 < hit < groups / 20
    query = stored.filter((F.col("country_region") == wanted[0]) & F.col("date").between(wanted[1], wanted[2]))
    assert "EqualTo(country_region,s17)" in query._jdf.queryExecution().toString()
    assert query.count() == 31


def test_ranged_publishing_keeps_the_rows(spark, fact, tmp_path):
    plain = PanelStages(fact, CONFIG)
    ranged = PanelStages(fact, CONFIG, root=str(tmp_path), cut=("daily", "features", "anomalies"), ranged=True)
    for name in ("daily", "features", "anomalies", "risk_tiers"):
        assert sorted(map(str, getattr(ranged, name)().collect())) == sorted(map(str, getattr(plain, name)().collect()))
    stored = spark.read.parquet(str(tmp_path / "features" / "features")).withColumn("file", F.input_file_name())
    for rows in stored.groupBy("file").agg(F.collect_list(F.struct("country_region", "date")).alias("keys")).collect():
        assert rows["keys"] == sorted(rows["keys"])


def test_stored_views_outlive_the_session(spark, fact, tmp_path):
    stages = PanelStages(fact, CONFIG, root=str(tmp_path), cut=("daily", "features"))
    names = stages.store_views("view_")
    other = spark.newSession()
    counts = [other.table(name).count() for name in names]
    assert counts == [120, 160, 2]
    lazy = PanelStages(fact, CONFIG)
    assert sorted(map(str, other.table(names[2]).collect())) == sorted(map(str, lazy.context().collect()))
    assert sorted(map(str, other.table(names[0]).collect())) == sorted(map(str, lazy.training().collect()))
    PanelStages(fact.filter("country_region = 'a'"), CONFIG, root=str(tmp_path / "b")).store_views("view_")
    assert spark.newSession().table(names[0]).count() == 60
    for name in names:
        spark.sql(f"DROP VIEW {name}")


def test_stored_views_over_bucketed_tables(spark, fact):
    stages = PanelStages(fact, CONFIG, buckets=4, database_prefix="bview_", cut=("daily",))
    names = stages.store_views("bview_")
    assert [spark.newSession().table(name).count() for name in names] == [120, 160, 2]
    for name in names:
        spark.sql(f"DROP VIEW {name}")
    for database in ("raw", "features", "ml", "analytics"):
        spark.sql(f"DROP DATABASE bview_{database} CASCADE")


def test_no_registered_query_orders_a_whole_table_in_one_window():
    """Windows without a partition put all rows in one task."""
    import pathlib
    import re

    top = pathlib.Path(__file__).parent.parent
    for folder in ("panelloom/operators", "panelloom/functions", "panelloom/plans", "panelloom/sources", "registry"):
        for file in (top / folder).glob("*.py"):
            if file.name != "oracle.py":
                assert not re.search(r"Window\.orderBy|OVER \(ORDER BY", file.read_text()), file
