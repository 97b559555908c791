import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> datetime.date:
    """The n-th day after 2021-01-03, a Sunday."""
    return datetime.date(2021, 1, 3) + datetime.timedelta(days=n)


COMBINED = "country_region string, date date, cumulative_confirmed bigint, cumulative_deaths bigint"
DAILY = COMBINED + ", daily_new_cases bigint, daily_new_deaths bigint"
ANOMALIES = (
    "country_region string, date date, daily_new_cases bigint, expected double, is_anomaly boolean, "
    "percentile double, distance double, deviation_pct double, anomaly_direction string"
)
FORECASTS = (
    "country_region string, date date, forecasted_cases double, forecast_lower double, forecast_upper double, type string"
)


@pytest.fixture(scope="session")
def daily_frame(spark):
    """``{series: [daily cases]}`` to a daily panel; None leaves a calendar gap."""

    def build(series: dict, deaths_every: int = 0, start: dict | None = None):
        rows = []
        for name, values in series.items():
            first, total, dead = (start or {}).get(name, 0), 0, 0
            for i, x in enumerate(values):
                if x is None:
                    continue
                d = x // deaths_every if deaths_every else 0
                total, dead = total + x, dead + d
                rows.append((name, day(first + i), total, dead, x, d))
        return spark.createDataFrame(rows, DAILY)

    return build


def by_key(df, *names):
    """``{(series, date): value or tuple}`` of a keyed frame."""
    out = {}
    for r in df.collect():
        values = tuple(r[n] for n in names)
        out[(r["country_region"], r["date"])] = values[0] if len(values) == 1 else values
    return out
