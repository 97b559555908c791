import math
import random

import pytest
from conftest import ANOMALIES, by_key, day

from panelloom.config import AnomalyConfig
from panelloom.operators import anomaly, report, text
from panelloom.sources.tables import schemas

CONFIG = AnomalyConfig(start=str(day(0)))


def test_zscore_against_the_definition(spark, daily_frame):
    rng = random.Random(9)
    values = [rng.choice((0, 5, rng.randint(0, 400))) for _ in range(60)]
    got = by_key(
        anomaly.zscore_anomalies(daily_frame({"a": values}), CONFIG), "expected", "is_anomaly", "distance", "deviation_pct", "anomaly_direction"
    )
    for i, x in enumerate(values):
        f = values[max(0, i - 13) : i + 1]
        mean = sum(f) / len(f)
        std = math.sqrt(sum(v * v for v in f) / len(f) - mean * mean) if len(set(f)) > 1 else 0.0
        z = (x - mean) / std if std > 0 else 0.0
        expected, flag, distance, deviation, direction = got[("a", day(i))]
        assert expected == pytest.approx(mean, abs=0.00501)
        assert flag == (abs(z) > 2.5)
        assert distance == pytest.approx(z, abs=0.000501)
        assert deviation == pytest.approx((x - mean) * 100 / mean if mean > 0 else 0, abs=0.0501)
        assert direction == ("SPIKE" if x > mean else "DROP" if x < mean else "NEUTRAL")


def test_rare_branches(spark, daily_frame):
    panel = {
        "early": [10, 11] * 4 + [5000],
        "seventh": [10] * 6 + [5000],
        "spike": [100, 101] * 7 + [900],
        "drop": [500, 501] * 7 + [0],
        "flat": [4] * 20,
        "zero": [0] * 20,
    }
    out = anomaly.zscore_anomalies(daily_frame(panel), CONFIG)
    rows = {(r["country_region"], r["date"]): r for r in out.collect()}
    assert rows[("early", day(8))]["is_anomaly"] and rows[("early", day(8))]["anomaly_direction"] == "SPIKE"
    assert rows[("seventh", day(6))]["distance"] == 2.449 and not rows[("seventh", day(6))]["is_anomaly"]
    assert not any(r["is_anomaly"] for (_, d), r in rows.items() if d < day(7))
    assert rows[("spike", day(14))]["anomaly_direction"] == "SPIKE" and rows[("spike", day(14))]["is_anomaly"]
    assert rows[("drop", day(14))]["anomaly_direction"] == "DROP" and rows[("drop", day(14))]["is_anomaly"]
    for name in ("flat", "zero"):
        row = rows[(name, day(19))]
        assert (row["is_anomaly"], row["distance"], row["deviation_pct"], row["anomaly_direction"]) == (False, 0.0, 0.0, "NEUTRAL")
        assert row["percentile"] is None
    flagged, spikes, drops = anomaly.flagged_split(out)
    assert flagged.count() == spikes.count() + drops.count() and drops.count() == 1
    summary = {r[0]: tuple(r)[1:] for r in anomaly.anomaly_summary(out).collect()}
    assert summary["drop"] == (1, 0, 1, 100.0) and summary["flat"] == (0, 0, 0, None)


def test_frames_start_at_the_configured_date(spark, daily_frame):
    daily = daily_frame({"a": [1000] * 10 + [1, 2, 1, 2, 1, 2, 1, 2, 90]})
    out = anomaly.zscore_anomalies(daily, AnomalyConfig(start=str(day(10)))).collect()
    assert len(out) == 9 and [r["date"] for r in out if r["is_anomaly"]] == [day(18)]


def test_model_anomalies(spark, daily_frame):
    values = [50 + (i % 7) * 10 + (i % 3) for i in range(70)]
    values[40] = 900
    out = anomaly.model_anomalies(daily_frame({"a": values, "flat": [6] * 30}), CONFIG)
    rows = {(r["country_region"], r["date"]): r for r in out.collect()}
    assert [k[1] for k, r in rows.items() if r["is_anomaly"]] == [day(40)]
    spike = rows[("a", day(40))]
    assert spike["anomaly_direction"] == "SPIKE" and spike["percentile"] > 0.999
    assert all(0 <= r["percentile"] <= 1 for r in rows.values())
    flat = rows[("flat", day(5))]
    assert (flat["expected"], flat["distance"], flat["percentile"], flat["deviation_pct"]) == (6.0, 0.0, 0.5, 0.0)
    assert out.columns == anomaly.zscore_anomalies(daily_frame({"a": [1]}), CONFIG).columns


def rows_of(spark, rows):
    """``(series, day, flagged, deviation)`` to an anomaly table."""
    full = [
        (s, day(d), 1, 1.0, flag, None, 0.0, dev, "SPIKE" if dev > 0 else "DROP" if dev < 0 else "NEUTRAL")
        for s, d, flag, dev in rows
    ]
    return spark.createDataFrame(full, ANOMALIES)


def test_recent_flag_equals_the_range_join(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", d, rng.random() < 0.05, 1.0) for i in range(40) for d in range(rng.randint(1, 30))]
    rows += [("edge", 0, True, 1.0), ("edge", 7, False, 1.0), ("past", 0, True, 1.0), ("past", 8, False, 1.0)]
    table = rows_of(spark, rows)
    fast = {r[0]: r[1] for r in anomaly.recent_flag(table).collect()}
    joined = {}
    for r in anomaly.recent_rows(table).collect():
        joined[r["country_region"]] = max(joined.get(r["country_region"], 0), int(r["is_anomaly"]))
    assert fast == joined and fast["edge"] == 1 and fast["past"] == 0


def test_stats_and_kpis(spark):
    table = rows_of(spark, [("a", 0, True, 30.0), ("a", 1, True, -40.5), ("a", 2, False, 900.0), ("b", 0, False, 1.0), ("c", 0, True, 2.0)])
    stats = {r["country_region"]: r for r in anomaly.anomaly_stats(table).collect()}
    a = stats["a"]
    assert (a["total_anomalies"], a["spike_count"], a["drop_count"], a["max_deviation_pct"]) == (2, 1, 1, 40.5)
    assert (a["last_anomaly_date"], a["avg_deviation_pct"]) == (day(1), 35.25)
    assert stats["b"]["avg_deviation_pct"] is None and stats["b"]["total_anomalies"] == 0
    kpis = {r[0]: tuple(r)[1:] for r in anomaly.anomaly_kpis(table).collect()}
    assert kpis == {"a": (2, 3, 35.25), "b": (0, 3, None), "c": (1, 3, 2.0)}


def test_top_by_absolute_and_by_signed_deviation(spark):
    table = rows_of(
        spark,
        [("a", 3, True, 50.0), ("a", 1, True, -50.0), ("a", 2, True, 50.0), ("a", 0, True, -50.0), ("a", 4, False, 99.0), ("b", 0, True, 1.0)],
    )
    top = by_key(text.top_anomalies(table, 3), "rnk")
    assert top == {("a", day(0)): 1, ("a", day(1)): 2, ("a", day(2)): 3, ("b", day(0)): 1}
    signed = [(r["country_region"], r["date"]) for r in report.top_n_signed(table, 3).collect()]
    assert signed == [("a", day(2)), ("a", day(3)), ("b", day(0))]
    per = by_key(report.top_n_signed_per_series(table, 2), "rnk")
    assert per == {("a", day(2)): 1, ("a", day(3)): 2, ("b", day(0)): 1}
    chart = by_key(report.anomaly_chart(table), "spike", "drop")
    assert chart[("a", day(1))] == (None, 1) and chart[("a", day(4))] == (None, None)


def test_trailing_max(spark):
    rows = [("a", day(0), 9.0), ("a", day(1), 5.0), ("a", day(15), 3.0), ("b", day(0), 1.0)]
    df = spark.createDataFrame(rows, "country_region string, date date, m double")
    assert {tuple(r) for r in anomaly.trailing_max(df, "m", 14).collect()} == {("a", 5.0)}
    empty = spark.createDataFrame([], schemas.MOBILITY)
    assert anomaly.trailing_max(empty, "mobility_index", 14).count() == 0


def test_rank_percentiles_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for name, n in (("many", 400), ("ties", 90), ("one", 1), ("far", 120)):
        for i in range(n):
            d = round(rng.gauss(0, 1), 3) if name == "many" else rng.choice((-1.0, 0.0, 0.5)) if name == "ties" else rng.choice((-31.5, 0.001, 0.002, 44.0))
            rows.append((name, day(i), d))
        rows.append((name, day(n), None))
    frame = spark.createDataFrame(rows, "country_region string, date date, distance double")
    got = {(r["country_region"], r["date"]): (r["rank_percentile"], r["is_rare"]) for r in anomaly.empirical_percentiles(frame, 0.9).collect()}
    want = {}
    for name in {r[0] for r in rows}:
        of = [max(-20.0, min(20.0, d)) for n, _, d in rows if n == name and d is not None]
        for n, at, d in rows:
            if n == name and d is not None:
                d = max(-20.0, min(20.0, d))
                upto, above = sum(x <= d for x in of), sum(x >= d for x in of)
                want[n, at] = (math.floor(upto / len(of) * 10**6 + 0.5) / 10**6, min(upto, above) * 20 <= len(of))
    assert got == want
    assert {k[0] for k, (_, rare) in got.items() if rare} >= {"many"} and not got["one", day(0)][1]
