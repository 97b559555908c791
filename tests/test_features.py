import math
import random
from fractions import Fraction

import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from panelloom.config import EndemicConfig, FeatureConfig
from panelloom.operators import features, windows


def rounded(x, digits):
    """Half away from zero, exactly."""
    if x is None:
        return None
    units = int(abs(Fraction(x)) * 10**digits + Fraction(1, 2))
    return (-units if x < 0 else units) / 10**digits


def expected(values, dates):
    """Row by row, straight from the definitions."""
    out, cum = [], 0
    totals = []
    for i, x in enumerate(values):
        cum += x
        totals.append(cum)

        def frame(back, end=0):
            return values[max(0, i - back) : max(0, i - end + 1)]

        def mean(back):
            f = frame(back)
            return rounded(Fraction(sum(f), len(f)), 2)

        row = {
            "rolling_avg_7d_cases": mean(6),
            "rolling_avg_14d_cases": mean(13),
            "rolling_avg_28d_cases": mean(27),
            "sum_7d_cases": sum(frame(6)),
            "sum_30d_cases": sum(frame(27)),
            "prev_sum_7d_cases": sum(frame(13, 7)) if i >= 7 else None,
            "cases_7d_ago": values[i - 7] if i >= 7 else None,
            "confirmed_7d_ago": totals[i - 7] if i >= 7 else None,
            "rt_numerator": sum(frame(4)),
            "rt_denominator": sum(frame(9, 5)) if i >= 5 else None,
            "days_since_first_case": (dates[i] - dates[0]).days,
            "day_of_week": dates[i].isoweekday() % 7,
        }
        f = frame(13)
        n = len(f)
        if n > 1:
            var = Fraction(n * sum(v * v for v in f) - sum(f) ** 2, n * (n - 1))
            row["volatility_14d"] = math.floor(math.sqrt(float(var)) * 100 + 0.5) / 100
        else:
            row["volatility_14d"] = None
        den = row["rt_denominator"]
        row["rt_effective"] = rounded(Fraction(row["rt_numerator"], den), 3) if den is not None and den > 10 else None
        before = row["confirmed_7d_ago"]
        grows = before is not None and before > 0 and cum > before
        row["doubling_time_days"] = (
            math.floor(7 * math.log(2) / math.log(cum / before) * 10 + 0.5) / 10 if grows else None
        )
        prev, ago = row["prev_sum_7d_cases"], row["cases_7d_ago"]
        row["wow_change_pct"] = rounded(Fraction((row["sum_7d_cases"] - prev) * 100, prev), 2) if prev else 0.0
        row["weekly_growth_rate"] = rounded(Fraction((x - ago) * 100, ago), 2) if ago else 0.0
        vol = row["volatility_14d"]
        cents = lambda v: round(v * 100)
        row["signal_to_noise"] = (
            rounded(Fraction(cents(row["rolling_avg_14d_cases"]), cents(vol)), 2) if vol else None
        )
        row["acceleration"] = (
            (cents(row["rolling_avg_7d_cases"]) - cents(out[i - 7]["rolling_avg_7d_cases"])) / 100 if i >= 7 else None
        )
        out.append(row)
    return out


@pytest.mark.parametrize("seed, scale", [(1, 40), (2, 3), (3, 100_000)])
def test_every_feature_against_the_definitions(spark, daily_frame, seed, scale):
    rng = random.Random(seed)
    panel = {f"s{n}": [rng.choice((0, rng.randint(0, scale))) for _ in range(n)] for n in (1, 2, 7, 8, 13, 14, 15, 28, 29, 60)}
    panel["gap"] = [rng.randint(0, scale) if not 10 <= i < 15 else None for i in range(40)]
    panel["flat"] = [5] * 30
    panel["zero"] = [0] * 20
    df = features.features_without_flag(daily_frame(panel))
    got = {(r["country_region"], r["date"]): r for r in df.collect()}
    for name, values in panel.items():
        kept = [(day(i), v) for i, v in enumerate(values) if v is not None]
        rows = expected([v for _, v in kept], [d for d, _ in kept])
        for (d, _), want in zip(kept, rows):
            row = got[(name, d)]
            assert {k: row[k] for k in want} == want, (name, d)


def test_result_does_not_depend_on_input_order_or_partitions(spark, daily_frame):
    rng = random.Random(5)
    daily = daily_frame({f"s{i}": [rng.randint(0, 90) for _ in range(30)] for i in range(6)}, deaths_every=7)
    one = sorted(map(tuple, features.feature_store(daily).collect()))
    shuffled = daily.orderBy(F.rand(3)).repartition(7)
    assert sorted(map(tuple, features.feature_store(shuffled).collect())) == one


def test_store_has_its_31_columns(daily_frame):
    df = features.feature_store(daily_frame({"a": [1, 2, 3]}))
    assert len(df.columns) == 31 and df.columns[-1] == "endemic_flag"
    assert [c for c in df.columns if c.startswith("_")] == []


def test_missing_counts_are_skipped(spark):
    rows = [("a", day(i), None, 0, v, 0) for i, v in enumerate([4, None, 8, None, None])]
    df = spark.createDataFrame(rows, "country_region string, date date, cumulative_confirmed bigint, cumulative_deaths bigint, daily_new_cases bigint, daily_new_deaths bigint")
    got = by_key(windows.rolling_avg(df, "daily_new_cases", {"m": 2}), "m")
    assert [got[("a", day(i))] for i in range(5)] == [4.0, 4.0, 8.0, 8.0, None]
    sums = by_key(windows.rolling_sum(df, "daily_new_cases", {"s": (2, 1)}), "s")
    assert [sums[("a", day(i))] for i in range(5)] == [None, 4, 4, 8, 8]


def test_fatality_rate(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (2, 0), (None, 5)], "d bigint, c bigint")
    got = [r[0] for r in df.select(features.case_fatality_rate("d", "c")).collect()]
    assert got == [33.3333, 0.0, 0.0, None]


# (7-row mean, 14-row mean, 28-row mean) in hundredths, then the two classes.
CLASSES = [
    ((13001, 10000, 10000), "ACCELERATING", "EXPONENTIAL_GROWTH"),
    ((13000, 10000, 10000), "ACCELERATING", "LINEAR_GROWTH"),
    ((12001, 10000, 9000), "ACCELERATING", "EXPONENTIAL_GROWTH"),
    ((12000, 10000, 9000), "ACCELERATING", "LINEAR_GROWTH"),
    ((11000, 10000, 10000), "STABLE", "LINEAR_GROWTH"),
    ((10501, 10000, 10000), "STABLE", "LINEAR_GROWTH"),
    ((10500, 10000, 10000), "STABLE", "PLATEAU"),
    ((9500, 10000, 10000), "STABLE", "PLATEAU"),
    ((9499, 10000, 10000), "STABLE", "LINEAR_DECLINE"),
    ((9000, 10000, 10000), "STABLE", "LINEAR_DECLINE"),
    ((8999, 10000, 10000), "DECELERATING", "LINEAR_DECLINE"),
    ((7001, 10000, 10000), "DECELERATING", "LINEAR_DECLINE"),
    ((7000, 10000, 10000), "DECELERATING", "TRANSITION"),
    ((6999, 10000, 10000), "DECELERATING", "EXPONENTIAL_DECLINE"),
    ((0, 0, 0), "STABLE", "PLATEAU"),
    ((None, None, None), "STABLE", "TRANSITION"),
]


def test_class_boundaries(spark):
    rows = [means for means, _, _ in CLASSES]
    df = spark.createDataFrame(rows, "__avg7 bigint, __avg14 bigint, __avg28 bigint")
    config = FeatureConfig()
    got = df.select(features.trend_direction(config), features.epidemic_phase(config)).collect()
    assert [tuple(r) for r in got] == [(t, p) for _, t, p in CLASSES]


def test_rt_needs_a_large_enough_base(spark):
    df = spark.createDataFrame([(11, 10), (11, 11), (5, 12), (3, None)], "rt_numerator bigint, rt_denominator bigint")
    assert [r[0] for r in df.select(features.rt_effective()).collect()] == [None, 1.0, 0.417, None]


PHASES = "country_region string, date date, epidemic_phase string"


def phases(spark, series):
    rows = [(name, day(i), p) for name, ps in series.items() for i, p in enumerate(ps) if p]
    return spark.createDataFrame(rows, PHASES)


def test_endemic_flag(spark):
    decline, flat = "LINEAR_DECLINE", "PLATEAU"
    df = phases(
        spark,
        {
            "all": [flat] * 39 + [decline, "EXPONENTIAL_DECLINE"] * 30 + [decline],
            "one_flat": [decline] * 60 + [flat] + [decline] * 39,
            "flat_on_cutoff": [decline] * 39 + [flat] + [decline] * 60,
            "flat_before_cutoff": [decline] * 38 + [flat] + [decline] * 61,
            "stopped": [decline] * 30,
        },
    )
    flagged = features.endemic_flag(df, df, EndemicConfig(days=60))
    got = {r["country_region"]: r["endemic_flag"] for r in flagged.select("country_region", "endemic_flag").distinct().collect()}
    assert got == {"all": True, "one_flat": False, "flat_on_cutoff": False, "flat_before_cutoff": True, "stopped": False}
    listed = {r[0] for r in features.endemic_series(df, df, EndemicConfig(days=60)).collect()}
    assert listed == {name for name, flag in got.items() if flag}


def test_snapshot_at_the_global_last_date(daily_frame):
    daily = daily_frame({"a": [5] * 20, "b": [50] * 20, "stopped": [9] * 10})
    rows = features.global_latest_snapshot(features.feature_store(daily)).collect()
    assert [r["country_region"] for r in rows] == ["b", "a"]
    assert rows[0]["avg7d"] == 50.0 and rows[0]["rt"] == 1.0


def test_latest_per_series_keeps_stopped_series(daily_frame):
    daily = daily_frame({"a": [5] * 20, "stopped": [9] * 10})
    got = {(r["country_region"], r["date"]) for r in windows.latest_per_series(daily).collect()}
    assert got == {("a", day(19)), ("stopped", day(9))}


def test_positions_first_last_and_partition_max(daily_frame):
    daily = daily_frame({"a": [3, 9, 4]})
    got = by_key(windows.row_number_both_ways(daily), "rn_asc", "rn_desc")
    assert [got[("a", day(i))] for i in range(3)] == [(1, 3), (2, 2), (3, 1)]
    assert tuple(windows.first_last(daily, "daily_new_cases").first()) == ("a", 3, 4)
    assert {r["m"] for r in windows.partition_max(daily, "daily_new_cases", "m").collect()} == {9}


def test_window_operators_take_any_column_names(spark, daily_frame):
    from panelloom.config import Columns

    names = Columns(series="shop name", ts="the day")
    daily = daily_frame({"a": [4, 8, 1, 9]}).select("country_region", "date", "daily_new_cases")
    df = daily.toDF("shop name", "the day", "units sold")
    rows = windows.rolling_avg(df, "units sold", {"m": 2}, names).orderBy("the day").collect()
    assert [r["m"] for r in rows] == [4.0, 6.0, 4.5, 5.0]
    rows = windows.rolling_stddev(df, "units sold", 2, "v", names).orderBy("the day").collect()
    assert [r["v"] for r in rows] == [None, 2.83, 4.95, 5.66]
    assert windows.rolling_moments(df, "units sold", 2, names).filter("moment_sum_sq = 80").count() == 1


def test_fatality_rate_of_huge_counts(spark):
    df = spark.createDataFrame([(5 * 10**12, 10**13), (9 * 10**18, 9 * 10**18), (1, 0)], "d bigint, c bigint")
    assert [r[0] for r in df.select(features.case_fatality_rate("d", "c")).collect()] == [50.0, 100.0, 0.0]
