"""The same results as SQL over the driver's tables, for the side-by-side check.

Each relation is written once under a ``c_`` name; ``_query`` prepends the ones a query refers to.
Trailing frames are written as window frames here and as running totals in the library, so the two
sides share definitions but not their method.
"""

from __future__ import annotations

import math
import re

from panelloom.config import ReportConfig, RiskConfig
from panelloom.functions.template import pieces
from panelloom.operators import text as texts
from panelloom.operators.forecast import METRIC_ORDER, interval_multiplier
from panelloom.operators.projections import PHASE_LABELS
from panelloom.operators.report import risk_labels
from registry.bindings import CONFIG, ORIGINS, REPORT_START, SELECTED, TRAIN_END, TRAIN_START, VOLUME

KEY = "country_region"
RISK = RiskConfig(volume=VOLUME)
Z = f"'{interval_multiplier(0.95)!r}'::DOUBLE"


def ratio(num: str, den: str, digits: int) -> str:
    """Integer ratio rounded half away from zero."""
    unit = 10**digits
    return (
        f"(CASE WHEN {num} < 0 THEN -1 ELSE 1 END * CAST((abs({num}) * {2 * unit} + {den}) "
        f"// NULLIF(2 * {den}, 0) AS BIGINT) / CAST({unit} AS DOUBLE))"
    )


def half_up(x: str, digits: int) -> str:
    unit = 10**digits
    return (
        f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * CAST(floor(abs({x}) * CAST({unit} AS DOUBLE) "
        f"+ CAST(0.5 AS DOUBLE)) AS BIGINT) / CAST({unit} AS DOUBLE))"
    )


def units(x: str, digits: int) -> str:
    return f"CAST(round({x} * CAST({10**digits} AS DOUBLE)) AS BIGINT)"


def text_of(value) -> str:
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def ladder(x: str, steps, default, op: str = ">") -> str:
    whens = " ".join(f"WHEN {x} {op} {threshold} THEN {text_of(value)}" for threshold, value in steps)
    return f"CASE {whens} ELSE {text_of(default)} END"


def number_text(x: str, digits: int) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(38,6)) AS DECIMAL(38,{digits})) AS VARCHAR)"


def fill(template: str) -> str:
    parts = []
    for literal, name, fmt, default in pieces(template):
        if literal:
            parts.append(text_of(literal))
        if name is None:
            continue
        if fmt.endswith("f"):
            shown = number_text(name, int(fmt[1:-1]))
        elif fmt == "d":
            shown = f"CAST(CAST({name} AS BIGINT) AS VARCHAR)"
        else:
            shown = f"CAST({name} AS VARCHAR)"
        parts.append(f"coalesce({shown}, {text_of(default)})")
    return " || ".join(parts)


def frame(back: int, end: int = 0) -> str:
    upper = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"(PARTITION BY {KEY} ORDER BY date ROWS BETWEEN {back} PRECEDING AND {upper})"


IN_ORDER = f"(PARTITION BY {KEY} ORDER BY date)"

C: dict[str, str] = {}

C["c_increments"] = """
SELECT n_name AS country_region, CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS confirmed,
       CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R' AND l_tax >= 0.08), 0) AS BIGINT) AS deaths
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY ALL"""

C["c_running"] = f"""
SELECT {KEY}, date,
       CAST(sum(confirmed) OVER {IN_ORDER} - CASE WHEN day(date) = 13 THEN 500 ELSE 0 END AS BIGINT) AS confirmed,
       CAST(sum(deaths) OVER {IN_ORDER} AS BIGINT) AS deaths
FROM c_increments"""

C["c_fact"] = f"""
SELECT {KEY}, date, 'Confirmed' AS case_type, confirmed AS cases FROM c_running
UNION ALL
SELECT {KEY}, date, 'Deaths' AS case_type, deaths AS cases FROM c_running"""

RENAMED = f"CASE WHEN {KEY} IN ('NATION_21', 'NATION_22') THEN 'NATION_20' ELSE {KEY} END"

C["c_combined"] = f"""
SELECT {RENAMED} AS {KEY}, date,
       CAST(coalesce(sum(cases) FILTER (case_type = 'Confirmed'), 0) AS BIGINT) AS cumulative_confirmed,
       CAST(coalesce(sum(cases) FILTER (case_type = 'Deaths'), 0) AS BIGINT) AS cumulative_deaths
FROM c_fact GROUP BY ALL"""

C["c_daily"] = f"""
SELECT *,
       greatest(cumulative_confirmed - lag(cumulative_confirmed, 1, 0) OVER {IN_ORDER}, 0) AS daily_new_cases,
       greatest(cumulative_deaths - lag(cumulative_deaths, 1, 0) OVER {IN_ORDER}, 0) AS daily_new_deaths
FROM c_combined"""

C["c_frames"] = f"""
SELECT *,
       sum(daily_new_cases) OVER w7 AS s7, count(daily_new_cases) OVER w7 AS n7,
       sum(daily_new_cases) OVER w14 AS s14, count(daily_new_cases) OVER w14 AS n14,
       sum(daily_new_cases) OVER w28 AS s28, count(daily_new_cases) OVER w28 AS n28,
       sum(CAST(daily_new_cases AS HUGEINT) * daily_new_cases) OVER w14 AS q14,
       sum(daily_new_deaths) OVER w7 AS d7, count(daily_new_deaths) OVER w7 AS dn7,
       sum(daily_new_deaths) OVER w14 AS d14, count(daily_new_deaths) OVER w14 AS dn14,
       CAST(sum(daily_new_cases) OVER {frame(13, 7)} AS BIGINT) AS prev_sum_7d_cases,
       CAST(sum(daily_new_cases) OVER {frame(4)} AS BIGINT) AS rt_numerator,
       CAST(sum(daily_new_cases) OVER {frame(9, 5)} AS BIGINT) AS rt_denominator,
       lag(daily_new_cases, 7) OVER {IN_ORDER} AS cases_7d_ago,
       lag(cumulative_confirmed, 7) OVER {IN_ORDER} AS confirmed_7d_ago,
       CAST(date - min(date) OVER (PARTITION BY {KEY}) AS INTEGER) AS days_since_first_case
FROM c_daily
WINDOW w7 AS {frame(6)}, w14 AS {frame(13)}, w28 AS {frame(27)}"""

C["c_base"] = f"""
SELECT *,
       {ratio('s7', 'n7', 2)} AS rolling_avg_7d_cases,
       {ratio('s14', 'n14', 2)} AS rolling_avg_14d_cases,
       {ratio('s28', 'n28', 2)} AS rolling_avg_28d_cases,
       {ratio('d7', 'dn7', 2)} AS rolling_avg_7d_deaths,
       {ratio('d14', 'dn14', 2)} AS rolling_avg_14d_deaths,
       CAST(s7 AS BIGINT) AS sum_7d_cases, CAST(s28 AS BIGINT) AS sum_30d_cases,
       CASE WHEN n14 > 1 THEN {half_up('sqrt(CAST(n14 * q14 - s14 * s14 AS DOUBLE) / CAST(n14 * (n14 - 1) AS DOUBLE))', 2)} END
           AS volatility_14d,
       CASE WHEN cumulative_confirmed > 0 THEN {ratio('(CAST(cumulative_deaths AS HUGEINT) * 100)', 'cumulative_confirmed', 4)} ELSE 0.0 END
           AS case_fatality_rate,
       CAST(dayofweek(date) AS INTEGER) AS day_of_week
FROM c_frames"""

LOG2_WEEK = f"'{7 * math.log(2.0)!r}'::DOUBLE"

C["c_derived"] = f"""
SELECT *,
       CASE WHEN rt_denominator > 10 THEN {ratio('rt_numerator', 'rt_denominator', 3)} END AS rt_effective,
       CASE WHEN confirmed_7d_ago > 0 AND cumulative_confirmed > confirmed_7d_ago
            THEN {half_up(f'({LOG2_WEEK} / ln(CAST(cumulative_confirmed AS DOUBLE) / CAST(confirmed_7d_ago AS DOUBLE)))', 1)}
            END AS doubling_time_days,
       CASE WHEN prev_sum_7d_cases > 0 THEN {ratio('((sum_7d_cases - prev_sum_7d_cases) * 100)', 'prev_sum_7d_cases', 2)}
            ELSE 0.0 END AS wow_change_pct,
       CASE WHEN cases_7d_ago > 0 THEN {ratio('((daily_new_cases - cases_7d_ago) * 100)', 'cases_7d_ago', 2)}
            ELSE 0.0 END AS weekly_growth_rate,
       CASE WHEN volatility_14d > 0 THEN {ratio(units('rolling_avg_14d_cases', 2), units('volatility_14d', 2), 2)} END
           AS signal_to_noise,
       CAST(rolling_avg_7d_cases AS DECIMAL(18,2)) AS a7,
       CAST(rolling_avg_14d_cases AS DECIMAL(18,2)) AS a14,
       CAST(rolling_avg_28d_cases AS DECIMAL(18,2)) AS a28
FROM c_base"""

L = CONFIG.features


def above(x: str, y: str, percent: int) -> str:
    return f"{x} * 100 > {y} * {percent}"


def below(x: str, y: str, percent: int) -> str:
    return f"{x} * 100 < {y} * {percent}"


PHASES = (
    (above("a7", "a14", L.exp_growth_fortnight_pct) + " AND " + above("a7", "a28", L.exp_growth_month_pct), "EXPONENTIAL_GROWTH"),
    (above("a7", "a14", L.lin_growth_pct), "LINEAR_GROWTH"),
    (f"NOT ({above('abs(a7 - a14)', 'a14', L.plateau_band_pct)})", "PLATEAU"),
    (below("a7", "a14", L.lin_decline_pct) + " AND " + above("a7", "a28", L.decline_month_pct), "LINEAR_DECLINE"),
    (below("a7", "a28", L.decline_month_pct), "EXPONENTIAL_DECLINE"),
)
TRENDS = ((above("a7", "a14", L.trend_up_pct), "ACCELERATING"), (below("a7", "a14", L.trend_down_pct), "DECELERATING"))


def first_match(cases, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in cases) + f" ELSE '{default}' END"


C["c_classified"] = f"""
SELECT *, CAST(a7 - lag(a7, 7) OVER {IN_ORDER} AS DOUBLE) AS acceleration,
       {first_match(TRENDS, 'STABLE')} AS trend_direction, {first_match(PHASES, 'TRANSITION')} AS epidemic_phase
FROM c_derived"""

DECLINE = "epidemic_phase IN ('EXPONENTIAL_DECLINE', 'LINEAR_DECLINE')"


def endemic(days: int) -> str:
    return (
        f"SELECT {KEY} FROM c_classified WHERE date >= (SELECT max(date) FROM c_daily) - {days} "
        f"GROUP BY {KEY} HAVING bool_and({DECLINE})"
    )


FEATURE_COLUMNS = (
    f"{KEY}, date, cumulative_confirmed, cumulative_deaths, daily_new_cases, daily_new_deaths, "
    "rolling_avg_7d_cases, rolling_avg_14d_cases, rolling_avg_28d_cases, rolling_avg_7d_deaths, "
    "rolling_avg_14d_deaths, sum_7d_cases, prev_sum_7d_cases, sum_30d_cases, cases_7d_ago, confirmed_7d_ago, "
    "volatility_14d, case_fatality_rate, day_of_week, days_since_first_case, rt_numerator, rt_denominator, "
    "rt_effective, doubling_time_days, wow_change_pct, weekly_growth_rate, signal_to_noise, acceleration, "
    "trend_direction, epidemic_phase"
)
C["c_features"] = f"SELECT {FEATURE_COLUMNS}, {KEY} IN ({endemic(60)}) AS endemic_flag FROM c_classified"

C["c_train"] = f"""
SELECT {KEY}, date, rolling_avg_7d_cases AS target FROM c_features
WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_END}' AND rolling_avg_7d_cases IS NOT NULL"""

C["c_input"] = f"""
SELECT {KEY}, date, daily_new_cases FROM c_daily
WHERE date >= DATE '{TRAIN_START}' AND daily_new_cases IS NOT NULL"""


def fit(prefix: str, rows: str, y: str) -> None:
    """Sufficient statistics by weekday, then the closed-form model of each series."""
    C[f"{prefix}_days"] = f"""
SELECT {KEY}, dayofweek(date) AS dow, count(*) AS n, sum(t) AS t1, sum(t * t) AS t2, sum(y) AS y1,
       sum(t * y) AS ty, sum(y * y) AS y2, max(date) AS last_date
FROM (SELECT {KEY}, date, CAST(date - DATE '{TRAIN_START}' AS HUGEINT) AS t, CAST({y} AS HUGEINT) AS y FROM {rows})
GROUP BY ALL"""
    C[f"{prefix}_trend"] = f"""
SELECT {KEY}, n_train, n_days, last_date, spread, slope, (y1 - slope * t1) / n_train AS intercept,
       t1 / n_train AS t_mean, spread / n_train AS t_spread
FROM (SELECT {KEY}, CAST(sum(n) AS DOUBLE) AS n_train, count(*) AS n_days, max(last_date) AS last_date,
             CAST(sum(t1) AS DOUBLE) AS t1, CAST(sum(y1) AS DOUBLE) AS y1,
             CAST(sum(n) * sum(t2) - sum(t1) * sum(t1) AS DOUBLE) AS spread,
             CASE WHEN sum(n) * sum(t2) - sum(t1) * sum(t1) > 0
                  THEN CAST(sum(n) * sum(ty) - sum(t1) * sum(y1) AS DOUBLE)
                       / CAST(sum(n) * sum(t2) - sum(t1) * sum(t1) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS slope
      FROM {prefix}_days GROUP BY {KEY})"""
    C[f"{prefix}_offsets"] = f"""
SELECT d.{KEY}, d.dow,
       (CAST(d.y1 AS DOUBLE) - intercept * CAST(d.n AS DOUBLE) - slope * CAST(d.t1 AS DOUBLE)) / CAST(d.n AS DOUBLE) AS offset_,
       greatest((CAST(d.n * d.y2 - d.y1 * d.y1 AS DOUBLE)
                 - CAST(2 AS DOUBLE) * slope * CAST(d.n * d.ty - d.t1 * d.y1 AS DOUBLE)
                 + slope * slope * CAST(d.n * d.t2 - d.t1 * d.t1 AS DOUBLE)) / CAST(d.n AS DOUBLE), CAST(0 AS DOUBLE)) AS squares
FROM {prefix}_days d JOIN {prefix}_trend m ON d.{KEY} = m.{KEY}"""
    C[f"{prefix}_model"] = f"""
SELECT m.*, CASE WHEN n_train >= 14 AND n_train - n_days - 1 > 0 THEN sqrt(sse / (n_train - n_days - 1))
                 ELSE CAST(0 AS DOUBLE) END AS sigma
FROM {prefix}_trend m
JOIN (SELECT {KEY}, CAST(sum(CAST(squares AS DECIMAL(38,6))) AS DOUBLE) AS sse FROM {prefix}_offsets GROUP BY {KEY}) s
  ON m.{KEY} = s.{KEY}"""


fit("c_fit", "c_train", units("target", 2))
fit("c_nfit", "c_input", "daily_new_cases")


def cents(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * CAST(floor(abs({x}) + CAST(0.5 AS DOUBLE)) AS BIGINT) / CAST(100 AS DOUBLE))"


def predict(prefix: str) -> str:
    """The 30 days after the last fitted date of each series."""
    return f"""
SELECT {KEY}, date, {cents('point')} AS forecasted_cases, {cents('(point - half)')} AS forecast_lower,
       {cents('(point + half)')} AS forecast_upper, 'FORECAST' AS type
FROM (SELECT s.{KEY}, s.date, intercept + slope * t + coalesce(offset_, CAST(0 AS DOUBLE)) AS point,
             {Z} * sigma * sqrt(CAST(1 AS DOUBLE) + CAST(1 AS DOUBLE) / n_train
                 + CASE WHEN t_spread > 0 THEN (t - t_mean) * (t - t_mean) / t_spread ELSE CAST(0 AS DOUBLE) END) AS half
      FROM (SELECT *, CAST(date - DATE '{TRAIN_START}' AS DOUBLE) AS t
            FROM (SELECT *, CAST(last_date + CAST(unnest(range(1, 31)) AS INTEGER) AS DATE) AS date FROM {prefix}_model)) s
      LEFT JOIN {prefix}_offsets o ON s.{KEY} = o.{KEY} AND dayofweek(s.date) = o.dow)"""


C["c_forecasts"] = predict("c_fit")

C["c_hundredths"] = f"""
SELECT {KEY}, date, dayofweek(date) AS dow, {units('target', 2)} AS c,
       row_number() OVER (PARTITION BY {KEY} ORDER BY date DESC) AS nth,
       row_number() OVER (PARTITION BY {KEY}, dayofweek(date) ORDER BY date DESC) AS nth_of_day FROM c_train"""
C["c_weekday_means"] = f"""
SELECT {KEY}, dow, (2 * sum(c) + count(*)) // (2 * count(*)) AS point FROM c_hundredths WHERE nth_of_day <= 4 GROUP BY ALL"""
C["c_last_weeks"] = f"""
SELECT {KEY}, max(date) AS last_date, (2 * sum(c) + count(*)) // (2 * count(*)) AS point,
       CASE WHEN count(*) > 1 THEN floor({Z} * sqrt(CAST(count(*) * sum(CAST(c AS HUGEINT) * c) - sum(c) * sum(c) AS DOUBLE)
            / CAST(count(*) * (count(*) - 1) AS DOUBLE)) + 0.5) ELSE 0 END AS half
FROM c_hundredths WHERE nth <= 28 GROUP BY {KEY}"""
C["c_weekday_forecasts"] = f"""
SELECT {KEY}, date, CAST(p AS DOUBLE) / 100 AS forecasted_cases, (CAST(p AS DOUBLE) - half) / 100 AS forecast_lower,
       (CAST(p AS DOUBLE) + half) / 100 AS forecast_upper, 'FORECAST' AS type
FROM (SELECT a.{KEY}, a.date, a.half, coalesce(w.point, a.point) AS p
      FROM (SELECT *, CAST(last_date + CAST(unnest(range(1, 31)) AS INTEGER) AS DATE) AS date FROM c_last_weeks) a
      LEFT JOIN c_weekday_means w ON a.{KEY} = w.{KEY} AND dayofweek(a.date) = w.dow)"""

C["c_overlap"] = f"""
SELECT f.{KEY}, f.date, f.forecasted_cases, f.forecast_lower, f.forecast_upper, a.rolling_avg_7d_cases AS actual
FROM c_forecasts f JOIN c_features a ON f.{KEY} = a.{KEY} AND f.date = a.date
WHERE a.rolling_avg_7d_cases IS NOT NULL"""

C["c_held"] = f"SELECT * FROM c_train QUALIFY date <= max(date) OVER (PARTITION BY {KEY}) - 30"
fit("c_bfit", "c_held", units("target", 2))
C["c_bforecasts"] = predict("c_bfit")
C["c_boverlap"] = f"""
SELECT f.{KEY}, f.date, f.forecasted_cases, f.forecast_lower, f.forecast_upper, a.target AS actual
FROM c_bforecasts f JOIN c_train a ON f.{KEY} = a.{KEY} AND f.date = a.date"""

MAPE_TERM = "CASE WHEN y <> 0 THEN CAST(CAST(e AS DOUBLE) / CAST(abs(y) AS DOUBLE) AS DECIMAL(38,12)) END"
SMAPE_TERM = (
    "CASE WHEN abs(y) + abs(p) = 0 THEN 0 "
    "ELSE CAST(CAST(2 * e AS DOUBLE) / CAST(abs(y) + abs(p) AS DOUBLE) AS DECIMAL(38,12)) END"
)
MISS = "CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END"


def digits_of(x: str) -> str:
    """A decimal's digits as a whole number."""
    return f"CAST(replace(CAST({x} AS VARCHAR), '.', '') AS HUGEINT)"


METRIC_SQL = {
    "MAE": ratio("sum(e)", "(count(*) * 100)", 4),
    "MSE": ratio("sum(CAST(e AS HUGEINT) * e)", "(count(*) * 10000)", 4),
    "MAPE": ratio(digits_of(f"sum({MAPE_TERM})"), "(count(*) FILTER (y <> 0) * CAST(10000000000 AS HUGEINT))", 4),
    "SMAPE": ratio(digits_of(f"sum({SMAPE_TERM})"), "(count(*) * CAST(10000000000 AS HUGEINT))", 4),
    "MDA": ratio("count(*) FILTER (before IS NOT NULL AND sign(y - before) = sign(p - before))", "count(before)", 4),
    "WINKLER_ALPHA=0.05": ratio(f"CAST(sum(hi - lo) + 40 * sum({MISS}) AS HUGEINT)", "(count(*) * 100)", 4),
}


def metrics(prefix: str, pairs: str) -> None:
    C[f"{prefix}_errors"] = f"""
SELECT *, abs(y - p) AS e, lag(y) OVER {IN_ORDER} AS before FROM (
  SELECT {KEY}, date, {units('actual', 2)} AS y, {units('forecasted_cases', 2)} AS p,
         {units('forecast_lower', 2)} AS lo, {units('forecast_upper', 2)} AS hi FROM {pairs})"""
    C[f"{prefix}_metrics"] = " UNION ALL ".join(
        f"SELECT {KEY} AS series, '{name}' AS error_metric, {sql} AS metric_value FROM {prefix}_errors GROUP BY {KEY}"
        for name, sql in METRIC_SQL.items()
    )


metrics("c", "c_overlap")
metrics("c_b", "c_boverlap")
C["c_origins"] = f"""
SELECT CAST(DATE '{ORIGINS.last}' - CAST({ORIGINS.step} * unnest(range({ORIGINS.count})) AS INTEGER) AS DATE) AS origin"""
# Every origin as a panel of its own: the series' name carries the date.
C["c_otrain"] = f"""
SELECT {KEY} || '|' || CAST(origin AS VARCHAR) AS {KEY}, date, target FROM c_train, c_origins WHERE date <= origin"""
fit("c_ofit", "c_otrain", units("target", 2))
C["c_oforecasts"] = predict("c_ofit")
C["c_ooverlap"] = f"""
SELECT f.{KEY}, f.date, f.forecasted_cases, f.forecast_lower, f.forecast_upper, a.target AS actual
FROM c_oforecasts f JOIN c_train a ON split_part(f.{KEY}, '|', 1) = a.{KEY} AND f.date = a.date"""
metrics("c_o", "c_ooverlap")
C["c_quality"] = f"""
SELECT series AS {KEY}, max(metric_value) FILTER (error_metric = 'MAPE') AS mape,
       max(metric_value) FILTER (error_metric = 'MAE') AS mae FROM c_metrics GROUP BY series"""

C["c_history"] = f"""
SELECT {KEY}, date, rolling_avg_7d_cases AS val, CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound,
       'ACTUAL' AS type FROM c_features WHERE date >= DATE '{TRAIN_START}'
UNION ALL
SELECT {KEY}, date, forecasted_cases, forecast_lower, forecast_upper, type FROM c_forecasts"""

C["c_moments"] = f"""
SELECT *, count(*) OVER w AS n, sum(daily_new_cases) OVER w AS s,
       sum(CAST(daily_new_cases AS HUGEINT) * daily_new_cases) OVER w AS q
FROM c_input WINDOW w AS {frame(13)}"""

C["c_anomalies"] = f"""
SELECT {KEY}, date, daily_new_cases, {ratio('s', 'n', 2)} AS expected, abs(z) > 2.5 AS is_anomaly,
       CAST(NULL AS DOUBLE) AS percentile, {half_up('z', 3)} AS distance,
       CASE WHEN s > 0 THEN {ratio('((n * daily_new_cases - s) * 100)', 's', 1)} ELSE CAST(0 AS DOUBLE) END AS deviation_pct,
       CASE WHEN n * daily_new_cases > s THEN 'SPIKE' WHEN n * daily_new_cases < s THEN 'DROP' ELSE 'NEUTRAL' END
           AS anomaly_direction
FROM (SELECT *, CASE WHEN n * q - s * s > 0
                     THEN CAST(n * daily_new_cases - s AS DOUBLE) / sqrt(CAST(n * q - s * s AS DOUBLE))
                     ELSE CAST(0 AS DOUBLE) END AS z FROM c_moments)"""

POLY = "CAST('1.330274429' AS DOUBLE)"
for _b in ("-1.821255978", "1.781477937", "-0.356563782", "0.319381530"):
    POLY = f"(CAST('{_b}' AS DOUBLE) + k * {POLY})"

C["c_scored"] = f"""
SELECT *, CASE WHEN sigma > 0 THEN (y - point) / sigma ELSE CAST(0 AS DOUBLE) END AS d
FROM (SELECT r.{KEY}, r.date, r.daily_new_cases, CAST(r.daily_new_cases AS DOUBLE) AS y, sigma,
             intercept + slope * CAST(r.date - DATE '{TRAIN_START}' AS DOUBLE) + coalesce(offset_, CAST(0 AS DOUBLE)) AS point
      FROM c_input r JOIN c_nfit_model m ON r.{KEY} = m.{KEY}
      LEFT JOIN c_nfit_offsets o ON r.{KEY} = o.{KEY} AND dayofweek(r.date) = o.dow)"""

C["c_model_anomalies"] = f"""
SELECT {KEY}, date, daily_new_cases, {half_up('point', 2)} AS expected, abs(d) > {Z} AS is_anomaly,
       {half_up("CASE WHEN d >= 0 THEN CAST(1 AS DOUBLE) - tail ELSE tail END", 6)} AS percentile,
       {half_up('d', 3)} AS distance,
       CASE WHEN point > 0 THEN {half_up('((y - point) * CAST(100 AS DOUBLE) / point)', 1)} ELSE CAST(0 AS DOUBLE) END AS deviation_pct,
       CASE WHEN y > point THEN 'SPIKE' WHEN y < point THEN 'DROP' ELSE 'NEUTRAL' END AS anomaly_direction
FROM (SELECT *, exp(-(d * d) / CAST(2 AS DOUBLE)) * CAST('0.3989422804014327' AS DOUBLE) * k * {POLY} AS tail
      FROM (SELECT *, CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST('0.2316419' AS DOUBLE) * abs(d)) AS k FROM c_scored))"""

C["c_events"] = """
SELECT n_name AS place, c_mktsegment AS segment, CAST(ts AS DATE) AS date, event_type, CAST(value AS DECIMAL(18,2)) AS value
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

C["c_vax_days"] = """
SELECT place, date, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bought,
       count(*) FILTER (event_type = 'signup') AS joined, CAST(sum(value) AS DOUBLE) AS amount
FROM c_events GROUP BY ALL"""

C["c_vaccinations"] = """
SELECT CASE WHEN place IN ('NATION_21', 'NATION_22') THEN 'NATION_20' ELSE place END AS country_region, date,
       CAST(total AS BIGINT) AS total_vaccinations, CAST(part AS BIGINT) AS people_vaccinated,
       CAST(full_part AS BIGINT) AS people_fully_vaccinated, amount AS daily_vaccinations,
       CASE WHEN bought > 0 THEN CAST(part AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(total AS DOUBLE) END AS vaccinated_per_100,
       CASE WHEN bought > 0 THEN CAST(full_part AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(total AS DOUBLE) END AS fully_vaccinated_per_100
FROM (SELECT *, sum(n) OVER w AS total, sum(bought) OVER w AS part, sum(joined) OVER w AS full_part
      FROM c_vax_days WINDOW w AS (PARTITION BY place ORDER BY date))"""

MOBILE = " + ".join(
    f"coalesce(CAST({c} AS DECIMAL(28,8)), 0)" for c in ("retail_and_recreation", "transit_stations", "workplaces")
)
C["c_mobility"] = f"""
SELECT *, {ratio(digits_of(MOBILE), "CAST(300000000 AS HUGEINT)", 2)} AS mobility_index
FROM (SELECT place AS country_region, date,
             CAST(sum(value) FILTER (event_type = 'view') AS DOUBLE) AS retail_and_recreation,
             CAST(sum(value) FILTER (event_type = 'click') AS DOUBLE) AS grocery_and_pharmacy,
             CAST(sum(value) FILTER (event_type = 'signup') AS DOUBLE) AS transit_stations,
             CAST(sum(value) FILTER (event_type = 'purchase') AS DOUBLE) AS workplaces,
             CAST(sum(value) FILTER (event_type = 'error') AS DOUBLE) AS residential
      FROM c_events GROUP BY ALL)"""

C["c_latest"] = f"SELECT * FROM c_features QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY date DESC) = 1"

C["c_fc_summary"] = f"""
SELECT {KEY}, greatest(arg_max(forecasted_cases, date), 0) AS fc_end, greatest(arg_min(forecasted_cases, date), 0) AS fc_start,
       greatest(max(forecasted_cases), 0) AS fc_peak,
       greatest(CAST(sum(CAST(forecasted_cases AS DECIMAL(28,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE), 0) AS fc_avg
FROM c_forecasts GROUP BY {KEY}"""

C["c_recent_rows"] = f"""
SELECT a.* FROM c_anomalies a JOIN (SELECT {KEY}, max(date) AS last FROM c_anomalies GROUP BY {KEY}) m
  ON a.{KEY} = m.{KEY} AND a.date >= m.last - 7"""

C["c_recent"] = f"SELECT {KEY}, CAST(bool_or(is_anomaly) AS INTEGER) AS has_recent_anomaly FROM c_recent_rows GROUP BY {KEY}"

C["c_mobility_latest"] = f"""
SELECT {KEY}, max(mobility_index) AS mobility_index FROM c_mobility
WHERE date >= (SELECT max(date) FROM c_mobility) - 14 GROUP BY {KEY}"""

SNAPSHOT = (
    "rolling_avg_7d_cases, rt_effective, doubling_time_days, epidemic_phase, case_fatality_rate, wow_change_pct, "
    "acceleration, trend_direction, endemic_flag, signal_to_noise, cumulative_confirmed, cumulative_deaths"
)
C["c_snapshot"] = f"""
SELECT l.{KEY}, date, {SNAPSHOT}, fc_end, fc_start, fc_peak, fc_avg, has_recent_anomaly, mobility_index
FROM c_latest l LEFT JOIN c_fc_summary f ON l.{KEY} = f.{KEY}
LEFT JOIN c_recent r ON l.{KEY} = r.{KEY} LEFT JOIN c_mobility_latest m ON l.{KEY} = m.{KEY}"""

TREND = (
    "greatest(CASE WHEN fc_start > 0 AND fc_end IS NOT NULL THEN "
    + ratio(f"(({units('fc_end', 2)} - {units('fc_start', 2)}) * 100)", units("fc_start", 2), 1)
    + " ELSE CAST(0 AS DOUBLE) END, -100)"
)
F2 = " ".join(f"WHEN fc_start > 0 AND fc_end > fc_start * CAST({x} AS DOUBLE) THEN {p}" for x, p in RISK.forecast)
FACTORS = {
    "f1_rt": ladder("rt_effective", RISK.rt, 0),
    "f2_forecast": f"CASE {F2} ELSE 0 END",
    "f3_accel": "CASE WHEN acceleration > 0 AND trend_direction = 'ACCELERATING' THEN 15 ELSE 0 END",
    "f4_doubling": ladder("doubling_time_days", RISK.doubling, 0, "<"),
    "f5_wow": ladder("wow_change_pct", RISK.wow, 0),
    "f6_cfr": ladder("case_fatality_rate", RISK.cfr, 0),
    "f7_volume": ladder("rolling_avg_7d_cases", RISK.volume, 0),
    "f8_anomaly": "CASE WHEN has_recent_anomaly = 1 THEN 5 ELSE 0 END",
}
FACTOR_LIST = ", ".join(FACTORS)
GAP = "coalesce(rolling_avg_7d_cases, 0) = 0"
C["c_factors"] = (
    f"SELECT {KEY}, date, {SNAPSHOT}, fc_end, fc_peak, {GAP} AS data_gap, {TREND} AS forecast_trend_pct, "
    + ", ".join(f"CAST({sql} AS INTEGER) AS {name}" for name, sql in FACTORS.items())
    + ", coalesce(mobility_index, CAST(0 AS DOUBLE)) AS mobility_index FROM c_snapshot"
)
TOTAL = " + ".join(FACTORS)
C["c_risk"] = f"""
SELECT *, CAST(least({TOTAL}, 100) AS INTEGER) AS risk_score, {ladder(f'({TOTAL})', RISK.tiers, 'LOW', '>=')} AS risk_tier
FROM c_factors"""

C["c_trajectory"] = f"""
SELECT {KEY}, min(forecasted_cases) AS forecast_min, max(forecasted_cases) AS forecast_max,
       CAST(sum(CAST(forecasted_cases AS DECIMAL(28,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS forecast_avg,
       arg_min(forecasted_cases, date) AS forecast_day1, arg_max(forecasted_cases, date) AS forecast_day30,
       max(date) FILTER (forecasted_cases = top) AS forecast_peak_date, max(top) AS forecast_peak_value,
       min(forecast_lower) AS ci_lower_min, max(forecast_upper) AS ci_upper_max,
       CAST(sum(CAST(forecast_upper AS DECIMAL(28,2)) - CAST(forecast_lower AS DECIMAL(28,2))) AS DOUBLE)
           / CAST(count(*) AS DOUBLE) AS ci_avg_width,
       max(date) AS forecast_end_date
FROM (SELECT *, max(forecasted_cases) OVER (PARTITION BY {KEY}) AS top FROM c_forecasts) GROUP BY {KEY}"""

C["c_stats"] = f"""
SELECT {KEY}, count(*) FILTER (is_anomaly) AS total_anomalies,
       count(*) FILTER (is_anomaly AND anomaly_direction = 'SPIKE') AS spike_count,
       count(*) FILTER (is_anomaly AND anomaly_direction = 'DROP') AS drop_count,
       max(abs(deviation_pct)) FILTER (is_anomaly) AS max_deviation_pct,
       max(date) FILTER (is_anomaly) AS last_anomaly_date,
       CAST(sum(CAST(abs(deviation_pct) AS DECIMAL(28,1))) FILTER (is_anomaly) AS DOUBLE)
           / CAST(nullif(count(*) FILTER (is_anomaly), 0) AS DOUBLE) AS avg_deviation_pct
FROM c_anomalies GROUP BY {KEY}"""

C["c_waves"] = f"""
SELECT {KEY}, max(top) AS all_time_peak_cases, max(date) FILTER (rolling_avg_7d_cases = top) AS all_time_peak_date,
       count(DISTINCT epidemic_phase) AS phases_observed
FROM (SELECT *, max(rolling_avg_7d_cases) OVER (PARTITION BY {KEY}) AS top FROM c_features) GROUP BY {KEY}"""

CONFIDENCE = "CASE WHEN model_mape IS NULL THEN 'UNKNOWN' WHEN model_mape < 10 THEN 'HIGH' WHEN model_mape < 25 THEN 'MODERATE' ELSE 'LOW' END"
PCT = ratio(f"({units('rolling_avg_7d_cases', 2)} * 100)", units("all_time_peak_cases", 2), 1)
C["c_context"] = f"""
SELECT *, {CONFIDENCE} AS model_confidence, {PCT} AS pct_of_all_time_peak FROM (
SELECT f.{KEY}, f.date AS data_date, f.rolling_avg_7d_cases, f.rolling_avg_14d_cases, f.rolling_avg_7d_deaths,
       f.daily_new_cases, f.cumulative_confirmed, f.cumulative_deaths, f.rt_effective, f.doubling_time_days,
       f.case_fatality_rate, f.acceleration, f.wow_change_pct, f.signal_to_noise, f.volatility_14d,
       f.epidemic_phase, f.trend_direction, f.endemic_flag, r.risk_score, r.risk_tier, r.forecast_trend_pct,
       {', '.join('r.' + name for name in FACTORS)},
       t.forecast_day1, t.forecast_day30, t.forecast_avg, t.forecast_peak_value, t.forecast_peak_date,
       t.ci_lower_min, t.ci_upper_max, t.ci_avg_width, t.forecast_end_date, q.mape AS model_mape, q.mae AS model_mae,
       coalesce(s.total_anomalies, 0) AS total_anomalies, coalesce(s.spike_count, 0) AS anomaly_spikes,
       coalesce(s.drop_count, 0) AS anomaly_drops, s.max_deviation_pct, s.avg_deviation_pct, s.last_anomaly_date,
       w.all_time_peak_cases, w.all_time_peak_date
FROM c_latest f LEFT JOIN c_risk r ON f.{KEY} = r.{KEY} LEFT JOIN c_trajectory t ON f.{KEY} = t.{KEY}
LEFT JOIN c_quality q ON f.{KEY} = q.{KEY} LEFT JOIN c_stats s ON f.{KEY} = s.{KEY}
LEFT JOIN c_waves w ON f.{KEY} = w.{KEY})"""

C["c_scenarios"] = f"""
SELECT *, {ratio(f"({units('rt_effective', 3)} * 140)", '100000', 2)} AS rt_variant,
       {ratio(f"({units('rt_effective', 3)} * 75)", '100000', 2)} AS rt_intervention,
       {KEY} AS series_name, 'Most recent anomaly: ' || CAST(last_anomaly_date AS VARCHAR) || '.' || chr(10) AS last_anomaly_line
FROM c_context"""

C["c_top"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY abs(deviation_pct) DESC, date) AS rnk
               FROM c_anomalies WHERE is_anomaly) WHERE rnk <= 3"""

C["c_anomaly_prompts"] = f"""
SELECT {KEY}, date, actual, expected, deviation_pct, anomaly_direction, day_of_week, {fill(texts.ANOMALY_PROMPT)} AS prompt
FROM (SELECT *, daily_new_cases AS actual, strftime(date, '%a') AS day_of_week, {KEY} AS series_name, date AS day FROM c_top)"""

NO_ERROR = "CAST(NULL AS VARCHAR) AS error"


def draft(prompt: str) -> str:
    """What the offline generator answers."""
    return (
        f"'Draft for a prompt of ' || CAST(length({prompt}) AS VARCHAR) || ' characters: ' "
        f"|| split_part({prompt}, chr(10), 1)"
    )


C["c_named"] = f"SELECT *, {KEY} AS series_name, (SELECT count(*) FROM c_risk) AS n_series FROM c_risk"
C["c_lines"] = f"""
SELECT *, sum(length(line) + 2) OVER (ORDER BY risk_score DESC NULLS LAST, {KEY} ROWS UNBOUNDED PRECEDING) - length(line) - 2 AS start,
       greatest({CONFIG.report.triage_budget} - max(length(line) + 2) OVER (), 1) AS width
FROM (SELECT *, {fill(texts.TRIAGE_LINE)} AS line FROM (SELECT *, {KEY} AS series_name FROM c_risk))"""
C["c_triage"] = f"""
SELECT CAST(start // width AS BIGINT) AS page, count(*) AS n_series, {text_of(texts.TRIAGE_OPENING)}
       || string_agg(line, '; ' ORDER BY start) || '.' AS prompt
FROM c_lines GROUP BY page"""


def triage_level(prefix: str, below: str) -> None:
    """The briefs of one level packed into the prompts of the next."""
    C[f"{prefix}_lines"] = f"""
SELECT *, sum(length(line) + 1) OVER (ORDER BY page ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS start,
       greatest({CONFIG.report.triage_budget} - max(length(line) + 1) OVER (), 1) AS width
FROM (SELECT page, n_series, {draft('prompt')} AS line FROM {below})"""
    C[prefix] = f"""
SELECT CAST(start // width AS BIGINT) AS page, CAST(sum(n_series) AS BIGINT) AS n_series, {text_of(texts.TRIAGE_GLOBAL)}
       || string_agg(line, chr(10) ORDER BY start) AS prompt
FROM {prefix}_lines GROUP BY ALL"""


# A few levels more than the series at hand need; a level of one page ends the ladder.
LEVELS = ("c_triage", "c_level1", "c_level2", "c_level3", "c_level4")
for _below, _above in zip(LEVELS, LEVELS[1:]):
    triage_level(_above, _below)
C["c_global"] = " UNION ALL ".join(
    f"SELECT n_series, prompt FROM {level} WHERE (SELECT count(*) FROM {level}) = 1"
    + "".join(f" AND (SELECT count(*) FROM {lower}) > 1" for lower in LEVELS[:k])
    for k, level in enumerate(LEVELS)
)

FENCE = texts.FENCE
C["c_responses"] = f"""
SELECT conv_id, turn, role,
       CASE role WHEN 'user' THEN 'Let me look.' || chr(10) || '{FENCE}sql' || chr(10) || 'SELECT ' || body || chr(10) || '{FENCE}' || chr(10) || 'Done.'
                 WHEN 'assistant' THEN '{FENCE}' || chr(10) || 'select 1 -- ' || body || '{FENCE} ok'
                 ELSE '{FENCE}sql' || chr(10) || 'DROP TABLE x; ' || body || '{FENCE}' END AS response
FROM (SELECT *, coalesce(text, '') AS body FROM conversations)"""


def _query(sql: str) -> str:
    """``sql`` with the relations it refers to, directly or through others, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bc_[a-z0-9_]+\b", text)):
            if name in C and name not in ordered:
                visit(C[name])
                ordered.append(name)

    visit(sql)
    head = ",\n".join(f"{name} AS ({C[name]})" for name in ordered)
    return f"WITH {head}\n{sql}" if head else sql


def brief(text: str, sentences: int = 2) -> str:
    marked = f"regexp_replace({text}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g')"
    return f"array_to_string(list_slice(string_split({marked}, chr(1)), 1, {sentences}), ' ')"


def strip_space(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def keyed(columns: str, source: str) -> str:
    return f"SELECT {KEY}, date, {columns} FROM {source}"


PROFILE = f"""
SELECT {KEY}, count(*) AS days, min(date) AS first_date, max(date) AS last_date, max(cumulative_confirmed) AS total_cases,
       max(cumulative_deaths) AS total_deaths,
       {ratio('(max(cumulative_deaths) * 100)', 'max(cumulative_confirmed)', 2)} AS cfr_pct,
       count(*) FILTER (daily_new_cases = 0 OR daily_new_cases IS NULL) AS zero_days,
       {ratio('(count(*) FILTER (daily_new_cases = 0) * 100)', 'count(*)', 1)} AS zero_pct
FROM c_daily GROUP BY {KEY}"""

SUMMARY = (
    "SELECT '{0}' AS tbl, count(*) AS row_count, count(DISTINCT country_region) AS n_series, "
    "min(date) AS first_date, max(date) AS last_date FROM {1}"
)

LABELLED = " ".join(f"WHEN {text_of(k)} THEN {text_of(v)}" for k, v in PHASE_LABELS.items())
PHASE_LABEL = f"CASE epidemic_phase {LABELLED} WHEN 'TRANSITION' THEN 'Transition' ELSE '—' END"

CONTEXT_COLUMNS = "* FROM c_context"
REPORT_SEGMENTS = f"""
SELECT {KEY}, date, val, lower_bound, upper_bound, segment FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY}, segment ORDER BY date DESC) AS rn FROM (
    SELECT h.{KEY}, h.date, CASE WHEN val IS NOT NULL THEN greatest(val, 0) END AS val, lower_bound, upper_bound, start_,
           CASE WHEN type = 'FORECAST' THEN 'FORECAST' WHEN start_ IS NULL OR h.date < start_ THEN 'HISTORY'
                WHEN h.date <= end_ THEN 'VALIDATION' END AS segment
    FROM c_history h LEFT JOIN (SELECT {KEY}, min(date) AS start_, max(date) AS end_ FROM c_forecasts GROUP BY {KEY}) f
      ON h.{KEY} = f.{KEY})
  WHERE segment IS NOT NULL)
WHERE segment <> 'HISTORY' OR rn <= CASE WHEN start_ IS NULL THEN 180 ELSE 120 END"""

SHOWN = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '—') AS \"{label}\"" for c, label in risk_labels().items())
SELECTION = f"SELECT {KEY} FROM c_risk ORDER BY risk_score DESC, {KEY} LIMIT 3"
COMPARED = ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '—') AS {c}"
    for c in (KEY, "risk_tier", "risk_score", "rt_effective", "epidemic_phase", "forecast_trend_pct")
)
TOP_COLUMNS = "daily_new_cases, expected, deviation_pct, anomaly_direction"
BODY = f"""
SELECT *, CASE WHEN contains(response, '{FENCE}sql')
               THEN {strip_space(f"split_part(split_part(response, '{FENCE}sql', 2), '{FENCE}', 1)")}
               WHEN contains(response, '{FENCE}') AND contains(upper(response), 'SELECT')
               THEN {strip_space(f"split_part(response, '{FENCE}', 2)")} END AS body
FROM c_responses"""
WORDS = "|".join(texts.FORBIDDEN)


def guarded(pattern: str) -> str:
    return (
        "SELECT conv_id, turn, role, CASE WHEN starts_with(upper(body), 'SELECT') "
        f"AND NOT regexp_matches(upper(body), '{pattern}') THEN body END AS query FROM ({BODY})"
    )


NARRATIVE_TEMPLATES = {
    "metric_explainer": texts.METRIC_EXPLAINER,
    "situation_summary": texts.SITUATION_SUMMARY,
    "preventive_measures": texts.PREVENTIVE_MEASURES,
}
NARRATIVES = (
    f"SELECT {KEY}, risk_tier, risk_score, rt_effective, rolling_avg_7d_cases, epidemic_phase, forecast_trend_pct, "
    + ", ".join(draft(f"p_{name}") + f" AS {name}" for name in NARRATIVE_TEMPLATES)
    + f", {brief(draft('p_situation_summary'))} AS executive_brief, {NO_ERROR} FROM (SELECT *, "
    + ", ".join(f"{fill(template)} AS p_{name}" for name, template in NARRATIVE_TEMPLATES.items())
    + " FROM c_scenarios)"
)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["s01_scan_table"] = "SELECT * FROM c_fact"
    q["s02_scan_optional"] = "SELECT conv_id, turn, role, text, CAST(NULL AS VARCHAR) AS lang FROM conversations"
    q["s03_load_vaccinations"] = "SELECT * FROM c_vaccinations"
    q["s04_load_mobility"] = "SELECT * FROM c_mobility"
    q["s05_write_table"] = "SELECT * FROM c_daily"
    q["s05_publish_version"] = "SELECT * FROM c_daily"
    q["s06_append_rows"] = "SELECT * FROM c_vaccinations"
    q["s08_view_training"] = "SELECT * FROM c_train"
    q["s08_view_anomaly_input"] = "SELECT * FROM c_input"
    q["s08_view_context"] = f"SELECT {CONTEXT_COLUMNS}"
    q["s08_stored_training"] = q["s08_view_training"]
    q["s08_stored_anomaly_input"] = q["s08_view_anomaly_input"]
    q["s08_stored_context"] = q["s08_view_context"]
    q["s09_load_all"] = " UNION ALL ".join(
        f"SELECT '{name}' AS tbl, count(*) AS row_count FROM {source}"
        for name, source in (
            ("risk_tiers", "c_risk"), ("features", "c_features"), ("history_forecast", "c_history"),
            ("forecasts", "c_forecasts"), ("anomalies", "c_anomalies"), ("vaccinations", "c_vaccinations"),
            ("forecast_metrics", "c_metrics"),
        )
    )

    q["p01_canonicalise_names"] = f"SELECT {RENAMED} AS {KEY}, date, case_type, cases FROM c_fact"
    q["p01_canonicalise_by_table"] = f"""
SELECT coalesce(r_name, f.{KEY}) AS {KEY}, date, case_type, cases FROM c_fact f
LEFT JOIN nation ON f.{KEY} = n_name LEFT JOIN region ON n_regionkey = r_regionkey"""
    q["p02_filter_in_list"] = (
        "SELECT event_id, event_type, value FROM events WHERE event_type IN ('view', 'click', 'purchase')"
    )
    q["p02_filter_in_table"] = f"""
SELECT * FROM c_fact WHERE {KEY} IN (SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey
                                     GROUP BY n_name HAVING count(*) >= 6)"""
    q["p03_filter_date_range"] = f"SELECT * FROM c_fact WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_END}'"
    complete = "rt_effective IS NOT NULL AND doubling_time_days IS NOT NULL AND signal_to_noise IS NOT NULL"
    q["p03_clustered_range"] = (
        f"SELECT {FEATURE_COLUMNS} FROM c_classified WHERE {KEY} = '{SELECTED}' AND date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'"
    )
    q["p04_filter_null"] = keyed("rt_effective, doubling_time_days, signal_to_noise", f"c_derived WHERE {complete}")
    q["p04_filter_is_null"] = keyed("daily_new_cases", "c_derived WHERE rt_effective IS NULL")
    q["p05_star_extend"] = keyed(
        "cumulative_confirmed, cumulative_deaths, daily_new_cases, daily_new_deaths, case_fatality_rate, day_of_week", "c_base"
    )
    q["p06_literal_tag"] = keyed(
        "daily_new_cases, 'ACTUAL' AS type, FALSE AS endemic_flag, CAST(NULL AS DOUBLE) AS lower_bound", "c_daily"
    )
    q["p07_case_tier"] = keyed(
        f"CAST({ladder('rolling_avg_7d_cases', VOLUME, 0)} AS INTEGER) AS volume_points, "
        f"{ladder('case_fatality_rate', ((3.0, 'HIGH'), (1.5, 'MODERATE')), 'LOW', '>=')} AS fatality_tier",
        "c_base",
    )
    q["p08_boolean_expr"] = keyed(f"{GAP} AS data_gap", "c_base")
    q["p09_rename_fill_display"] = f"SELECT {SHOWN} FROM c_risk"
    q["p10_label_map"] = keyed(f"{PHASE_LABEL} AS phase_label", "c_classified")
    q["p11_clip_nonnegative"] = keyed(
        "greatest(val, 0) AS val, CASE WHEN lower_bound IS NOT NULL THEN greatest(lower_bound, 0) END AS lower_bound, "
        "CASE WHEN upper_bound IS NOT NULL THEN greatest(upper_bound, 0) END AS upper_bound, type",
        "c_history",
    )

    q["j01_left_join_chain"] = "SELECT * FROM c_snapshot"
    q["j02_context_join"] = f"SELECT {CONTEXT_COLUMNS}"
    q["j03_recent_range_join"] = "SELECT * FROM c_recent_rows"
    q["j04_semi_in_subquery"] = keyed("epidemic_phase", f"c_classified WHERE {KEY} IN ({endemic(3)})")
    q["j05_scalar_subquery_filter"] = keyed(
        "daily_new_cases", "c_daily WHERE date >= (SELECT max(date) FROM c_daily) - 14"
    )
    q["j06_overlap_join"] = "SELECT * FROM c_overlap"

    q["a01_conditional_pivot"] = "SELECT * FROM c_combined"
    q["a02_table_summary"] = SUMMARY.format("combined", "c_combined")
    q["a03_series_profile"] = PROFILE
    q["a04_train_coverage"] = (
        f"SELECT {KEY}, count(*) AS train_days, min(date) AS start_dt, max(date) AS end_dt FROM c_train GROUP BY {KEY}"
    )
    width = f"({units('forecast_upper', 2)} - {units('forecast_lower', 2)})"
    q["a05_forecast_coverage"] = f"""
SELECT {KEY}, count(*) AS days, min(date) AS fc_start, max(date) AS fc_end,
       {ratio(f"sum({units('forecasted_cases', 2)})", '(count(*) * 100)', 0)} AS avg_fc,
       {ratio(f'sum({width})', '(count(*) * 100)', 0)} AS avg_ci_width FROM c_forecasts GROUP BY {KEY}"""
    q["a06_anomaly_summary"] = f"""
SELECT {KEY}, total_anomalies, spike_count AS spikes, drop_count AS drops, max_deviation_pct AS max_deviation FROM c_stats"""
    q["a07_anomaly_stats"] = "SELECT * FROM c_stats"
    q["a08_first_last_by_order"] = f"""
SELECT {KEY}, arg_min(rolling_avg_7d_cases, date) AS first_value, arg_max(rolling_avg_7d_cases, date) AS last_value
FROM c_base GROUP BY {KEY}"""
    q["a09_peak_with_date"] = f"SELECT {KEY}, all_time_peak_cases AS peak_value, all_time_peak_date AS peak_date FROM c_waves"
    q["a10_having_all"] = f"""
SELECT {KEY}, count(*) FILTER ({DECLINE}) AS n_decline, count(*) AS n_rows FROM c_classified
WHERE date >= (SELECT max(date) FROM c_daily) - 3 GROUP BY {KEY} HAVING bool_and({DECLINE})"""
    q["a11_count_distinct"] = f"SELECT {KEY}, count(DISTINCT epidemic_phase) AS phases FROM c_classified GROUP BY {KEY}"
    pivoted = ", ".join(
        f"max(metric_value) FILTER (error_metric = '{name}') AS \"{name}\"" for name in METRIC_ORDER
    )
    q["a12_metric_pivot"] = f"SELECT series, {pivoted} FROM c_metrics GROUP BY series"
    q["a12_metric_pivot_extra"] = f"""
SELECT series, {pivoted}, {half_up("sqrt(max(metric_value) FILTER (error_metric = 'MSE'))", 4)} AS "RMSE" FROM c_metrics GROUP BY series"""
    q["a13_global_kpis"] = """
SELECT count(*) AS n_series, CAST(sum(risk_score) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_score,
       CAST(sum(CAST(rt_effective AS DECIMAL(28,3))) AS DOUBLE) / CAST(count(rt_effective) AS DOUBLE) AS avg_rt,
       count(*) FILTER (risk_tier = 'HIGH') AS n_high, count(*) FILTER (risk_tier = 'MODERATE') AS n_moderate,
       count(*) FILTER (risk_tier = 'LOW') AS n_low FROM c_risk"""
    q["a14_list_agg"] = "SELECT * FROM c_triage"
    q["a15_anomaly_kpis"] = f"""
SELECT {KEY}, total_anomalies AS series_anomalies, (SELECT count(*) FROM c_anomalies WHERE is_anomaly) AS all_anomalies,
       avg_deviation_pct AS avg_deviation FROM c_stats"""
    q["a16_recent_flag"] = "SELECT * FROM c_recent"
    q["a17_trailing_max"] = "SELECT * FROM c_mobility_latest"

    q["w01_daily_delta"] = "SELECT * FROM c_daily"
    q["w02_rolling_avg"] = keyed("rolling_avg_7d_cases, rolling_avg_14d_cases, rolling_avg_28d_cases", "c_base")
    q["w02_rolling_avg_deaths"] = keyed("rolling_avg_7d_deaths, rolling_avg_14d_deaths", "c_base")
    q["w03_rolling_sum"] = keyed("sum_7d_cases, sum_30d_cases", "c_base")
    q["w04_offset_frame_sum"] = keyed("prev_sum_7d_cases", "c_base")
    q["w05_lag_n"] = keyed("cases_7d_ago, confirmed_7d_ago", "c_base")
    q["w06_rolling_stddev"] = keyed("volatility_14d", "c_base")
    q["w07_first_value_datediff"] = keyed("days_since_first_case", "c_base")
    q["w08_rt_windows"] = keyed("rt_numerator, rt_denominator", "c_base")
    q["w09_rolling_moments"] = keyed(
        "n AS moment_n, CAST(s AS BIGINT) AS moment_sum, CAST(q AS DOUBLE) AS moment_sum_sq, "
        "CAST(n * q - s * s AS DOUBLE) AS moment_spread",
        "c_moments",
    )
    q["w10_row_number_top1"] = "SELECT * FROM c_latest"
    q["w11_row_number_asc_desc"] = f"""
SELECT {KEY}, date, forecasted_cases, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY date) AS INTEGER) AS rn_asc,
       CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY date DESC) AS INTEGER) AS rn_desc FROM c_forecasts"""
    q["w12_partition_max"] = keyed(
        f"rolling_avg_7d_cases, max(rolling_avg_7d_cases) OVER (PARTITION BY {KEY}) AS series_peak", "c_base"
    )
    q["w13_topk_per_group"] = keyed("deviation_pct, CAST(rnk AS INTEGER) AS rnk", "c_top")

    q["i01_case_fatality_rate"] = keyed("case_fatality_rate", "c_base")
    q["i02_day_of_week"] = keyed("day_of_week", "c_base")
    q["i03_rt_effective"] = keyed("rt_effective", "c_derived")
    q["i04_doubling_time"] = keyed("doubling_time_days", "c_derived")
    q["i05_wow_change_pct"] = keyed("wow_change_pct", "c_derived")
    q["i06_weekly_growth_rate"] = keyed("weekly_growth_rate", "c_derived")
    q["i07_signal_to_noise"] = keyed("signal_to_noise", "c_derived")
    q["i08_trend_direction"] = keyed("trend_direction", "c_classified")
    q["i09_acceleration"] = keyed("acceleration", "c_classified")
    q["i10_epidemic_phase"] = keyed("epidemic_phase", "c_classified")
    q["i11_endemic_flag"] = keyed("endemic_flag", "c_features")
    q["i12_feature_store"] = "SELECT * FROM c_features"
    q["i12_incremental_refresh"] = "SELECT * FROM c_features"
    q["i13_global_latest_snapshot"] = f"""
SELECT {KEY}, date, {ratio(units('rolling_avg_7d_cases', 2), '100', 0)} AS avg7d,
       {ratio(units('rt_effective', 3), '1000', 2)} AS rt, doubling_time_days AS dbl_time, epidemic_phase, endemic_flag
FROM c_features WHERE date = (SELECT max(date) FROM c_features)"""
    q["i14_mobility_index"] = "SELECT country_region, date, mobility_index FROM c_mobility"

    q["f01_train_split"] = "SELECT * FROM c_train"
    offsets = ", ".join(
        f"{half_up(f'max(o.offset_) FILTER (o.dow = {d})', 4)} AS offset_{d}" for d in range(7)
    )
    q["f02_fit_forecaster"] = f"""
SELECT m.{KEY}, CAST(max(n_train) AS BIGINT) AS n_train, max(last_date) AS last_date, {half_up('max(slope)', 6)} AS slope,
       {half_up('max(intercept)', 4)} AS intercept, {half_up('max(sigma)', 4)} AS sigma, {offsets}
FROM c_fit_model m JOIN c_fit_offsets o ON m.{KEY} = o.{KEY} GROUP BY m.{KEY}"""
    q["f03_forecast"] = "SELECT * FROM c_forecasts"
    q["f04_history_forecast"] = "SELECT * FROM c_history"
    q["f05_forecast_metrics"] = "SELECT * FROM c_metrics"
    q["f05_backtest_metrics"] = "SELECT * FROM c_b_metrics"
    q["f05_rolling_origins"] = """
SELECT split_part(series, '|', 1) AS series, CAST(split_part(series, '|', 2) AS DATE) AS origin, error_metric, metric_value
FROM c_o_metrics"""
    q["f06_forecast_summary"] = "SELECT * FROM c_fc_summary"
    q["f07_forecast_trajectory"] = "SELECT * FROM c_trajectory"
    q["f08_forecast_display_split"] = REPORT_SEGMENTS
    q["f09_forecast_kpis"] = f"""
SELECT {KEY}, rolling_avg_7d_cases AS current_avg_7d, coalesce(fc_end, 0) AS forecast_end, coalesce(fc_peak, 0) AS forecast_peak,
       forecast_trend_pct, endemic_flag AS low_confidence FROM c_risk"""
    q["f10_interval_band"] = keyed(
        "greatest(lower_bound, 0) AS lower_bound, greatest(upper_bound, 0) AS upper_bound",
        "c_history WHERE lower_bound IS NOT NULL AND upper_bound IS NOT NULL",
    )
    q["f11_fit_forecaster_custom"] = """
SELECT * FROM c_weekday_forecasts"""
    q["n01_zscore_anomalies"] = "SELECT * FROM c_anomalies"
    q["n02_model_anomalies"] = "SELECT * FROM c_model_anomalies"
    q["n02_rank_percentiles"] = f"""
SELECT {KEY}, date, distance, is_anomaly, percentile, {ratio('upto', 'n', 6)} AS rank_percentile,
       least(upto, n - below) * 1000000 <= n * 25000 AS is_rare
FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n,
             count(*) OVER (PARTITION BY {KEY} ORDER BY distance RANGE UNBOUNDED PRECEDING) AS upto,
             rank() OVER (PARTITION BY {KEY} ORDER BY distance) - 1 AS below FROM c_model_anomalies)"""
    q["n03_flagged_split"] = keyed(
        "anomaly_direction = 'SPIKE' AS is_spike, anomaly_direction = 'DROP' AS is_drop", "c_anomalies WHERE is_anomaly"
    )

    q["k01_latest_per_series"] = f"SELECT {KEY}, date, rolling_avg_7d_cases, rt_effective, epidemic_phase FROM c_latest"
    q["k02_data_gap_flag"] = f"SELECT {KEY}, data_gap FROM c_risk"
    q["k03_forecast_trend_pct"] = f"SELECT {KEY}, {TREND} AS forecast_trend_pct FROM c_fc_summary"
    keys = {
        "f1_rt": "k04", "f2_forecast": "k05", "f3_accel": "k06", "f4_doubling": "k07", "f5_wow": "k08",
        "f6_cfr": "k09", "f7_volume": "k10", "f8_anomaly": "k11",
    }
    on_features = {"f1_rt", "f3_accel", "f4_doubling", "f5_wow", "f6_cfr", "f7_volume"}
    for name, key in keys.items():
        points = f"CAST({FACTORS[name]} AS INTEGER) AS {name}"
        if name in on_features:
            q[f"{key}_{name}"] = keyed(points, "c_classified")
        else:
            q[f"{key}_{name}"] = f"SELECT {KEY}, {points} FROM " + ("c_fc_summary" if name == "f2_forecast" else "c_recent")
    q["k12_risk_score"] = f"SELECT {KEY}, risk_score FROM c_risk"
    q["k13_risk_tier"] = f"SELECT {KEY}, risk_tier FROM c_risk"
    q["k14_risk_tiers"] = "SELECT * FROM c_risk"
    q["k15_model_confidence"] = f"SELECT {KEY}, model_mape, {CONFIDENCE} AS model_confidence FROM (SELECT {KEY}, mape AS model_mape FROM c_quality)"
    q["k16_wave_context"] = "SELECT * FROM c_waves"
    q["k17_pct_of_peak"] = f"""
SELECT l.{KEY}, {PCT} AS pct_of_all_time_peak FROM c_latest l JOIN c_waves w ON l.{KEY} = w.{KEY}"""
    q["k18_context_view"] = f"SELECT {CONTEXT_COLUMNS}"
    q["k19_scenario_inputs"] = f"""
SELECT {KEY}, rt_effective, rt_variant, rt_intervention, forecast_day30, all_time_peak_cases, model_confidence FROM c_scenarios"""

    for key, name in (
        ("t01_prompt_metric_explainer", texts.METRIC_EXPLAINER),
        ("t02_prompt_situation_summary", texts.SITUATION_SUMMARY),
        ("t03_prompt_preventive", texts.PREVENTIVE_MEASURES),
        ("t05_prompt_scenarios", texts.SCENARIO_PROMPT),
    ):
        q[key] = f"SELECT {KEY}, {fill(name)} AS prompt FROM c_scenarios"
    q["t04_prompt_anomaly"] = f"SELECT {KEY}, date, day_of_week, prompt FROM c_anomaly_prompts"
    q["t06_batch_generate"] = f"SELECT conv_id, turn, {draft('text')} AS answer FROM conversations"
    q["t06_stored_answers"] = f"SELECT conv_id, turn, {draft('text')} AS answer, {NO_ERROR} FROM conversations"
    q["t06_stored_calls"] = """
SELECT 'first' AS run, count(*) AS n_rows, count(DISTINCT text) AS n_prompts, count(DISTINCT text) AS n_calls,
       CAST(0 AS BIGINT) AS n_failed FROM conversations WHERE role = 'user'
UNION ALL
SELECT 'second', count(*), count(DISTINCT text), count(DISTINCT text) - count(DISTINCT text) FILTER (role = 'user'),
       CAST(0 AS BIGINT) FROM conversations"""
    q["t07_batch_summarise"] = f"SELECT doc_id, {brief('text')} AS brief FROM documents"
    q["t08_anomaly_explanations"] = f"""
SELECT {KEY}, date, actual, expected, deviation_pct, anomaly_direction, day_of_week, {draft('prompt')} AS explanation, {NO_ERROR}
FROM c_anomaly_prompts"""
    q["t09_global_triage"] = f"SELECT n_series, {draft('prompt')} AS global_brief, {NO_ERROR} FROM c_global"
    q["t10_narratives"] = NARRATIVES
    lengths = ", ".join(f"length({c}) AS {c}_len" for c in (*NARRATIVE_TEMPLATES, "executive_brief"))
    q["t11_text_length_check"] = f"SELECT {KEY}, risk_tier, {lengths} FROM ({NARRATIVES})"
    q["t12_policy_simulations"] = f"""
SELECT {KEY}, risk_tier, {draft('prompt')} AS scenario_analysis, {NO_ERROR} FROM (SELECT *, {fill(texts.SCENARIO_PROMPT)} AS prompt FROM c_scenarios)"""
    q["t13_conversation_context"] = """
SELECT conv_id, turn, CAST(n AS INTEGER) AS n_messages, history FROM (
  SELECT conv_id, turn, role, count(*) OVER w AS n,
         string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10)) OVER w AS history
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
WHERE role = 'user'"""
    q["t14_extract_select"] = guarded(WORDS)
    q["t14_extract_select_words"] = guarded(rf"\b({WORDS})\b")
    head = strip_space(f"split_part(response, '{FENCE}', 1)")
    q["t15_strip_fence"] = f"""
SELECT conv_id, turn, CASE WHEN clean = '' THEN 'Please rephrase the question.' ELSE clean END AS clean FROM (
  SELECT conv_id, turn, CASE WHEN contains(response, '{FENCE}') THEN {head} ELSE response END AS clean FROM c_responses)"""
    q["t16_series_context_line"] = f"SELECT {KEY}, {fill(texts.CONTEXT_LINE)} AS context_line FROM c_named"
    q["t17_chat_prompts"] = f"""
SELECT conv_id, turn, {fill(texts.CHAT_PROMPT)} AS prompt
FROM ({q["t13_conversation_context"]}) h
JOIN (SELECT {fill(texts.CONTEXT_LINE)} AS context_line, row_number() OVER (ORDER BY {KEY}) - 1 AS n, n_series FROM c_named) s
  ON h.conv_id % s.n_series = s.n"""
    q["t18_result_prompts"] = f"""
SELECT conv_id, turn, {fill(texts.RESULT_PROMPT)} AS prompt FROM (
  SELECT conv_id, turn, role, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS preview FROM conversations)
WHERE role = 'user'"""

    q["r01_risk_ranking"] = f"SELECT {KEY}, risk_tier, risk_score FROM c_risk"
    q["r02_rt_score_scatter"] = f"""
SELECT {KEY}, risk_tier, rt_effective, risk_score, rolling_avg_7d_cases FROM c_risk
WHERE rt_effective IS NOT NULL AND risk_score IS NOT NULL AND rolling_avg_7d_cases IS NOT NULL"""
    q["r03_risk_table"] = f"SELECT {SHOWN} FROM c_risk"
    q["r04_epi_profile"] = keyed(
        "rt_effective, rolling_avg_7d_cases, rolling_avg_14d_cases, rolling_avg_7d_deaths",
        f"c_derived WHERE date >= DATE '{REPORT_START}'",
    )
    q["r04_epi_profile_selected"] = q["r04_epi_profile"] + f" AND {KEY} = '{SELECTED}'"
    q["r05_vaccination_series"] = f"""
SELECT {KEY}, date, vaccinated_per_100, fully_vaccinated_per_100 FROM c_vaccinations
WHERE {KEY} IN (SELECT {KEY} FROM c_vaccinations WHERE vaccinated_per_100 IS NOT NULL)"""
    q["r06_comparison"] = keyed(
        "rolling_avg_7d_cases, rt_effective", f"c_derived WHERE {KEY} IN ({SELECTION}) AND date >= DATE '{REPORT_START}'"
    )
    q["r06_comparison_risk"] = f"SELECT {COMPARED} FROM c_risk WHERE {KEY} IN ({SELECTION})"
    q["r07_default_selection"] = SELECTION
    q["r07_selected_and_riskiest"] = f"""
SELECT '{SELECTED}' AS {KEY} UNION ALL SELECT * FROM (
  SELECT {KEY} FROM (SELECT * FROM c_risk ORDER BY risk_score DESC, {KEY} LIMIT 4) WHERE {KEY} <> '{SELECTED}'
  ORDER BY risk_score DESC, {KEY} LIMIT 2)"""
    q["r08_anomaly_chart_data"] = keyed(
        "daily_new_cases AS observed, expected, "
        "CASE WHEN is_anomaly AND anomaly_direction = 'SPIKE' THEN daily_new_cases END AS spike, "
        "CASE WHEN is_anomaly AND anomaly_direction = 'DROP' THEN daily_new_cases END AS drop",
        "c_anomalies",
    )
    top = ReportConfig().top_n
    q["r09_top_n_signed"] = keyed(
        TOP_COLUMNS, f"c_anomalies WHERE is_anomaly ORDER BY deviation_pct DESC, date, {KEY} LIMIT {top}"
    )
    q["r09_top_n_per_series"] = f"""
SELECT * FROM (SELECT {KEY}, date, {TOP_COLUMNS},
               CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY deviation_pct DESC, date) AS INTEGER) AS rnk
               FROM c_anomalies WHERE is_anomaly) WHERE rnk <= {top}"""

    q["r10_preview_limit"] = f"SELECT * FROM c_anomalies ORDER BY {KEY}, date LIMIT {ReportConfig().preview_rows}"

    q["o01_order_by"] = f"SELECT {KEY}, risk_tier, risk_score, {FACTOR_LIST} FROM c_risk"
    last = ReportConfig().history_rows
    q["o02_last_rows_per_series"] = f"""
SELECT * FROM (SELECT {KEY}, date, daily_new_cases,
                      CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY date DESC) AS INTEGER) AS rnk FROM c_daily)
WHERE rnk <= {last}"""
    q["o03_union_all"] = f"SELECT {KEY}, date, type, val FROM c_history"
    return {name: _query(sql) for name, sql in q.items()}
