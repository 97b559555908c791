"""From the long cumulative fact to one row per series and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelloom.config import Columns, IngestConfig
from panelloom.functions.numeric import clip_low, ratio, ratio_wide
from panelloom.operators.projections import canonical_name


def series_window(columns: Columns):
    """The one window specification of all panel operators."""
    return Window.partitionBy(columns.series).orderBy(columns.ts)


def conditional_pivot(
    fact: DataFrame, keys: list[str], type_column: str, value: str, outputs: dict[str, str]
) -> DataFrame:
    """Long to wide with fixed columns: ``outputs`` maps an output column to a type code.

    One aggregate with map-side partial sums, so a series that holds most of the fact reaches the
    shuffle as at most one row per day and map task.
    """
    return fact.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col(type_column) == code, F.col(value)).otherwise(F.lit(0))).cast("bigint").alias(name)
            for name, code in outputs.items()
        ]
    )


def combine(fact: DataFrame, config: IngestConfig = IngestConfig(), columns: Columns = Columns()) -> DataFrame:
    """Tracked names in published spelling, one cumulative row per series and day.

    The filter is on raw names so that it reaches the scan.
    """
    kept = fact if config.tracked is None else fact.filter(F.col(columns.series).isin(*config.tracked))
    named = kept.select(
        canonical_name(columns.series, config.variants).alias(columns.series),
        F.to_date(columns.ts).alias(columns.ts),
        "case_type",
        F.col("cases").cast("bigint").alias("cases"),
    )
    return conditional_pivot(
        named,
        [columns.series, columns.ts],
        "case_type",
        "cases",
        {"cumulative_confirmed": config.confirmed_type, "cumulative_deaths": config.deaths_type},
    )


def daily_delta(combined: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Cumulative to daily: the first day keeps its full count, falling counts give 0."""
    w = series_window(columns)
    before = {"__c": F.lag("cumulative_confirmed").over(w), "__d": F.lag("cumulative_deaths").over(w)}
    new = {
        "daily_new_cases": clip_low(F.col("cumulative_confirmed") - F.coalesce("__c", F.lit(0)), 0),
        "daily_new_deaths": clip_low(F.col("cumulative_deaths") - F.coalesce("__d", F.lit(0)), 0),
    }
    return combined.withColumns(before).withColumns(new).drop(*before)


def table_summary(df: DataFrame, label: str, columns: Columns = Columns()) -> DataFrame:
    """Row, series and date-range check of one table."""
    return df.agg(
        F.lit(label).alias("tbl"),
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(columns.series).alias("n_series"),
        F.min(columns.ts).alias("first_date"),
        F.max(columns.ts).alias("last_date"),
    )


def series_profile(daily: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Days, range, totals, fatality percentage and zero-day share of each series."""
    days = F.count(F.lit(1))
    cases, deaths = F.max("cumulative_confirmed"), F.max("cumulative_deaths")
    zero = F.col("daily_new_cases") == 0
    return daily.groupBy(columns.series).agg(
        days.alias("days"),
        F.min(columns.ts).alias("first_date"),
        F.max(columns.ts).alias("last_date"),
        cases.alias("total_cases"),
        deaths.alias("total_deaths"),
        ratio_wide(deaths.cast("decimal(20,0)") * 100, cases, 2).alias("cfr_pct"),
        F.count(F.when(zero | F.col("daily_new_cases").isNull(), 1)).alias("zero_days"),
        ratio(F.count(F.when(zero, 1)) * 100, days, 1).alias("zero_pct"),
    )


def combined_and_daily(
    fact: DataFrame, config: IngestConfig = IngestConfig(), columns: Columns = Columns()
) -> DataFrame:
    return daily_delta(combine(fact, config, columns), columns)
