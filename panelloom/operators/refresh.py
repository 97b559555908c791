"""Bringing the feature store up to date after rows were appended or corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelloom.config import Columns, EndemicConfig, FeatureConfig
from panelloom.operators.features import endemic_series, features_without_flag
from panelloom.operators.ingest import daily_delta


def halo_rows(config: FeatureConfig = FeatureConfig()) -> int:
    """How many earlier rows any feature of a row reads: the longest trailing or skipped frame, or lag."""
    frames = (config.month, config.fortnight, 2 * config.week, 2 * config.serial_interval)
    return max(*(rows - 1 for rows in frames), config.week)


def first_changes(changes: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """The first changed day of each series, from the rows that were appended, corrected or removed."""
    return changes.groupBy(columns.series).agg(F.min(columns.ts).alias("first_changed"))


def changed_tail(
    combined: DataFrame, first: DataFrame, config: FeatureConfig = FeatureConfig(), columns: Columns = Columns()
) -> DataFrame:
    """Rows of changed series from their first changed day on, and as many before it as these read.

    One row more than the halo, whose daily counts are only right where the series begins. Columns ``__new``
    (to be published) and ``__start`` (the first day of the series) are added. Rows before the change are
    ranked backwards, so the rank filter leaves each task the halo of a series and not its history.
    """
    rows = combined.join(first, columns.series)
    fresh = rows.filter(F.col(columns.ts) >= F.col("first_changed")).withColumn("__new", F.lit(True))
    newest = Window.partitionBy(columns.series).orderBy(F.col(columns.ts).desc())
    earlier = rows.filter(F.col(columns.ts) < F.col("first_changed"))
    halo = (
        earlier.withColumn("__back", F.row_number().over(newest))
        .filter(F.col("__back") <= halo_rows(config) + 1)
        .drop("__back")
        .withColumn("__new", F.lit(False))
    )
    starts = rows.groupBy(columns.series).agg(F.min(columns.ts).alias("__start"))
    return fresh.unionByName(halo).join(starts, columns.series).drop("first_changed")


def refresh_features(
    features: DataFrame,
    combined: DataFrame,
    changes: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    endemic: EndemicConfig = EndemicConfig(),
    columns: Columns = Columns(),
) -> DataFrame:
    """The feature store of ``combined``, given that of before the ``changes``.

    ``features`` is the published store, ``combined`` the whole panel as it is now, ``changes`` the
    ``(series, ts)`` keys that were appended, corrected or removed since. Only series with a change are computed
    again, and only from their first changed day, over a halo of the rows before it: every trailing total
    is a difference inside the halo, so the totals of the history need not be known. All other rows are
    taken over. The endemic flag depends on the last date of the whole panel; it is derived for each series from
    the closing period alone and put on its rows.
    """
    series, ts = columns.series, columns.ts
    first = first_changes(changes, columns)
    tail = changed_tail(combined, first, config, columns)
    daily = daily_delta(tail.drop("__new", "__start"), columns)
    marks = tail.select(series, ts, "__new", "__start")
    computed = features_without_flag(daily, config, columns).join(marks, [series, ts]).filter("__new")
    computed = computed.withColumn("days_since_first_case", F.datediff(F.col(ts), F.col("__start"))).drop("__new", "__start")
    old = features.drop("endemic_flag").join(first, series, "left")
    kept = old.filter(F.col("first_changed").isNull() | (F.col(ts) < F.col("first_changed"))).drop("first_changed")
    rows = kept.unionByName(computed)
    flagged = endemic_series(rows.select(series, ts, "epidemic_phase"), combined, endemic, columns)
    flags = flagged.select(series, F.lit(True).alias("__flag"))
    out = rows.join(flags, series, "left").withColumn("endemic_flag", F.coalesce("__flag", F.lit(False)))
    return out.select(*features.columns)
