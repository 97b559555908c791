"""Reading base tables and the two optional sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelloom import schemas
from panelloom.config import (
    MOBILITY_NAMES,
    VACCINATION_NAME_VARIANTS,
    VACCINATION_NAMES,
    Columns,
)
from panelloom.functions.numeric import WIDE, ratio_wide
from panelloom.operators.projections import canonical_name


def scan_table(spark: SparkSession, location: str) -> DataFrame:
    """A catalog table (no slash in ``location``) or a Parquet directory."""
    return spark.read.parquet(location) if "/" in location else spark.table(location)


def scan_optional(spark: SparkSession, location: str | None, declared: T.StructType) -> DataFrame:
    """The source when it exists, else an empty frame with the declared schema.

    A folder that exists without a readable file is a broken source and raises.
    """
    if location is not None:
        try:
            return schemas.conform(scan_table(spark, location), declared)
        except AnalysisException as err:
            if err.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
    return spark.createDataFrame([], declared)


def append_rows(table: DataFrame, rows: DataFrame, declared: T.StructType) -> DataFrame:
    """The declared table followed by new rows brought to its schema."""
    return schemas.conform(table, declared).unionByName(schemas.conform(rows, declared))


def load_vaccinations(
    source: DataFrame,
    variants: dict | None = None,
    tracked: tuple | None = VACCINATION_NAMES,
    columns: Columns = Columns(),
) -> DataFrame:
    """Rename, canonicalise and filter the vaccination source to its eight published columns."""
    variants = VACCINATION_NAME_VARIANTS if variants is None else variants
    kept = source if tracked is None else source.filter(F.col("location").isin(*tracked))
    renamed = kept.select(
        canonical_name("location", variants).alias(columns.series),
        F.col("date").alias(columns.ts),
        "total_vaccinations",
        "people_vaccinated",
        "people_fully_vaccinated",
        F.col("new_vaccinations_smoothed").alias("daily_vaccinations"),
        F.col("people_vaccinated_per_hundred").alias("vaccinated_per_100"),
        F.col("people_fully_vaccinated_per_hundred").alias("fully_vaccinated_per_100"),
    )
    return schemas.conform(renamed, schemas.keyed(schemas.VACCINATIONS, columns))


def mobility_index() -> Column:
    """Mean of three measures, a missing one counting as 0; exact for measures of up to 8 decimals."""
    measures = ("retail_and_recreation", "transit_stations", "workplaces")
    parts = [F.coalesce(F.col(c).cast("decimal(28,8)"), F.lit(0)) for c in measures]
    total = ((parts[0] + parts[1] + parts[2]) * F.lit(10**8)).cast(WIDE)
    return ratio_wide(total, F.lit(3 * 10**8), 2)


def load_mobility(
    source: DataFrame, tracked: tuple | None = MOBILITY_NAMES, columns: Columns = Columns()
) -> DataFrame:
    """Country-level rows of the mobility source with the computed index."""
    kept = source.filter(F.col("sub_region_1").isNull())
    if tracked is not None:
        kept = kept.filter(F.col("country_region").isin(*tracked))
    indexed = kept.withColumn("mobility_index", mobility_index())
    named = indexed.withColumnsRenamed({"country_region": columns.series, "date": columns.ts})
    return schemas.conform(named, schemas.keyed(schemas.MOBILITY, columns))


def load_all(tables: dict[str, DataFrame], columns: Columns = Columns()) -> dict[str, DataFrame]:
    """Published tables by name with their date column normalised to DATE; all stay lazy.

    Ordering is left to the report that needs it: a sort here would be a range shuffle of a whole
    table that the next operator discards.
    """
    return {
        name: df.withColumn(columns.ts, F.to_date(columns.ts)) if columns.ts in df.columns else df
        for name, df in tables.items()
    }
