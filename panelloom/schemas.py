"""Declared schemas of the inputs and published tables, and ``conform``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


TYPES = {
    "string": T.StringType(), "date": T.DateType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def schema(columns: str) -> T.StructType:
    """``"name type, name type"`` as a schema; unlike DDL parsing it needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


FACT = schema("country_region string, date date, case_type string, cases bigint")
COMBINED = schema("country_region string, date date, cumulative_confirmed bigint, cumulative_deaths bigint")
VACCINATIONS = schema(
    "country_region string, date date, total_vaccinations bigint, people_vaccinated bigint, "
    "people_fully_vaccinated bigint, daily_vaccinations double, vaccinated_per_100 double, "
    "fully_vaccinated_per_100 double"
)
VACCINATION_SOURCE = schema(
    "location string, date date, total_vaccinations bigint, people_vaccinated bigint, "
    "people_fully_vaccinated bigint, new_vaccinations_smoothed double, "
    "people_vaccinated_per_hundred double, people_fully_vaccinated_per_hundred double"
)
MOBILITY_SOURCE = schema(
    "country_region string, sub_region_1 string, date date, retail_and_recreation double, "
    "grocery_and_pharmacy double, transit_stations double, workplaces double, residential double"
)
MOBILITY = schema(
    "country_region string, date date, retail_and_recreation double, grocery_and_pharmacy double, "
    "transit_stations double, workplaces double, residential double, mobility_index double"
)
METRICS = schema("series string, error_metric string, metric_value double")


def keyed(declared: T.StructType, columns) -> T.StructType:
    """A declared schema with the two key columns under the names of ``columns``."""
    names = {"country_region": columns.series, "date": columns.ts}
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in declared.fields])


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Cast and order ``df`` to ``target``; columns it lacks become typed NULLs."""
    have = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )
