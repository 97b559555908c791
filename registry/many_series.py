"""The panel with one series per part: many short series instead of few long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.operators import features, forecast, ingest
from registry.bindings import CONFIG, as_fact, table


def daily_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("country_region"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("severe"),
    )
    increments = lines.groupBy("country_region", "date").agg(
        F.sum("quantity").alias("confirmed"),
        F.sum(F.when(F.col("severe"), F.col("quantity")).otherwise(F.lit(0))).cast("bigint").alias("deaths"),
    )
    return ingest.combined_and_daily(as_fact(increments), CONFIG.ingest)


def features_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features_without_flag(daily_by_part(spark, sf_dir), CONFIG.features)


def forecast_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = forecast.training_view(features_by_part(spark, sf_dir), CONFIG.forecast)
    return forecast.forecast(forecast.fit_forecaster(train, CONFIG.forecast), CONFIG.forecast)
