"""How the driver's tables stand in for the inputs of the panel stages.

The main fact is shipped quantity by nation and day: cumulative quantity is "Confirmed", the part
on returned, highly taxed lines "Deaths", and a correction of -500 on every 13th of a month makes
cumulative counts fall. Two nations are spelling variants of a third. Events by customer nation
stand for the two optional sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelloom.config import (
    AnomalyConfig,
    ForecastConfig,
    IngestConfig,
    OriginConfig,
    PanelConfig,
    ReportConfig,
    RiskConfig,
)
from panelloom.plans.stages import PanelStages
from panelloom.sources.sinks import run_folder
from panelloom.sources.tables import load_mobility, load_vaccinations

VARIANTS = {"NATION_21": "NATION_20", "NATION_22": "NATION_20"}
TRAIN_START, TRAIN_END = "1995-03-15", "2000-12-31"
REPORT_START = "1995-06-01"
# The series of the reports that show a chosen one.
SELECTED = "NATION_13"
VOLUME = ((100.0, 5), (50.0, 2))

# Twenty cut-off dates of the rolling evaluation, the last a month before the training range ends.
ORIGINS = OriginConfig(last="2000-11-30", step=45, count=20)
# A small page, so that the series at hand fill several.
TRIAGE_BUDGET = 600

CONFIG = PanelConfig(
    ingest=IngestConfig(variants=VARIANTS, tracked=None),
    forecast=ForecastConfig(train_start=TRAIN_START, train_end=TRAIN_END, history_start=TRAIN_START),
    anomaly=AnomalyConfig(start=TRAIN_START),
    risk=RiskConfig(volume=VOLUME),
    report=ReportConfig(start=REPORT_START, triage_budget=TRIAGE_BUDGET),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by nation and day.

    Lines meet supplier and are summed by nation key at once; names are joined to the sums. The
    aggregate's partial sums run before its shuffle, so a nation with most of the lines costs no
    more than its days. No join carries a hint: supplier is broadcast only under the size
    threshold, and a sort-merge join beyond it has its hot keys split by adaptive execution.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08)).alias("severe"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country_region"))
    sums = (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "date")
        .agg(
            F.sum("quantity").alias("confirmed"),
            F.sum(F.when(F.col("severe"), F.col("quantity")).otherwise(F.lit(0))).cast("bigint").alias("deaths"),
        )
    )
    return sums.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "country_region", "date", "confirmed", "deaths"
    )


def as_fact(increments: DataFrame) -> DataFrame:
    """Daily increments to the long cumulative fact, in one pass."""
    frame = Window.partitionBy("country_region").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    correction = F.when(F.dayofmonth("date") == 13, F.lit(500)).otherwise(F.lit(0))
    running = increments.select(
        "country_region",
        "date",
        (F.sum("confirmed").over(frame) - correction).cast("bigint").alias("Confirmed"),
        F.sum("deaths").over(frame).cast("bigint").alias("Deaths"),
    )
    return running.unpivot(["country_region", "date"], ["Confirmed", "Deaths"], "case_type", "cases")


def panel_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_fact(panel_increments(spark, sf_dir))


def late_rows():
    """About one row in two hundred, which arrives after the others."""
    return F.pmod(F.crc32(F.concat("country_region", F.lit("late"), F.col("date").cast("string"))), F.lit(211)) == 7


def wrong_rows():
    """About one row in two hundred, first reported wrong, in the last months of three series."""
    return F.col("country_region").isin("NATION_3", "NATION_7", "NATION_20") & (F.col("date") >= "1998-06-01") & (F.dayofmonth("date") == 9)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the nation and market segment of their customer."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "events")
        .select("user_id", F.to_date("ts").alias("date"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
        .join(customer, F.col("user_id") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("place"), F.col("c_mktsegment").alias("segment"), "date", "event_type", "value")
    )


def _total(event_type: str):
    return F.sum(F.when(F.col("event_type") == event_type, F.col("value"))).cast("double")


def mobility_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country rows and rows by sub-region (the market segment), as one grouping-sets aggregate."""
    measures = {
        "retail_and_recreation": "view",
        "grocery_and_pharmacy": "click",
        "transit_stations": "signup",
        "workplaces": "purchase",
        "residential": "error",
    }
    place, date, segment = F.col("place"), F.col("date"), F.col("segment")
    sets = [[place, date], [place, date, segment]]
    return (
        event_rows(spark, sf_dir)
        .groupingSets(sets, place, date, segment)
        .agg(*[_total(kind).alias(name) for name, kind in measures.items()])
        .select(F.col("place").alias("country_region"), F.col("segment").alias("sub_region_1"), "date", *measures)
    )


def vaccination_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative event counts by nation and day; coverage is unknown on days without a purchase."""
    frame = Window.partitionBy("location").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = event_rows(spark, sf_dir).groupBy(F.col("place").alias("location"), "date").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "purchase").alias("bought"),
        F.count_if(F.col("event_type") == "signup").alias("joined"),
        F.sum("value").cast("double").alias("new_vaccinations_smoothed"),
    )
    total, bought, joined = (F.sum(c).over(frame) for c in ("events", "bought", "joined"))

    def share(part):
        return F.when(F.col("bought") > 0, part.cast("double") * F.lit(100.0) / total.cast("double"))

    return days.select(
        "location",
        "date",
        total.alias("total_vaccinations"),
        bought.alias("people_vaccinated"),
        joined.alias("people_fully_vaccinated"),
        "new_vaccinations_smoothed",
        share(bought).alias("people_vaccinated_per_hundred"),
        share(joined).alias("people_fully_vaccinated_per_hundred"),
    )


def vaccinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_vaccinations(vaccination_source(spark, sf_dir), variants=VARIANTS, tracked=None)


def mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_mobility(mobility_source(spark, sf_dir), tracked=None)


def folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or the warehouse where a session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return run_folder(spark, named or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages")


def stages(spark: SparkSession, sf_dir: str, cut: tuple = ()) -> PanelStages:
    """Stages whose cuts go to a folder of their own."""
    root = folder(spark) if cut else None
    return PanelStages(
        panel_fact(spark, sf_dir),
        CONFIG,
        vaccinations=lambda: vaccinations(spark, sf_dir),
        mobility=lambda: mobility(spark, sf_dir),
        root=root,
        cut=cut,
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses made from conversation texts, one shape per role."""
    fence = "`" * 3
    text = F.coalesce("text", F.lit(""))
    shaped = (
        F.when(
            F.col("role") == "user",
            F.concat(F.lit(f"Let me look.\n{fence}sql\nSELECT "), text, F.lit(f"\n{fence}\nDone.")),
        )
        .when(F.col("role") == "assistant", F.concat(F.lit(f"{fence}\nselect 1 -- "), text, F.lit(f"{fence} ok")))
        .otherwise(F.concat(F.lit(f"{fence}sql\nDROP TABLE x; "), text, F.lit(fence)))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", shaped.alias("response"))
