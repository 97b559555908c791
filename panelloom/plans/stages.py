"""The chain of stages from raw facts to published tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from panelloom import schemas
from panelloom.config import PanelConfig
from panelloom.operators import anomaly, context, features, forecast, ingest, risk, text, windows
from panelloom.sources.sinks import (
    clustered,
    create_namespaces,
    publish_version,
    remove_folder,
    run_folder,
    write_catalog_table,
    write_clustered,
    write_table,
)

# Published tables and their namespaces.
TABLES = {
    "combined": "raw",
    "daily": "raw",
    "vaccinations": "raw",
    "mobility": "raw",
    "features": "features",
    "forecasts": "ml",
    "forecast_metrics": "ml",
    "history_forecast": "ml",
    "anomalies": "ml",
    "risk_tiers": "analytics",
    "context": "analytics",
    "narratives": "analytics",
    "anomaly_explanations": "analytics",
    "global_triage": "analytics",
    "policy_simulations": "analytics",
}

# The one measure that the forecast stages read.
AVERAGES = "rolling_avg_7d_cases"

# Tables with one row per series and day whose rows arrive partitioned by series.
BUCKETED = ("combined", "daily", "averages", "features", "anomalies")


class PanelStages:
    """Lazy stages over one raw fact.

    A stage listed in ``cut`` is written as Parquet when it is first needed and read back, so that
    its consumers share one computation, prune columns at the scan and do not replay the lineage
    after a lost executor. The optional sources may be given as functions, called when a stage needs
    them. Cuts go under ``root``, by default a fresh folder below the session's
    ``spark.checkpoint.dir``; without either, the first cut raises. A folder made here is removed by
    ``close()``, at the end of a ``with`` block, or when the application ends; a given root stays.
    ``parallelism`` bounds the concurrent clients of every text stage. With a ``ResponseStore`` as
    ``responses`` these stages ask for a prompt once, whatever is built again.

    With ``ranged`` the series-and-day tables are written in ranges of series and day, so that reports on a
    few series or days skip most of their row groups; it costs a shuffle for each such table.

    With ``buckets`` cuts become catalog tables instead, in one database per namespace (names start
    with ``database_prefix``). The series-and-day tables are bucketed by series: the panel is
    shuffled by series once, and the windows of every later stage read it without a shuffle. With ``versions``
    a name is a view of the newest complete version of its table, so a run that fails leaves the last one readable.
    """

    def __init__(
        self,
        fact: DataFrame,
        config: PanelConfig = PanelConfig(),
        vaccinations: DataFrame | Callable[[], DataFrame] | None = None,
        mobility: DataFrame | Callable[[], DataFrame] | None = None,
        root: str | None = None,
        cut: tuple | frozenset = (),
        generator=text.offline_generator,
        generated_at=None,
        buckets: int = 0,
        database_prefix: str = "",
        parallelism: int | None = None,
        responses=None,
        ranged: bool = False,
        versions: bool = False,
    ):
        self.spark = fact.sparkSession
        self.fact, self.config = fact, config
        self._vaccinations, self._mobility = vaccinations, mobility
        self._root, self._own, self.cut = root, None, frozenset(cut)
        self.parallelism, self.responses = parallelism, responses
        self.ranged, self.versions = ranged, versions
        self.generator, self.generated_at = generator, generated_at
        self.buckets, self.database_prefix = buckets, database_prefix
        self._done: dict[str, DataFrame] = {}
        self._stored: set[str] = set()
        if buckets:
            create_namespaces(self.spark, database_prefix)

    def _stage(self, name: str, build) -> DataFrame:
        if name not in self._done:
            df = build()
            if name in self.cut:
                df = self._written(name, df)
                self._stored.add(name)
            self._done[name] = df
        return self._done[name]

    def _folder(self) -> str:
        if self._root is None:
            self._root = self._own = run_folder(self.spark)
        return self._root

    def _work(self, name: str) -> str:
        """A fresh folder for what an operator writes on its way; it goes with the application."""
        return run_folder(self.spark, f"{self._folder()}/_work/{name}")

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        namespace = TABLES.get(name, "features")
        if self.buckets:
            table = f"{self.database_prefix}{namespace}.{name}"
            key = self.config.columns.series if name in BUCKETED else None
            write = publish_version if self.versions else write_catalog_table
            return write(df, table, key, self.buckets)
        path = f"{self._folder()}/{namespace}/{name}"
        if self.ranged and name in BUCKETED:
            return write_clustered(df, path, self.config.columns.series, self.config.columns.ts)
        return write_table(df, path)

    def close(self) -> None:
        """Remove the folder this object made; frames that read from it end with it."""
        if self._own is not None:
            remove_folder(self.spark, self._own)
            self._root = self._own = None
        self._done.clear()
        self._stored.clear()

    def __enter__(self) -> PanelStages:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _optional(self, source, declared) -> DataFrame:
        if source is None:
            return self.spark.createDataFrame([], schemas.keyed(declared, self.config.columns))
        return source() if callable(source) else source

    def combined(self) -> DataFrame:
        c = self.config

        def build() -> DataFrame:
            panel = ingest.combine(self.fact, c.ingest, c.columns)
            return clustered(panel, c.columns.series, self.buckets) if self.buckets else panel

        return self._stage("combined", build)

    def daily(self) -> DataFrame:
        return self._stage("daily", lambda: ingest.daily_delta(self.combined(), self.config.columns))

    def vaccinations(self) -> DataFrame:
        return self._stage("vaccinations", lambda: self._optional(self._vaccinations, schemas.VACCINATIONS))

    def mobility(self) -> DataFrame:
        return self._stage("mobility", lambda: self._optional(self._mobility, schemas.MOBILITY))

    def features(self) -> DataFrame:
        c = self.config
        return self._stage("features", lambda: features.feature_store(self.daily(), c.features, c.endemic, c.columns))

    def averages(self) -> DataFrame:
        """Series, date and 7-row average: all that fitting, evaluating and drawing a forecast reads.

        Three columns of the feature store where that is written, else computed from the daily panel alone.
        """
        c = self.config.columns
        if "features" in self.cut or "features" in self._stored:
            return self.features().select(c.series, c.ts, AVERAGES)

        def build() -> DataFrame:
            rolled = windows.rolling_avg(self.daily(), "daily_new_cases", {AVERAGES: self.config.features.week}, c)
            return rolled.select(c.series, c.ts, AVERAGES)

        return self._stage("averages", build)

    def training(self) -> DataFrame:
        return forecast.training_view(self.averages(), self.config.forecast, self.config.columns)

    def model(self) -> DataFrame:
        return forecast.fit_forecaster(self.training(), self.config.forecast, self.config.columns)

    def forecasts(self) -> DataFrame:
        c = self.config
        return self._stage("forecasts", lambda: forecast.forecast(self.model(), c.forecast, c.columns))

    def overlap(self) -> DataFrame:
        return forecast.overlap(self.averages(), self.forecasts(), self.config.columns)

    def forecast_metrics(self) -> DataFrame:
        c = self.config

        def build() -> DataFrame:
            pairs = forecast.backtest(self.training(), c.forecast, c.columns) if c.forecast.backtest else self.overlap()
            return forecast.forecast_metrics(pairs, c.forecast, c.columns)

        return self._stage("forecast_metrics", build)

    def history_forecast(self) -> DataFrame:
        c = self.config
        return self._stage(
            "history_forecast",
            lambda: forecast.history_forecast(self.averages(), self.forecasts(), c.forecast, c.columns),
        )

    def anomalies(self) -> DataFrame:
        c = self.config
        return self._stage("anomalies", lambda: anomaly.zscore_anomalies(self.daily(), c.anomaly, c.columns))

    def risk_tiers(self) -> DataFrame:
        c = self.config
        return self._stage(
            "risk_tiers",
            lambda: risk.risk_tiers(
                self.features(), self.forecasts(), self.anomalies(), self.mobility(), c.risk, c.columns
            ),
        )

    def context(self) -> DataFrame:
        c = self.config
        return self._stage(
            "context",
            lambda: context.context_view(
                self.features(), self.risk_tiers(), self.forecasts(), self.forecast_metrics(),
                self.anomalies(), c.risk, c.columns,
            ),
        )

    def narratives(self) -> DataFrame:
        return self._stage(
            "narratives",
            lambda: text.narratives(
                self.context(), self.generated_at, self.generator, self.config.columns, self.parallelism,
                self.responses,
            ),
        )

    def anomaly_explanations(self) -> DataFrame:
        c = self.config
        return self._stage(
            "anomaly_explanations",
            lambda: text.anomaly_explanations(
                self.anomalies(), c.report.explain_per_series, self.generator, c.columns, self.parallelism,
                self.responses,
            ),
        )

    def global_triage(self) -> DataFrame:
        return self._stage(
            "global_triage",
            lambda: text.global_triage(
                self.risk_tiers(), self._work("triage"), self.generated_at, self.generator,
                self.config.report.triage_budget, self.config.columns, self.parallelism, self.responses,
            ),
        )

    def policy_simulations(self) -> DataFrame:
        return self._stage(
            "policy_simulations",
            lambda: text.policy_simulations(
                self.context(), self.generated_at, self.generator, self.config.columns, self.parallelism,
                self.responses,
            ),
        )

    def register_views(self, prefix: str = "") -> None:
        """Temporary views over the lazy training, anomaly-input and context stages."""
        c = self.config
        self.training().createOrReplaceTempView(f"{prefix}forecast_training")
        anomaly.anomaly_input(self.daily(), c.anomaly, c.columns).createOrReplaceTempView(f"{prefix}anomaly_input")
        self.context().createOrReplaceTempView(f"{prefix}context_view")

    def store_views(self, database_prefix: str = "") -> list[str]:
        """Views of the same three tables in the catalog, in SQL over written stages; any session may read them.

        The stages they stand on are written now if they are not yet: to tables of the catalog with
        ``buckets``, else to Parquet below ``root``, which the views name by path. Storing them again points
        them at the stages of today. Returns their names, in database ``analytics``.
        """
        c = self.config
        series, ts = c.columns.series, c.columns.ts
        create_namespaces(self.spark, database_prefix)
        # Averages that are columns of written features are read from there.
        average = "features" if "features" in self.cut or "features" in self._stored else "averages"
        at = {}
        for stage in (average, "daily", "context"):
            df = getattr(self, stage)()
            if stage not in self._stored:
                self._done[stage] = self._written(stage, df)
                self._stored.add(stage)
            namespace = TABLES.get(stage, "features")
            path = f"parquet.`{self._folder()}/{namespace}/{stage}`" if not self.buckets else None
            at[stage] = path or f"{self.database_prefix}{namespace}.{stage}"
        f, a = c.forecast, c.anomaly
        views = {
            "forecast_training": f"SELECT {series}, {ts}, {AVERAGES} AS target FROM {at[average]} WHERE {ts} BETWEEN "
            f"DATE '{f.train_start}' AND DATE '{f.train_end}' AND {AVERAGES} IS NOT NULL",
            "anomaly_input": f"SELECT {series}, {ts}, daily_new_cases FROM {at['daily']} WHERE {ts} >= DATE '{a.start}' "
            "AND daily_new_cases IS NOT NULL",
            "context_view": f"SELECT * FROM {at['context']}",
        }
        for name, sql in views.items():
            self.spark.sql(f"CREATE OR REPLACE VIEW {database_prefix}analytics.{name} AS {sql}")
        return [f"{database_prefix}analytics.{name}" for name in views]

    def publish(self) -> dict[str, DataFrame]:
        """Write every table under its namespace, each stage reading the one written before it.

        Stages that were built lazily before are built again on the written ones.
        """
        self.cut = frozenset(TABLES)
        self._done = {name: df for name, df in self._done.items() if name in self._stored}
        return {name: getattr(self, name)() for name in TABLES}
