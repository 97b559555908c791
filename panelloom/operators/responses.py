"""Generated text that is paid for once: answers kept under a digest of their prompt."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelloom.operators.text import batch_generate, offline_generator
from panelloom.sources.sinks import path_exists, remove_folder, run_folder, write_table

ANSWERS = "model string, key string, output string, error string, asked_at timestamp, run string"


class ResponseStore:
    """Answers of a text service as Parquet below ``root``, one sub-folder for each run.

    An answer belongs to a model name and the SHA-256 of a prompt. ``generate`` asks only for prompts that
    have no answer yet, each different prompt once however many rows hold it, and appends what comes back, so
    that neither a rerun nor a second job repeats a call. Failed calls are kept with their message and
    asked again next time. ``root`` must be a folder that all executors reach.
    """

    def __init__(self, root: str, model: str = "offline"):
        self.root, self.model = root.rstrip("/"), model

    def rows(self, spark: SparkSession) -> DataFrame:
        """Everything stored, failed calls and answers of other models too."""
        if not path_exists(spark, self.root):
            return spark.createDataFrame([], ANSWERS)
        return spark.read.schema(ANSWERS).parquet(self.root)

    def answers(self, spark: SparkSession) -> DataFrame:
        """``(key, output, error)``, one row per prompt: its first answer, or the last failure where there is none.

        Two jobs that asked at the same time, or a compaction that was cut off, may leave a key twice.
        """
        good = F.col("error").isNull()
        micros = F.unix_micros("asked_at")
        newest = F.struct(good, F.when(good, -micros).otherwise(micros), "run", "output")
        own = self.rows(spark).filter(F.col("model") == self.model)
        return own.groupBy("key").agg(F.max_by(F.struct("output", "error"), newest).alias("__a")).select("key", "__a.*")

    def missing(self, prompts: DataFrame) -> DataFrame:
        """``(key, prompt)`` rows without an answer, each key once."""
        asked = prompts.filter("prompt IS NOT NULL").groupBy("key").agg(F.any_value("prompt").alias("prompt"))
        answered = self.answers(prompts.sparkSession).filter("error IS NULL").select("key")
        return asked.join(answered, "key", "left_anti")

    def generate(
        self,
        df: DataFrame,
        prompt_column: str,
        output: str,
        generator=offline_generator,
        parallelism: int | None = None,
        error: str = "error",
        waves: int = 1,
        run: str | None = None,
    ) -> DataFrame:
        """``df`` with ``output`` and ``error`` from the store, after asking for what it lacks.

        Asking happens here and now, unlike in ``batch_generate``; the returned frame only reads. Calls of a
        task are kept when the task ends, and visible when its job ends: a lost executor costs the calls of its
        unfinished tasks. ``waves`` cuts the missing prompts into that many jobs, so that a driver that dies
        loses one wave at most. ``run`` names the sub-folder, by default a fresh one.
        """
        spark, run = df.sparkSession, run or uuid.uuid4().hex
        keyed = df.withColumn("__key", prompt_key(prompt_column))
        missing = self.missing(keyed.select(F.col("__key").alias("key"), F.col(prompt_column).alias("prompt")))
        own = None
        if waves > 1:
            own = run_folder(spark, f"{self.root}-pending")
            missing = write_table(missing, own)
        for wave in range(waves):
            part = missing.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave) if waves > 1 else missing
            asked = batch_generate(part, "prompt", "output", generator, parallelism).drop("prompt")
            kept = asked.select(F.lit(self.model).alias("model"), "key", "output", "error", F.current_timestamp().alias("asked_at"))
            kept.write.mode("append").parquet(f"{self.root}/run={run}")
        if own:
            remove_folder(spark, own)
        got = self.answers(spark).select(F.col("key").alias("__key"), F.col("output").alias(output), F.col("error").alias(error))
        return keyed.join(got, "__key", "left").drop("__key")

    def calls(self, spark: SparkSession) -> DataFrame:
        """How many prompts each run asked for, and how many of them failed."""
        return self.rows(spark).groupBy("run").agg(
            F.count(F.lit(1)).alias("n_calls"), F.count("error").alias("n_failed")
        )

    def compact(self, spark: SparkSession) -> None:
        """One answer per model and key in one new run; the runs it replaces are removed after it is written."""
        rows = self.rows(spark)
        old = [r["run"] for r in rows.select("run").distinct().collect()]
        good = F.col("error").isNull()
        first = Window.partitionBy("model", "key").orderBy(good.desc(), F.when(good, F.unix_micros("asked_at")), F.desc("asked_at"), "run")
        best = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "run")
        best.write.parquet(f"{self.root}/run={uuid.uuid4().hex}")
        for run in old:
            remove_folder(spark, f"{self.root}/run={run}")


def prompt_key(prompt: str) -> Column:
    """Digest of a prompt; NULL for a NULL prompt, which is never asked."""
    return F.sha2(F.col(prompt).cast("string"), 256)
