"""What several corpus operators share: tables, written stages, key sieves, lower-casing, texts of a batch."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words between ASCII white space, as a regular expression of Spark and of DuckDB.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
# Runs of digits, lower-case letters and everything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# A key sieve holds 2**25 bits, in at most 1,024 rows of 4 KB: a bound that no input changes.
SIEVE_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


class Texts:
    """A text column of an Arrow batch as UTF-8 bytes, null as empty; one text is a Python object at a time."""

    def __init__(self, column: pa.Array):
        self.column = column.cast(pa.binary())

    def __len__(self) -> int:
        return len(self.column)

    def __iter__(self) -> Iterator[bytes]:
        for text in self.column:
            yield text.as_py() or b""

    def groups(self, size: int) -> Iterator[tuple[int, list[bytes]]]:
        """The texts in groups of about ``size`` bytes, one text at least, with the number of the first row."""
        start, total, group = 0, 0, []
        for text in self:
            if group and total + len(text) > size:
                yield start, group
                start, total, group = start + len(group), 0, []
            group.append(text)
            total += len(text)
        if group:
            yield start, group


def stage_folder(spark: SparkSession) -> str:
    """A fresh folder every executor reaches: below ``spark.checkpoint.dir``, else below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Its consumers share one computation, a lost executor repeats nothing before it, and the optimizer
    knows the size of what it joins. The folder goes when the application ends.
    """
    spark, folder = df.sparkSession, stage_folder(df.sparkSession)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def sieve(frame: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """``frame`` with a column ``_maybe``, false only where ``key`` is not among ``keys``.

    The keys are hashed into a bit table of fixed size, which is broadcast, so that rows without a
    partner skip the shuffle of the join that follows. A full table only lets more rows through.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)) + 1
    bits = (
        keys.select(slot(of).alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    byte = F.expr("conv(hex(substring(_bits, int(bitmap_bit_position(_slot) div 8) + 1, 1)), 16, 10)").cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(_slot) % 8))")) != 0, F.lit(False))
    columns = frame.columns
    probed = frame.withColumn("_slot", slot(key)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    return probed.join(F.broadcast(bits), "_bucket", "left").select(*[F.col(f"`{c}`") for c in columns], hit.alias("_maybe"))


def without_ids(docs: DataFrame, dropped: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped``; ids may be null. Only rows the sieve marks are shuffled."""
    dropped = written(dropped.select(F.col(column).alias("_dropped")).distinct())
    marked = sieve(docs, F.col(column), dropped, F.col("_dropped"))
    sure = marked.filter(~F.col("_maybe")).drop("_maybe")
    rest = marked.filter("_maybe").join(dropped, F.col(column).eqNullSafe(F.col("_dropped")), "left_anti")
    return sure.unionByName(rest.drop("_maybe"))
