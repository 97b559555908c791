"""Writing stages: Parquet directories grouped by namespace, or catalog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Namespaces of the published tables.
NAMESPACES = ("raw", "features", "ml", "analytics")


def create_namespaces(spark: SparkSession, prefix: str = "") -> None:
    """Catalog databases for ``write_catalog_table``; Parquet paths need none."""
    for name in NAMESPACES:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{name}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", options: dict | None = None) -> DataFrame:
    """Write Parquet and return the written table, which also cuts the lineage of ``df``.

    An overwritten table is built beside the old one and takes its place when it is complete: a build
    that fails leaves the old table as it was, and ``df`` may read the table it replaces. The change of
    names is two renames, atomic each where the file system's renames are.
    """
    spark, schema, options = df.sparkSession, df.schema, options or {}
    if mode == "overwrite" and path_exists(spark, path):
        fresh, stale = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        try:
            df.write.options(**options).parquet(fresh)
        except Exception:
            remove_folder(spark, fresh)
            raise
        rename(spark, path, stale)
        try:
            rename(spark, fresh, path)
        except Exception:
            rename(spark, stale, path)
            raise
        remove_folder(spark, stale)
        spark.catalog.refreshByPath(path)
    else:
        df.write.mode(mode).options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_clustered(df: DataFrame, path: str, *order: str, row_group: int | None = None) -> DataFrame:
    """``write_table`` with rows ranged and sorted by ``order``, so that few row groups hold any range of it.

    The statistics of files and row groups then let a scan skip the others. ``row_group`` is the size of a
    row group in bytes, by default the writer's.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(ranged, path, options={"parquet.block.size": row_group} if row_group else None)


def publish_version(
    df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0, keep: int = 1
) -> DataFrame:
    """Build a new version of a catalog table and point its name at it when it is complete.

    Versions are tables of their own (``name__v`` and a number); ``name`` is a stored view of the newest, so
    that switching is one change in the catalog, schemas may differ, and buckets stay known to whoever
    reads it. A build that fails leaves the name on the old version. ``keep`` older versions stay for readers
    that have begun; those before them are dropped.
    """
    spark = df.sparkSession
    database, _, short = name.rpartition(".")
    older = versions(spark, name)
    table = f"{name}__v{older[-1][0] + 1 if older else 1:06d}_{uuid.uuid4().hex[:8]}"
    write_catalog_table(df, table, bucket_by, buckets, mode="errorifexists")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")
    for _, stale in older[: max(len(older) - keep, 0)]:
        spark.sql(f"DROP TABLE IF EXISTS {stale}")
    return spark.table(name)


def versions(spark: SparkSession, name: str) -> list[tuple[int, str]]:
    """Numbers and full names of the versions of a published table, oldest first."""
    database, _, short = name.rpartition(".")
    listed = spark.sql(f"SHOW TABLES {f'IN {database} ' if database else ''}LIKE '{short}__v*'").collect()
    names = [(r["tableName"], f"{database}.{r['tableName']}" if database else r["tableName"]) for r in listed if not r["isTemporary"]]
    return sorted((int(table.split("__v")[-1].split("_")[0]), full) for table, full in names)


def write_catalog_table(
    df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0, mode: str = "overwrite"
) -> DataFrame:
    """Write a catalog table; bucketed by the series, later windows over it need no shuffle.

    Rows that are already hash-partitioned by ``bucket_by`` into ``buckets`` partitions give one
    file per bucket; repartition others first (``clustered``).
    """
    writer = df.write.mode(mode).format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def clustered(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Rows hash-partitioned the way a table with that many buckets stores them."""
    return df.repartition(buckets, F.col(column))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``; the same rule on every master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("writing stages needs a root, or a folder that all executors reach in spark.checkpoint.dir")
    return folder


def run_folder(spark: SparkSession, base: str | None = None) -> str:
    """A fresh sub-folder of ``base``, by default the shared folder, so that runs never overwrite each other.

    It goes when the application ends, or earlier by ``remove_folder``.
    """
    folder = f"{(base or shared_folder(spark)).rstrip('/')}/panelloom/{uuid.uuid4().hex}"
    system, path = _hadoop(spark, folder)
    system.deleteOnExit(path)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    system, path = _hadoop(spark, folder)
    system.delete(path, True)


def path_exists(spark: SparkSession, folder: str) -> bool:
    system, path = _hadoop(spark, folder)
    return system.exists(path)


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, source = _hadoop(spark, old)
    if not system.rename(source, _hadoop(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
