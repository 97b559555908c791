"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/check_oracle.py SF_DIR [name ...]

Extra session settings: CHECK_CONF="spark.sql.autoBroadcastJoinThreshold=-1 spark.sql.shuffle.partitions=31"
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, datetime.datetime):
        return x.date().isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(value(r[i]) for i in order) for r in map(tuple, rows)], key=repr)


def compare(df, connection, sql):
    """None when equal, else a message."""
    ours = normal(df.columns, df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = normal(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        a, b = different[0]
        cells = [(c, x, y) for c, x, y in zip(sorted(names), a, b) if x != y]
        return f"{len(different)} rows differ, first {cells[:4]}"
    return None if ours else "empty"


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(pair.split("=", 1) for pair in os.environ.get("CHECK_CONF", "").split())
    spark = SparkSession.builder.master("local[8]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            message = compare(df, connection, sqls[name]) if name in sqls else f"no sql, {len(df.collect())} rows"
        except Exception as err:  # report and go on
            message = f"ERROR {str(err)[:600]}"
        bad += bool(message) and not str(message).startswith("no sql")
        print(f"{time.time() - start:6.2f} {name}: {message or 'ok'}", flush=True)
    missing = set(sqls) - set(entry.queries())
    print("bad", bad, "sql without query", missing)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
