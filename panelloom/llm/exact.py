"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.llm.common import written

FAN_IN = 8


def text_key(text: Column) -> Column:
    """SHA-256, a second hash and the length of a text, so that a digest is never trusted alone."""
    second = F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.octet_length(text)), 16, "0"))
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(second))


def merge_run(keep: str):
    """A merge of the sorted runs of one lane into one run, batch by batch."""
    best = np.fmax if keep == "max" else np.fmin

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last key so far, which the next batch may continue
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            keys = batch["key"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ids = batch["id"].astype("Int64")
            merged = pd.DataFrame(
                {
                    "lane": batch["lane"].to_numpy()[starts],
                    "key": keys[starts],
                    # Ids stay whole numbers; the mask tells a missing one.
                    "id": pd.array(best.reduceat(ids.fillna(_none(keep)).to_numpy(np.int64), starts), dtype="Int64"),
                    "rows": np.add.reduceat(batch["rows"].to_numpy(), starts),
                }
            )
            merged["id"] = merged["id"].mask(merged["id"] == _none(keep))
            held = merged.tail(1)
            yield merged.iloc[:-1]
        if held is not None:
            yield held

    return merge


def _none(keep: str) -> int:
    """The whole number that loses against every id."""
    limits = np.iinfo(np.int64)
    return int(limits.min if keep == "max" else limits.max)


def exact_groups(docs: DataFrame, keep: str = "min", lanes: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, text)`` to one row per document: keep_id, group_size, kept, text_sha256.

    Each lane (a hash of the row) first reduces its rows to a run of distinct keys. Then lanes exchange
    runs in rounds, as in a binomial tree of ``fan_in`` branches: in round r the lanes that differ only in
    digit r of their number send each other the keys whose own digit is theirs, sort what they got and
    merge it into one run with the best id and the count of each key. After the last round a key is in one
    lane. A text held by a third of all rows is one row per lane from the start, and no lane ever gathers
    more than its share of the keys. Results go back to the rows by lane and key, which spreads such a
    text over all lanes. ``lanes`` defaults to the session's shuffle partitions.

    Texts are equal when identical; a null text is empty. ``keep`` names the id that stays, ``min`` or
    ``max``. A null id never wins over another; a group of null ids only has a null keep_id and all its
    rows stay. Rows that repeat an id with the same text are one document and share their verdict.
    No documents give no rows. Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    spark = docs.sparkSession
    wanted = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan_in**rounds < wanted:
        rounds += 1
    lanes = fan_in**rounds
    keyed = docs.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"))
    rows = written(keyed.withColumn("lane", F.pmod(F.xxhash64("doc_id", "key"), F.lit(lanes)).cast("int")))
    best = F.max if keep == "max" else F.min
    first = rows.groupBy("lane", "key").agg(best("doc_id").cast("bigint").alias("id"), F.count("*").alias("rows"))
    run = first
    for r in range(rounds):
        unit = fan_in**r
        digit = lambda c, unit=unit: (F.col(c) / unit).cast("bigint") % fan_in
        home = F.pmod(F.xxhash64("key", F.lit("lane")), F.lit(lanes)).alias("home")
        run = run.select("*", home).withColumn("lane", (F.col("lane") + (digit("home") - digit("lane")) * unit).cast("int"))
        run = run.drop("home").repartitionById(lanes, F.col("lane")).sortWithinPartitions("key")
        run = run.mapInPandas(merge_run(keep), "lane int, key binary, id bigint, rows bigint")
    groups = run.select("key", F.col("id").alias("keep_id"), F.col("rows").alias("group_size"))
    by_lane = first.select("lane", "key").join(groups, "key")
    sha = F.lower(F.hex(F.substring("key", 1, 32)))
    return rows.join(by_lane, ["lane", "key"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        sha.alias("text_sha256"),
    )
