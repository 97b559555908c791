"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.llm.common import SPACED_WORD, written


@dataclass(frozen=True)
class MixConfig:
    weights: tuple = (3, 1, 2)  # dealt to the sources in order of their names, repeating; null comes last
    budget: tuple = (3, 2)  # the mix holds 3/2 of all words
    epochs: int = 2  # a document is taken so many times at most
    seed: str = "mix"
    digits: int = 3  # hex digits of the shuffle key that cut each source into 16**3 slices
    ranges: int = 65536  # equal ranges of virtual time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``, one row per source.

    Sources share the budget by weight; none gets more than ``epochs`` times its size. With the sources
    ordered by size for their weight, those below the water level take their most and the others share
    what is left, which is where repeated resharing ends. The windows hold one narrow row per source.
    """
    up, down = config.budget
    weights = F.array(*[F.lit(w).cast("bigint") for w in config.weights])
    names = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    fuller = Window.orderBy(F.col("source_size") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("source_size") * config.epochs
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(names) - 1)
        .withColumn("_weight", F.element_at(weights, F.pmod("_rank", F.lit(len(config.weights))).cast("int") + 1))
        .withColumn("_left", F.sum("source_size").over(everything) * up - F.coalesce(F.sum(most).over(fuller), F.lit(0)) * down)
        .withColumn("_sharing", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(fuller), F.lit(0)))
        .withColumn("_full", F.col("_weight") * F.col("_left") >= most * down * F.col("_sharing"))
    )
    # What is left shrinks along the order, so its largest value among sources not full is the level's.
    left = F.max(F.when(~F.col("_full"), F.col("_left"))).over(everything)
    sharing = F.max(F.when(~F.col("_full"), F.col("_sharing"))).over(everything)
    share = (F.col("_weight") * left).cast("double") / (sharing * down).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("_full"), most.cast("double")).otherwise(share).alias("target"))


def paced(docs: DataFrame, config: MixConfig = MixConfig(), row: str | None = None) -> DataFrame:
    """``(doc_id, source, size)`` with source_size, target and ``finish``, the virtual finish time.

    Documents of a source stand in the order of a hash of their id. The finish time is the source's words
    up to and with the document, divided by the source's target; a repeat comes ``source_size / target``
    later. Each source is cut into slices of its hash order, so that a source with a third of all rows
    is summed by many tasks: first whole slices, then the documents inside one slice. ``row`` names a column
    that orders rows of equal id and size and stays in the result. Rows without an id stand by a hash of their size,
    so that a source of such rows fills more than one slice.
    """
    rows = [row] if row else []
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("size").cast("string")))
    keyed = docs.select(
        "doc_id", "source", "size", *rows,
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
        F.substring(F.md5(F.concat(F.lit(config.seed), name)), 1, 16).alias("_key"),
    ).withColumn("_slice", F.substring("_key", 1, config.digits))
    keyed = written(keyed)
    slices = keyed.groupBy("_source", "_slice").agg(F.sum("size").alias("_words"), F.max("source").alias("source"))
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("_source", "_slice", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    sizes = slices.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.max("source").alias("source"))
    shares = source_targets(sizes.select("source", "source_size"), config).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "source_size", "target"
    )
    inside = Window.partitionBy("_source", "_slice").orderBy("_key", "doc_id", "size", *rows).rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        keyed.withColumn("_inside", F.sum("size").over(inside))
        .join(starts, ["_source", "_slice"])
        .join(shares, "_source")
        .withColumn("_end", F.col("_start") + F.col("_inside"))
    )
    return ends.select(
        "doc_id", "source", "size", *rows, "source_size", "target", "_end",
        F.when(F.col("target") > 0, F.col("_end") / F.col("target")).otherwise(0.0).alias("finish"),
    )


def mix(docs: DataFrame, config: MixConfig = MixConfig(), row: str | None = None) -> DataFrame:
    """``(doc_id, source, size)`` to one row per document with source_size, target, finish, copies, taken.

    All copies of all documents stand in one queue by finish time, which is cut at the budget: the mix is
    the longest head of the queue whose words fit. The queue is cut in two steps, first by equal ranges of
    virtual time (their sums are a table of fixed size), then inside the one range where the budget ends.
    ``copies`` tells how often a document is taken, ``taken`` its words.

    Null ids and sources count like others (a null source stands last). Documents without words take
    nothing. Rows that repeat an id with the same size are equal and are taken alike. No documents give
    no rows. Other columns are ignored, but ``row`` names one that stays in the result.
    """
    up, down = config.budget
    rows = written(paced(docs, config, row))

    def finish(epoch):
        late = (F.col("_end") + F.col("source_size") * epoch) / F.col("target")
        return F.when(F.col("target") > 0, late).otherwise(0.0)

    def span(at):
        return F.least(F.floor(at * (config.ranges // 2)), F.lit(config.ranges - 1))

    queue = rows.filter("size > 0").select(
        "size", F.explode(F.array(*[finish(e) for e in range(config.epochs)])).alias("_at")
    ).withColumn("_range", span(F.col("_at")))
    sums = queue.groupBy("_range").agg(F.sum("size").alias("_words"))
    budget = (rows.agg(F.sum("size")).first()[0] or 0) * up // down
    running = sums.withColumn("_upto", F.sum("_words").over(Window.orderBy("_range")))
    cut = running.filter(F.col("_upto") > budget).orderBy("_range").first()
    # Nothing is cut only where there are no words.
    cut_range, before = (cut["_range"], cut["_upto"] - cut["_words"]) if cut else (config.ranges, 0)
    inside = queue.filter(F.col("_range") == cut_range).withColumn("_upto", F.sum("size").over(Window.orderBy("_at")) + before)
    last = inside.filter(F.col("_upto") <= budget).agg(F.max("_at")).first()[0]
    last = -1.0 if last is None else last

    def is_in(epoch):
        at = finish(epoch)
        return ((span(at) < cut_range) | (at <= last)) & (F.col("size") > 0)

    copies = sum((is_in(e).cast("int") for e in range(config.epochs)), F.lit(0))
    return rows.select(
        "doc_id", "source", "size", *([row] if row else []), "source_size", "target", "finish", copies.alias("copies"),
        (F.col("size") * copies).cast("bigint").alias("taken"),
    )


def measured(documents: DataFrame, row: str | None = None) -> DataFrame:
    """The operator's input from documents with a text."""
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([row] if row else []))
