"""The corpus pipeline: five stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelloom.llm import decontam, exact, mixing, near, toxicity
from panelloom.llm.common import sieve, table, without_ids, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def row_key(digest: Column) -> Column:
    """What tells rows apart when an operator's verdict goes back to them: the id, which may be null, and the text.

    Verdicts depend on nothing else, so rows that share the key share the verdict; a null text is empty.
    """
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject; the labels of the given documents train it.

    Every row is judged by its own text, whatever its id. Labels of null ids train nothing.
    """
    scored = toxicity.scored(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id.

    A row with a null id goes if another id has its text; a text under null ids only keeps its rows, and
    so do rows that repeat both id and text, which are one document. Other texts of a dropped row's id stay.
    """
    dropped = exact.exact_groups(docs, keep="max").filter("NOT kept").select(row_key(F.col("text_sha256")).alias("_row"))
    return without_ids(docs.select(*COLUMNS, row_key(text_digest()).alias("_row")), dropped, "_row").drop("_row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Null and repeated ids as for copies: each row goes or stays by its own text, repeats of id and text alike.
    Different texts of the smallest id of one group all stay, as they do in the operator.
    """
    docs = docs.select(*COLUMNS, row_key(text_digest()).alias("_row"))
    dropped = near.near_groups(docs, row="_row").filter("NOT kept")
    return without_ids(docs, dropped, "_row").drop("_row")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; each row is judged by its text alone, whatever its id."""
    docs = docs.select(*COLUMNS, text_digest().alias("_row"))
    found = decontam.contamination(docs.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    dropped = found.filter("contaminated").select(F.col("doc_id").alias("_row"))
    return without_ids(docs, dropped, "_row").drop("_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with how often each is taken and its place in the queue, in queue order.

    Every row stands in the queue by itself, rows of null or repeated ids too, and comes out once at most.
    The mix goes back to the rows by all their columns: of rows equal in all of them one is kept for the
    join, which then gives one row for each of them in the mix.
    """
    others = F.to_json(F.struct("lang", "source", "n_chars"))
    docs = docs.select(*COLUMNS, F.concat_ws(":", row_key(text_digest()), others).alias("_row"))
    mixed = written(mixing.mix(mixing.measured(docs, "_row"), row="_row").filter("copies > 0").select("_row", "copies", "taken", "finish"))
    repeated = written(mixed.groupBy("_row").count().filter("count > 1").select("_row"))
    marked = sieve(docs, F.col("_row"), repeated, F.col("_row"))
    single = marked.filter(~F.col("_maybe")).unionByName(marked.filter("_maybe").dropDuplicates(["_row"])).drop("_maybe")
    joined = single.join(mixed, "_row").drop("_row")
    return joined.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

# The model of the first stage and the sketches of the third are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
