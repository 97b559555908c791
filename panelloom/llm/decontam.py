"""Benchmark decontamination by winnowing, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.llm.common import PLAIN_WORD, ascii_lower, sieve, written


# The words of PLAIN_WORD before they are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Files of the benchmark's tables, which are small beside the documents.
FILES = 8


@dataclass(frozen=True)
class WinnowConfig:
    span: int = 10  # words of a window: every shared span of so many words is found
    gram: int = 5  # words of a fingerprint; a winnowing window holds span - gram + 1 of them


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def _grams(n: int, size: Column) -> Column:
    """Hashes of every n words in a row of the word hashes ``_h``."""
    at = lambda i: F.xxhash64(F.lit(n), *[F.get("_h", i + j) for j in range(n)])
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), at)).otherwise(F.array().cast("array<bigint>"))


def _marked(grams: Column) -> Column:
    """Structs of hash and place of a list of gram hashes."""
    return F.transform(grams, lambda g, i: F.struct(g.alias("fp"), i.alias("at")))


def _coarse(text: Column) -> Column:
    """Hashes of the words for fingerprints, each lower-cased by itself.

    Lower-casing a word fully is faster than A-Z alone and only merges more: what it gives depends on the word's own
    letters, so words that are equal but for A-Z stay equal. Over a whole text it would not: a final sigma
    looks at what stands beyond the word.
    """
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_CASE), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def fingerprints(texts: DataFrame, config: WinnowConfig, short: list[int], whole: bool) -> DataFrame:
    """``(key, id, text)`` to ``(key, id, n, fp, at)``: the winnowed grams of each text and their places.

    Each text also gives one row with its number of words and ``at`` = -1, which stands for no gram.

    A gram is kept if it is the smallest of some window of ``span - gram + 1`` grams, the leftmost among equal
    ones. Two texts that share ``span`` words share such a window and so its smallest gram. ``short`` lists
    word counts below the span: with ``whole`` a text of so many words is one fingerprint, else every run
    of so many words is one.
    """
    wide = config.span - config.gram + 1
    size = F.size("_h")
    hashed = texts.select("key", "id", _coarse(F.col("text")).alias("_h"))
    grams = hashed.select("key", "id", "_h", size.alias("n"), _grams(config.gram, size).alias("_g"))
    none = F.array().cast("array<struct<fp:bigint,at:int>>")
    lows = F.when(
        F.size("_g") >= wide,
        F.transform(F.sequence(F.lit(1), F.size("_g") - wide + 1), lambda i: F.array_min(F.slice("_g", i, wide))),
    ).otherwise(F.array().cast("array<bigint>"))
    lowest = grams.select("key", "id", "_h", "n", "_g", lows.alias("_low"))

    # The leftmost smallest gram of a window is new if the minimum changed or the one before has left.
    def new(i: Column) -> Column:
        return (i == 0) | (F.get("_low", i) != F.get("_low", i - 1)) | (F.get("_g", i - 1) == F.get("_low", i - 1))

    def placed(i: Column) -> Column:
        low = F.get("_low", i)
        inside = F.array_position(F.slice("_g", i + 1, wide), low).cast("int")
        return F.struct(low.alias("fp"), (i + inside - 1).alias("at"))

    windows = F.when(F.size("_low") > 0, F.sequence(F.lit(0), F.size("_low") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.filter(windows, new), placed)
    lists = [kept]
    for n in short:
        list_of = _marked(_grams(n, size))
        lists.append(F.when(F.col("n") == n, list_of).otherwise(none) if whole else list_of)
    # Its fp is the row's key, so that these rows spread like the others wherever they are shuffled.
    every = F.concat(F.array(F.struct(F.col("key").alias("fp"), F.lit(-1).alias("at"))), *lists)
    # An outer explode: for an inner one the optimizer infers a filter and computes the whole list in it again.
    spread = lowest.select("key", "id", "n", every.alias("_fps")).select("key", "id", "n", F.explode_outer("_fps").alias("_fp"))
    return spread.select("key", "id", "n", "_fp.*")


def contamination(docs: DataFrame, items: DataFrame, config: WinnowConfig = WinnowConfig()) -> DataFrame:
    """``(doc_id, text)`` against ``(item_id, text)``: n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``span`` words in a row of an item, or the whole of a shorter item; a document word inside
    an occurrence of a window is hit. Different fingerprints of both sides are joined; each hit extends to the windows
    around it, whose words are compared with the items' windows, and items are looked up for the windows
    that agree. So a fingerprint that many documents and many items share costs their sum, not their
    product. Only documents with a hit are read again with their words.

    Null and empty texts have no words. Items without words hit nothing. A null item_id is listed as an
    empty string; items that repeat an id count once. Rows that repeat a doc_id are judged by their own
    texts. Without items, or documents, nothing is hit. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text", F.octet_length("text")))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    # Equal texts of one id are one item; the number of an item is fixed by writing it, in a few files.
    items = items.filter(F.size("words") > 0).distinct().coalesce(FILES).withColumn("key", F.monotonically_increasing_id())
    items = written(items)
    # At most span - 1 numbers.
    short = [r[0] for r in items.filter(F.size("words") < config.span).select(F.size("words")).distinct().collect()]
    prints = fingerprints(items.select("key", F.col("item").alias("id"), F.array_join("words", " ").alias("text")), config, sorted(short), True)
    # A print stands once, however many items share it: which items a window belongs to is looked up last.
    prints = prints.filter("at >= 0").select(F.col("fp").alias("item_fp"), F.least("n", F.lit(config.span)).alias("n")).distinct()
    prints = written(prints.coalesce(FILES))
    found = fingerprints(docs.select("key", F.col("doc_id").alias("id"), "text"), config, sorted(short), False)
    pairs = found.withColumnRenamed("n", "n_words").join(prints, (F.col("fp") == F.col("item_fp")) & (F.col("at") >= 0), "left")
    met = pairs.filter("at = -1 OR n IS NOT NULL")
    met = written(met.select("key", "id", "n_words", "at", "n"))
    counted = met.filter("at = -1").select("key", F.col("id").alias("doc_id"), F.col("n_words").cast("bigint").alias("n_words"))
    hits = met.filter("at >= 0").select("key", "at", "n").distinct()

    # Every hit extends to the windows that hold it; their words are compared as they stand.
    lying = hits.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("_hits"))
    again = sieve(docs, F.col("key"), hits, F.col("key")).filter("_maybe")
    worded = again.select("key", words(F.col("text")).alias("_w")).join(lying, "key")
    reach = config.span - config.gram

    def starts(hit: Column) -> Column:
        first = F.when(hit["n"] < config.span, hit["at"]).otherwise(F.greatest(hit["at"] - reach, F.lit(0)))
        last = F.when(hit["n"] < config.span, hit["at"]).otherwise(F.least(hit["at"], F.size("_w") - config.span))
        inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(inside, lambda i: F.struct(i.alias("start"), hit["n"].alias("n")))

    windows = F.array_distinct(F.flatten(F.transform("_hits", starts)))
    window = lambda words_, start, n: F.array_join(F.slice(words_, start + 1, n), " ")
    listed = F.transform(windows, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), window(F.col("_w"), x["start"], x["n"]).alias("window")))
    laid = worded.select("key", F.explode(listed).alias("_x")).select("key", "_x.*")
    least = F.least(F.lit(config.span), F.size("words"))
    parts = F.transform(F.sequence(F.lit(0), F.size("words") - least), lambda i: window(F.col("words"), i, least))
    wanted = items.select("item", least.alias("n"), F.explode(F.array_distinct(parts)).alias("window")).distinct()
    wanted = written(wanted.coalesce(FILES))
    runs = written(laid.join(wanted.select("n", "window").distinct(), ["n", "window"], "left_semi"))
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    places = runs.select("key", covered.alias("_place")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = runs.select("key", "n", "window").distinct().join(wanted, ["n", "window"]).select("key", "item").distinct()
    verdicts = places.join(named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("_items")), "key")
    out = counted.join(verdicts, "key", "left")
    return out.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("_items", F.array().cast("array<string>"))).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
