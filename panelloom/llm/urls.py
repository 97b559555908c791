"""URL filters: given rules, then association rules mined from labelled URLs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.llm.common import ascii_lower, written

# Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

BAD = "label=bad"


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple = RULES
    support: float = 0.01  # least share of the labelled URLs that hold a rule's tokens and are bad
    evidence: int = 25  # and their least number: fewer URLs prove nothing, and every subset of theirs would be frequent
    confidence: float = 0.6  # least share of bad ones among the labelled URLs that hold a rule's tokens


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of: scheme, parts of the host, its suffix, path segments, query keys, and the words of all parts."""
    parts = F.split(host, r"\.", -1)
    some = lambda items: F.filter(items, lambda x: x != "")
    tag = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(name), x))
    segments = F.transform(some(F.split(ascii_lower(path), "/", -1)), lambda s: F.regexp_replace(s, "[0-9]+", "0"))
    suffix = F.when(F.size(parts) >= 2, F.array(F.concat_ws(".", F.slice(parts, -2, 2)))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.concat_ws("/", host, ascii_lower(path)), r"[^a-z\x80-\x{10FFFF}]+", -1), lambda w: F.length(w) > 1)
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    scheme = F.array(ascii_lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    anchor = F.when(url.contains("#"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        tag("scheme=", some(scheme)), tag("host=", some(parts)), tag("site=", suffix), tag("path=", segments),
        tag("word=", words), tag("key=", keys), anchor,
    )
    return F.when(host != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def given_rule(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits a host or a domain above it and the start of the path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def token_classes(labelled: DataFrame, least: int) -> DataFrame:
    """``(_row, items)`` to ``(token, class, n)``: tokens in at least ``least`` rows; equal sets of rows, one class.

    Tokens that always stand together say the same; mined apart, every subset of them would be a rule. A class is
    named by its first token and holds no more tokens than one URL does. Sets of rows are compared by their
    size and two sums of hashes.
    """
    spread = labelled.select("_row", F.explode("items").alias("token"))
    sums = [F.bit_xor(F.xxhash64("_row", F.lit(k))).alias(f"_h{k}") for k in (1, 2)]
    tokens_ = written(spread.groupBy("token").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= least))
    named = tokens_.groupBy("n", "_h1", "_h2").agg(F.min("token").alias("class"))
    return tokens_.join(named, ["n", "_h1", "_h2"]).select("token", "class", "n")


def in_classes(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """``(key, items)`` with the classes of the items instead; rows without any are left out."""
    spread = rows.select(key, F.explode("items").alias("token"))
    return spread.join(classes.select("token", "class"), "token").groupBy(key).agg(F.collect_set("class").alias("items"))


def mined_rules(labelled: DataFrame, config: UrlConfig = UrlConfig()) -> tuple[DataFrame, DataFrame]:
    """``(_row, items, bad)`` to the classes of tokens, and rules ``(antecedent, confidence, support)`` over them that conclude a bad URL.

    A rule is left out if a part of its classes makes a rule of at least its confidence. Such a part stands
    in the index under its rarest class, so that a rule meets only parts whose rarest class it holds.
    """
    count = max(labelled.count(), 1)
    support = min(1.0, max(config.support, config.evidence / count))
    classes = written(token_classes(labelled, math.ceil(support * count - 1e-9)))
    baskets = labelled.select("_row", "bad").join(in_classes(labelled, "_row", classes), "_row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    baskets = baskets.select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(BAD)))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=config.confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    rules = written(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    short = by_rarest(rules, classes).select(F.col("antecedent").alias("_part"), F.col("confidence").alias("_sure"), "class")
    inside = rules.withColumn("class", F.explode("antecedent")).join(short, "class").filter(
        (F.size("_part") < F.size("antecedent")) & (F.col("_sure") >= F.col("confidence"))
        & (F.size(F.array_except("_part", "antecedent")) == 0)
    )
    return classes, rules.join(inside.select("antecedent").distinct(), "antecedent", "left_anti")


def by_rarest(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules with the rarest class of their antecedent."""
    sizes = classes.select("class", "n").distinct()
    choice = rules.withColumn("class", F.explode("antecedent")).join(sizes, "class")
    return choice.groupBy("antecedent", "confidence").agg(F.min_by("class", F.struct("n", "class")).alias("class"))


def filter_urls(pages: DataFrame, labels: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """``(page_id, url)`` to one row per page: host, path, rule, verdict.

    A given rule decides where one fits. Elsewhere a URL is blocked if it holds all tokens of a mined rule,
    else allowed. The rules are mined from the URLs of labelled pages; bad are those of low quality or
    toxic, a label belonging to the page with its number. Tokens that stand in the same labelled URLs count as
    one, of which a URL needs any. Each mined rule stands in the index under its rarest token, so that a URL
    meets only rules that share a rare token with it.

    Null URLs and URLs without ``://`` have empty host and path, no tokens, and are allowed. Rows are
    judged by their URL alone, so repeated and null page ids change nothing; labels of null ids, or null,
    are ignored, and an id labelled twice is bad if one label is. Without labels nothing is mined. No
    pages give no rows. Other columns are ignored.
    """
    url = F.coalesce("url", F.lit(""))
    host, path = split_url(url)
    parts = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), config.rules)
    split = parts.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("_given"))
    listed = split.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path")))

    bad = F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int"))
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg((bad == 1).alias("bad"))
    labelled = listed.join(known, F.col("page_id") == F.col("doc_id")).filter(F.size("items") > 0)
    # The number of a row is fixed by writing it.
    labelled = written(labelled.select(F.monotonically_increasing_id().alias("_row"), "items", "bad"))
    classes, rules = mined_rules(labelled, config)

    spread = listed.filter("rule IS NULL").select("url", "items").distinct()
    index = written(by_rarest(rules, classes).select("antecedent", "class"))
    holds = F.size(F.array_except("antecedent", "items")) == 0
    held = in_classes(spread, "url", classes)
    blocked = held.withColumn("class", F.explode("items")).join(index, "class").filter(holds).select("url").distinct()
    return split.join(blocked.withColumn("_blocked", F.lit(True)), "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_given", F.when(F.col("_blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
