"""Line deduplication by how often a line stands on a site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.llm.common import sieve, written
from panelloom.llm.urls import split_url

# What makes a line of HTML end, and the entities that are decoded.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|body|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
BREAKS = rf"(?i)</?(?:{BLOCKS})(?:[\x20\x09-\x0D/][^>]*)?>"
TAGS = r"</?[A-Za-z][^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


@dataclass(frozen=True)
class LineConfig:
    ratio: float = 0.3  # a line on more than this share of a host's pages is boilerplate
    pages: int = 5  # hosts with fewer pages tell nothing


def page_lines(html: Column) -> Column:
    """Visible lines of a page, without those that are empty."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAKS, "\n"), TAGS, "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    # White space is collapsed once over the page; only runs that change are matched.
    text = F.regexp_replace(text, r"\x20*[\x09\x0B\x0C][\x20\x09\x0B\x0C]*|\x20{2,}", " ")
    lines = F.transform(F.split(text, r"[\n\r]+", -1), lambda s: F.trim(s))
    return F.filter(lines, lambda s: s != "")


def drop_boilerplate(pages: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``(page_id, url, html)`` to one row per page: host, text, n_lines, n_dropped.

    A line counts once for a page. Where a host has enough pages, lines on more than ``ratio`` of them are
    dropped from all its pages, wherever and however often they stand; ``text`` joins the others. Counts
    are added up before they are shuffled, so a line on a third of all pages is a row per task.

    Null html has no lines; null URLs and URLs without ``://`` belong to the empty host. Rows that repeat a
    page count as pages of their own. No pages give no rows. Other columns are ignored.
    """
    host, _ = split_url(F.coalesce("url", F.lit("")))
    html = F.coalesce("html", F.lit(""))
    # Pages are split once; the counts and the result both read the lines.
    split = written(
        pages.select("page_id", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("_key"), page_lines(html).alias("_all"))
    )
    lines = split.select("host", "_key", F.array_distinct(F.transform("_all", lambda s: F.md5(s))).alias("_lines"))
    # An outer explode: for an inner one the optimizer infers a filter and hashes every line in it again.
    spread = written(lines.select("host", "_key", F.explode_outer("_lines").alias("line")).filter("line IS NOT NULL"))
    sizes = split.groupBy("host").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= config.pages)
    often = spread.groupBy("host", "line").agg(F.count("*").alias("_on")).join(sizes, "host")
    common = written(often.filter(F.col("_on") > F.col("_pages") * config.ratio).select("host", "line"))
    marks = spread.join(common, ["host", "line"]).groupBy("_key").agg(F.collect_set("line").alias("_drop"))
    marks = written(marks)
    marked = sieve(split, F.col("_key"), marks, F.col("_key"))
    none = F.array().cast("array<string>")
    joined = marked.filter("_maybe").join(marks, "_key", "left").unionByName(
        marked.filter("NOT _maybe").withColumn("_drop", F.lit(None).cast("array<string>"))
    )
    joined = joined.withColumn("_drop", F.coalesce("_drop", none))
    kept = F.when(F.size("_drop") == 0, F.col("_all")).otherwise(F.filter("_all", lambda s: ~F.array_contains("_drop", F.md5(s))))
    return joined.select("page_id", "host", "_all", kept.alias("_kept")).select(
        "page_id", "host", F.array_join("_kept", "\n").alias("text"),
        F.size("_all").cast("bigint").alias("n_lines"), (F.size("_all") - F.size("_kept")).cast("bigint").alias("n_dropped"),
    )
