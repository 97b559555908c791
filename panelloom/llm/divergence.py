"""How the sources of a language differ in their words: row-wise accumulation over a term-major index."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.common import written

# Letters of any script: A-Z in lower case, every byte of what lies beyond ASCII, blanks for the rest.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
# Counters of a task are written out when they hold so many terms.
HELD = 200_000
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
PARTIAL = pa.schema([*((c, pa.string()) for c in ("lang", "source", "item")), ("own", pa.int64()), ("met", pa.int64())])


@dataclass(frozen=True)
class DivergenceConfig:
    docs: int = 30  # documents of a language that a kept term is in, at least
    prior: int = 5  # added to each count
    unit: int = 1_000_000_000  # what the shares of a group add up to, but for rounding
    terms: int = 50  # terms reported for each group
    block: int = 1 << 14  # postings of a block of terms, for every 128 sources of the language


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (lang, source, text) to rows of COUNTS, added up over what a task has read.

    An empty term stands for the group itself, so that a group without terms is seen.
    """
    found, docs = defaultdict(Counter), defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        out = [(lang, source, term.decode(), n, docs[lang, source][term]) for (lang, source), c in found.items() for term, n in c.items()]
        columns = zip(*out) if out else ((),) * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
        for i in range(len(batch)):
            group = langs[i].as_py(), sources[i].as_py()
            words = texts[i].as_py().encode().translate(LETTERS).split()
            found[group].update(words)
            docs[group].update(set(words))
            found[group][b""] += 0
            if i % 64 == 63 and sum(map(len, found.values())) > HELD:
                yield rows()
                found.clear()
                docs.clear()
    yield rows()


def accumulate(block: pa.Table) -> pa.Table:
    """One block of terms of a language to what each pair of its sources gains there.

    Rows without a term head the block: every source of the language with ``zero``, its share of a term it
    does not have, and in the language's first block the number of kept terms, else -1. The others are
    postings. ``own`` is what the source's terms add to the distance of the two zeros; ``met`` corrects the
    terms that the peer has too, and holds, in the first block, the distance of the zeros for all terms.
    The sums are whole numbers below 2**53.
    """
    lang = block.column("lang")[0].as_py()
    heads = block.filter(pc.is_null(block.column("term")))
    posts = block.filter(pc.is_valid(block.column("term")))
    names = heads.column("source").to_pylist()
    zero, terms = heads.column("zero").to_numpy(), heads.column("terms")[0].as_py()
    at = {name: k for k, name in enumerate(names)}
    # The index: postings in the order of their terms, with the first of each term.
    term = posts.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term = term[order]
    peer = np.fromiter((at[s] for s in posts.column("source").to_pylist()), np.int64, len(term))[order]
    share = posts.column("share").to_numpy()[order]
    first = np.searchsorted(term, np.arange(term[-1] + 2 if len(term) else 1))
    mine = np.argsort(peer, kind="stable")
    cuts = np.searchsorted(peer[mine], np.arange(len(names) + 1))
    out = []
    for g in range(len(names)):
        row = mine[cuts[g] : cuts[g + 1]]
        if not len(row) and terms < 0:
            continue
        p, z = share[row], zero[g]
        base = np.abs(z - zero)
        # Distances of all shares of the row to each zero, from their running sums.
        sums = np.concatenate([[0], np.cumsum(np.sort(p))])
        below = np.searchsorted(np.sort(p), zero)
        own = zero * below - sums[below] + (sums[-1] - sums[below]) - zero * (len(p) - below) - len(p) * base
        # The row scatters each of its terms over the term's postings into one cell for each peer.
        size = first[term[row] + 1] - first[term[row]]
        skip = np.repeat(first[term[row]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        hit = np.arange(size.sum()) + skip
        to, q, p = peer[hit], share[hit], np.repeat(p, size)
        gain = np.abs(p - q) - np.abs(p - zero[to]) - np.abs(z - q) + base[to]
        met = np.bincount(to, gain, len(names)).astype(np.int64) + max(terms, 0) * base
        out.append((g, own, met))
    if not out:
        return pa.table([[], [], [], [], []], schema=PARTIAL)
    groups = np.concatenate([np.full(len(names), g) for g, _, _ in out])
    peers = np.tile(np.arange(len(names)), len(out))
    other = groups != peers
    labels = pa.array(names, pa.string())
    return pa.table(
        [
            pa.array([lang] * int(other.sum()), pa.string()), labels.take(pa.array(groups[other])), labels.take(pa.array(peers[other])),
            np.concatenate([x for _, x, _ in out])[other], np.concatenate([x for _, _, x in out])[other],
        ],
        schema=PARTIAL,
    )


def _share(n: str, total: str, terms: str, config: DivergenceConfig) -> str:
    """A term's share of its group as a whole number; exact for any counts that a long holds."""
    over = f"CAST({n} + {config.prior} AS DECIMAL(20, 0)) * {config.unit}"
    under = f"CAST({total} + {config.prior} * {terms} AS DECIMAL(20, 0))"
    return f"CASE WHEN {terms} > 0 THEN 1 + ({over}) div {under} ELSE 0L END"


def divergence(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """``(text, lang, source)`` to (lang, source, part, item, value, rank).

    Terms are runs of letters, A-Z in lower case. A language keeps the terms that enough of its documents
    hold; each of its sources, and the language, gives each kept term a share. Part ``pair`` has the summed
    distance of the shares to each other source of the language, part ``term`` the kept terms that the
    source has and uses more than the language does, as far as ``terms``.

    Term counts are added up in the tasks before they are shuffled. For the pairs, the kept postings of a
    language are dealt into blocks by a hash of the term, in which each source adds up its row over the
    term-major index, one cell for each peer; no pair of postings is ever a row. A source of any size is a
    part of every block, and blocks hold a bounded number of postings. Terms that neither side has, and the
    two sides' zeros, are corrected in closed form, so shares of absent terms are never listed.

    Null text, lang and source are empty strings. A group without terms takes part with zeros; a language
    without kept terms gives its pairs a value of 0 and no terms. Repeated rows count as often as they
    stand. No documents give no rows. Other columns are ignored.
    """
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = given.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term")
    counts = written(counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("_docs"))
    kept = written(kept.filter(F.col("_docs") >= config.docs).select("lang", "term", "all_n"))
    posts = written(counts.filter("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))

    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("posts"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "posts"])
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.sum("posts").alias("_posts"), F.count("*").alias("_sources"))
    sizes = sizes.join(langs, "lang", "left").na.fill(0, ["terms", "lang_total"])
    block = F.ceil(F.col("_sources") / 128) * config.block
    sizes = sizes.select("lang", "terms", "lang_total", F.greatest(F.ceil(F.col("_posts") / block), F.lit(1)).alias("blocks"))
    zero = F.expr(_share("0", "total", "terms", config)).alias("zero")
    groups = written(groups.join(sizes, "lang").select("lang", "source", "total", "terms", "lang_total", "blocks", zero))

    shared = posts.join(groups, ["lang", "source"]).withColumn("share", F.expr(_share("n", "total", "terms", config)))
    where = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    none = F.lit(0).cast("bigint")
    listed = shared.select("lang", where, "source", "term", "share", none.alias("zero"), none.alias("terms"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    heads = groups.select("lang", every, "source", F.lit(None).cast("string").alias("term"), none.alias("share"), "zero", "terms")
    heads = heads.withColumn("terms", F.when(F.col("block") == 0, F.col("terms")).otherwise(F.lit(-1).cast("bigint")))
    partial = "lang string, source string, item string, own bigint, met bigint"
    sums = listed.unionByName(heads).groupBy("lang", "block").applyInArrow(accumulate, partial)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("own").alias("own"), F.sum("met").alias("met"))
    # Each side's own terms count for both directions of a pair; what is in ``met`` each direction has itself.
    sides = F.explode(
        F.array(
            F.struct("source", "item", (F.col("own") + F.col("met")).alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("value")),
        )
    )
    pairs = sums.select("lang", sides.alias("_side")).select("lang", "_side.*").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    more = F.col("share") - F.expr(_share("all_n", "lang_total", "terms", config))
    terms = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.cast("bigint").alias("value"))
    return ranked(pairs).unionByName(ranked(terms.filter("value > 0")).filter(F.col("rank") <= config.terms))
