"""Secret scans by sliding-window entropy, in DataFrame expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, in their order. A maximal run of fewer characters holds no longer one,
# so the least length of access and hex can stand in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

# Characters of a candidate; the place of a character is its counter.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]"

# Strings that look random and are none.
ALLOWED = (
    r"^[A-Za-z]?[a-z]+([/_=-][A-Za-z]?[a-z]+)*$",  # words, paths and names of words
    r"^[A-Z]+([/_=-][A-Z]+)*$",  # words in capitals
    r"^[0-9]+([/_=-][0-9]+)*$",  # numbers, dates, ranges
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers of records
    r"(?i)example|sample|dummy|placeholder|changeme|0123456789|abcdefghij",
)


# Character classes, the first that holds a whole candidate counts, and the least entropy of their windows in bits.
CLASSES = (
    ("[0-9a-fA-F]", 3.1),  # of log2(16) = 4
    ("[A-Z2-7]", 3.6),  # base 32
    ("[0-9a-z]", 3.6),  # base 36
    ("[0-9A-Z]", 3.6),
)


@dataclass(frozen=True)
class EntropyConfig:
    window: int = 24  # characters
    classes: tuple = CLASSES
    mixed_bits: float = 3.9  # least entropy of a window of a candidate of other characters, of log2(24) = 4.58 at most
    allowed: tuple = ALLOWED


# Lengths that are summed at once, and windows that are counted at once.
BLOCK, WINDOWS = 128, 4096
SPANS = "array<struct<start:int,rank:int,stop:int>>"


def _running(steps: Column) -> Column:
    """What comes before each place of an array of lengths: sums within blocks, and sums of the blocks before.

    Appending to one array would copy it once for each place.
    """

    def before(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, zero, add, lambda s: s["out"])

    starts = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))
    blocks = F.when(F.size(steps) > 0, F.transform(starts, lambda i: F.slice(steps, i, BLOCK)))
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x))
    both = F.arrays_zip(blocks.alias("steps"), before(sums).alias("upto"))
    return F.flatten(F.transform(both, lambda z: F.transform(before(z["steps"]), lambda at: at + z["upto"])))


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Places of a pattern's matches: gaps and matches alternate, so running lengths give the offsets."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    # The gap after the last match is of no use.
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), 1, F.size(lengths))
    steps = F.zip_with(gaps, lengths, lambda g, m: g + m)
    parts = [_running(steps).alias("at"), gaps.alias("gap"), lengths.alias("long")]
    placed = F.arrays_zip(*parts, *([keep.alias("keep")] if keep is not None else []))
    kept = placed if keep is None else F.filter(placed, lambda s: s["keep"])

    def span(s):
        start = s["at"] + s["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + s["long"]).alias("stop"))

    return F.coalesce(F.transform(kept, span), F.array().cast(SPANS))


def _only_if(condition: Column, spans: Column) -> Column:
    """Offsets are computed only for texts that hold the pattern."""
    return F.when(condition, spans).otherwise(F.array().cast(SPANS))


def _candidates(text: Column, config: EntropyConfig) -> Column:
    """Strings long enough for a window and not on the allow list, as codes of their characters."""
    pattern = CANDIDATE + "{%d,}" % config.window
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"), _spans(text, pattern, 0).alias("span")
    )

    def unlisted(c):
        keep = F.lit(True)
        for allowed in config.allowed:
            keep = keep & ~c["word"].rlike(allowed)
        return keep

    def coded(c):
        letters = F.filter(F.split(c["word"], ""), lambda x: x != "")
        codes = F.transform(letters, lambda x: F.instr(F.lit(ALPHABET), x) - 1)
        bound = F.lit(config.mixed_bits)
        for pattern, bits in reversed(config.classes):
            bound = F.when(c["word"].rlike(f"^{pattern}+$"), F.lit(bits)).otherwise(bound)
        return F.struct(c["span"]["start"].alias("start"), codes.alias("codes"), bound.alias("bound"))

    return F.transform(F.filter(found, unlisted), coded)


def _hot_spans(candidate: Column, config: EntropyConfig) -> Column:
    """Merged windows of a candidate whose entropy reaches the bound of its character class.

    There is one counter per character. A step moves two of them, and the sum of c * log2(c) over all
    counters changes by what these two change. Hot windows that touch become one span. Long candidates are
    counted some thousand windows at a time, and the spans that touch across these stretches joined after.
    """
    n = config.window
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(n + 2)])
    weight = lambda c: F.get(weights, c)
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("stop"),
        F.array().cast(SPANS).alias("out"),
    )

    def span(state):
        start = candidate["start"] + state["first"]
        return F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), (candidate["start"] + state["stop"]).alias("stop"))

    def closed(state):
        return F.when(state["first"] >= 0, F.concat(state["out"], F.array(span(state)))).otherwise(state["out"])

    def stretch(begin):
        """Spans of the windows that start from ``begin`` on."""

        def step(state, i):
            comes = F.get(candidate["codes"], i)
            goes = F.when(i - n >= begin, F.get(candidate["codes"], i - n)).otherwise(-1)
            before = F.coalesce(F.get(state["counts"], goes), F.lit(0))
            there = F.get(state["counts"], comes) - (comes == goes).cast("int")
            left = F.when(goes >= 0, weight(before - 1) - weight(before)).otherwise(0.0)
            total = state["sum"] + left + weight(there + 1) - weight(there)
            counts = F.transform(state["counts"], lambda c, j: c + (j == comes).cast("int") - (j == goes).cast("int"))
            hot = (i - begin >= n - 1) & (F.lit(math.log2(n)) - total / n >= candidate["bound"])
            opens = hot & (i - n + 1 > state["stop"])
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(opens, i - n + 1).otherwise(state["first"]).alias("first"),
                F.when(hot, i + 1).otherwise(state["stop"]).alias("stop"),
                F.when(opens, closed(state)).otherwise(state["out"]).alias("out"),
            )

        last = F.least(begin + F.lit(WINDOWS + n - 2), F.size(candidate["codes"]) - 1)
        return F.aggregate(F.sequence(begin, last), zero, step, closed)

    # No stretch begins where no window is left.
    begins = F.sequence(F.lit(0), F.size(candidate["codes"]) - n, F.lit(WINDOWS))
    return _joined(F.flatten(F.transform(begins, stretch)))


def _joined(spans: Column) -> Column:
    """Spans in order, those that touch as one: each starts where none before reaches, and stops before the next start."""

    def join(xs: Column) -> Column:
        opens = F.filter(xs, lambda s, i: (i == 0) | (s["start"] > F.get(xs, i - 1)["stop"]))
        closes = F.filter(xs, lambda s, i: (i == F.size(xs) - 1) | (F.get(xs, i + 1)["start"] > s["stop"]))
        return F.zip_with(
            opens, closes, lambda a, b: F.struct(a["start"].alias("start"), a["rank"].alias("rank"), b["stop"].alias("stop"))
        )

    # The list is bound once, not computed anew for each of its places.
    return F.element_at(F.transform(F.array(spans), join), 1)


def scan(docs: DataFrame, config: EntropyConfig = EntropyConfig()) -> DataFrame:
    """``(doc_id, text)`` to one row per document with ``spans``, an array of (start, rank, stop).

    Three patterns give the base spans: rank 1 a value assigned to a telling name, 2 an access key, 3 a
    long run of hex digits. Rank 4 are windows of high entropy in other strings of the same characters;
    strings on the allow list, and windows inside a base span, are left out. Offsets count code points,
    ends are exclusive, spans are ordered by start, then rank.

    Null and empty texts have no spans. Each row is judged alone, so repeated rows and ids, null ids and
    other columns change nothing. No documents give no rows.
    """
    text = F.col("_text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= ASSIGN_VALUE)
    long = CANDIDATE + "{%d,}" % config.window
    based = docs.select(
        "doc_id", "_text",
        F.concat(
            _only_if(text.rlike(ASSIGN), _spans(text, ASSIGN, 1, values)),
            _only_if(text.contains("AKIA"), _spans(text, ACCESS, 2)),
            _only_if(text.rlike(HEX), _spans(text, HEX, 3)),
        ).alias("_base"),
        F.when(text.rlike(long), _candidates(text, config)).alias("_found"),
    )
    hot = F.flatten(F.transform("_found", lambda c: _hot_spans(c, config)))
    marked = based.select("doc_id", "_base", F.coalesce(hot, F.array().cast(SPANS)).alias("_hot"))
    new = F.filter(
        "_hot", lambda e: ~F.exists("_base", lambda b: (b["start"] <= e["start"]) & (e["stop"] <= b["stop"]))
    )
    return marked.select("doc_id", F.array_sort(F.concat("_base", new)).alias("spans"))


def rendered(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"])
    one = lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def counted(found: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] <= 3)
    return found.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"),
    )
