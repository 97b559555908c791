"""Toxicity scores from class-conditional Kneser-Ney models."""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.llm.common import Texts, written


@dataclass(frozen=True)
class ToxicityConfig:
    order: int = 5  # bytes of a gram
    discount: float = 0.75
    floor: float = 0.01  # added to the backoff count of each of ``letters`` symbols
    letters: int = 60
    window: int = 12  # grams over which the log-likelihoods are compared
    slots: int = 1 << 21  # of a dense table, where ``peak`` is given one
    # So many different grams at most are broadcast to the tasks that score; more are joined to the texts.
    broadcast_grams: int = 1 << 21
    threshold: float = 0.7
    # Labels of so many rows at most are broadcast to the documents; more are joined by a shuffle.
    broadcast_labels: int = 1_000_000


# Bytes a task works on at a time. Longer texts are cut into pieces that overlap.
CHUNK = 1_000_000
# Bytes of text that share one list of different grams where these are joined to their ratios.
GROUP = 8_000_000
_APART = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


def normal(text: bytes) -> bytes:
    """A-Z in lower case, one space for everything in ASCII that is no letter, a space at both ends."""
    return b" " + _APART.sub(b" ", text.lower()) + b" "


def packed(letters: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on as one number; the first byte is the highest."""
    size = len(letters) - n + 1
    out = np.zeros(max(size, 0), np.int64)
    for j in range(n):
        out = (out << 8) | letters[j : j + size]
    return out


def pieces(texts: Iterable[bytes], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of about ``CHUNK`` bytes: joined letters, and the owner and the first place of each piece.

    Pieces are parted by zero bytes, longer than a window and a gram.
    """
    owners, starts, parts, total = [], [], [], 0
    gap = bytes(overlap)

    def group():
        letters = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        return letters, np.array(owners), np.array(starts)

    for i, raw in enumerate(texts):
        text = normal(raw)
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK + overlap]
            if parts and total + len(part) > CHUNK:
                yield group()
                owners, starts, parts, total = [], [], [], 0
            owners.append(i)
            starts.append(total)
            parts += [part, gap]
            total += len(part) + len(gap)
    if parts:
        yield group()


def slot_of(grams: np.ndarray, slots: int) -> np.ndarray:
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(slots)).astype(np.int64)


def whole_grams(letters: np.ndarray, order: int) -> np.ndarray:
    """The grams of a group of pieces, without those that reach into a gap."""
    grams = packed(letters, order)
    whole = np.ones(len(grams), bool)
    for j in range(order):
        whole &= letters[j : j + len(grams)] != 0
    return grams[whole]


def gram_table(grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of grams, -1 for none, and of their values; a gram whose slot is taken moves to the next free one."""
    size = 16
    while size < 2 * len(grams):
        size *= 2
    keys, held = np.full(size, -1, np.int64), np.zeros(size, np.float32)
    left, at = np.arange(len(grams)), slot_of(grams, size)
    while len(left):
        free = left[keys[at[left]] < 0]
        _, first = np.unique(at[free], return_index=True)
        put = free[first]
        keys[at[put]], held[at[put]] = grams[put], values[put]
        left = left[keys[at[left]] != grams[left]]
        at[left] = (at[left] + 1) % size
    return keys, held


def looked_up(grams: np.ndarray, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The values of grams, 0 for one that the table does not hold."""
    at = slot_of(grams, len(keys))
    seen = keys[at]
    hit = seen == grams
    out = np.where(hit, held[at], 0.0)
    left = np.flatnonzero(~hit & (seen >= 0))
    while len(left):
        at[left] = (at[left] + 1) % len(keys)
        seen = keys[at[left]]
        hit = seen == grams[left]
        out[left[hit]] = held[at[left[hit]]]
        left = left[~hit & (seen >= 0)]
    return out


def counted(config: ToxicityConfig):
    """Arrow batches of (text, toxic, fold) to (gram, toxic, fold, n), summed over a task's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, part = (batch.column(c).to_numpy() for c in ("toxic", "fold"))
            for toxic, fold in sorted(set(zip(label.tolist(), part.tolist()))):
                rows = pa.array((label == toxic) & (part == fold))
                for letters, _, _ in pieces(Texts(batch.column("text").filter(rows)), config.window + config.order):
                    # Pieces of a long text share a few grams, which then count twice.
                    keys, n = np.unique(whole_grams(letters, config.order), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys),
                            pa.array(np.full(len(keys), toxic, np.int32)),
                            pa.array(np.full(len(keys), fold, np.int32)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["gram", "toxic", "fold", "n"],
                    )

    return run


SELECTIONS = ("all", "fold0", "fold1")
# Grams of so many bytes are the shared backoff; longer ones are counted by class.
SHARED = 2


def gram_ratios(counts: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``(gram, t0, o0, t1, o1)``, toxic and ordinary counts of two folds, to ``(gram, n, all, fold0, fold1)``.

    The last three are log p(last byte | other bytes, toxic) - log p(the same, ordinary), from both folds and
    from one of them. Each class is an interpolated Kneser-Ney model: the counts of a gram less a discount,
    and the mass so freed spread over the model of the gram without its first byte, whose counts are the
    different grams of the class that end in it, so that a passage copied a thousand times counts once. At the
    bottom both classes back off to one distribution from the grams of either, which keeps a rare or
    unseen expression from speaking for a class.
    """
    t0, o0, t1, o1 = (F.col(c) for c in ("t0", "o0", "t1", "o1"))
    cells = {"t_all": t0 + t1, "o_all": o0 + o1, "t_fold0": t0, "o_fold0": o0, "t_fold1": t1, "o_fold1": o1}
    level = counts.select("gram", *[c.alias(name) for name, c in cells.items()])
    levels = {config.order: level}
    shorter = lambda n: F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).alias("gram")
    for n in range(config.order, SHARED + 1, -1):
        ends = [F.sum((F.col(c) > 0).cast("int")).alias(c) for c in cells]
        levels[n - 1] = levels[n].groupBy(shorter(n)).agg(*ends)

    context = Window.partitionBy(F.shiftright("gram", 8))
    total = F.sum("kinds").over(context)
    kinds = levels[SHARED + 1].groupBy(shorter(SHARED + 1)).agg(F.count("*").alias("kinds"))
    base = (F.col("kinds") + config.floor) / (total + config.floor * config.letters)
    below = kinds.select(F.col("gram").alias("_end"), *[base.alias(f"p_{c}") for c in cells])
    for n in range(SHARED + 1, config.order + 1):

        def smoothed(c: str) -> Column:
            seen, different = F.sum(c).over(context), F.sum((F.col(c) > 0).cast("int")).over(context)
            kept = F.greatest(F.col(c) - config.discount, F.lit(0.0))
            # Half a count of the backoff keeps an unseen context defined.
            return (kept + (different * config.discount + 0.5) * F.col(f"p_{c}")) / (seen + 0.5)

        joined = levels[n].withColumn("_end", shorter(n)).join(below, "_end")
        now = joined.select("gram", F.col("t_all") + F.col("o_all"), *[smoothed(c).alias(f"p_{c}") for c in cells])
        now = now.toDF("gram", "n", *[f"p_{c}" for c in cells])
        below = now.drop("n").withColumnRenamed("gram", "_end")
    return now.select("gram", "n", *[F.log(F.col(f"p_t_{s}") / F.col(f"p_o_{s}")).alias(s) for s in SELECTIONS])


def stretches(letters: np.ndarray, ratios: np.ndarray, starts: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """The largest mean of ``window`` ratios in a row of each piece, -inf for none."""
    n, w = config.order, config.window
    blank = np.concatenate([[0], np.cumsum(letters == 0)])
    ratios[blank[n:] - blank[:-n] > 0] = 0.0
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    last = np.minimum(np.arange(len(ratios)) + w, len(ratios))
    means = (sums[last] - sums[: len(ratios)]) / w
    # A window that starts in a gap belongs to no text.
    means[letters[: len(means)] == 0] = -np.inf
    return np.maximum.reduceat(means, np.minimum(starts, len(means) - 1))


def peak(texts: Collection[bytes], table: tuple | np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """The largest mean log ratio over ``window`` grams in a row of each text; 0 for a text without letters.

    ``table`` is what ``gram_table`` gives, or a dense array of ``slots`` ratios.
    """
    out = np.full(len(texts), -np.inf)
    for letters, owners, starts in pieces(texts, config.window + config.order):
        grams = packed(letters, config.order)
        if isinstance(table, tuple):
            ratios = looked_up(grams, *table)
        else:
            ratios = table[slot_of(grams, config.slots)].astype(np.float64)
        np.maximum.at(out, owners, stretches(letters, ratios, starts, config))
    return np.where(np.isfinite(out), out, 0.0)


def cut_up(config: ToxicityConfig):
    """Arrow batches of (_toxic_row, text) to groups of pieces with a key of their own and their different grams."""
    integers, none = pa.list_(pa.list_(pa.int64())), np.empty(0, np.int64)

    def group(held: list, grams: np.ndarray) -> pa.RecordBatch:
        letters, owners, starts = ([x] for x in map(list, zip(*held)))
        # Groups that drew one key would share what is found, which holds the grams of both.
        columns = [pa.array([uuid.uuid4().int >> 65]), pa.array(letters, pa.list_(pa.binary())), pa.array(owners, integers)]
        columns += [pa.array(starts, integers), pa.array([grams], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "letters", "owners", "starts", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams, size = [], none, 0
        for batch in batches:
            rows = batch.column("_toxic_row").to_numpy()
            for letters, owners, starts in pieces(Texts(batch.column("text")), config.window + config.order):
                held.append((letters.astype(np.uint8).tobytes(), rows[owners], starts))
                grams = np.union1d(grams, whole_grams(letters, config.order))
                size += len(letters)
                if size >= GROUP:
                    yield group(held, grams)
                    held, grams, size = [], none, 0
        if held:
            yield group(held, grams)

    return run


def judged_chunks(names: list[str], config: ToxicityConfig):
    """Arrow batches of (letters, owners, starts, found, and ratios as ``names``) to (_toxic_row, ``names``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("found")[i].values
                tables = [gram_table(np.empty(0, np.int64), np.empty(0, np.float32))] * len(names)
                if found is not None:
                    known = found.field("gram").to_numpy()
                    tables = [gram_table(known, found.field(c).to_numpy()) for c in names]
                for raw, owners, starts in zip(*(batch.column(c)[i].values for c in ("letters", "owners", "starts"))):
                    letters = np.frombuffer(raw.as_buffer(), np.uint8).astype(np.int64)
                    grams, first = packed(letters, config.order), starts.values.to_numpy()
                    peaks = [pa.array(stretches(letters, looked_up(grams, *t), first, config)) for t in tables]
                    yield pa.RecordBatch.from_arrays([owners.values, *peaks], ["_toxic_row", *names])

    return run


def joined_peaks(docs: DataFrame, ratios: DataFrame, names: dict, config: ToxicityConfig) -> DataFrame:
    """``docs`` with the peaks ``names`` (column to selection), for a ratio table of any size.

    Texts are cut into pieces of about ``CHUNK`` bytes, in groups of about ``GROUP``. The different grams of each group are joined to the
    ratios, so that a frequent gram is one row a group, and what is found returns to the group, whose
    windows are rebuilt in place. No task holds more than its groups' own grams.
    """
    rows = written(docs.withColumn("_toxic_row", F.monotonically_increasing_id()))
    schema = "chunk bigint, letters array<binary>, owners array<array<bigint>>, starts array<array<bigint>>, grams array<bigint>"
    cut = rows.select("_toxic_row", F.coalesce("text", F.lit("")).alias("text"))
    cut = written(cut.mapInArrow(cut_up(config), schema))
    wanted = cut.select("chunk", F.explode("grams").alias("gram"))
    known = ratios.select("gram", *[F.col(which).alias(c) for c, which in names.items()])
    found = wanted.join(known, "gram").groupBy("chunk").agg(F.collect_list(F.struct("gram", *names)).alias("found"))
    met = cut.drop("grams").join(found, "chunk", "left").select("letters", "owners", "starts", "found")
    peaks = met.mapInArrow(judged_chunks(list(names), config), "_toxic_row bigint" + "".join(f", {c} double" for c in names))
    best = peaks.groupBy("_toxic_row").agg(*[F.max(c).alias(c) for c in names])
    out = rows.select(*[F.col(f"`{c}`") for c in docs.columns], "_toxic_row").join(best, "_toxic_row", "left").drop("_toxic_row")
    bare = F.lit(float("-inf"))
    return out.withColumns({c: F.when(F.col(c) > bare, F.col(c)).otherwise(0.0) for c in names})


@dataclass
class ToxicityModel:
    """The ratio of every gram for both folds and each one, and the logistic curve over the peak.

    ``tables`` are broadcasts of ``gram_table``; where the grams are too many, ``ratios`` is the table to join.
    """

    tables: dict
    slope: float
    middle: float
    config: ToxicityConfig
    ratios: DataFrame | None = None

    def peaks(self, text: Column, which: str = "all") -> Column:
        (keys, held), config = self.tables[which], self.config

        @F.arrow_udf("double")
        def peaks(batch: pa.Array) -> pa.Array:
            return pa.array(peak(Texts(batch), (keys.value, held.value), config))

        return peaks(text)

    def with_peaks(self, docs: DataFrame, names: dict) -> DataFrame:
        """``docs`` with the peaks ``names``, column to selection."""
        if self.ratios is not None:
            return joined_peaks(docs, self.ratios, names, self.config)
        return docs.withColumns({c: self.peaks(F.col("text"), which) for c, which in names.items()})

    def score(self, peaks: Column) -> Column:
        """Between 0 and 1; higher means that label 1 is likelier."""
        return 1 / (1 + F.exp(F.lit(-self.slope) * (peaks - self.middle)))


def logistic(values: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve through binned counts.

    Both classes weigh the same, however rare one is, and the targets are drawn in a little.
    """
    if not ones.sum() or not zeros.sum():
        return 1.0, 2.0
    high, low = (ones.sum() + 1) / (ones.sum() + 2), 1 / (zeros.sum() + 2)
    half = (ones.sum() + zeros.sum()) / 2
    ones, zeros = ones * half / ones.sum(), zeros * half / zeros.sum()
    x = np.stack([values, np.ones_like(values)], 1)
    theta = np.array([1.0, -2.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        weight = (ones + zeros) * p * (1 - p)
        gradient = x.T @ (ones * (high - p) + zeros * (low - p)) - 1e-3 * theta
        move = np.linalg.solve((x * weight[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        theta = theta + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-9:
            break
    slope = max(float(theta[0]), 1e-3)
    return slope, float(-theta[1] / slope)


def training_rows(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``(text, toxic, fold)`` of the labelled documents; ids whose CRC-32 leaves 1 when divided by 3 are held out."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("_rest", rest).filter("_rest <> 1").select("doc_id", "toxic", (F.col("_rest") / 2).cast("int").alias("fold"))
    known = written(known)
    if known.count() <= config.broadcast_labels:
        known = F.broadcast(known)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("text", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Models of all labelled documents that are not held out.

    The grams of both classes are counted over the whole texts, and each keeps its own ratio: in a broadcast
    table that grows with them up to ``broadcast_grams``, beyond that in a table that is joined to the texts.
    The curve from the peak of a text to its score is fitted on the same documents, each judged by the model of the other fold, through counts in
    bins of the peak.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels, config)
    found = rows.mapInArrow(counted(config), "gram bigint, toxic int, fold int, n bigint")
    cells = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(name)
             for name, y, f in (("t0", 1, 0), ("o0", 0, 0), ("t1", 1, 1), ("o1", 0, 1))]
    counts = written(found.groupBy("gram").agg(*cells))
    ratios = gram_ratios(counts, config).select("gram", *[F.col(c).cast("float").alias(c) for c in SELECTIONS])
    model = ToxicityModel({}, 1.0, 2.0, config)
    if counts.count() <= config.broadcast_grams:
        known = ratios.toArrow()
        grams = known.column("gram").to_numpy()
        for c in SELECTIONS:
            slots, held = gram_table(grams, known.column(c).to_numpy())
            keys = model.tables["all"][0] if model.tables else spark.sparkContext.broadcast(slots)
            model.tables[c] = keys, spark.sparkContext.broadcast(held)
    else:
        model.ratios = written(ratios)
    width = 0.01
    judged = model.with_peaks(rows, {"p0": "fold0", "p1": "fold1"})
    value = F.when(F.col("fold") == 0, F.col("p1")).otherwise(F.col("p0"))
    bins = judged.groupBy(F.round(F.greatest(F.least(value, F.lit(20.0)), F.lit(-20.0)) / width).cast("int").alias("bin"))
    rows_of = bins.agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")).orderBy("bin").collect()
    if rows_of:
        cells = np.array([[r["bin"] * width, r["ones"], r["zeros"]] for r in rows_of], float)
        model.slope, model.middle = logistic(cells[:, 0], cells[:, 1], cells[:, 2])
    return model


def scored(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; labels only train, and nothing but the text is scored.

    The score of a text depends on its most toxic stretch of ``window`` grams: the difference of the two
    models' log-likelihoods over it, divided by its length. Null and empty texts score what no evidence
    gives. Labels that are null, of null ids or other than 0 and 1 are ignored; an id labelled both ways is
    toxic. With no labels of one class every text scores the same curve over a peak of 0. No documents
    give no rows. Columns of ``docs`` stay; ``score`` and ``predicted`` are replaced if present.
    """
    model = fit(docs, labels, config)
    peaks = model.with_peaks(docs, {"_toxic_peak": "all"})
    out = peaks.withColumn("score", model.score(F.col("_toxic_peak"))).drop("_toxic_peak")
    return out.withColumn("predicted", (F.col("score") >= config.threshold).cast("int"))
