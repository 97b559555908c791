"""Hard negatives of anchor vectors by the threshold algorithm over sorted component lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.common import written

FOUND = "anchor bigint, slot int, id bigint, score bigint"


@dataclass(frozen=True)
class NegativeConfig:
    scale: int = 256  # components become the whole number below scale times their value
    anchor_every: int = 100  # ids divisible by it are anchors
    positives: int = 5
    negatives: int = 5
    least: int = 80  # a negative scores at least this share of its positive, in hundredths
    most: int = 100
    block: int = 4096  # rows whose sorted lists a task holds at once
    chunk: int = 1024  # anchors a task holds at once
    depth: int = 8  # first step of the sorted access; each later step is twice as deep


def matrix(lists: pa.Array) -> np.ndarray:
    """Whole-number vectors as rows; shorter ones end in zeros, which add nothing to a score."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), size.max(initial=0)), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten()
    return out


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Lists:
    """A block of vectors with its components sorted, dimension by dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def accessed(self, anchor: np.ndarray, step: int):
        """New rows with their scores, and the threshold after them: no row still unseen scores more.

        Each list is read from the end where the anchor's component makes the largest products.
        """
        n = len(self.vectors)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, depth = np.zeros(n, bool), 0
        while depth < n:
            to = min(depth + step, n)
            met = np.zeros(n, bool)
            met[self.order[n - to : n - depth, up].ravel()] = True
            met[self.order[depth:to, down].ravel()] = True
            new = np.flatnonzero(met & ~seen) if to < n else np.flatnonzero(~seen)
            seen[new] = True
            threshold = self.sorted[n - to, up] @ anchor[up] + self.sorted[to - 1, down] @ anchor[down]
            yield new, self.vectors[new] @ anchor, threshold
            depth, step = to, 2 * step


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by descending score, smaller ids first among equals."""
    return np.lexsort((ids, -scores))[:k]


class TopK:
    """The best k rows with scores from ``low`` to ``high``, both included; None is no bound."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.ids = self.scores = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = np.ones(len(ids), bool) if self.high is None else (scores <= self.high) & (scores >= self.low)
        if len(self.scores) == self.k:
            inside &= scores >= self.scores[-1]
        if inside.any():
            ids, scores = np.concatenate([self.ids, ids[inside]]), np.concatenate([self.scores, scores[inside]])
            first = best(ids, scores, self.k)
            self.ids, self.scores = ids[first], scores[first]

    def closed(self, threshold: int) -> bool:
        """No unseen row can enter: equal scores still could, by a smaller id."""
        full = len(self.scores) == self.k and threshold < self.scores[-1]
        return full or self.low is not None and threshold < self.low


def search(config: NegativeConfig, same: bool):
    """A grid cell's anchors against its rows: the best rows of each window of each anchor.

    With ``same`` an anchor has one window, the rows of its own label but for itself; else the windows of its
    positives, over the rows of other labels.
    """

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "slot": [], "id": [], "score": []}
        if len(anchors) and len(rows):
            a, x = matrix(anchors.column("vec").combine_chunks()), matrix(rows.column("vec").combine_chunks())
            width = max(a.shape[1], x.shape[1])
            a, lists = widen(a, width), Lists(widen(x, width))
            row, ids, label = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            for i, (at, mine) in enumerate(zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist())):
                if same:
                    open_ = {0: TopK(config.positives)}
                else:
                    # Bounds in whole scores: least * p <= 100 * s <= most * p.
                    open_ = {
                        slot: TopK(config.negatives, -(-config.least * p // 100), config.most * p // 100)
                        for slot, p in enumerate(anchors.column("scores")[i].as_py(), 1)
                    }
                fits = (label == mine) & (row != at) if same else label != mine
                tops = open_
                for new, scores, threshold in lists.accessed(a[i], config.depth):
                    ok = fits[new]
                    for top in open_.values():
                        top.add(ids[new][ok], scores[ok])
                    open_ = {slot: top for slot, top in open_.items() if not top.closed(threshold)}
                    if not open_:
                        break
                for slot, top in tops.items():
                    out["anchor"] += [at] * len(top.ids)
                    out["slot"] += [slot] * len(top.ids)
                    out["id"] += top.ids.tolist()
                    out["score"] += top.scores.tolist()
        kinds = {"anchor": pa.int64(), "slot": pa.int32(), "id": pa.int64(), "score": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def hard_negatives(vectors: DataFrame, config: NegativeConfig = NegativeConfig()) -> DataFrame:
    """``(vec_id, label, embedding)`` to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best other rows of the same label; for each, the best rows of other labels
    that score between ``least`` and ``most`` hundredths of the positive are its hard negatives. Scores are
    inner products of whole numbers; ties go to the smaller id.

    Rows are dealt into blocks of a bounded size by a hash of the row, anchors into chunks, and each cell of
    that grid runs the threshold algorithm: components are sorted once for a block; an anchor reads each list
    from the side of its own sign, scores every new row it meets, and stops when the sum of its products at
    that depth, which no unseen row exceeds, is strictly below the worst score kept of each open window, or
    below the window. Cells return at most k rows for each window; ranks over those give the result, so neither
    a hot label nor a vector that stands many times gathers in one task.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors
    count as ending in zeros. Rows that repeat an id are rows of their own: each repeated anchor has its own
    windows, and "other" means another row. Anchors without positives, and windows without rows, give none.
    Scores and their hundredfold must fit a long. No vectors give no rows. Other columns are ignored.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(config.scale) * x.cast("double")).cast("bigint"))
    # The row number is fixed by writing it.
    rows = written(
        given.select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"), whole.alias("vec"),
        )
    )
    anchors = rows.filter(F.col("vec_id") % config.anchor_every == 0)
    blocks = -(-rows.count() // config.block) or 1
    chunks = -(-anchors.count() // config.chunk) or 1
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def grid(queries: DataFrame, same: bool) -> DataFrame:
        left = queries.toDF(*queries.columns).withColumn("chunk", dealt(chunks)).withColumn("block", spread(blocks)).groupBy("block", "chunk")
        right = rows.withColumn("block", dealt(blocks)).withColumn("chunk", spread(chunks)).groupBy("block", "chunk")
        found = left.cogroup(right).applyInArrow(search(config, same), FOUND)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        k = config.positives if same else config.negatives
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    positives = grid(anchors, True).select(F.col("anchor").alias("row"), F.col("rank").alias("slot"), "id", "score")
    positives = written(positives)
    windows = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "score"))).alias("_windows"))
    windows = windows.select("row", F.transform("_windows", lambda w: w["score"]).alias("scores"))
    negatives = grid(anchors.join(windows, "row"), False)
    named = positives.select(F.col("row").alias("anchor"), "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
