"""MinHash near-deduplication by fast similarity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.common import Texts, sieve, written
from panelloom.llm.components import components


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5  # words of a shingle
    percent: int = 80  # least similarity of a link, of 100
    rows: int = 6  # coordinates of a band
    # A pair at a similarity of 0.8 shares no band with a chance of (1 - 0.8**6)**40, five in a million.
    bands: int = 40


# Bytes of text that a task hashes at a time; the arrays of a chunk take some ten times as much.
CHUNK = 1_000_000

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _C1
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> tuple[np.ndarray, bytes]:
    """Sorted distinct shingle hashes of a text, and a 128-bit digest of its words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64), b""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        parts = [hashes[i : i + 1] for i in range(len(words))]
    else:
        parts = [hashes[i : len(words) - k + 1 + i] for i in range(k)]
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mixed(out ^ part)
    return np.unique(out), digest


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One fast similarity sketch of ``size`` coordinates for each non-empty set.

    In each of the first ``size`` rounds every element of a set is placed in one bin by a hash of the round;
    in round ``size + i`` all of them are placed in bin i. A coordinate is the smallest hash of the first
    round that reached its bin, so that at the latest round ``2 * size - 1`` fills the last one. A set
    leaves as soon as it is filled, after about ``size * ln(size) / elements`` rounds.
    """
    counts = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), counts)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), size), top, np.uint64)
    taken = np.zeros((len(sets), size), bool)
    for r in range(2 * size):
        h = mixed(values ^ mixed(np.uint64(r + 1) * np.ones(1, np.uint64)))
        if r < size:
            bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            h = mixed(h)
        else:
            bins = np.full(len(values), r - size)
        flat = owner * size + bins
        free = ~taken.reshape(-1)[flat]
        flat, h = flat[free], h[free]
        np.minimum.at(out.reshape(-1), flat, np.minimum(h, top - np.uint64(1)))
        taken.reshape(-1)[flat] = True
        alive = ~taken.all(axis=1)
        if not alive.any():
            break
        if r % 4 == 3 or not alive[owner].all():
            stay = alive[owner]
            values, owner = values[stay], owner[stay]
    return out


def band_keys(out: np.ndarray, config: NearConfig) -> np.ndarray:
    keys = np.full((len(out), config.bands), 1, np.uint64) * np.arange(1, config.bands + 1, dtype=np.uint64)
    for i in range(config.rows):
        keys = mixed(keys ^ out[:, i :: config.rows][:, : config.bands])
    return keys.astype(np.int64)


def signed(config: NearConfig):
    """Arrow batches of (doc_id, text) and others to (doc_id, n_shingles, content, bands) and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c not in ("doc_id", "text")]
            for start, texts in Texts(batch.column("text")).groups(CHUNK):
                pairs = [shingle_set(text, config.shingle) for text in texts]
                full = [s for s, _ in pairs if len(s)]
                keys = iter(band_keys(sketches(full, config.rows * config.bands), config) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        pa.array([len(s) for s, _ in pairs], pa.int64()),
                        pa.array([d for _, d in pairs], pa.binary()),
                        pa.array([next(keys) if len(s) else [] for s, _ in pairs], pa.list_(pa.int64())),
                        *(batch.column(c).slice(start, len(texts)) for c in others),
                    ],
                    ["doc_id", "n_shingles", "content", "bands", *others],
                )

    return run


def shingled(k: int):
    """Arrow batches of (doc_id, text) to (doc_id, content, shingles); rows equal in both stay once in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in Texts(batch.column("text")).groups(CHUNK):
                found = {}
                for i, text in enumerate(texts, start):
                    shingles, digest = shingle_set(text, k)
                    found.setdefault((ids[i], digest), shingles)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in found], pa.int64()),
                        pa.array([d for _, d in found], pa.binary()),
                        pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "content", "shingles"],
                )

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose whole shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - F.col("_common")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "_sa", "_sb", common.alias("_common"))
        .filter(F.col("_common") * 100 >= union * percent)
        .select("a", "b")
    )


def near_groups(docs: DataFrame, config: NearConfig = NearConfig(), row: str | None = None) -> DataFrame:
    """``(doc_id, text)`` to one row per document: n_shingles, component_id, kept.

    Texts with the same words are one node. Nodes that share a band of their sketches are candidates; a
    link is confirmed on the whole shingle sets, and groups are what links reach. Inside a bucket not all
    pairs are tried: first every node against the smallest of its bucket, then, where groups still
    differ, against the largest. The nodes of buckets that still hold several groups are at last compared
    across groups by the rarest shingles of their sets, which finds every link. A pair that is left out
    lies in one group already or cannot be linked, so that no group is lost, while a bucket of many
    copies costs about as many tests as it has nodes.

    Letters A-Z are lower-cased, words stand between ASCII white space; a text of fewer words than a shingle is
    one shingle. Texts without words, and null, have no shingles and no links. The smallest id of a group
    stays; null ids are never the smallest, and a group of null ids only keeps all its rows with a null
    component_id. Rows that repeat an id are judged by their own texts; with equal texts both stay. No
    documents give no rows. Other columns are ignored, but ``row`` names a string column that stays in the result.
    """
    rows = [row] if row else []
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *rows)
    schema = "doc_id bigint, n_shingles bigint, content binary, bands array<bigint>" + "".join(f", `{c}` string" for c in rows)
    signatures = written(docs.mapInArrow(signed(config), schema))
    filled = signatures.filter("n_shingles > 0")
    classes = filled.groupBy("content").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    same = (filled["content"] == classes["content"]) & filled["doc_id"].eqNullSafe(classes["rep"])
    # A representative may stand in many equal rows; a node has its bands, and below its shingles, once.
    single = filled.join(classes, same).select("node", "n", "bands").dropDuplicates(["node"])
    banded = single.select("node", "n", F.explode("bands").alias("bucket"))
    ends = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = written(banded.join(ends, "bucket"))

    involved = written(members.select("node").distinct().join(classes, "node").select("node", "content", "rep"))
    texts = sieve(docs, F.col("doc_id"), involved, F.col("rep")).filter("_maybe").select("doc_id", "text")
    hashed = texts.mapInArrow(shingled(config.shingle), "doc_id bigint, content binary, shingles array<bigint>")
    same = (hashed["content"] == involved["content"]) & hashed["doc_id"].eqNullSafe(involved["rep"])
    sets = written(hashed.join(involved, same).select("node", "shingles").dropDuplicates(["node"]))

    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * config.percent
    sized = classes.select(F.col("node").alias("a"), F.col("n").alias("_na"))
    star = members.filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"), "n").distinct()
    tried = written(star.join(sized, "a").filter(near(F.col("_na"), F.col("n"))).select("a", "b"))
    links = written(confirmed(tried, sets, config.percent))
    roots = components(links)

    rooted = written(_open_buckets(members, roots))
    star = _apart(
        rooted.filter("node = high").select("bucket", F.col("node").alias("b"), F.col("root").alias("_rb"), F.col("n").alias("_nb")),
        rooted.filter("node < high").select("bucket", F.col("node").alias("a"), F.col("root").alias("_ra"), F.col("n").alias("_na")),
        near,
    )
    if not rooted.isEmpty():
        again = written(star.join(tried, ["a", "b"], "left_anti"))
        links = written(links.unionByName(confirmed(again, sets, config.percent)))
        tried = tried.unionByName(again)
        rooted = written(_open_buckets(members, components(links)))
        rest = _prefix_pairs(rooted.select("node", "root", "n").distinct(), sets, config.percent)
        last = written(rest.join(tried, ["a", "b"], "left_anti"))
        links = written(links.unionByName(confirmed(last, sets, config.percent)))
        roots = components(links)

    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "root").select("content", "component_id")
    found = filled.select("doc_id", "n_shingles", "content", *rows).join(named, "content")
    found = found.select("doc_id", "n_shingles", "component_id", *rows)
    empty = signatures.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *rows)
    return found.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their root, of the buckets that hold more than one group."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high")
    return rooted.join(several.select("bucket"), "bucket", "left_semi")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of ``(node, root, n)`` with different roots that may be similar enough.

    With the shingles of every set ordered alike, rarest first, two similar sets share one among the first
    ``n - ceil(n * percent / 100) + 1`` of each, and after the first shared one enough are left in both. So
    a copy whose own changes fill that head meets nobody, however many copies lie around it. Shingles that
    only one group holds join nothing and are left out.
    """
    spread = nodes.join(sets, "node").select("node", "root", "n", F.explode("shingles").alias("x"))
    often = spread.groupBy("x").agg(F.count("*").alias("_f"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    order = Window.partitionBy("node").orderBy("_f", "x")
    ranked = spread.join(often, "x").withColumn("at", F.row_number().over(order))
    needed = F.ceil(F.col("n") * percent / 100)
    heads = ranked.filter((F.col("at") <= F.col("n") - needed + 1) & (F.col("_low") < F.col("_high")))
    heads = written(heads.select("x", "node", "root", "n", "at"))
    first = heads.select("x", *[F.col(c).alias(f"_{c}a") for c in ("node", "root", "n", "at")])
    second = heads.select("x", *[F.col(c).alias(f"_{c}b") for c in ("node", "root", "n", "at")])
    left = F.least(F.col("_na") - F.col("_ata"), F.col("_nb") - F.col("_atb")) + 1
    enough = left * (100 + percent) >= (F.col("_na") + F.col("_nb")) * percent
    apart = (F.col("_roota") != F.col("_rootb")) & (F.col("_nodea") < F.col("_nodeb"))
    met = first.alias("f").join(second.alias("s"), (F.col("f.x") == F.col("s.x")) & apart & enough)
    return met.select(F.col("_nodea").alias("a"), F.col("_nodeb").alias("b")).distinct()


def _apart(first: DataFrame, second: DataFrame, near) -> DataFrame:
    """Pairs a < b of one bucket in different groups whose sizes allow a link."""
    apart = (F.col("_ra") != F.col("_rb")) & (F.col("a") < F.col("b")) & near(F.col("_na"), F.col("_nb"))
    return first.alias("f").join(second.alias("s"), (F.col("f.bucket") == F.col("s.bucket")) & apart).select("a", "b").distinct()
