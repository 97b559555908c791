"""Substring deduplication by hashing passages: runs of sentences that stand elsewhere before."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelloom.llm.common import sieve, written


@dataclass(frozen=True)
class PassageConfig:
    sentence: int = 5  # words of a sentence that is hashed; shorter ones belong to the one that follows
    words: int = 25  # a repeated run of more words in whole units is removed; a run of 51 loses at most its cut ends


# Pieces of a text: up to the end of a sentence or line, and nothing is left out.
PIECE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
UNITS = pa.schema(
    [("key", pa.int64()), ("rank", pa.int64()), ("digest", pa.binary()), *((c, pa.int32()) for c in ("at", "words", "start", "stop"))]
)
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def units(text: str, least: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(digest, words, start, stop) of each unit, in code points: a sentence of ``least`` words with the shorter ones before it.

    Units are equal when their words between ASCII white space are, A-Z in lower case. What is left at the
    end is a unit too.
    """
    start = stop = 0
    for piece in PIECE.finditer(text):
        stop = piece.end()
        if len(piece.group().encode().split()) >= least:
            words = text[start:stop].encode().lower().split()
            yield xxhash.xxh3_128_digest(b" ".join(words)), len(words), start, stop
            start = stop
    if words := text[start:stop].encode().lower().split():
        yield xxhash.xxh3_128_digest(b" ".join(words)), len(words), start, stop


def hashed(least: int):
    """Arrow batches of (key, rank, text) to one row per unit, some megabytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in UNITS]

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, UNITS)], schema=UNITS)
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            keys, ranks, texts = (batch.column(c) for c in ("key", "rank", "text"))
            for i in range(len(batch)):
                key, rank = keys[i].as_py(), ranks[i].as_py()
                for at, (digest, words, start, stop) in enumerate(units(texts[i].as_py(), least)):
                    for column, value in zip(columns, (key, rank, digest, at, words, start, stop)):
                        column.append(value)
                if len(columns[0]) > 50_000:
                    yield batch_of()
        yield batch_of()

    return run


def runs(repeats: list[dict], least: int) -> list[dict]:
    """Spans of the runs of more than ``least`` words: units in a row whose first occurrences are in one document."""
    out, held = [], None
    for x in [*sorted(repeats, key=lambda x: x["at"]), None]:
        if x and held and x["at"] == held["at"] + 1 and x["first"] == held["first"]:
            held = {**held, "at": x["at"], "stop": x["stop"], "words": held["words"] + x["words"]}
            continue
        if held and held["words"] > least:
            if out and out[-1]["stop"] == held["start"]:
                out[-1]["stop"] = held["stop"]
            else:
                out.append({"start": held["start"], "stop": held["stop"]})
        held = x
    return out


def spans_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(x, least) for x in batch.column("repeats").to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, SPANS)], ["key", "removed"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return run


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the code points of their ``removed`` spans."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            edges = [0, *(e for s in spans for e in (s["start"], s["stop"])), None]
            texts.append(text if text is None else "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("removed")], ["doc_id", "text", "removed"])


def drop_repeats(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """``(doc_id, text)`` to one row per document: text without repeats, removed, n_removed.

    Texts are cut into units: sentences or lines of enough words, each with the shorter ones before it. Of equal
    units, in one document or over all, the first occurrence stays: the one of the smallest doc_id and there the
    earliest. The others are removed where they stand in a run of more than ``words`` words whose first
    occurrences are all in one document; a shorter repeat, a licence line or a common sentence, stays. ``removed``
    lists (start, stop) in code points of the text as it was, touching runs as one; n_removed is their number.
    Only digests and offsets are shuffled, and only documents that lose a run are joined with their text.
    A unit of a third of all documents is one row per task when counted.

    Null and empty texts lose nothing (a null text stays null). Null ids rank last; documents of one id, or of
    none, rank by a hash of id and text. Rows that repeat both are one document and share their verdict. Ids
    must be whole numbers or texts of such. No documents give no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.octet_length("text")).alias("key"))
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    given = docs.filter("text IS NOT NULL").select("key", rank.alias("rank"), "text")
    schema = "key bigint, rank bigint, digest binary, at int, words int, start int, stop int"
    found = written(given.mapInArrow(hashed(config.sentence), schema))
    counts = found.groupBy("digest").agg(F.min(F.struct("rank", "key", "at")).alias("first"), F.count("*").alias("_n"))
    repeated = counts.filter("_n > 1").select("digest", F.col("first.key").alias("first"), F.col("first.at").alias("_at"))
    repeated = written(repeated)
    # Units that stand once, which most do, are not shuffled again.
    again = sieve(found.drop("rank"), F.col("digest"), repeated, F.col("digest")).filter("_maybe").drop("_maybe")
    # Rows that repeat a document repeat its units, the first place too.
    later = again.join(repeated, "digest").filter((F.col("key") != F.col("first")) | (F.col("at") != F.col("_at")))
    repeats = F.collect_set(F.struct("at", "words", "start", "stop", "first"))
    marks = later.groupBy("key").agg(repeats.alias("repeats"))
    cuts = written(marks.mapInArrow(spans_of(config.words), "key bigint, removed array<struct<start:int,stop:int>>"))
    marked = sieve(docs, F.col("key"), cuts, F.col("key"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    joined = marked.filter("_maybe").join(cuts, "key", "left").select("doc_id", "text", F.coalesce("removed", none).alias("removed"))
    kind = dict(docs.dtypes)["doc_id"]
    shorter = joined.mapInArrow(shortened, f"doc_id {kind}, text string, removed array<struct<start:int,stop:int>>")
    whole = marked.filter("NOT _maybe").select("doc_id", "text", none.alias("removed"))
    return shorter.unionByName(whole).withColumn("n_removed", F.size("removed").cast("bigint"))
