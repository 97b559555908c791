"""Chat formatting: logged snapshots collapse to the longest conversation before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.common import without_ids, written

# Turns of a conversation that one task ranks; a longer conversation is cut into blocks of turn numbers.
BLOCK = 1024
LOW = (1 << 32) - 1


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, turn, role, text)`` to ``(conv_id, place, a, b, c)``, one row per turn.

    a, b and c are the rolling hash of the conversation up to the turn: running sums of three 32-bit hashes
    of a turn and its place. Sums over blocks of turns come first, then the turns inside a block, so a
    conversation with a third of all turns is spread over many tasks.
    """
    narrow = turns.select("conv_id", "turn", F.xxhash64("role", F.col("role").isNull(), "text", F.col("text").isNull()).alias("_said"))
    blocked = narrow.withColumn("_block", F.floor(F.coalesce("turn", F.lit(0)) / block))
    counts = blocked.groupBy("conv_id", "_block").agg(F.count("*").alias("_turns"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "_block", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "_said")

    def with_start(rows: DataFrame, starts: DataFrame) -> DataFrame:
        starts = starts.withColumnsRenamed({"conv_id": "_conv", "_block": "_of"})
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of"))
        return rows.join(starts, same).drop("_conv", "_of")

    ranked = blocked.withColumn("_row", F.row_number().over(inside))
    placed = with_start(ranked, starts).select("conv_id", "_block", (F.col("_start") + F.col("_row")).alias("place"), "_said")
    one, two = F.xxhash64("place", "_said"), F.xxhash64("_said", "place", F.lit(1))
    hashed = written(
        placed.select(
            "conv_id", "_block", "place",
            one.bitwiseAND(F.lit(LOW)).alias("_a"), F.shiftrightunsigned(one, 32).alias("_b"), two.bitwiseAND(F.lit(LOW)).alias("_c"),
        )
    )
    sums = hashed.groupBy("conv_id", "_block").agg(*[F.sum(c).alias(c) for c in ("_a", "_b", "_c")])
    starts = sums.select("conv_id", "_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_a", "_b", "_c")])
    upto = Window.partitionBy("conv_id", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "_block", "place", *[F.sum(c).over(upto).alias(c) for c in ("_a", "_b", "_c")])
    return with_start(running, starts).select(
        "conv_id", "place", *[(F.col(f"_{x}") + F.col(f"_{x}0")).alias(x) for x in "abc"]
    )


def superseded(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ids of the conversations that are the beginning of a longer one."""
    key = ["place", "a", "b", "c"]
    rolling = written(prefixes(turns, block))
    ends = rolling.groupBy("conv_id").agg(F.max("place").alias("_last")).withColumnRenamed("conv_id", "_conv")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_last"))
    whole = written(rolling.join(ends, same).select("conv_id", *key))
    # More conversations pass through a prefix than end there.
    passing = rolling.groupBy(key).agg(F.count("*").alias("_pass"))
    ending = whole.groupBy(key).agg(F.count("*").alias("_end"))
    begun = passing.join(ending, key).filter("_pass > _end").select(key)
    return whole.join(begun, key, "left_semi").select("conv_id")


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns of the maximal conversations: conv_id, turn, role, rendered.

    A conversation is dropped if its turns, in order, are the first turns of a longer conversation. Equal
    conversations are both maximal and stay. A rendered turn is its role and text between markers; the
    turns of a conversation in order are its rendering, which is never gathered into one row.

    Turns stand by number, null first, equal numbers by content. Null roles and texts differ from empty ones
    and render as empty; a null conv_id is one conversation. A repeated row is a turn said twice. No
    turns give no rows. Other columns are ignored.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = without_ids(turns, superseded(turns, block), "conv_id")
    rendered = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    return kept.select("conv_id", "turn", "role", rendered.alias("rendered"))
