"""Row numbers and pages over a whole table: ranges of rows, each with what comes before it.

Rows are ranged by their order and sorted within their ranges, so that a position is the sum of the ranges
before plus a position inside one. Only one number per range meets in one place, never the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.sources.sinks import write_table

PART, AT = "__part", "__at"


def ranged(df: DataFrame, order: list, folder: str) -> DataFrame:
    """``df`` in ranges of its order, with the range ``__part`` and the place ``__at`` of each row in it.

    The rows are written to ``folder``, since a second computation might cut the ranges elsewhere. Rows that are
    equal in ``order`` share a range; end it with a unique column.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Upper bits: the partition; lower 33: the place in it.
    placed = sorted_.withColumn("__id", F.monotonically_increasing_id())
    parts = {PART: F.shiftright("__id", 33).cast("int"), AT: F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}
    return write_table(placed.withColumns(parts).drop("__id"), folder)


def before(rows: DataFrame, amount: Column) -> DataFrame:
    """``(__part, __before)``: the sum of an amount over all earlier ranges. One array entry per range."""
    totals = rows.groupBy(PART).agg(F.sum(amount).alias("n"))
    listed = totals.groupBy().agg(F.sort_array(F.collect_list(F.struct(PART, "n"))).alias("l"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<part:int,upto:bigint>>").alias("out"))
    summed = F.aggregate(
        "l",
        start,
        lambda acc, x: F.struct(
            (acc["sum"] + x["n"]).alias("sum"),
            F.concat(acc["out"], F.array(F.struct(x[PART].alias("part"), acc["sum"].alias("upto")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    each = listed.select(F.explode(summed).alias("x"))
    return each.select(F.col("x.part").alias(PART), F.col("x.upto").alias("__before"))


def numbered(df: DataFrame, order: list, name: str, folder: str) -> DataFrame:
    """``df`` with its row number in ``order``, from 0, without a window over the whole table."""
    rows = ranged(df, order, folder)
    number = F.col("__before") + F.col(AT)
    return rows.join(before(rows, F.lit(1).cast("bigint")), PART).withColumn(name, number).drop(PART, AT, "__before")


def paged(df: DataFrame, order: list, line: str, budget: int, folder: str, separator: int = 2) -> DataFrame:
    """``df`` with ``page`` (and ``__part``, ``__at``): lines in order, packed into pages of at most ``budget`` characters.

    A line starts where all lines before it end, with a separator after each. A page takes the lines that
    start in its stretch of that axis; a stretch is the budget less the longest line, so that no page
    exceeds the budget, at any number of lines. Lines longer than half of the budget may stand alone; one beyond it
    is a page of its own. Page numbers ascend in order and may leave gaps.
    """
    length = (F.coalesce(F.length(line), F.lit(0)) + separator).cast("bigint")
    rows = ranged(df, order, folder)
    longest = rows.select(F.max(length).alias("n")).scalar()
    inside = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum(length).over(inside), F.lit(0))
    width = F.greatest(F.lit(budget) - longest, F.lit(1).cast("bigint"))
    out = rows.join(before(rows, length), PART).withColumn("page", F.call_function("div", start, width))
    return out.drop("__before")


def joined_lines(line: str, separator: str) -> Column:
    """The lines of a page in order, as one text; for use in an aggregate by page."""
    listed = F.sort_array(F.collect_list(F.struct(PART, AT, F.col(line).alias("line"))))
    return F.array_join(F.transform(listed, lambda x: x["line"]), separator)
