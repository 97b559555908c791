"""Projections, filters and predicates shared by every stage."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F


def canonical_name(column: str, variants: dict) -> Column:
    """Replace known spelling variants; other names pass through.

    ``variants`` is a configuration table, so it is folded into the plan as one map literal.
    """
    if not variants:
        return F.col(column)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(variants.items())])
    return F.coalesce(table[F.col(column)], F.col(column))


def canonicalise_names(df: DataFrame, column: str, variants: dict | DataFrame) -> DataFrame:
    """Rename entity variants by a small dict, or by a ``(raw_name, name)`` frame of any size.

    The frame is joined without a broadcast hint: the optimizer broadcasts it only below its
    size threshold.
    """
    if isinstance(variants, dict):
        return df.withColumn(column, canonical_name(column, variants))
    names = variants.select(F.col("raw_name").alias(column), F.col("name").alias("__name"))
    return (
        df.join(names, column, "left")
        .withColumn(column, F.coalesce("__name", column))
        .select(*df.columns)
    )


def filter_in_list(df: DataFrame, column: str, allowed) -> DataFrame:
    """Keep listed values: a sequence becomes a pushed-down IN, a one-column frame a semi join."""
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(F.col(allowed.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(*allowed))


def filter_date_range(df: DataFrame, ts: str, start: str | None, end: str | None = None) -> DataFrame:
    """Closed calendar range; either side may stay open."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("date"))
    return df


def filter_null(df: DataFrame, subset: list[str], keep_null: bool = False) -> DataFrame:
    """Complete cases of ``subset``; with ``keep_null`` the rows where all of them are NULL."""
    if not keep_null:
        return df.dropna(subset=subset)
    for column in subset:
        df = df.filter(F.col(column).isNull())
    return df


def literal_tag(df: DataFrame, tags: dict, typed_nulls: dict | None = None) -> DataFrame:
    """Constant columns and typed NULL columns."""
    constants = {name: F.lit(value) for name, value in tags.items()}
    nulls = {name: F.lit(None).cast(kind) for name, kind in (typed_nulls or {}).items()}
    return df.withColumns({**constants, **nulls})


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that ``df`` has, in the wanted order."""
    have = {c.lower() for c in df.columns}
    return [c for c in wanted if c.lower() in have]


def rename_fill_display(df: DataFrame, labels: dict, missing: str = "—") -> DataFrame:
    """Columns of ``labels`` that exist, as text under their display label, NULL shown as a dash."""
    return df.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(labels[c])
            for c in present(df, list(labels))
        ]
    )


# Short display labels of the phases.
PHASE_LABELS = {
    "EXPONENTIAL_GROWTH": "Exp. Growth",
    "EXPONENTIAL_DECLINE": "Exp. Decline",
    "LINEAR_GROWTH": "Lin. Growth",
    "LINEAR_DECLINE": "Lin. Decline",
    "PLATEAU": "Plateau",
}


def label_map(column: str, labels: dict = PHASE_LABELS, missing: str = "—") -> Column:
    """Short label of a code; unknown codes become words in title case, NULL a dash."""
    words = F.initcap(F.regexp_replace(F.col(column), "_", " "))
    known = canonical_name(column, labels)
    return F.coalesce(F.when(F.col(column).isin(*labels), known).otherwise(words), F.lit(missing))
