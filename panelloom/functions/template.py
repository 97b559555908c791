"""Text templates filled from columns.

A template is a format string whose fields are column names, e.g. ``"Rt {rt_effective:.2f|n/a}"`` or ``"{phase:|unknown}"``.
The part before ``|`` is the format (``.Nf`` for N decimals, ``d`` for whole numbers, empty for
text and dates), the part after it the text used for NULL (``N/A`` when omitted). A missing value
therefore never blanks the whole text.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

MISSING = "N/A"


def pieces(template: str):
    """Yield ``(literal, field, fmt, default)``; ``field`` is None for the closing literal."""
    for literal, name, spec, _ in Formatter().parse(template):
        if name is None:
            yield literal, None, "", ""
            continue
        fmt, bar, default = (spec or "").partition("|")
        yield literal, name, fmt, default if bar else MISSING


def number_text(x, digits: int) -> Column:
    """Fixed-point text of a double with at most 6 decimals, rounded half away from zero."""
    x = F.col(x) if isinstance(x, str) else x
    exact = x.cast("decimal(38,6)")
    return F.round(exact, digits).cast(f"decimal(38,{digits})").cast("string")


def fill(template: str) -> Column:
    parts = []
    for literal, name, fmt, default in pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if fmt.endswith("f"):
            text = number_text(name, int(fmt[1:-1]))
        elif fmt == "d":
            text = F.col(name).cast("bigint").cast("string")
        else:
            text = F.col(name).cast("string")
        parts.append(F.coalesce(text, F.lit(default)))
    return F.concat(*parts)
