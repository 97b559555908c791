import math
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelloom.functions.numeric import (
    clip_low,
    half_up,
    high,
    ladder,
    low,
    normal_cdf,
    ratio,
    reround,
    spread_terms,
)
from panelloom.functions.template import fill, pieces


def exact(num, den, digits):
    value = Fraction(abs(num) * 10**digits, den)
    units = int(value + Fraction(1, 2))
    return (-units if num < 0 else units) / 10**digits


def test_ratio_rounds_half_away_from_zero(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-10**9, 10**9), rng.randint(1, 5000)) for _ in range(2000)]
    rows += [(1, 8), (-1, 8), (57, 200), (-57, 200), (0, 3), (5, 1000), (-5, 1000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for digits in (0, 1, 2, 4):
        got = [r[2] for r in df.select("a", "b", ratio("a", "b", digits)).collect()]
        assert got == [exact(a, b, digits) for a, b in rows]


def test_ratio_without_divisor_is_null(spark):
    df = spark.createDataFrame([(1, 0), (None, 3), (3, None)], "a bigint, b bigint")
    assert [r[0] for r in df.select(ratio("a", "b", 2)).collect()] == [None, None, None]


def test_half_up_and_reround(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (2.345,), (-1.0004,), (None,)], "x double")
    assert [r[0] for r in df.select(half_up("x", 0)).collect()] == [1.0, -1.0, 2.0, -1.0, None]
    df = spark.createDataFrame([(0.15,), (0.35,), (-0.25,), (12.5,)], "x double")
    assert [r[0] for r in df.select(reround("x", 2, 1)).collect()] == [0.2, 0.4, -0.3, 12.5]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-3,), (0,), (4,), (None,)], "x bigint")
    assert [r[0] for r in df.select(clip_low("x")).collect()] == [0, 0, 4, None]


def test_ladder_is_first_match_with_null_default(spark):
    df = spark.createDataFrame([(0.8,), (0.81,), (1.0,), (1.01,), (1.5,), (1.51,), (None,)], "x double")
    steps = ((1.5, 25), (1.0, 15), (0.8, 5))
    assert [r[0] for r in df.select(ladder("x", steps, 0)).collect()] == [0, 5, 5, 15, 15, 25, 0]
    assert [r[0] for r in df.select(ladder("x", ((1.0, "a"),), "b", op="<")).collect()][:3] == ["a", "a", "b"]


@pytest.mark.parametrize("base, step", [(0, 1), (5, 3), (2**23 - 2, 1), (2**23, 2**22), (3_000_000_019, 1), (7 * 10**13, 10**11)])
def test_spread_terms_survive_large_close_values(spark, base, step):
    xs = [base + step * (i % 5) for i in range(14)]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    h, l = high("x"), low("x")
    sums = df.selectExpr(
        "count(*) n", "sum(x) s", f"sum({h}) h", f"sum({h} * {h}) hh", f"sum({h} * {l}) hl", f"sum({l} * {l}) ll"
    )
    want = 14 * sum(x * x for x in xs) - sum(xs) ** 2
    assert sums.select(spread_terms("n", "s", "h", "hh", "hl", "ll")).first()[0] == pytest.approx(want, rel=1e-15)


def test_normal_cdf(spark):
    xs = [-4.0, -1.96, -0.5, 0.0, 0.3, 1.0, 2.5, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, (got,) in zip(xs, df.select(normal_cdf("x")).collect()):
        assert abs(got - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-7


def test_template_fills_every_kind_and_null(spark):
    template = "{name}: {x:.1f}, {n:d}, {d}, {gone:.2f|none}{line:|}."
    assert [p[1] for p in pieces(template)] == ["name", "x", "n", "d", "gone", "line", None]
    df = spark.createDataFrame([("a", 0.25, 7, None, None, None)], "name string, x double, n int, d date, gone double, line string")
    assert df.select(fill(template)).first()[0] == "a: 0.3, 7, N/A, none."


def test_template_rounding_matches_decimal(spark):
    values = [0.285, 1.005, 2.675, -0.125, 1234567.885]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [str(Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert [r[0] for r in df.select(fill("{x:.2f}")).collect()] == want


def test_empty_input_gives_empty_output(spark):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert df.select(ratio(F.col("a"), F.col("b"), 2)).count() == 0
