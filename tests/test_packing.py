"""Row numbers and pages without a window over the whole table."""

import pytest
from pyspark.sql import functions as F

from panelloom.operators import packing, text


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_numbers_follow_the_order(spark, tmp_path, n):
    df = spark.range(n).select(F.expr("(id * 7919) % 10007").alias("v"), F.col("id").cast("string").alias("name")).repartition(5)
    got = packing.numbered(df, [F.desc("v"), "name"], "n", str(tmp_path / "rows")).collect()
    want = sorted(((r["v"], r["name"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert {r["n"]: (r["v"], r["name"]) for r in got} == dict(enumerate(want)) and len(got) == n


def test_one_value_in_most_rows_is_spread_by_the_tie_breaker(spark, tmp_path):
    df = spark.range(8000).select(F.lit(1).alias("same"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        rows = packing.ranged(df, ["same", "k"], str(tmp_path / "rows"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in rows.groupBy("__part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 4000


def brute_pages(lines, budget, separator):
    width, at, out = max(budget - max(len(x) + separator for x in lines), 1), 0, []
    for x in lines:
        out.append(at // width)
        at += len(x) + separator
    return out


@pytest.mark.parametrize("budget", [60, 200, 5000])
def test_pages_hold_the_budget_in_order(spark, tmp_path, budget):
    lines = [(k, "x" * (k * 37 % 50)) for k in range(700)] + [(700, None)]
    df = spark.createDataFrame(lines, "k int, line string").repartition(4)
    rows = packing.paged(df, ["k"], "line", budget, str(tmp_path / "rows"))
    got = {r["k"]: r["page"] for r in rows.collect()}
    assert [got[k] for k in range(701)] == brute_pages([x or "" for _, x in lines], budget, 2)
    pages = rows.groupBy("page").agg(F.sum(F.coalesce(F.length("line"), F.lit(0)) + 2).alias("size")).collect()
    assert max(p["size"] for p in pages) <= budget


RISK = "country_region string, risk_tier string, risk_score int, rt_effective double, rolling_avg_7d_cases double"


def series(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("country_region"), F.lit("LOW").alias("risk_tier"),
        F.when(F.col("id") % 50 > 0, F.col("id") % 101).cast("int").alias("risk_score"), F.lit(1.0).alias("rt_effective"),
        F.lit(2.0).alias("rolling_avg_7d_cases"),
    )


@pytest.mark.parametrize("n", [3, 2000, 200_000])
def test_triage_is_bounded_at_every_size(spark, tmp_path, n):
    budget = 4000
    prompts = text.triage_prompts(text.triage_lines(series(spark, n)), str(tmp_path / "one"), budget).collect()
    assert sum(p["n_series"] for p in prompts) == n
    assert max(len(p["prompt"]) for p in prompts) <= budget + len(text.TRIAGE_OPENING) + 1
    if n <= 2000:
        ordered = sorted(prompts, key=lambda p: p["page"])
        named = [x.split(":")[0] for p in ordered for x in p["prompt"][len(text.TRIAGE_OPENING) : -1].split("; ")]
        score = lambda k: -1 if k % 50 == 0 else k % 101
        assert named == [str(k) for k in sorted(range(n), key=lambda k: (-score(k), str(k)))]

    def longest():
        # A brief that tells the longest prompt below it.
        def run(batch):
            return [str(max([len(p), *(int(x) for x in p.split("\n")[1:] if x.isdigit())])) for p in batch]

        return run

    (row,) = text.global_triage(series(spark, n), str(tmp_path / "all"), F.lit(None), longest, budget).collect()
    assert row["n_series"] == n and row["error"] is None
    assert int(row["global_brief"]) <= budget + max(len(text.TRIAGE_OPENING), len(text.TRIAGE_GLOBAL)) + 1


def test_triage_of_nothing_of_a_missing_score_and_of_long_briefs(spark, tmp_path):
    assert text.global_triage(spark.createDataFrame([], RISK), str(tmp_path / "a")).count() == 0
    one = spark.createDataFrame([("a", "LOW", None, None, None)], RISK)
    (row,) = text.triage_prompts(text.triage_lines(one), str(tmp_path / "b")).collect()
    assert row["n_series"] == 1 and row["prompt"].startswith(text.TRIAGE_OPENING + "a: LOW (score N/A")
    with pytest.raises(ValueError, match="raise the budget"):
        text.global_triage(series(spark, 30), str(tmp_path / "c"), None, lambda: lambda b: ["y" * 500] * len(b), 200)
