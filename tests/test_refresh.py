"""Incremental refresh of the feature store against a full rebuild."""

import random

import pytest
from conftest import COMBINED, day
from pyspark.sql import functions as F

from panelloom.config import EndemicConfig, FeatureConfig
from panelloom.operators import features, ingest, refresh

ENDEMIC = EndemicConfig(days=20)


def panel(seed=3, days=150):
    """Cumulative panels: noisy, declining, short, gappy and dead series."""
    rng, rows = random.Random(seed), {}
    shapes = {
        "noisy": lambda i: rng.randint(0, 400),
        "falling": lambda i: max(0, 3000 - 20 * i + rng.randint(0, 3)),
        "short": lambda i: rng.randint(5, 9) if i > 135 else None,
        "gappy": lambda i: rng.randint(0, 90) if i % 4 else None,
        "dead": lambda i: 5 if i < 60 else None,
        "still": lambda i: 7,
    }
    for name, shape in shapes.items():
        total = 0
        for i in range(days):
            new = shape(i)
            if new is not None:
                total += new
                rows[name, day(i)] = (total - (30 if i == 77 else 0), total // 40)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], COMBINED).repartition(3)


def full(df):
    return features.feature_store(ingest.daily_delta(df), endemic=ENDEMIC)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", range(6))
def test_refresh_equals_rebuild(spark, tmp_path, seed):
    """Random appends, corrections and removals, at the ends and in the middle of series."""
    rng = random.Random(seed)
    now = panel()
    before = dict(now)
    changed = []
    for key in rng.sample(sorted(now), 9) + [(n, day(149)) for n in ("noisy", "falling", "still") if rng.random() < 0.5]:
        if key not in before:
            continue
        kind = rng.choice(("late", "wrong"))
        if kind == "late":
            del before[key]
        else:
            before[key] = (before[key][0] + rng.randint(1, 500), before[key][1])
        changed.append(key)
    if seed % 2:  # a row that was published and has gone since, and a series that is new
        before["dead", day(100)] = (999, 1)
        changed.append(("dead", day(100)))
        for key in [k for k in before if k[0] == "short"]:
            del before[key]
            changed.append(key)
    old = full(frame(spark, before))
    old.write.parquet(str(tmp_path / "old"))
    stored = spark.read.parquet(str(tmp_path / "old"))
    changes = spark.createDataFrame(changed, "country_region string, date date")
    got = refresh.refresh_features(stored, frame(spark, now), changes, endemic=ENDEMIC)
    want = full(frame(spark, now))
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_only_the_tail_and_its_halo_are_computed(spark):
    now = frame(spark, panel())
    changes = spark.createDataFrame([("noisy", day(140)), ("noisy", day(145)), ("gappy", day(145))], "country_region string, date date")
    tail = refresh.changed_tail(now, refresh.first_changes(changes))
    counts = {(r["country_region"], r["__new"]): r["count"] for r in tail.groupBy("country_region", "__new").count().collect()}
    assert counts == {("noisy", True): 10, ("noisy", False): 28, ("gappy", True): 4, ("gappy", False): 28}
    assert refresh.halo_rows() == 27 and refresh.halo_rows(FeatureConfig(serial_interval=20)) == 39


def test_nothing_changed_keeps_every_row(spark, tmp_path):
    now = frame(spark, panel())
    full(now).write.parquet(str(tmp_path / "old"))
    stored = spark.read.parquet(str(tmp_path / "old"))
    none = spark.createDataFrame([], "country_region string, date date")
    assert rows_of(refresh.refresh_features(stored, now, none, endemic=ENDEMIC)) == rows_of(stored)


def test_a_later_last_date_moves_the_endemic_flag_of_other_series(spark, tmp_path):
    rows = panel()
    before = {k: v for k, v in rows.items() if k[1] < day(148)}
    full(frame(spark, before)).write.parquet(str(tmp_path / "old"))
    stored = spark.read.parquet(str(tmp_path / "old"))
    rows["noisy", day(400)] = (10**6, 3)
    rows = {k: v for k, v in rows.items() if k in before or k[0] == "noisy"}
    changes = spark.createDataFrame([k for k in rows if k not in before], "country_region string, date date")
    got = refresh.refresh_features(stored, frame(spark, rows), changes, endemic=ENDEMIC)
    assert rows_of(got) == rows_of(full(frame(spark, rows)))
    assert stored.filter("endemic_flag").select("country_region").distinct().count() >= 0
    assert got.filter((F.col("country_region") == "falling") & F.col("endemic_flag")).count() == 0
