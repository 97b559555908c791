"""Answers that are kept: each different prompt is asked once over all runs."""

import threading

import pytest
from pyspark.sql import functions as F

from panelloom.operators import text
from panelloom.operators.responses import ResponseStore, prompt_key


def prompts(spark, n=1000, different=100):
    return spark.range(n).select("id", F.concat(F.lit("prompt "), (F.col("id") % different).cast("string")).alias("p"))


def shouting():
    def shout():
        return lambda batch: [p.upper() for p in batch]

    return shout


shout = shouting()  # a function of another function travels to the tasks by value


def test_two_runs_make_one_call_per_prompt(spark, tmp_path):
    store = ResponseStore(str(tmp_path / "answers"))
    first = store.generate(prompts(spark), "p", "out", shout, run="one")
    again = store.generate(prompts(spark), "p", "out", shout, run="two")
    more = store.generate(prompts(spark, 1000, 103), "p", "out", shout, run="three")
    for df, n in ((first, 100), (again, 100), (more, 103)):
        got = df.collect()
        assert len(got) == 1000 and all(r["out"] == f"PROMPT {r['id'] % n}" and r["error"] is None for r in got)
    calls = {r["run"]: r["n_calls"] for r in store.calls(spark).collect()}
    assert calls.get("one") == 100 and calls.get("two", 0) == 0 and calls["three"] == 3


def test_waves_resume_after_a_driver_that_died(spark, tmp_path, monkeypatch):
    store = ResponseStore(str(tmp_path / "answers"))
    from panelloom.operators import responses

    real, waves = responses.batch_generate, []

    def dies(*args, **kwargs):
        waves.append(1)
        if len(waves) == 3:
            raise KeyboardInterrupt
        return real(*args, **kwargs)

    monkeypatch.setattr(responses, "batch_generate", dies)
    with pytest.raises(KeyboardInterrupt):
        store.generate(prompts(spark), "p", "out", shout, waves=4, run="first")
    monkeypatch.setattr(responses, "batch_generate", real)
    done = store.rows(spark).count()
    assert 20 < done < 80
    out = store.generate(prompts(spark), "p", "out", shout, run="second")
    assert out.filter("out = upper(p)").count() == 1000
    assert {r["run"]: r["n_calls"] for r in store.calls(spark).collect()} == {"first": done, "second": 100 - done}


def test_failures_are_asked_again_and_null_prompts_never(spark, tmp_path):
    store = ResponseStore(str(tmp_path / "answers"))
    rows = [(1, "good"), (2, "bad"), (3, None), (4, "bad"), (5, "")]
    df = spark.createDataFrame(rows, "id int, p string")

    def picky():
        def run(batch):
            if "bad" in batch:
                raise ValueError("no")
            return [f"<{p}>" for p in batch]

        return run

    got = {r["id"]: (r["out"], r["error"]) for r in store.generate(df, "p", "out", picky, run="a").collect()}
    assert got == {1: ("<good>", None), 2: (None, "ValueError: no"), 3: (None, None), 4: (None, "ValueError: no"), 5: ("<>", None)}
    got = {r["id"]: (r["out"], r["error"]) for r in store.generate(df, "p", "out", shout, run="b").collect()}
    assert got == {1: ("<good>", None), 2: ("BAD", None), 3: (None, None), 4: ("BAD", None), 5: ("<>", None)}
    assert {r["run"]: (r["n_calls"], r["n_failed"]) for r in store.calls(spark).collect()} == {"a": (3, 1), "b": (1, 0)}


def test_models_do_not_share_answers_and_compaction_keeps_them(spark, tmp_path):
    root = str(tmp_path / "answers")
    df = prompts(spark, 20, 5)
    one, two = ResponseStore(root, "one"), ResponseStore(root, "two")
    one.generate(df, "p", "out", shout)
    two.generate(df, "p", "out", lambda: lambda batch: ["two"] * len(batch))
    # Two jobs that asked at the same time leave a key twice; the first answer counts.
    late = one.rows(spark).filter("model = 'one'").withColumns({"output": F.lit("late"), "asked_at": F.col("asked_at") + F.expr("INTERVAL 1 DAY")})
    late.drop("run").write.parquet(f"{root}/run=late")
    before = sorted(map(tuple, one.answers(spark).collect()))
    assert len(before) == 5 and all(r[1].startswith("PROMPT") for r in before)
    one.compact(spark)
    assert one.rows(spark).count() == 10 and one.rows(spark).select("run").distinct().count() == 1
    assert sorted(map(tuple, one.answers(spark).collect())) == before
    assert {r["output"] for r in two.answers(spark).collect()} == {"two"}


def test_two_threads_append_side_by_side(spark, tmp_path):
    store = ResponseStore(str(tmp_path / "answers"))
    parts = [prompts(spark, 100, 50), prompts(spark, 100, 60)]
    threads = [threading.Thread(target=lambda d=d: store.generate(d, "p", "out", shout)) for d in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.answers(spark).count() == 60


def test_stages_use_the_store(spark, tmp_path):
    from test_stages import CONFIG, fact as build

    from panelloom.plans.stages import PanelStages

    fact = build.__wrapped__(spark) if hasattr(build, "__wrapped__") else build(spark)
    store = ResponseStore(str(tmp_path / "answers"))
    counts = []
    for k in (1, 2):
        stages = PanelStages(fact, CONFIG, root=str(tmp_path / f"run{k}"), responses=store)
        stages.publish()
        counts.append(store.rows(spark).count())
    assert counts[0] > 0 and counts[0] == counts[1]


def test_keys_are_digests(spark):
    import hashlib

    got = spark.createDataFrame([("a",), (None,)], "p string").select(prompt_key("p")).collect()
    assert [r[0] for r in got] == [hashlib.sha256(b"a").hexdigest(), None]


def test_generated_without_a_store_is_lazy(spark):
    df = text.generated(prompts(spark, 4, 2), "p", "out", shout)
    assert {r["out"] for r in df.collect()} == {"PROMPT 0", "PROMPT 1"}
