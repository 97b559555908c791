"""The pipeline, each stage against plain Python on its own input."""

import os
import subprocess
import sys

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import toxic_corpus

import corpus_pipeline
from panelloom.llm import toxicity
from panelloom.llm.common import SIEVE_BITS, sieve, without_ids

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage as plain rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


@needs_tables
def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(columns[:5] == COLUMNS for _, _, columns in stages.values())
    assert all(columns == COLUMNS for name, (_, _, columns) in stages.items() if name != "mixing")
    for before, after, _ in stages.values():
        text = {r["doc_id"]: r["text"] for r in before}
        assert all(text[r["doc_id"]] == r["text"] for r in after)


@needs_tables
def test_toxicity_stage_drops_what_the_operator_rejects(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    kept = toxicity.scored(docs, labels).filter("predicted = 0")
    assert ids(stages["toxicity"][1]) == ids(kept.collect())


@needs_tables
def test_stages_equal_brute_force(spark, stages):
    before, after, _ = stages["exact_dedup"]
    assert ids(after) == sorted(r[0] for r in brute.exact_groups([(r["doc_id"], r["text"]) for r in before]) if r[3])
    before, after, _ = stages["near_dedup"]
    assert ids(after) == sorted(r[0] for r in brute.near_groups([(r["doc_id"], r["text"]) for r in before], 5) if r[3])
    before, after, _ = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(after) == sorted(r[0] for r in brute.contamination([(r["doc_id"], r["text"]) for r in before], items) if not r[5])
    assert len(after) < len(before)
    before, after, _ = stages["mixing"]
    wanted = {r[0]: r[4] for r in brute.mix([(r["doc_id"], r["source"], r["text"]) for r in before]) if r[4]}
    assert {r["doc_id"]: r["taken"] for r in after} == wanted


@needs_tables
def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in stages["mixing"][1])


def test_peaks_equal_a_plain_model(spark):
    """The whole way from texts to peaks in dictionaries."""
    import math
    import zlib
    from collections import Counter, defaultdict

    docs, labels, truth = toxic_corpus(spark, 90)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", model.peaks(F.col("text")).alias("p")).collect()}
    texts = {r["doc_id"]: toxicity.normal(r["text"].encode()) for r in docs.collect()}
    trained = [d for d in texts if zlib.crc32(str(d).encode()) % 3 != 1]
    p = []
    pooled3 = set()
    counts = []
    for y in (1, 0):
        n5 = Counter(t[i : i + 5] for d in trained if truth[d] == y for t in [texts[d]] for i in range(len(t) - 4))
        n4 = Counter(g[1:] for g in n5)
        n3 = Counter(g[1:] for g in n4)
        pooled3 |= set(n3)
        counts.append({5: n5, 4: n4, 3: n3})
    ends, tops = Counter(g[1:] for g in pooled3), Counter()
    for g, n in ends.items():
        tops[g[:1]] += n
    for levels in counts:
        seen, kinds = defaultdict(int), defaultdict(int)
        for n, table in levels.items():
            for g, c in table.items():
                seen[g[:-1]] += c
                kinds[g[:-1]] += 1

        def prob(g, levels, seen, kinds):
            if len(g) == 2:
                return (ends[g] + 0.01) / (tops[g[:1]] + 0.6)
            kept = max(levels[len(g)].get(g, 0) - 0.75, 0)
            return (kept + (kinds[g[:-1]] * 0.75 + 0.5) * prob(g[1:], levels, seen, kinds)) / (seen[g[:-1]] + 0.5)

        p.append({g: prob(g, levels, seen, kinds) for g in set(counts[0][5]) | set(counts[1][5])})
    near = 0
    for d, t in texts.items():
        ratios = [math.log(p[0][g] / p[1][g]) if g in p[0] else 0.0 for g in (t[i : i + 5] for i in range(len(t) - 4))] + [0.0] * 4
        best = max(sum(ratios[i : i + 12]) / 12 for i in range(len(ratios)))
        near += abs(best - got[d]) < 1e-4
    # Two grams of a few thousand may meet in a slot.
    assert near >= 0.95 * len(texts)


def test_sieve_keeps_every_partner(spark):
    left = spark.range(2000).select(F.col("id"), F.lit(1).alias("_slot0"))
    keys = spark.range(0, 2000, 37).select(F.col("id").alias("k"))
    got = {r["id"] for r in sieve(left, F.col("id"), keys, F.col("k")).filter("_maybe").collect()}
    assert set(range(0, 2000, 37)) <= got and len(got) < 70 and SIEVE_BITS == 1 << 25
    assert sieve(left, F.col("id"), keys.limit(0), F.col("k")).filter("_maybe").count() == 0


def test_without_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id bigint, text string")
    drop = spark.createDataFrame([(2,), (None,), (2,), (9,)], "doc_id bigint")
    assert sorted(r["doc_id"] for r in without_ids(docs, drop).collect()) == [1, 3]
    assert without_ids(docs, drop.limit(0)).count() == 5


def test_stages_of_null_and_repeated_ids(spark, tmp_path):
    """Of a null or repeated id only the copy, near copy or leak goes, and the mix gives each row once."""
    passage = lambda n, start: " ".join(f"w{start + i}" for i in range(n))
    rows = [
        (9, passage(40, 0)), (None, passage(40, 0)), (None, passage(30, 100)), (4, passage(40, 0)), (4, passage(20, 200)),
        (1, passage(60, 300)), (None, passage(59, 300) + " other"), (5, passage(59, 300) + " more"), (5, passage(25, 400)),
        (None, "before " + passage(14, 500)), (6, "then " + passage(14, 500)), (6, passage(35, 600)),
        (7, passage(22, 700)), (7, passage(22, 700)), (None, passage(21, 800)), (None, passage(21, 800)), (None, passage(21, 900)), (None, None),
    ]
    spark.createDataFrame([(1, passage(14, 500))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    # The operators' brute force gives one verdict for each row, in the rows' order.
    flags = {
        corpus_pipeline.drop_copies: [r[3] for r in brute.exact_groups(rows)],
        corpus_pipeline.drop_near_copies: [r[3] for r in brute.near_groups(rows, 5)],
        corpus_pipeline.drop_leaks: [not r[5] for r in brute.contamination(rows, [(1, passage(14, 500))])],
    }
    for stage, kept in flags.items():
        assert plain(stage(spark, frame(rows), str(tmp_path))) == sorted((r for r, k in zip(rows, kept) if k), key=repr)
        assert not all(kept)
    got = corpus_pipeline.mix_sources(spark, frame(rows), str(tmp_path)).collect()
    wanted = [r for r in brute.mix([(d, "s", t) for d, t in rows]) if r[4]]
    assert sorted((repr(r["doc_id"]), r["taken"]) for r in got) == sorted((repr(r[0]), r[4]) for r in wanted)
    assert all(r["taken"] == r["copies"] * len(r["text"].split()) for r in got)


def test_stages_of_no_documents_and_of_very_long_texts(spark, tmp_path):
    """Each stage on an empty table, and on one with texts of a hundred thousand words; other columns do not reach the result."""
    labels = [(i, i % 2, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14)))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, finish string"
    long = " ".join(f"x{i * i % 9973}" for i in range(100_000))
    rows = [(i, f"{long} {'good' if i % 3 else 'bad'}{i % 2}", "en", "s", 1, "r", "f") for i in range(3)]
    rows += [(10, long + " w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "en", "s", 1, "r", "f"), (11, "short text of its own", None, None, None, "r", "f")]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:5] == COLUMNS and "_row" not in out.columns
            kept = ids(out.collect())
            if not given:
                assert kept == []
            elif name == "near_dedup":
                assert kept == [0, 11]
            elif name == "decontamination":
                assert kept == [0, 1, 2, 11]


def test_other_queries_need_no_corpus_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "panelloom.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as contract
assert not any(q.startswith("op") or q == "pipeline" for q in contract.queries()) and len(contract.queries()) > 140
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-2000:]


def test_other_queries_need_no_operators_where_the_pipeline_stays():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "panelloom.llm":
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as contract
assert not contract.CORPUS and not contract.CORPUS_SQL and len(contract.queries()) > 140
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-2000:]


def test_scores_do_not_use_other_columns(spark):
    docs, labels, _ = toxic_corpus(spark, 120)
    plain = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    rng = np.random.default_rng(1)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(str(rng.integers(9)))).withColumn("toxic", F.lit(1))
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(other, labels).collect()} == pytest.approx(plain)
