"""A spread of registered queries against their SQL on the small driver tables.

``python tests/check_oracle.py SF_DIR`` runs all of them.
"""

import os
import subprocess
import sys

import pytest
from check_oracle import compare, connect

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "s03_load_vaccinations", "s04_load_mobility", "p02_filter_in_table", "a03_series_profile", "a12_metric_pivot",
    "i12_feature_store", "f02_fit_forecaster", "f05_forecast_metrics", "f08_forecast_display_split",
    "n01_zscore_anomalies", "n02_model_anomalies", "k14_risk_tiers", "k18_context_view", "t02_prompt_situation_summary",
    "t07_batch_summarise", "t10_narratives", "t13_conversation_context", "t14_extract_select", "t16_series_context_line",
    "r09_top_n_per_series",
)


def test_every_sql_has_a_query():
    queries, sqls = contract.queries(), contract.oracle_sql()
    assert set(sqls) <= set(queries)
    assert set(contract.QUERIES) <= set(sqls)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    message = compare(contract.queries()[name](spark, SF_DIR), connect(SF_DIR), contract.oracle_sql()[name])
    assert message is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
def test_entry(spark):
    assert contract.entry(spark).count() == 9


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
def test_python_hooks_run_without_the_package_on_the_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("contract", "{root}/__spark_entry__.py")
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("t06_batch_generate", "f11_fit_forecaster_custom"):
    assert contract.queries()[name](spark, "{SF_DIR}").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
