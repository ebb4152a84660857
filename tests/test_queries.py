"""Registered queries against their SQL twins, and rules on their plans.

All of them run with PLURALITY_ORACLE=all; a spread over every category runs by default.
"""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from plurality.plans.registry import QUERIES
from tools.compare import compare, connect

DEFAULT = ("a14", "b06", "b11", "c03", "c15", "d04", "d08", "e10", "f04", "g02", "g09", "g14", "h03", "h06", "h11", "i01", "j01", "k05",
           "l01", "m04", "n02")
NAMES = [n for n in queries() if os.environ.get("PLURALITY_ORACLE") == "all" or n.split("_")[0] in DEFAULT]


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, data, name):
    line = compare(spark, duck, name, queries()[name], oracle_sql().get(name), data)
    assert line.startswith(("ok", "ROWS")), line


def test_every_operator_has_a_query():
    assert len(QUERIES) == 204 and set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_queries_without_the_optional_subpackage():
    """A process in which the subpackage cannot be imported still has every other query, though the pipeline's file is there."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == 'plurality.llm' or name.startswith('plurality.llm.'):
            raise ModuleNotFoundError(name, name=name)
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith('plurality.llm') else real(name, package)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["204", "False", "False", "True"]


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["method", "group_kl", "row_kl", "n_rows", "n_groups"] and df.count() == 3


@pytest.mark.parametrize("name", ["g02_group_weighted_mean", "h03_soft_top_label_ece", "h06_risk_coverage", "g09_confusion_matrix", "d08_select_spectrogram_rows", "b11_analysis_strata"])
def test_plans_have_no_products_and_no_driver_collect(spark, data, name):
    plan = queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_it_needs(spark, data):
    from plurality.sources import standins as sv

    plan = sv.votes(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


@pytest.fixture(scope="module")
def lacking(data, tmp_path_factory):
    """The tables with recordings that lack one to four of their last channels, or all of them; the last one has one."""
    import duckdb

    at = tmp_path_factory.mktemp("lacking")
    for name in os.listdir(data):
        if name != "embeddings.parquet":
            (at / name).symlink_to(f"{data}/{name}")
    gone = "vec_id > 495 OR vec_id BETWEEN 493 AND 494 OR vec_id BETWEEN 485 AND 489 OR vec_id IN (24, 48, 49, 72, 73, 74)"
    duckdb.sql(f"COPY (SELECT * FROM '{data}/embeddings.parquet' WHERE NOT ({gone})) TO '{at}/embeddings.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["d07_window_extraction", "d11_interpolate_small_gaps", "e02_bipolar_differences", "e03_median_removal", "e04_framing", "e05_hann_taper",
                                  "e06_power_spectrum", "e07_frame_validity", "e08_regional_mean", "e09_frequency_rebinning", "e10_time_rebinning", "e11_full_encoding"])
def test_recordings_that_lack_channels_match_sql(spark, lacking, name):
    """The queries had rows for channels, leads and regions that a recording does not have."""
    line = compare(spark, connect(lacking), name, queries()[name], oracle_sql()[name], lacking)
    assert line.startswith("ok"), line
