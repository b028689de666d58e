import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from registry.oracles import ORACLES
from registry.queries import REGISTRY

@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    first = contract.entry(spark)
    assert first.columns == ["feature", "mi_sum"] and first.count() == 3


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    for name in ("surveyloom", "registry"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert set(names.stdout.split()) >= set(REGISTRY) and "pipeline" not in names.stdout.split()


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert not set(ORACLES) - set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(spark, con, sf, name) is None


@pytest.mark.parametrize("name", [
    "mutual_information", "training_set", "covariance_report", "label_maps", "pad_batches", "contingency",
    "covariance_matrix", "exact_sample", "generate_candidates", "kfold_assign", "prepare_numeric",
])
def test_no_slow_operators(spark, sf, name):
    plan = REGISTRY[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
