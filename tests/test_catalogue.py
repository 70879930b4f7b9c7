"""Every catalogue query against its DuckDB oracle, and the shape of its plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from carepath.plans import catalogue, oracle  # noqa: E402
from conftest import plan_of  # noqa: E402

# the training-data queries have their own tests in tests/llm
NAMES = list(catalogue.QUERIES)
# one-row frames, and blocks of stated queries against blocks of the corpus
CROSS_JOINS = ("journey_on_date", "tool_dispatch", "vector_topk")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_oracle(spark, duck, sf_dir, name):
    ok, text = check.compare(spark, duck, name, sf_dir)
    assert ok, text


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("sink", "dataset_l", "monitor", "quality", "error"))])
def test_no_cross_join_and_no_row_python(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan or (name in CROSS_JOINS and not bad.endswith("EvalPython"))
    if name != "vector_topk":
        assert "Python" not in plan and "InPandas" not in plan


def test_entry_gives_one_patients_journey(spark):
    got = entry.entry(spark).collect()
    assert got and len({r.patient_id for r in got}) == 1
    dates = [r.event_date for r in got]
    assert dates == sorted(dates)
    assert {r.kind for r in got} == {"enrollment", "medical_claim", "diagnosis", "pharmacy_claim", "procedure"}
