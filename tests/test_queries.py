"""Every registered query against its SQL counterpart on the smallest supplied tables."""

import ast
import re
from pathlib import Path

import pytest

from compare import connect, differences
from __spark_entry__ import SMOKE_DIR, entry, oracle_sql
from pyspark.sql import functions as F
from tidemark.plans import derive, queries
from tidemark.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, SMOKE_DIR), duck, oracle_sql()[name]) == []


def test_names_match():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("job_", "stream_"))])
def test_plans_have_no_pairing_joins_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Python(UDF|RDD)|ArrowEval|MapInPandas|BatchEvalPython", plan)


def test_no_local_checkpoints_and_no_python_functions_over_rows():
    forbidden = {"localCheckpoint", "toPandas", "udf", "pandas_udf", "foreach", "crossJoin"}
    for path in (p for p in (ROOT / "tidemark").rglob("*.py") if "llm" not in p.parts):
        for node in ast.walk(ast.parse(path.read_text())):
            assert getattr(node, "attr", None) not in forbidden, path


@pytest.mark.parametrize("name", ["facts_unknown_fields", "facts_flatten_company", "facts_flatten_company_typed"])
def test_company_envelopes_are_gathered_in_one_shuffle_and_parsed_once(spark, name):
    """One exchange to gather the envelopes, one for the aggregation over what they hold."""
    plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan parquet") == 1


def test_neighbours_in_a_file_are_compared_across_blocks(spark, monkeypatch):
    """Rows 2 and 5 lie before a smaller key; in blocks of two rows the second pair parts at an edge."""
    monkeypatch.setattr(queries, "ORDER_BLOCK", 2)
    keys = [(i, k) for i, k in enumerate([1, 2, 9, 3, 4, 7, 6])]
    placed = spark.createDataFrame(keys, "row_index bigint, key int").withColumn("file", F.lit("a"))
    other = spark.createDataFrame([(0, 5), (1, 8)], "row_index bigint, key int").withColumn("file", F.lit("b"))
    assert queries.disordered(placed.unionByName(other), ["file"]).collect() == [(9, 2)]
    assert queries.disordered(placed.where("false"), ["file"]).collect() == [(0, 0)]


@pytest.mark.parametrize("name", ["figi_flatten", "facts_flatten", "facts_flatten_company_typed"])
def test_narrow_rows_are_dealt_to_tasks_of_a_bounded_number(spark, monkeypatch, name):
    """6,000 rows of lineitem, in tasks of 500."""
    monkeypatch.setattr(derive, "TASK_ROWS", 500)
    plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)[1] == "12"
    assert "REPARTITION_BY_COL" not in plan
