"""What the plans of the registered queries may not contain."""

from __future__ import annotations

import re

import pytest

from millrace_checks.all_checks import QUERIES
from millrace_checks.fixtures import table
from millrace.operators import filters
from millrace.plans import orders

FORBIDDEN = ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
LAZY = sorted(n for n in QUERIES if not n.startswith(("sink_", "stream_", "fanout", "control", "run_", "folder")))


def plan_of(df, mode="simple"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]
    if name != "sort_rows":  # there: one row per written file
        assert not re.search(r"Window \[.*\n.*Sort.*\n.*Exchange SinglePartition", plan)


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    df = filters.exclude_value(table(spark, sf_dir, "orders"), "o_orderstatus", "F")
    plan = plan_of(df.select("o_orderkey"))
    assert "Not(EqualNullSafe(o_orderstatus,F))" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", plan)


def test_nested_scan_reads_only_the_used_attributes(spark, sf_dir):
    plan = plan_of(QUERIES["qc_skip_event_type"](spark, sf_dir))
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "eventName" in schema and "Fonts" not in schema


def test_summary_has_no_shuffle(spark, sf_dir):
    from millrace_checks.fixtures import frame

    assert "Exchange" not in plan_of(orders.order_summary(frame(spark, sf_dir, "raw_orders")))
