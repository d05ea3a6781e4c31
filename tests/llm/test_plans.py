"""Native operators run no Python on the executors; nothing is joined without a key."""

import re

import pytest

from segspark.llm import common, line_dedup, mixing, queries, secrets

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_secret_scan", "op8_line_dedup", "op10_mixing"])
def test_native_plans(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_native_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = secrets.parts(docs)
    for found in (parts, secrets.link(common.stash(parts)), mixing.mix(docs), line_dedup.remove_boilerplate(docs)):
        assert not re.search("Python|Pandas|Arrow", plan(found))
