"""Plans that hold at scale: no cross joins, no Python, pushed filters, few shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tablewarden.operators import integrity, joins
from tablewarden.operators.ids import assign_ids
from tablewarden.plans.changes import columns as column_requests
from workload import business, governed, requested
from workload.derived import given

SF = "/root/testdata/sf0.001"
OWN = {name: q for part in (business, governed, requested) for name, q in part.QUERIES.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("name", list(OWN))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    text = plan(OWN[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, bad
    # The only window without a partition is the running sum over one row per task.
    for window in re.findall(r"Window \[.*?\], \[[^\]]*\]\n", text):
        assert "_size" in window


def test_attribute_drift_shuffles_each_side_once(spark, no_broadcast):
    text = plan(queries()["drift_attr_diff"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 2
    assert "FullOuter" in text


def test_guard_reads_only_the_keys_it_needs(spark, no_broadcast):
    text = plan(queries()["only_child_orphans"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_returnflag), Not(EqualTo(l_returnflag,R))" in text
    assert "LeftAnti" in text


def test_guard_combines_copies_before_the_shuffle(spark, no_broadcast):
    lines = given(spark, SF, "lineitem")
    orders = given(spark, SF, "orders").select("o_orderkey")
    text = plan(joins.not_in(orders, lines, {"o_orderkey": "l_orderkey"}))
    # distinct: partial aggregate, one exchange, final aggregate, and the join uses that exchange
    assert text.count("HashAggregate") == 2 and text.count("Exchange hashpartitioning") == 2


def test_flags_take_one_aggregate_and_one_join(spark, no_broadcast):
    text = plan(queries()["load_key_flags"](spark, SF))
    assert text.count("SortMergeJoin") == 1
    assert text.count("Exchange hashpartitioning") == 2


def test_code_checks_take_one_pass(spark, frame):
    codes = frame("code", [dict(CODE_GROUP="CD_STATUS", CODE_VALUE="ACTIVE")])
    lines = given(spark, SF, "lineitem").select(
        F.col("l_orderkey").alias("COLUMN_ID"), F.col("l_returnflag").alias("STATUS_CD"),
        F.col("l_linestatus").alias("PCI_CATEGORY_CD"), F.lit(None).cast("string").alias("MASKING_RULE_CD"))
    text = plan(integrity.code_violations(lines, ["COLUMN_ID"], integrity.COLUMN_CODES, codes))
    assert text.count("FileScan parquet") == 1


def test_numbering_moves_rows_by_range_and_not_to_one_task(spark):
    found = assign_ids(given(spark, SF, "lineitem").select("l_orderkey", "l_partkey"), "n", 0, ["l_orderkey", "l_partkey"])
    assert "SinglePartition" not in plan(found).split("BroadcastExchange")[0]


@pytest.mark.parametrize("threshold", ["1m", "-1"])
def test_spark_broadcasts_a_batch_by_its_bytes(spark, frame, no_broadcast, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    main = {
        "table": given(spark, SF, "orders").select(
            F.col("o_orderkey").alias("TABLE_ID"), F.lit("S").alias("SCHEMA_NAME"),
            F.concat(F.lit("TB_O"), "o_orderkey").alias("TABLE_NAME")),
        "column": frame("column", []).unionByName(given(spark, SF, "lineitem").select(
            F.col("l_partkey").alias("COLUMN_ID"), F.col("l_orderkey").alias("TABLE_ID"),
            F.concat(F.lit("C"), "l_partkey").alias("COLUMN_NAME")), allowMissingColumns=True),
        "index": frame("index", []), "index_column": frame("index_column", []),
    }
    asked = given(spark, SF, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("request_id"), F.col("n_nationkey").cast("bigint").alias("request_seq"),
        F.lit("why").alias("reason"), F.lit("s").alias("schema"), F.concat(F.lit("o"), "n_nationkey").alias("tableName"),
        F.lit("c1").alias("colName"), F.lit("SOFT").alias("mode"))
    done = column_requests.column_drop(main, asked, "2024-01-01")
    text = plan(done.replace["column"])
    shuffled = "SortMergeJoin" in text and "Exchange hashpartitioning" in text
    assert shuffled == (threshold == "-1")
