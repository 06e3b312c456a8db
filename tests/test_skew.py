"""One key holds a third of all rows: results stay whole and equal to a brute-force count."""

from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewarden.operators import drift, integrity, joins
from tablewarden.operators.fold import fold_in_order


@pytest.fixture(scope="module")
def hot(spark):
    ids = spark.range(9000)
    return ids.select(
        F.when(F.col("id") < 3000, 7).otherwise(F.col("id") * 31 % 997).alias("k"),
        (F.col("id") % 5).alias("kind"), "id").cache()


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(1200).withColumnRenamed("id", "k")


def test_flags(hot, keys):
    found = joins.membership_flags(keys, hot, ["k"], {"a": F.col("kind") == 0, "b": F.col("id") >= 8990})
    data = hot.collect()
    a = {r.k for r in data if r.kind == 0}
    b = {r.k for r in data if r.id >= 8990}
    assert {(r.k, r.a, r.b) for r in found.collect()} == {
        (k, "Y" if k in a else "N", "Y" if k in b else "N") for k in range(1200)}


def test_guards(hot, keys):
    known = {r.k for r in hot.collect()}
    assert {r.k for r in joins.not_in(keys, hot, {"k": "k"}).collect()} == set(range(1200)) - known
    assert {r.k for r in joins.in_set(keys, hot, {"k": "k"}).collect()} == known
    some = keys.filter("k < 500")
    assert joins.not_in(hot, some, {"k": "k"}).count() == sum(r.k >= 500 for r in hot.collect())


def test_repeated_keys(hot):
    counts = Counter(r.k for r in hot.collect())
    assert dict(rows(integrity.duplicate_keys(hot, ["k"]))) == {k: n for k, n in counts.items() if n > 1}


def test_drift_with_copies_on_the_source_side(hot, keys):
    registry = keys.filter("k < 900").select("k", (F.col("k") % 5).alias("v"), (F.col("k") % 4 > 0).alias("on"))
    source = hot.select("k", F.col("kind").alias("v"))
    attribute = [drift.Attribute("v", "v", "meta_v", "real_v", -1)]
    args = registry, source, {"k": "k"}, attribute, F.col("on")
    one, two = drift.attr_diff(*args), drift.attr_diff(*args, one_pass=False)
    assert rows(one) == rows(two)
    data = hot.collect()
    want = [(k, k % 5, None, "MISSING_IN_DB") for k in range(900) if k % 4 and k not in {r.k for r in data}]
    want += [(r.k, r.k % 5, r.kind, "MISMATCH") for r in data if r.k < 900 and r.k % 4 and r.k % 5 != r.kind]
    want += [(r.k, None, r.kind, "MISSING_IN_META") for r in data if r.k >= 900]
    assert rows(one) == sorted(want, key=repr)


@pytest.fixture
def eager_skew_join(spark):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_split_by_the_guards_and_lookups(spark, eager_skew_join):
    hot = spark.range(0, 200000, 1, 8).select(
        F.when(F.col("id") < 70000, 7).otherwise(F.col("id") % 9973).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keys = spark.range(5000).select(F.col("id").alias("k"))
    guard = joins.not_in(hot, keys, {"k": "k"}).select("k", "v").groupBy().agg(F.max("v"), F.count("*"))
    lookup = joins.resolve_ids(hot, keys.select("k", (F.col("k") + 1).alias("TABLE_ID")), {"k": "k"}, "TABLE_ID").groupBy().agg(
        F.max("v"), F.count("TABLE_ID"))
    for df in (guard, lookup):
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_fold_of_a_hot_key_spans_pieces(spark):
    def value(k, i, step):
        return None if i % step else f"{k}:{i}"

    asked = [(k, i, value(k, i, 7), value(k, i, 113)) for k, n in ((1, 4000), (2, 3), (3, 1000)) for i in range(1, n + 1)]
    frame = spark.createDataFrame(asked, "k long, turn long, a string, b string").repartition(5)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        found = fold_in_order(frame, ["k"], ["turn"], ["a", "b"], "done").collect()
        spread = frame.repartitionByRange("k", "turn").filter("k = 1").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset(merging)
    expected, latest, last = set(), {}, {k: i for k, i, _, _ in asked}
    for k, i, a, b in asked:
        before = latest.get(k, (None, None))
        latest[k] = (a or before[0], b or before[1])
        expected.add((k, i, *latest[k], i == last[k]))
    assert len(found) == len(asked) and set(map(tuple, found)) == expected
    assert spread > 1
