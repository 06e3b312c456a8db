from pyspark.sql import functions as F

from tablewarden.operators.ids import assign_ids, next_ordinals, ordinal_in_parent
from tablewarden.operators.text_lists import ordered_text


def test_ids_are_dense_and_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    found = assign_ids(df, "n", 100, ["k"]).collect()
    assert sorted(r.n for r in found) == list(range(101, 1101))
    assert all(r.n == 101 + r.k for r in found)
    assert sorted(r.n for r in assign_ids(df, "n").collect()) == list(range(1, 1001))


def test_ids_of_no_rows(spark):
    assert assign_ids(spark.range(0), "n", 5, ["id"]).count() == 0


def test_one_parent_with_a_third_of_the_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50 + 1).alias("p"), (-F.col("id")).alias("o"))
    found = ordinal_in_parent(df, ["p"], ["o"], "n").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.p, []).append((r.o, r.n))
    assert len(found) == 3000
    for members in groups.values():
        assert [n for _, n in sorted(members)] == list(range(1, len(members) + 1))


def test_next_ordinals_continue_behind_the_last(spark):
    have = spark.createDataFrame([(1, 4), (1, 2), (2, 1)], "t int, o int")
    want = spark.createDataFrame([(1, 10), (1, 5), (3, 7), (2, 1)], "t int, seq int")
    found = next_ordinals(want, have, ["t"], "o", ["seq"], "n").collect()
    assert {(r.t, r.seq): r.n for r in found} == {(1, 5): 5, (1, 10): 6, (2, 1): 2, (3, 7): 1}


def test_text_in_pieces_equals_text_in_one(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 500).alias("o"))
    whole = ordered_text(df, ["k"], [F.col("o")], F.col("o"), "t")
    parts = ordered_text(df, ["k"], [F.col("o")], F.col("o"), "t", piece=[F.floor(F.col("o") / 16)])
    assert sorted(whole.collect()) == sorted(parts.collect())
    for r in whole.collect():
        values = [int(v) for v in r.t.split(", ")]
        assert values == sorted(values)
