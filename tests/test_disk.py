"""What the jobs hold on the disks at once: the shuffles of one phase, not those of a whole load or batch."""

import os
import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tablewarden.operators.history import snapshot
from tablewarden.plans import load
from tablewarden.plans.changes import columns as column_requests
from tablewarden.schemas import COLUMN, ENTITIES
from tablewarden.session import durable
from workload.derived import relation

TABLES, EACH = 4000, 5


def shuffled(spark):
    """Bytes of the shuffle files there are."""
    dirs, found = spark._jsc.sc().env().blockManager().diskBlockManager().localDirs(), 0
    for top in [str(d) for d in dirs]:
        for folder, _, names in os.walk(top):
            for name in names:
                try:
                    found += os.path.getsize(f"{folder}/{name}") if name.startswith("shuffle_") else 0
                except OSError:
                    pass  # it went meanwhile
    return found


def written(spark):
    """The folders of written rows."""
    durable(spark.range(1))
    return set(os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/work"))


@contextmanager
def most_at_once(spark):
    """A list that holds, at the end, the largest number of bytes shuffled that lay on the disk."""
    spark._jvm.System.gc()  # what tests before this one left goes now
    time.sleep(1)
    before, seen, over = shuffled(spark), [0], threading.Event()

    def watch():
        while not over.is_set():
            seen[0] = max(seen[0], shuffled(spark) - before)
            over.wait(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        yield seen
    finally:
        seen[0] = max(seen[0], shuffled(spark) - before)
        over.set()
        watcher.join()


@pytest.fixture
def big(spark):
    """Joins and broadcasts as with tables that are too large for one task."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "64k"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def mixed(name, i):
    """A name that does not follow the order of ids and that compresses badly."""
    return F.concat(F.lit(name), F.upper(F.substring(F.sha2(i.cast("string"), 256), 1, 16)))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables with columns, of which nine in ten are registered, and an index on each table's first column."""
    top = tmp_path_factory.mktemp("made")

    def kept(name, df):
        df.write.parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    i, table = F.col("id"), (F.col("id") % TABLES)
    rows = spark.range(TABLES * EACH)
    names = [F.lit("SVC1").alias("OWNER"), mixed("TB_", table).alias("TABLE_NAME"), mixed("C", i).alias("COLUMN_NAME")]
    out = {
        "table": kept("table", spark.range(TABLES).select(
            i.alias("TABLE_ID"), F.lit("SVC1").alias("SCHEMA_NAME"), mixed("TB_", i).alias("TABLE_NAME"))),
        "column": kept("column", rows.where("id % 10 > 0").select(
            i.alias("COLUMN_ID"), table.alias("TABLE_ID"), mixed("C", i).alias("COLUMN_NAME"), F.lit(1).alias("COLUMN_ORDER"))),
        "index": kept("index", rows.where(f"id < {TABLES}").select(
            i.alias("INDEX_ID"), i.alias("TABLE_ID"), mixed("IX_", i).alias("INDEX_NAME"))),
        "index_column": kept("index_column", rows.where(f"id < {TABLES}").select(
            i.alias("INDEX_ID"), F.lit(1).alias("COLUMN_POS"), mixed("C", i).alias("COLUMN_NAME"))),
        "tab_columns": kept("tab_columns", rows.select(
            *names, i.cast("int").alias("COLUMN_ID"), F.lit("DATE").alias("DATA_TYPE"), F.lit(7).alias("DATA_LENGTH"),
            F.lit(None).cast("int").alias("DATA_PRECISION"), F.lit(None).cast("int").alias("DATA_SCALE"), F.lit("Y").alias("NULLABLE"))),
        "cons_columns": kept("cons_columns", rows.select(F.concat(F.lit("P_"), i).alias("CONSTRAINT_NAME"), *names)),
        "constraints": kept("constraints", rows.select(
            F.lit("SVC1").alias("OWNER"), F.concat(F.lit("P_"), i).alias("CONSTRAINT_NAME"), F.lit("P").alias("CONSTRAINT_TYPE"),
            F.lit(None).cast("string").alias("INDEX_NAME"), F.when(i % 20 == 0, "ENABLED").otherwise("DISABLED").alias("STATUS"))),
        "col_comments": kept("col_comments", rows.select(*names, F.lit("why").alias("COMMENTS"))),
        "encrypted": kept("encrypted", rows.where("id % 30 = 0").select(*names, F.lit("AES").alias("ENCRYPTION_ALG"))),
        "asked": kept("asked", rows.select(
            i.alias("request_id"), i.alias("request_seq"), F.lit("why").alias("reason"), F.lit("E1").alias("emp_id"),
            F.lit("svc1").alias("schema"), F.lower(mixed("TB_", table)).alias("tableName"), F.lower(mixed("C", i)).alias("colName"))),
    }
    return out


def registered(frame, made, *entities):
    whole = {n: frame(n, []) for n in ENTITIES}
    return whole | {n: whole[n].unionByName(made[n], allowMissingColumns=True) for n in entities}


def once(spark, df):
    """Bytes of these rows shuffled once."""
    with most_at_once(spark) as seen:
        df.repartition(*df.columns).write.format("noop").mode("overwrite").save()
    return seen[0]


def test_written_rows_leave_no_shuffles(spark):
    before = shuffled(spark)
    durable(spark.range(200_000).withColumn("x", F.rand()).repartition("x"))
    for _ in range(100):  # Spark removes them behind the job
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before


def test_loading_columns_shuffles_whole_rows_of_new_ones_only(spark, frame, made, big):
    main = registered(frame, made, "table", "column")
    whole = once(spark, made["tab_columns"])
    with most_at_once(spark) as seen:
        rows = load.load_columns(
            made["tab_columns"], main["table"], made["col_comments"], made["constraints"], made["cons_columns"],
            made["encrypted"], main["column"], load.Stamp("2024-01-01"))
        found = rows.select("COLUMN_ORDER", "TABLE_ID", "PK_YN", "ENCRYPTION_YN", "DESCRIPTION").collect()
    new = [i for i in range(TABLES * EACH) if i % 10 == 0]
    assert sorted(found) == [
        (i, i % TABLES, "Y" if i % 20 == 0 else "N", "Y" if i % 30 == 0 else "N", "why") for i in new]
    assert seen[0] < 1.8 * whole


def test_a_column_without_a_name_is_loaded_with_the_names_that_repeat(frame):
    tables = frame("table", [dict(TABLE_ID=t, SCHEMA_NAME="S", TABLE_NAME="A") for t in (1, 2)])
    names = ["X", "X", None, "Y"]
    listed = frame("tab_columns", [dict(OWNER="S", TABLE_NAME="A", COLUMN_NAME=n, COLUMN_ID=i) for i, n in enumerate(names)])
    known = frame("column", [dict(COLUMN_ID=7, TABLE_ID=2, COLUMN_NAME="Y")])
    none = [frame(n, []) for n in ("col_comments", "constraints", "cons_columns", "encrypted_columns")]
    found = load.load_columns(listed, tables, *none, known, load.Stamp("2024-01-01")).collect()
    # Each row for both tables of the name; Y is known by its name, whichever of them has it.
    assert sorted((r.TABLE_ID, r.COLUMN_ORDER) for r in found) == [(t, o) for t in (1, 2) for o in (0, 1, 2)]
    assert sorted(r.COLUMN_ID for r in found) == list(range(8, 14))


@pytest.mark.parametrize("kind", ["add", "drop"])
def test_screening_moves_whole_requests_by_one_key_at_a_time(spark, frame, made, big, kind):
    main = registered(frame, made, "table", "column")
    asked = made["asked"].withColumns(
        {"dataType": F.lit("DATE"), "columnOrder": F.lit("9")} if kind == "add" else {"mode": F.lit("SOFT")})
    whole = once(spark, asked)
    with most_at_once(spark) as seen:
        if kind == "add":
            done = column_requests.column_add(main, asked, "2024-01-01")
            assert done.rejects.count() == TABLES * EACH * 9 // 10
        else:
            done = column_requests.column_drop(main, asked, "2024-01-01")
            assert done.rejects.count() == TABLES * EACH // 10
    assert seen[0] < 3 * whole


def test_lines_are_shuffled_once_for_their_groups_and_orders(spark, tmp_path, big):
    i = F.col("id")
    spark.range(100_000).select(
        (i % 30_000).alias("l_orderkey"), i.alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit("A").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit(3.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit(0.1).alias("l_tax"),
        F.lit("1996-03-01").cast("timestamp").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30_000).select(
        i.alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.lit("1996-03-01").cast("timestamp").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("req_column", "real_columns"):
        text = relation(spark, str(tmp_path), name)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 2


def test_dropping_columns_joins_the_registry_step_by_step(spark, frame, made, big):
    main = registered(frame, made, "table", "column", "index", "index_column")
    asked = made["asked"].withColumn("mode", F.lit("HARD"))
    with most_at_once(spark) as seen:
        done = column_requests.column_drop(main, asked, "2024-01-01", full_history=True)
        gone = [done.history[n].count() for n in ("column", "index", "index_column")]
    dropped = TABLES * 9 // 10
    assert gone == [TABLES * EACH * 9 // 10, dropped, dropped]
    assert done.replace["index"].count() == TABLES - dropped
    assert seen[0] < 4 * once(spark, asked)


def test_a_load_writes_its_entities_one_after_the_other(spark, frame, made, big):
    catalog = {n: frame(n, []) for n in ("tables", "views", "tab_comments", "indexes", "ind_columns", "sequences")}
    catalog |= {n: made[n] for n in ("tab_columns", "col_comments", "constraints", "cons_columns")}
    catalog["encrypted_columns"] = made["encrypted"]
    main = registered(frame, made, "table", "column")
    before = written(spark)
    added = load.load_objects(catalog, main, ["SVC1"], frame("code", []), load.Stamp("2024-01-01"))
    with most_at_once(spark) as seen:
        assert snapshot(added["column"], COLUMN, "I", "why", "me", "2024-01-01").count() == TABLES * EACH // 10
    # Counted from what is written: one number per task meets, and no row is joined again.
    assert seen[0] < 2000
    # Nothing else stays of the steps to them than a folder each for tables, views and four more; one is of this question.
    assert len(written(spark) - before) == 6 + 1
