"""Queries that run the operators on the business tables themselves, keyed by their own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions import types
from tablewarden.functions.names import check_name, errors
from tablewarden.functions.text import (
    cut, ensure_prefix, join_text, number_or_null, sql_quote, trim_all, yes_no,
)
from tablewarden.operators import history, integrity
from tablewarden.operators.backfill import phase_counts
from tablewarden.operators.drift import Attribute, attr_diff
from tablewarden.operators.filters import exclude_kinds, exclude_like, with_defaults
from tablewarden.operators.ids import assign_ids, last_id, next_ordinals, ordinal_in_parent
from tablewarden.operators.joins import in_set, membership_flags, not_in
from tablewarden.operators.text_lists import ordered_text
from tablewarden.operators.views import masked_view
from tablewarden.plans.changes.common import fold_patches, patch
from tablewarden.plans.load import index_type
from tablewarden.schemas import Column, Entity
from workload.derived import collector, given

AS_OF = "2024-01-01 00:00:00"
query, QUERIES, ORACLES = collector()


def _new_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = exclude_like(given(spark, sf_dir, "part"), "p_name", ["b_u%"])
    bulk = given(spark, sf_dir, "lineitem").filter("l_quantity > 48")
    return not_in(parts, bulk, {"p_partkey": "l_partkey"})


@query("""
    SELECT p_partkey, substring(p_name, 1, 2000) AS description, p_type, 'UNASSIGNED' AS service_cd
    FROM {part} WHERE p_name NOT LIKE 'b_u%' AND coalesce(p_type, 'HEAP') NOT IN ('PROMO', 'SMALL')
      AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def load_guarded_insert(spark, sf_dir):
    kept = exclude_kinds(_new_parts(spark, sf_dir), "p_type", ["PROMO", "SMALL"], "HEAP")
    rows = kept.select("p_partkey", cut(F.col("p_name")).alias("description"), "p_type")
    return with_defaults(rows, {"service_cd": "UNASSIGNED"})


@query("""
    SELECT p_partkey, p_name, (SELECT max(l_partkey) FROM {lineitem}) + row_number() OVER (ORDER BY p_partkey) AS new_id
    FROM {part} WHERE p_name NOT LIKE 'b_u%'
      AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def load_assign_ids(spark, sf_dir):
    last = last_id(given(spark, sf_dir, "lineitem"), "l_partkey")
    new = _new_parts(spark, sf_dir).select("p_partkey", "p_name")
    return assign_ids(new, "new_id", last, ["p_partkey"])


@query("""
    SELECT o_orderkey, o_orderstatus,
           CASE WHEN EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'Y' ELSE 'N' END AS returned_yn,
           CASE WHEN EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') THEN 'Y' ELSE 'N' END AS open_yn
    FROM {orders}""")
def load_key_flags(spark, sf_dir):
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = given(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return membership_flags(
        orders, lines, ["o_orderkey"],
        {"returned_yn": F.col("l_returnflag") == "R", "open_yn": F.col("l_linestatus") == "O"},
    )


@query("""
    SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 'BITMAP' WHEN p_type LIKE 'P%' THEN 'FUNCTION'
                           WHEN p_size > 40 THEN 'UNIQUE' ELSE 'NORMAL' END AS type_cd
    FROM {part}""")
def load_classify(spark, sf_dir):
    kind = F.when(F.col("p_type") == "STANDARD", "BITMAP").when(
        F.col("p_type").like("P%"), "FUNCTION-BASED NORMAL"
    ).otherwise("NORMAL")
    unique = F.when(F.col("p_size") > 40, "UNIQUE").otherwise("NONUNIQUE")
    return given(spark, sf_dir, "part").select("p_partkey", index_type(kind, unique).alias("type_cd"))


ORDER = Entity(
    "orders",
    (Column("o_orderkey", "id"), Column("o_orderstatus", "text"), Column("o_orderpriority", "text")),
    primary_key=("o_orderkey",),
)


@query("""
    WITH hist AS (
        SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'U' ELSE 'I' END AS ht,
               CASE o_orderstatus WHEN 'O' THEN 'new service' ELSE 'INITIAL_LOAD' END AS cr
        FROM {orders} WHERE o_orderstatus <> 'P')
    SELECT 'I' AS HIST_TYPE, TIMESTAMP '2024-01-01 00:00:00' AS HIST_AT, 'LOADER' AS HIST_BY,
           'INITIAL_LOAD' AS CHANGE_REASON, o_orderkey, o_orderstatus, o_orderpriority
    FROM {orders} o WHERE NOT EXISTS (
        SELECT 1 FROM hist h WHERE h.o_orderkey = o.o_orderkey AND ht = 'I' AND cr = 'INITIAL_LOAD')""")
def hist_initial_guard(spark, sf_dir):
    orders = given(spark, sf_dir, "orders")
    past = orders.filter("o_orderstatus <> 'P'").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "U").otherwise("I").alias("HIST_TYPE"),
        F.when(F.col("o_orderstatus") == "O", "new service").otherwise("INITIAL_LOAD").alias("CHANGE_REASON"),
    )
    return history.initial_history(orders, past, ORDER, AS_OF, "LOADER")


@query("""
    SELECT 'U' AS HIST_TYPE, TIMESTAMP '2024-01-01 00:00:00' AS HIST_AT, 'E1' AS HIST_BY,
           'soft delete' AS CHANGE_REASON, o_orderkey, 'DEPRECATED' AS o_orderstatus, o_orderpriority
    FROM {orders} WHERE o_orderstatus = 'P'""")
def hist_after_image(spark, sf_dir):
    after = given(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumn(
        "o_orderstatus", F.lit("DEPRECATED")
    )
    return history.snapshot(after, ORDER, "U", "soft delete", "E1", AS_OF)


@query("""
    SELECT c_custkey AS object_key, 'N' AS view_yn FROM {customer}
    WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)
    UNION ALL
    SELECT p_partkey, 'Y' FROM {part}
    WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def drift_missing_in_registry(spark, sf_dir):
    customers = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_key"))
    parts = given(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_key"))
    bulk = given(spark, sf_dir, "lineitem").filter("l_quantity > 48")
    without_orders = not_in(customers, given(spark, sf_dir, "orders"), {"object_key": "o_custkey"})
    without_bulk = not_in(parts, bulk, {"object_key": "l_partkey"})
    return without_orders.withColumn("view_yn", F.lit("N")).unionByName(
        without_bulk.withColumn("view_yn", F.lit("Y"))
    )


@query("""
    SELECT o_orderkey, o_orderstatus FROM {orders} o WHERE o_orderpriority <> '5-LOW'
      AND NOT (o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))
      AND NOT (o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_linestatus = 'O'))""")
def drift_missing_in_source(spark, sf_dir):
    active = given(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(
        "o_orderkey", "o_orderstatus"
    )
    # One scan of the lines: each line stands for an F object, an O object, both or none.
    kinds = F.array(
        F.when(F.col("l_returnflag") == "R", "F"), F.when(F.col("l_linestatus") == "O", "O")
    )
    found = given(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")
    )
    return not_in(active, found, {"o_orderkey": "l_orderkey", "o_orderstatus": "kind"})


@query("""
    WITH registry AS (
        SELECT o_orderkey AS k, o_orderstatus AS st,
               CASE WHEN o_totalprice > 250000 THEN 1 WHEN o_totalprice > 50000 THEN 0 END AS size_class,
               o_orderpriority <> '1-URGENT' AS active
        FROM {orders} WHERE o_orderpriority <> '5-LOW'),
    source AS (
        SELECT l_orderkey AS k,
               CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS st,
               CASE WHEN count(*) > 4 THEN 1 WHEN count(*) > 1 THEN 0 END AS size_class
        FROM {lineitem} GROUP BY l_orderkey)
    SELECT r.k AS order_key, r.st AS meta_status, s.st AS real_status,
           r.size_class AS meta_size, s.size_class AS real_size,
           CASE WHEN s.k IS NULL THEN 'MISSING_IN_DB' ELSE 'MISMATCH' END AS diff_kind
    FROM registry r LEFT JOIN source s ON s.k = r.k
    WHERE r.active AND (s.k IS NULL OR r.st <> s.st OR coalesce(r.size_class, -1) <> coalesce(s.size_class, -1))
    UNION ALL
    SELECT s.k, NULL, s.st, NULL, s.size_class, 'MISSING_IN_META'
    FROM source s LEFT JOIN registry r ON r.k = s.k WHERE r.k IS NULL""")
def drift_attr_diff(spark, sf_dir):
    price = F.col("o_totalprice")
    registry = given(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("order_key"),
        "o_orderstatus", "o_orderpriority",
        F.when(price > 250000, 1).when(price > 50000, 0).alias("size_class"),
    )
    lines = F.count(F.lit(1))
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    source = given(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.when(low == high, low).otherwise("P").alias("line_status"),
        F.when(lines > 4, 1).when(lines > 1, 0).alias("line_class"),
    )
    return attr_diff(
        registry, source, {"order_key": "l_orderkey"},
        [
            Attribute("o_orderstatus", "line_status", "meta_status", "real_status"),
            Attribute("size_class", "line_class", "meta_size", "real_size", -1),
        ],
        active=F.col("o_orderpriority") != "1-URGENT",
    )


@query("SELECT o_orderpriority, count(*) AS cnt FROM {orders} GROUP BY o_orderpriority")
def code_group_counts(spark, sf_dir):
    return integrity.count_per_group(given(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
    SELECT 'ORDERS' AS src, (SELECT count(*) FROM {orders}) AS main, (SELECT count(DISTINCT l_orderkey) FROM {lineitem}) AS hist
    UNION ALL
    SELECT 'PART', (SELECT count(*) FROM {part}), (SELECT count(DISTINCT l_partkey) FROM {lineitem})""")
def main_hist_counts(spark, sf_dir):
    lines = given(spark, sf_dir, "lineitem")
    return integrity.count_pair(
        "ORDERS", given(spark, sf_dir, "orders"), lines.select("l_orderkey").distinct()
    ).unionByName(
        integrity.count_pair("PART", given(spark, sf_dir, "part"), lines.select("l_partkey").distinct())
    )


@query("""
    SELECT s_suppkey AS id, 'bad s_nationkey: ' || s_nationkey AS issue FROM {supplier}
    WHERE NOT EXISTS (SELECT 1 FROM {nation} WHERE n_nationkey = s_nationkey AND n_regionkey = 1)
    UNION ALL
    SELECT c_custkey, 'bad c_mktsegment: ' || c_mktsegment FROM {customer}
    WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')""")
def code_violations(spark, sf_dir):
    nations = given(spark, sf_dir, "nation").filter("n_regionkey = 1").select(
        F.lit("NATION").alias("CODE_GROUP"), F.col("n_nationkey").cast("string").alias("CODE_VALUE")
    )
    segments = spark.createDataFrame(
        [("SEGMENT", "BUILDING"), ("SEGMENT", "AUTOMOBILE")], "CODE_GROUP string, CODE_VALUE string"
    )
    codes = nations.unionByName(segments)

    def check(table, key, rule):
        rows = given(spark, sf_dir, table).withColumnRenamed(key, "id")
        return integrity.code_violations(rows, ["id"], [rule], codes, "bad {column}: ")

    return check("supplier", "s_suppkey", integrity.CodeRule("s_nationkey", "NATION")).unionByName(
        check("customer", "c_custkey", integrity.CodeRule("c_mktsegment", "SEGMENT", skip_null=True))
    )


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM {lineitem}
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def constraint_unique(spark, sf_dir):
    return integrity.duplicate_keys(given(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem}
    WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {part} WHERE p_partkey = l_partkey AND p_size < 40)""")
def constraint_fk(spark, sf_dir):
    lines = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = given(spark, sf_dir, "part").filter("p_size < 40")
    return integrity.orphans(lines, parts, {"l_partkey": "p_partkey"}, unique=True)


@query("""
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders}
    WHERE NOT (o_orderstatus IN ('F', 'O') AND o_totalprice >= 0)""")
def constraint_check(spark, sf_dir):
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return integrity.failing_check(
        orders, F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") >= 0)
    )


@query("""
    SELECT d.doc_id, lang, n_chars, quality FROM {documents} d JOIN {labels} b ON b.doc_id = d.doc_id
    WHERE lang LIKE 'e_%' AND n_chars IS NOT NULL""")
def backfill_pending(spark, sf_dir):
    pending = given(spark, sf_dir, "documents").filter(
        F.col("lang").like("e_%") & F.col("n_chars").isNotNull()
    ).select("doc_id", "lang", "n_chars")
    labels = given(spark, sf_dir, "labels").select("doc_id", "quality")
    return pending.join(labels, "doc_id").orderBy("lang", "doc_id")


@query("""
    SELECT 'PENDING' AS phase, count(*) AS cnt FROM {documents} d LEFT JOIN {labels} b ON b.doc_id = d.doc_id WHERE quality IS NULL
    UNION ALL
    SELECT 'BACKFILLED', count(*) FROM {documents} d LEFT JOIN {labels} b ON b.doc_id = d.doc_id WHERE quality IS NOT NULL""")
def backfill_phase_counts(spark, sf_dir):
    labels = given(spark, sf_dir, "labels").select("doc_id", "quality")
    state = given(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select(
        F.when(F.col("quality").isNull(), "PENDING").otherwise("BACKFILLED").alias("phase")
    )
    return phase_counts(state, ["PENDING", "BACKFILLED"])


@query("""
    SELECT l_orderkey, 'CREATE OR REPLACE VIEW VW_O' || l_orderkey || ' AS SELECT '
           || string_agg('C' || l_partkey, ', ' ORDER BY l_linenumber, l_partkey) || ' FROM O' || l_orderkey || ';' AS ddl
    FROM {lineitem} WHERE l_returnflag = 'N' GROUP BY l_orderkey""")
def view_ddl(spark, sf_dir):
    lines = given(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )
    # The pieces follow the order (line number, part), so an order with very many lines is split.
    listed = ordered_text(
        lines, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")],
        F.concat(F.lit("C"), "l_partkey"), "_list",
        piece=[F.col("l_linenumber"), F.floor(F.col("l_partkey") / 4096)],
    )
    name = F.col("l_orderkey").cast("string")
    ddl = join_text(
        F.lit("CREATE OR REPLACE VIEW VW_O"), name, F.lit(" AS SELECT "), F.col("_list"),
        F.lit(" FROM O"), name, F.lit(";"),
    )
    return listed.select("l_orderkey", ddl.alias("ddl"))


@query("""
    SELECT l_orderkey, count(*) AS total_col, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS open_col,
           CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS closed_col
    FROM {lineitem} GROUP BY l_orderkey HAVING sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 0""")
def view_all_pci(spark, sf_dir):
    is_open = F.col("l_returnflag") == "N"
    return (
        given(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("total_col"),
            F.sum(F.when(is_open, 1).otherwise(0)).alias("open_col"),
            F.sum(F.when(~is_open, 1).otherwise(0)).alias("closed_col"),
        ).filter("open_col = 0").orderBy("l_orderkey")
    )


@query("""
    SELECT doc_id, CAST(strlen(text) + 3 AS INTEGER) AS gen_name_bytes FROM {documents}
    WHERE strlen(text) + 3 > 2000 ORDER BY gen_name_bytes DESC""")
def name_bytes_over(spark, sf_dir):
    sized = given(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length("text") + 3).alias("gen_name_bytes")
    )
    return sized.filter("gen_name_bytes > 2000").orderBy(F.desc("gen_name_bytes"))


@query("""
    SELECT c_custkey, substring(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS c_name, '********' AS c_mktsegment
    FROM {customer}""")
def masked_projection(spark, sf_dir):
    described = [("C_CUSTKEY", 1, "N", None), ("C_NAME", 2, "Y", "NAME"), ("C_MKTSEGMENT", 3, "Y", "FULL")]
    meta = spark.createDataFrame(
        [(n, o, "N", m, r, "ACTIVE") for n, o, m, r in described],
        "COLUMN_NAME string, COLUMN_ORDER int, PCI_YN string, MASKING_YN string, MASKING_RULE_CD string, STATUS_CD string",
    )
    return masked_view(given(spark, sf_dir, "customer"), meta)


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
           CASE WHEN o_orderstatus = 'P' THEN 'E1' END AS UPDATED_BY
    FROM {orders}""")
def apply_patch(spark, sf_dir):
    orders = given(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.lit(None).cast("string").alias("UPDATED_BY"), F.lit(None).cast("timestamp").alias("UPDATED_AT"),
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    asked = orders.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("key"),
        F.when(urgent, F.array(F.lit("status"))).when(
            F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("price"))
        ).otherwise(F.array().cast("array<string>")).alias("touched"),
        F.lit(None).cast("string").alias("status"),
        (F.col("o_totalprice") * 2).alias("price"),
        F.lit("why").alias("reason"), F.lit("E1").alias("_actor"),
        F.col("o_orderkey").alias("request_id"), F.lit(1).alias("request_seq"),
    )
    touched = F.col("touched")
    key = {"key": "o_orderkey"}
    folded = fold_patches(
        asked, key,
        {
            "o_orderstatus": (F.array_contains(touched, "status"), F.col("status")),
            "o_totalprice": (F.array_contains(touched, "price"), F.col("price")),
        },
    )
    return patch(orders, folded, key, AS_OF).select("o_orderkey", "o_orderstatus", "o_totalprice", "UPDATED_BY")


@query("""
    WITH asked AS (
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS turn,
               l_returnflag, l_linestatus, l_discount, l_extendedprice FROM {lineitem})
    SELECT o_orderkey, turn, 'L' || l_returnflag AS UPDATED_BY,
           coalesce(last_value(CASE WHEN l_returnflag <> 'N' THEN l_linestatus END IGNORE NULLS) OVER upto, o_orderstatus) AS o_orderstatus,
           coalesce(last_value(CASE WHEN l_discount > 0.05 THEN l_extendedprice END IGNORE NULLS) OVER upto, o_totalprice) AS o_totalprice
    FROM asked JOIN {orders} ON o_orderkey = l_orderkey
    WINDOW upto AS (PARTITION BY l_orderkey ORDER BY turn)""")
def apply_patches_in_turn(spark, sf_dir):
    """Every line of an order is a request that changes it: one image of the order per line."""
    orders = given(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice",
        F.lit(None).cast("string").alias("UPDATED_BY"), F.lit(None).cast("timestamp").alias("UPDATED_AT"),
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    turns = ordinal_in_parent(given(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "request_seq")
    asked = turns.withColumns(
        {
            "request_id": F.col("l_orderkey"), "reason": F.col("request_seq").cast("string"),
            "_actor": F.concat(F.lit("L"), "l_returnflag"),
        }
    )
    key = {"l_orderkey": "o_orderkey"}
    folded = fold_patches(
        asked, key,
        {
            "o_orderstatus": (F.col("l_returnflag") != "N", F.col("l_linestatus")),
            "o_totalprice": (F.col("l_discount") > 0.05, F.col("l_extendedprice")),
        },
    )
    return patch(orders, folded, key, AS_OF, "every").select(
        "o_orderkey", F.col("_reason").cast("bigint").alias("turn"), "UPDATED_BY", "o_orderstatus", "o_totalprice"
    )


@query("""
    SELECT 'LINES' AS src, (SELECT count(*) FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')) AS removed,
           (SELECT count(*) FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')) AS kept
    UNION ALL
    SELECT 'ORDERS', (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'P'), (SELECT count(*) FROM {orders} WHERE o_orderstatus <> 'P')""")
def cascade_delete(spark, sf_dir):
    orders, lines = given(spark, sf_dir, "orders"), given(spark, sf_dir, "lineitem").select("l_orderkey")
    gone = orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    on = {"l_orderkey": "o_orderkey"}
    parts = [
        integrity.count_pair("LINES", in_set(lines, gone, on, unique=True), not_in(lines, gone, on, unique=True)),
        integrity.count_pair("ORDERS", gone, orders.filter("o_orderstatus <> 'P'")),
    ]
    return parts[0].unionByName(parts[1]).select(
        "src", F.col("main").alias("removed"), F.col("hist").alias("kept")
    )


@query("""
    SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F'
      AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')""")
def only_child_orphans(spark, sf_dir):
    parents = given(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    others = given(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    return not_in(parents, others, {"o_orderkey": "l_orderkey"})


@query("""
    SELECT p_partkey, trim(upper(p_name)) AS part_name,
           CASE WHEN starts_with(trim(upper(p_brand)), 'TB_') THEN trim(upper(p_brand)) ELSE 'TB_' || trim(upper(p_brand)) END AS table_name
    FROM {part}""")
def normalize_names(spark, sf_dir):
    return given(spark, sf_dir, "part").select(
        "p_partkey", trim_all(F.upper("p_name")).alias("part_name"),
        ensure_prefix(F.col("p_brand"), "TB").alias("table_name"),
    )


@query("""
    SELECT p_partkey, field, value, CASE WHEN NOT regexp_full_match(upper(value), '[A-Z][A-Z0-9_]*') THEN 'charset' ELSE 'length' END AS rule
    FROM (SELECT p_partkey, 'p_type' AS field, p_type AS value FROM {part}
          UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM {part}
          UNION ALL SELECT p_partkey, 'p_name', p_name FROM {part})
    WHERE NOT regexp_full_match(upper(value), '[A-Z][A-Z0-9_]*') OR length(value) > 128""")
def validate_names(spark, sf_dir):
    found = errors(*[check_name(f, F.col(f)) for f in ("p_type", "p_brand", "p_name")])
    return given(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("e")).select(
        "p_partkey", "e.field", "e.value", "e.rule"
    )


@query("""
    WITH items AS (
        SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item,
               generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM {part})
    SELECT p_partkey, CAST(pos AS INTEGER) AS column_pos, upper(item) AS column_name,
           CASE WHEN item IN ('widget', 'ring') THEN 'DESC' ELSE 'ASC' END AS sort_order
    FROM items""")
def parse_column_list(spark, sf_dir):
    listed = F.replace("p_name", F.lit(" "), F.lit(", "))
    listed = F.regexp_replace(listed, r"\b(widget|ring)\b", "$1 desc")
    return given(spark, sf_dir, "part").select(
        "p_partkey", F.posexplode(types.parse_index_columns(listed)).alias("pos", "c")
    ).select(
        "p_partkey", (F.col("pos") + 1).alias("column_pos"),
        F.col("c.name").alias("column_name"), F.col("c.sort").alias("sort_order"),
    )


@query("""
    SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'VARCHAR2(' || p_size || ')' WHEN p_type = 'PROMO' THEN 'CHAR(1)'
                           WHEN p_type = 'LARGE' THEN 'NUMBER(' || p_size || ',2)' ELSE p_type END AS type_text
    FROM {part}""")
def render_type(spark, sf_dir):
    kind = (
        F.when(F.col("p_type") == "SMALL", "varchar2").when(F.col("p_type") == "PROMO", "char")
        .when(F.col("p_type") == "LARGE", "number").otherwise(F.col("p_type"))
    )
    size = F.when(F.col("p_type") != "PROMO", F.col("p_size"))
    text = types.render_type(kind, size, F.col("p_size"), F.lit(2))
    return given(spark, sf_dir, "part").select("p_partkey", text.alias("type_text"))


@query("""
    SELECT conv_id, turn, CAST(coalesce((SELECT max(turn) FROM {conversations} o WHERE o.conv_id = u.conv_id AND role <> 'user'), 0)
           + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS new_order
    FROM {conversations} u WHERE role = 'user'""")
def next_ordinal(spark, sf_dir):
    turns = given(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    asked = turns.filter("role = 'user'").select("conv_id", "turn")
    return next_ordinals(
        asked, turns.filter("role <> 'user'"), ["conv_id"], "turn", ["turn"], "new_order"
    )


@query("""
    SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'NULL' ELSE '''' || replace(text, '''', '''''') || '''' END AS quoted,
           CASE WHEN lang IN ('en', 'fr') THEN 'Y' ELSE 'N' END AS flag,
           TRY_CAST(source AS INTEGER) AS source_number, CAST(n_chars AS INTEGER) AS n_chars
    FROM {documents}""")
def form_values(spark, sf_dir):
    flag = F.when(F.col("lang") == "en", "y").when(F.col("lang") == "fr", "Y").when(F.col("lang") == "de", "")
    return given(spark, sf_dir, "documents").select(
        "doc_id", sql_quote(F.col("text")).alias("quoted"), yes_no(flag).alias("flag"),
        number_or_null(F.col("source")).alias("source_number"),
        number_or_null(F.concat(F.lit(" "), "n_chars")).alias("n_chars"),
    )
