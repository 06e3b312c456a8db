"""Index requests: create with a column list, and drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import check_name, problem
from tablewarden.functions.text import base_name, ensure_prefix, is_blank, number_or_null
from tablewarden.functions.types import parse_index_columns
from tablewarden.operators.filters import conform
from tablewarden.operators.history import snapshot
from tablewarden.operators.ids import assign_ids, last_id
from tablewarden.operators.joins import in_set, not_in
from tablewarden.plans.changes.common import (
    Change, add_error, asked_for, audit, begin, find_object, find_table, reject_repeats,
    settle, statements, with_errors, with_request,
)
from tablewarden.schemas import AUDIT_COLUMNS, INDEX, INDEX_COLUMN


def index_name(given, table, type_code):
    """Given name or the default one, with the prefix of its index type."""
    prefix = F.when(type_code == "UNIQUE", F.lit("UIX")).otherwise(F.lit("IX"))
    default = F.concat(prefix, F.lit("_"), base_name(table), F.lit("_01"))
    return ensure_prefix(F.coalesce(given, default), prefix)


def index_create(main: dict[str, DataFrame], requests: DataFrame, as_of, full_history: bool = False) -> Change:
    """New indexes with one row per parsed column. Items that do not parse drop out, and a
    request is rejected when none is left. History covers the header, with ``full_history``
    also the columns."""
    rows = begin(requests, "index_create").withColumns(
        {
            "_schema": F.upper("schema"),
            "_table": ensure_prefix(F.col("tableName"), "TB"),
            "_columns": F.coalesce(parse_index_columns(F.col("indexColumns")), F.array()),
        }
    )
    rows = rows.withColumn("_index", index_name(F.col("indexName"), F.col("_table"), F.col("indexTypeCd")))
    listed = F.transform(
        F.col("_columns"),
        lambda c, i: check_name(F.concat(F.lit("indexColumns."), (i + 1).cast("string")), c["name"]),
    )
    rows = with_errors(
        rows,
        [
            check_name("schema", F.col("schema")),
            check_name("tableName", F.col("_table")),
            check_name("indexName", F.col("indexName"), required=False),
            check_name("tablespaceName", F.col("tablespaceName"), required=False),
            F.when(
                F.size("_columns") == 0, problem("indexColumns", F.col("indexColumns"), "required")
            ),
        ],
        F.filter(listed, lambda e: e.isNotNull()),
    )
    rows = find_table(reject_repeats(rows, ["_schema", "_table", "_index"]), main["table"])
    rows = find_object(
        rows, main["index"], {"TABLE_ID": "TABLE_ID", "_index": "INDEX_NAME"}, "indexName", expected=False
    )
    items = F.transform(
        "_columns",
        lambda c: F.when(c["sort"] == "DESC", F.concat(c["name"], F.lit(" DESC"))).otherwise(c["name"]),
    )
    kind = F.when(F.col("indexTypeCd").isin("UNIQUE", "BITMAP"), F.concat(F.lit(" "), "indexTypeCd"))

    def option(word: str, field: str):
        return F.when(
            ~is_blank(F.col(field)), F.concat(F.lit(f"\n{word} "), F.upper(field))
        ).otherwise(F.lit(""))

    ddl = F.concat(
        F.lit("CREATE"), F.coalesce(kind, F.lit("")), F.lit(" INDEX "),
        F.concat_ws(".", "_schema", "_index"), F.lit(" ON "), F.concat_ws(".", "_schema", "_table"),
        F.lit(" ("), F.array_join(items, ", "), F.lit(")"),
        option("TABLESPACE", "tablespaceName"), option("INITRANS", "iniTrans"),
        option("PCTFREE", "pctFree"), F.lit(";"),
    )
    batch = settle(rows.withColumn("_ddl", ddl))
    good = batch.good
    placed = assign_ids(good, "INDEX_ID", last_id(main["index"], "INDEX_ID"), ["TABLE_ID", "_index"])
    headers = audit(placed, as_of).select(
        "INDEX_ID", "TABLE_ID", "reason", "_actor", *AUDIT_COLUMNS,
        F.col("_index").alias("INDEX_NAME"),
        F.col("indexTypeCd").alias("INDEX_TYPE_CD"),
        F.upper("tablespaceName").alias("TABLESPACE_NAME"),
        number_or_null(F.col("iniTrans")).alias("INI_TRANS"),
        number_or_null(F.col("pctFree")).alias("PCT_FREE"),
        F.col("purposeCd").alias("PURPOSE_CD"),
        F.col("performanceNote").alias("PERFORMANCE_NOTE"),
        F.col("_ddl").alias("CREATE_DDL"),
        F.lit("ACTIVE").alias("STATUS_CD"),
    )
    columns = placed.select("INDEX_ID", "reason", "_actor", F.posexplode("_columns").alias("_pos", "c")).select(
        "INDEX_ID", "reason", "_actor",
        (F.col("_pos") + 1).alias("COLUMN_POS"),
        F.col("c.name").alias("COLUMN_NAME"),
        F.col("c.sort").alias("SORT_ORDER"),
    )
    headers, columns = with_request(headers, INDEX), with_request(columns, INDEX_COLUMN)
    history = {"index": snapshot(headers, INDEX, "I", F.col("reason"), F.col("_actor"), as_of)}
    if full_history:
        history["index_column"] = snapshot(
            columns, INDEX_COLUMN, "I", F.col("reason"), F.col("_actor"), as_of
        )
    return Change(
        ddl=statements(good, [(F.lit(True), F.col("_ddl"))]),
        rejects=batch.rejects,
        append={
            "index": conform(headers, INDEX.schema),
            "index_column": conform(columns, INDEX_COLUMN.schema),
        },
        history=history,
    )


def index_drop(main: dict[str, DataFrame], requests: DataFrame, as_of, full_history: bool = False) -> Change:
    """Indexes removed with their columns. Without a table the name counts in every table."""
    rows = begin(requests, "index_drop").withColumns(
        {
            "_schema": F.upper("schema"),
            "_table": ensure_prefix(F.col("tableName"), "TB"),
            "_index": F.upper("indexName"),
        }
    )
    rows = with_errors(
        rows,
        [
            check_name("schema", F.col("schema")),
            check_name("indexName", F.col("indexName")),
            check_name("tableName", F.col("_table"), required=False),
        ],
    )
    rows = reject_repeats(rows, ["_schema", "_table", "_index"])
    named_tables = asked_for(
        main["table"], rows, {"_schema": "SCHEMA_NAME", "_table": "TABLE_NAME"}
    )
    ids = named_tables.select(
        "TABLE_ID", F.col("SCHEMA_NAME").alias("_schema"), F.col("TABLE_NAME").alias("_table")
    )
    rows = rows.join(ids, ["_schema", "_table"], "left")
    unknown = F.col("_table").isNotNull() & F.col("TABLE_ID").isNull()
    rows = add_error(rows, unknown, "tableName", F.col("_table"), "unknown")
    # Any index of that name, in the named table or anywhere.
    known = asked_for(main["index"], rows, {"_index": "INDEX_NAME"})
    by_table = known.select("TABLE_ID", F.col("INDEX_NAME").alias("_index"), F.lit(True).alias("_in_table"))
    by_name = known.select(F.col("INDEX_NAME").alias("_index")).distinct().withColumn("_anywhere", F.lit(True))
    rows = rows.join(by_table, ["TABLE_ID", "_index"], "left").join(by_name, "_index", "left")
    there = F.when(F.col("_table").isNull(), F.col("_anywhere")).otherwise(F.col("_in_table"))
    rows = add_error(rows, there.isNull(), "indexName", F.col("_index"), "unknown")
    batch = settle(rows.drop("_in_table", "_anywhere"))
    good = batch.good
    request = F.struct("request_seq", "reason", "_actor").alias("_by")
    named = good.filter(F.col("_table").isNotNull()).select("TABLE_ID", F.col("_index").alias("INDEX_NAME"), request)
    loose = good.filter(F.col("_table").isNull()).select(F.col("_index").alias("INDEX_NAME"), request)
    index_keys = main["index"].select("INDEX_ID", "TABLE_ID", "INDEX_NAME")
    hits = index_keys.join(named, ["TABLE_ID", "INDEX_NAME"]).select("INDEX_ID", "_by").unionByName(
        index_keys.join(loose, "INDEX_NAME").select("INDEX_ID", "_by")
    )
    # Two requests may meet in one index: the earlier one removes it.
    gone = hits.groupBy("INDEX_ID").agg(F.min("_by").alias("_by")).select(
        "INDEX_ID", F.col("_by.reason").alias("reason"), F.col("_by._actor").alias("_actor")
    )
    removed = main["index"].join(gone, "INDEX_ID")
    history = {"index": snapshot(removed, INDEX, "D", F.col("reason"), F.col("_actor"), as_of)}
    if full_history:
        history["index_column"] = snapshot(
            main["index_column"].join(gone, "INDEX_ID"), INDEX_COLUMN, "D",
            F.col("reason"), F.col("_actor"), as_of,
        )
    same = {"INDEX_ID": "INDEX_ID"}
    drop = F.concat(F.lit("DROP INDEX "), F.concat_ws(".", "_schema", "_index"), F.lit(";"))
    return Change(
        ddl=statements(good, [(F.lit(True), drop)]),
        rejects=batch.rejects,
        replace={
            "index_column": not_in(main["index_column"], gone, same, unique=True),
            "index": not_in(main["index"], gone, same, unique=True),
        },
        history=history,
        remove={"index": removed, "index_column": in_set(main["index_column"], gone, same, unique=True)},
    )
