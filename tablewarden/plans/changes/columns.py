"""Column requests: add, modify, and drop softly or with the indexes left without columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import check_name, check_present, problem
from tablewarden.functions.text import (
    base_name, ensure_prefix, is_blank, number_or_null, sql_quote, yes_no,
)
from tablewarden.functions.types import render_type
from tablewarden.operators.filters import conform
from tablewarden.operators.history import snapshot
from tablewarden.operators.ids import assign_ids, last_id, next_ordinals
from tablewarden.operators.joins import in_set, not_in
from tablewarden.plans.changes.common import (
    OUT_OF_USE, Change, audit, begin, find_object, find_table, fold_patches, patch,
    reject_after_removal, reject_repeats, reject_same_turns, settle, statements, with_errors, with_request,
)
from tablewarden.schemas import AUDIT_COLUMNS, COLUMN, ENTITIES
from tablewarden.session import durable

_KEY = {"TABLE_ID": "TABLE_ID", "_column": "COLUMN_NAME"}


def _named(requests: DataFrame, kind: str) -> DataFrame:
    return begin(requests, kind).withColumns(
        {
            "_schema": F.upper("schema"),
            "_table": ensure_prefix(F.col("tableName"), "TB"),
            "_column": F.upper("colName"),
        }
    )


def _name_checks() -> list:
    return [
        check_name("schema", F.col("schema")),
        check_name("tableName", F.col("_table")),
        check_name("colName", F.col("colName")),
    ]


def _size_check():
    sized = (F.col("dataType") == "NUMBER") & ~is_blank(F.col("dataLength"))
    return F.when(sized, problem("dataLength", F.col("dataLength"), "number_length"))


def _type():
    return render_type(F.col("dataType"), F.col("dataLength"), F.col("dataPrecision"), F.col("dataScale"))


def _pieces():
    full = F.concat_ws(".", "_schema", "_table")
    default = F.when(
        ~is_blank(F.col("defaultValue")), F.concat(F.lit(" DEFAULT "), "defaultValue")
    ).otherwise(F.lit(""))
    comment = F.concat(
        F.lit("COMMENT ON COLUMN "), full, F.lit("."), "_column", F.lit(" IS "),
        sql_quote(F.col("logicalName")), F.lit(";"),
    )
    alter = F.concat(F.lit("ALTER TABLE "), full)
    base = base_name(F.col("_table"))
    primary = F.concat(
        alter, F.lit(" ADD CONSTRAINT PK_"), base, F.lit(" PRIMARY KEY ("), "_column", F.lit(");")
    )
    unique = F.concat(
        alter, F.lit(" ADD CONSTRAINT UK_"), base, F.lit("_"), "_column", F.lit(" UNIQUE ("), "_column", F.lit(");")
    )
    foreign = F.concat(
        F.lit("-- TODO "), alter, F.lit(" ADD CONSTRAINT FK_"), base, F.lit("_"), "_column",
        F.lit(" FOREIGN KEY ("), "_column", F.lit(") REFERENCES ..."),
    )
    return alter, default, comment, primary, unique, foreign


def _on(flag: str):
    return F.coalesce(F.col(flag), F.lit(False))


def column_add(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """New columns; without an order they go behind the table's last one, in request order."""
    rows = with_errors(_named(requests, "column_add"), [*_name_checks(), _size_check()])
    rows = rows.withColumn("nullableYn", F.coalesce("nullableYn", F.lit(True)))
    rows = find_table(reject_repeats(rows, ["_schema", "_table", "_column"]), main["table"])
    rows = find_object(rows, main["column"], _KEY, "colName", expected=False)
    batch = settle(rows.withColumn("_order", number_or_null(F.col("columnOrder"))))
    good = batch.good
    given = good.filter(F.col("_order").isNotNull())
    taken = main["column"].select("TABLE_ID", "COLUMN_ORDER").unionByName(
        given.select("TABLE_ID", F.col("_order").alias("COLUMN_ORDER"))
    )
    open_ended = next_ordinals(
        good.filter(F.col("_order").isNull()), taken, ["TABLE_ID"], "COLUMN_ORDER",
        ["request_seq", "request_id"], "COLUMN_ORDER",
    )
    placed = given.withColumn("COLUMN_ORDER", F.col("_order")).unionByName(open_ended)
    columns = audit(placed, as_of).select(
        "TABLE_ID", "COLUMN_ORDER", "reason", "_actor", *AUDIT_COLUMNS,
        F.col("_column").alias("COLUMN_NAME"),
        F.col("logicalName").alias("LOGICAL_NAME"),
        F.col("description").alias("DESCRIPTION"),
        F.col("dataType").alias("DATA_TYPE"),
        number_or_null(F.col("dataLength")).alias("DATA_LENGTH"),
        number_or_null(F.col("dataPrecision")).alias("DATA_PRECISION"),
        number_or_null(F.col("dataScale")).alias("DATA_SCALE"),
        yes_no(F.col("nullableYn")).alias("NULLABLE_YN"),
        F.col("defaultValue").alias("DEFAULT_VALUE"),
        yes_no(F.col("pkYn")).alias("PK_YN"),
        yes_no(F.col("ukYn")).alias("UK_YN"),
        yes_no(F.col("fkYn")).alias("FK_YN"),
        yes_no(F.col("pciYn")).alias("PCI_YN"),
        F.col("pciCategoryCd").alias("PCI_CATEGORY_CD"),
        F.coalesce("sensitivityCd", F.lit("LOW")).alias("SENSITIVITY_CD"),
        yes_no(F.col("encryptionYn")).alias("ENCRYPTION_YN"),
        F.col("encryptionAlg").alias("ENCRYPTION_ALG"),
        yes_no(F.col("maskingYn")).alias("MASKING_YN"),
        F.col("maskingRuleCd").alias("MASKING_RULE_CD"),
        F.col("retentionPeriodCd").alias("RETENTION_PERIOD_CD"),
        F.col("tosCd").alias("TOS_CD"),
        F.lit("ACTIVE").alias("STATUS_CD"),
    )
    columns = with_request(
        assign_ids(columns, "COLUMN_ID", last_id(main["column"], "COLUMN_ID"), ["TABLE_ID", "COLUMN_NAME"]),
        COLUMN,
    )
    alter, default, comment, primary, unique, foreign = _pieces()
    add = F.concat(
        alter, F.lit(" ADD ("), "_column", F.lit(" "), _type(), default,
        F.when(_on("nullableYn"), F.lit("")).otherwise(F.lit(" NOT NULL")), F.lit(");"),
    )
    return Change(
        ddl=statements(
            good,
            [
                (F.lit(True), add), (~is_blank(F.col("logicalName")), comment),
                (_on("pkYn"), primary), (_on("ukYn"), unique), (_on("fkYn"), foreign),
            ],
        ),
        rejects=batch.rejects,
        append={"column": conform(columns, COLUMN.schema)},
        history={"column": snapshot(columns, COLUMN, "I", F.col("reason"), F.col("_actor"), as_of)},
    )


# The registry columns that a modify request always writes, and those that it
# writes when the field was touched (touched and empty means NULL).
ALWAYS_WRITTEN = {
    "NULLABLE_YN": "nullableYn",
    "PCI_YN": "pciYn",
    "ENCRYPTION_YN": "encryptionYn",
    "MASKING_YN": "maskingYn",
}
WRITTEN_IF_TOUCHED = {
    "LOGICAL_NAME": "logicalName",
    "DESCRIPTION": "description",
    "DATA_TYPE": "dataType",
    "DATA_LENGTH": "dataLength",
    "DATA_PRECISION": "dataPrecision",
    "DATA_SCALE": "dataScale",
    "DEFAULT_VALUE": "defaultValue",
    "PK_YN": "pkYn",
    "UK_YN": "ukYn",
    "FK_YN": "fkYn",
    "PCI_CATEGORY_CD": "pciCategoryCd",
    "ENCRYPTION_ALG": "encryptionAlg",
    "MASKING_RULE_CD": "maskingRuleCd",
    "RETENTION_PERIOD_CD": "retentionPeriodCd",
    "TOS_CD": "tosCd",
}


def _patches() -> dict:
    types = {c.name: c.kind for c in COLUMN.columns}
    touched = F.coalesce(F.col("touched"), F.array().cast("array<string>"))
    fields = {name: (F.lit(True), yes_no(F.col(source))) for name, source in ALWAYS_WRITTEN.items()}
    fields["SENSITIVITY_CD"] = (F.lit(True), F.coalesce("sensitivityCd", F.lit("LOW")))
    fields["STATUS_CD"] = (~is_blank(F.col("statusCd")), F.col("statusCd"))
    for name, source in WRITTEN_IF_TOUCHED.items():
        value = F.col(source)
        if types[name] == "flag":
            value = yes_no(value)
        elif types[name] == "int":
            value = number_or_null(value)
        fields[name] = (F.array_contains(touched, source), value)
    return fields


def column_modify(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """Columns patched field by field. The flags and the sensitivity are always written, so a
    request must state them. Several requests for one column take effect in the order of their turns,
    each with its own history row."""
    stated = [*ALWAYS_WRITTEN.values(), "sensitivityCd"]
    rows = with_errors(
        _named(requests, "column_modify"),
        [*_name_checks(), _size_check(), *[check_present(f, F.col(f).cast("string")) for f in stated]],
    )
    rows = find_table(reject_same_turns(rows), main["table"])
    batch = settle(find_object(rows, main["column"], _KEY, "colName", expected=True))
    good = batch.good
    folded = fold_patches(good, _KEY, _patches())
    images = patch(main["column"], folded, _KEY, as_of, "every")
    alter, default, comment, primary, unique, foreign = _pieces()
    kind = F.when(~is_blank(F.col("dataType")), F.concat(F.lit(" "), _type())).otherwise(F.lit(""))
    modify = F.concat(
        alter, F.lit(" MODIFY ("), "_column", kind, default,
        F.when(_on("nullableYn"), F.lit(" NULL")).otherwise(F.lit(" NOT NULL")), F.lit(");"),
    )
    return Change(
        ddl=statements(
            good,
            [
                (F.lit(True), modify), (~is_blank(F.col("logicalName")), comment),
                (_on("pkYn"), primary), (_on("ukYn"), unique), (_on("fkYn"), foreign),
            ],
        ),
        rejects=batch.rejects,
        replace={"column": patch(main["column"], folded, _KEY, as_of).select(*COLUMN.names)},
        history={"column": snapshot(images, COLUMN, "U", F.col("_reason"), F.col("_actor"), as_of)},
        update={"column": patch(main["column"], folded, _KEY, as_of, "changed").select(*COLUMN.names)},
    )


def emptied_indexes(
    indexes: DataFrame, index_columns: DataFrame, dropped: DataFrame
) -> DataFrame:
    """Indexes of the tables concerned that have no column left, with reason and actor.

    ``dropped`` holds (TABLE_ID, COLUMN_NAME, request_seq, reason, _actor). An index goes with the
    request that takes its last column; one that had none goes with its table's first request.
    """
    request = F.struct("request_seq", "reason", "_actor")
    concerned = dropped.groupBy("TABLE_ID").agg(F.min(request).alias("_first"))
    candidates = indexes.join(concerned, "TABLE_ID")
    entries = index_columns.select("INDEX_ID", "COLUMN_NAME").join(
        candidates.select("INDEX_ID", "TABLE_ID"), "INDEX_ID"
    )
    gone = dropped.select("TABLE_ID", "COLUMN_NAME", request.alias("_by"))
    left = (
        entries.join(gone, ["TABLE_ID", "COLUMN_NAME"], "left")
        .groupBy("INDEX_ID")
        .agg(
            F.count(F.when(F.col("_by").isNull(), 1)).alias("_left"),
            F.max("_by").alias("_last"),
        )
    )
    emptied = candidates.join(left, "INDEX_ID", "left").filter(F.coalesce("_left", F.lit(0)) == 0)
    by = F.coalesce("_last", "_first")
    return emptied.select(*indexes.columns, by["reason"].alias("reason"), by["_actor"].alias("_actor"))


def _removal(main: dict[str, DataFrame], dropped: DataFrame):
    """Columns, index entries and emptied indexes that go, with reason and actor, and the index
    rows that stay.

    The indexes of the tables concerned, their entries, and what goes of both are written one after the other, because
    removal, history and the rest all go back to them, and together their shuffles would need the disk at once."""
    by_column = dropped.select("TABLE_ID", "COLUMN_NAME", "reason", "_actor")
    concerned = durable(in_set(main["index"], dropped, {"TABLE_ID": "TABLE_ID"}))
    entries = durable(main["index_column"].join(concerned.select("INDEX_ID", "TABLE_ID"), "INDEX_ID"))
    lost = durable(entries.join(by_column, ["TABLE_ID", "COLUMN_NAME"]))
    removed = {
        "column": main["column"].join(by_column, ["TABLE_ID", "COLUMN_NAME"]),
        "index": durable(emptied_indexes(concerned, entries.select(main["index_column"].columns), dropped)),
        "index_column": lost,
    }
    entry = {"INDEX_ID": "INDEX_ID", "COLUMN_POS": "COLUMN_POS"}
    rest = {
        "index_column": not_in(main["index_column"], lost, entry, unique=True),
        "index": not_in(main["index"], removed["index"], {"INDEX_ID": "INDEX_ID"}, unique=True),
    }
    return removed, rest


def column_drop(main: dict[str, DataFrame], requests: DataFrame, as_of, full_history: bool = False) -> Change:
    """Columns put out of use (SOFT), or removed with their index entries and the indexes that
    are left without any (HARD). Remaining index positions keep their numbers.

    Index entries get no history unless ``full_history`` asks for it. A column may be put out of use and removed
    later in the same batch; what comes after its removal finds it no more.
    """
    rows = _named(requests, "column_drop")
    known_mode = F.coalesce(F.col("mode").isin("SOFT", "HARD"), F.lit(False))
    rows = with_errors(rows, [*_name_checks(), F.when(~known_mode, problem("mode", F.col("mode"), "value"))])
    is_soft = F.coalesce(F.col("mode") == "SOFT", F.lit(False))
    rows = reject_after_removal(rows, ["_schema", "_table", "_column"], ~is_soft, "colName")
    rows = find_table(rows, main["table"])
    batch = settle(find_object(rows, main["column"], _KEY, "colName", expected=True))
    good = batch.good
    soft, hard = good.filter(is_soft), good.filter(~is_soft)
    folded = fold_patches(soft, _KEY, {"STATUS_CD": (F.lit(True), F.lit(OUT_OF_USE))})
    patched = patch(main["column"], folded, _KEY, as_of).select(*COLUMN.names)
    images = patch(main["column"], folded, _KEY, as_of, "every")
    updated = snapshot(images, COLUMN, "U", F.col("_reason"), F.col("_actor"), as_of)
    replace, history = {"column": patched}, {"column": updated}
    update = {"column": patch(main["column"], folded, _KEY, as_of, "changed").select(*COLUMN.names)}
    remove = {}
    if not hard.isEmpty():
        dropped = hard.select(
            "TABLE_ID", F.col("_column").alias("COLUMN_NAME"), "request_seq", "reason", "_actor"
        )
        removed, rest = _removal(main | {"column": patched}, dropped)
        deleted = {
            n: snapshot(rows, ENTITIES[n], "D", F.col("reason"), F.col("_actor"), as_of)
            for n, rows in removed.items() if full_history or n != "index_column"
        }
        history = deleted | {"column": updated.unionByName(deleted["column"])}
        same = {"TABLE_ID": "TABLE_ID", "COLUMN_NAME": "COLUMN_NAME"}
        replace = rest | {
            "column": not_in(replace["column"], dropped, same, unique=True)
        }
        update = {"column": not_in(update["column"], dropped, same, unique=True)}
        remove = removed
    drop = F.concat(
        F.lit("ALTER TABLE "), F.concat_ws(".", "_schema", "_table"),
        F.lit(" DROP COLUMN "), "_column", F.lit(";"),
    )
    return Change(
        ddl=statements(good, [(~is_soft, drop)]),
        rejects=batch.rejects,
        replace=replace,
        history=history,
        update=update,
        remove=remove,
    )
