"""Table requests: create, and drop softly or with everything that hangs on the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.masking import mask_function_name
from tablewarden.functions.names import ERROR_TYPE, check_name, check_present, problem
from tablewarden.functions.text import (
    base_name, ensure_prefix, is_blank, number_or_null, sql_quote, yes_no,
)
from tablewarden.functions.types import render_type
from tablewarden.operators.filters import conform
from tablewarden.operators.history import snapshot
from tablewarden.operators.ids import assign_ids, last_id
from tablewarden.operators.joins import not_in
from tablewarden.plans.changes.common import (
    OUT_OF_USE, Change, add_error, audit, begin, find_object, find_table, fold_patches,
    patch, reject_after_removal, reject_repeats, settle, statements, with_errors, with_request,
)
from tablewarden.schemas import AUDIT_COLUMNS, COLUMN, ENTITIES, SEQUENCE, TABLE

# Options of a sequence that is created for a single-column NUMBER key.
KEY_SEQUENCE_OPTIONS = "START WITH 1\n  INCREMENT BY 1\n  NOCYCLE\n  CACHE 20\n  NOORDER"
NAME_WIDTH = 30
TYPE_WIDTH = 18


def padded(text, width: int):
    """Text filled up with blanks, and left alone when it is longer."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))))


def _column_errors():
    def check(column, i):
        place = F.concat(F.lit("columns."), (i + 1).cast("string"))
        sized = (column["dataType"] == "NUMBER") & ~is_blank(column["dataLength"])
        return F.array(
            check_name(place, column["colName"]),
            F.when(sized, problem(place, column["colName"], "number_length")),
        )

    names = F.transform("columns", lambda c: F.upper(c["colName"]))
    again = F.transform(
        F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)),
        lambda n: problem("columns", n, "duplicate"),
    )
    found = F.filter(F.flatten(F.transform(F.col("columns"), check)), lambda e: e.isNotNull())
    return F.concat(found.cast(ERROR_TYPE), again.cast(ERROR_TYPE))


def _screen_create(requests: DataFrame, tables: DataFrame) -> DataFrame:
    rows = begin(requests, "table_create").withColumns(
        {
            "_schema": F.upper("schema"),
            "_table": ensure_prefix(F.col("tableName"), "TB"),
            "columns": F.coalesce(F.col("columns"), F.array()),
        }
    )
    rows = with_errors(
        rows,
        [
            check_name("schema", F.col("schema")),
            check_name("tableName", F.col("_table")),
            F.when(F.size("columns") == 0, problem("columns", None, "required")),
            check_name("tablespace", F.col("tablespace"), required=False),
            F.when(F.col("viewGenYn"), check_name("viewName", F.col("viewName"), required=False)),
        ],
        _column_errors(),
    )
    rows = reject_repeats(rows, ["_schema", "_table"])
    return find_object(
        rows, tables, {"_schema": "SCHEMA_NAME", "_table": "TABLE_NAME"}, "tableName", expected=False
    )


def _nullable(column):
    # The form offers columns as nullable; a key column never is.
    return ~F.coalesce(column["pkYn"], F.lit(False)) & F.coalesce(column["nullableYn"], F.lit(True))


def _column_line(column):
    kind = render_type(
        column["dataType"], column["dataLength"], column["dataPrecision"], column["dataScale"]
    )
    default = F.when(
        ~is_blank(column["defaultValue"]), F.concat(F.lit(" DEFAULT "), column["defaultValue"])
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("    "), padded(F.upper(column["colName"]), NAME_WIDTH), F.lit(" "),
        padded(kind, TYPE_WIDTH), default,
        F.when(_nullable(column), F.lit("")).otherwise(F.lit(" NOT NULL")),
    )


def _names(flag: str):
    chosen = F.filter(F.col("columns"), lambda c: F.coalesce(c[flag], F.lit(False)))
    return F.transform(chosen, lambda c: F.upper(c["colName"]))


def _create_statements(good: DataFrame) -> DataFrame:
    full = F.concat_ws(".", "_schema", "_table")
    base = base_name(F.col("_table"))
    keys = _names("pkYn")

    def unique(name, i):
        number = F.when(i < 9, F.concat(F.lit("0"), (i + 1).cast("string"))).otherwise((i + 1).cast("string"))
        return F.concat(
            F.lit("    CONSTRAINT UK_"), base, F.lit("_"), number, F.lit(" UNIQUE ("), name, F.lit(")")
        )

    primary = F.when(
        F.size(keys) > 0,
        F.array(
            F.concat(F.lit("    CONSTRAINT PK_"), base, F.lit(" PRIMARY KEY ("), F.array_join(keys, ", "), F.lit(")"))
        ),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.transform("columns", _column_line), primary, F.transform(_names("ukYn"), unique))
    space = F.when(
        ~is_blank(F.col("tablespace")), F.concat(F.lit("\nTABLESPACE "), F.upper("tablespace"))
    ).otherwise(F.lit(""))
    create = F.concat(
        F.lit("CREATE TABLE "), full, F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n)"), space, F.lit(";")
    )
    comment = F.concat(F.lit("COMMENT ON TABLE "), full, F.lit(" IS "), sql_quote(F.col("logicalName")), F.lit(";"))
    described = F.filter("columns", lambda c: ~is_blank(c["logicalName"]))
    column_comments = F.array_join(
        F.transform(
            described,
            lambda c: F.concat(
                F.lit("COMMENT ON COLUMN "), full, F.lit("."), F.upper(c["colName"]),
                F.lit(" IS "), sql_quote(c["logicalName"]), F.lit(";"),
            ),
        ),
        "\n",
    )

    def shown(column):
        name = F.upper(column["colName"])
        masked = F.coalesce(column["maskingYn"], F.lit(False)) & ~is_blank(column["maskingRuleCd"])
        wrapped = F.concat(
            F.lit("    "), mask_function_name(column["maskingRuleCd"]), F.lit("("), name, F.lit(") AS "), name
        )
        return F.when(masked, wrapped).otherwise(F.concat(F.lit("    "), name))

    view_name = F.coalesce(F.upper("viewName"), F.regexp_replace("_table", "^TB_", "VW_"))
    view = F.concat(
        F.lit("CREATE OR REPLACE VIEW "), F.concat_ws(".", F.col("_schema"), view_name), F.lit(" AS\nSELECT\n"),
        F.array_join(F.transform("columns", shown), ",\n"), F.lit("\nFROM "), full, F.lit(";"),
    )
    return statements(
        good,
        [
            (F.lit(True), create),
            (~is_blank(F.col("logicalName")), comment),
            (F.size(described) > 0, column_comments),
            (F.coalesce(F.col("viewGenYn"), F.lit(False)), view),
            (F.col("_sequence").isNotNull(), F.col("_sequence_ddl")),
        ],
    )


def _one_sequence_each(rows: DataFrame) -> DataFrame:
    """Of the good requests of a batch that would make the same key sequence, only the earliest stays good."""
    turn = F.struct("request_seq", "request_id")
    wanted = rows.filter(F.col("_sequence").isNotNull()).groupBy(
        F.col("_schema").alias("_in"), F.col("_sequence").alias("_named")
    ).agg(F.min(F.when(F.size("errors") == 0, turn)).alias("_earliest"))
    joined = rows.join(wanted, (F.col("_schema") == F.col("_in")) & (F.col("_sequence") == F.col("_named")), "left")
    later = (F.size("errors") == 0) & (turn > F.col("_earliest"))
    return add_error(joined, later, "pkSeqGenYn", F.col("_sequence"), "duplicate").select(*rows.columns)


def table_create(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """New tables with their columns, and a key sequence where the key is one NUMBER column."""
    screened = _screen_create(requests, main["table"])
    key_columns = F.filter("columns", lambda c: F.coalesce(c["pkYn"], F.lit(False)))
    key = F.upper(F.get(key_columns, F.lit(0))["colName"])
    wanted = (
        F.coalesce(F.col("pkSeqGenYn"), F.lit(True))
        & (F.size(key_columns) == 1)
        & (F.get(key_columns, F.lit(0))["dataType"] == "NUMBER")
    )
    screened = screened.withColumns(
        {
            "_key": F.when(wanted, key),
            "_sequence": F.when(wanted, F.concat(F.lit("SEQ_"), base_name(F.col("_table")), F.lit("_"), key)),
        }
    ).withColumn(
        "_sequence_ddl",
        F.concat(
            F.lit("CREATE SEQUENCE "), "_schema", F.lit("."), "_sequence",
            F.lit(f"\n  {KEY_SEQUENCE_OPTIONS};"),
        ),
    )
    # The key sequence must be new, in the registry and in the batch.
    screened = find_object(
        screened, main["sequence"], {"_schema": "SCHEMA_NAME", "_sequence": "SEQUENCE_NAME"}, "pkSeqGenYn", expected=False
    )
    batch = settle(_one_sequence_each(screened))
    good = batch.good
    placed = assign_ids(good, "TABLE_ID", last_id(main["table"], "TABLE_ID"), ["_schema", "_table"])
    kept = ["reason", "_actor", *AUDIT_COLUMNS]
    tables = audit(placed, as_of).select(
        "TABLE_ID", *kept,
        F.col("_schema").alias("SCHEMA_NAME"),
        F.col("_table").alias("TABLE_NAME"),
        F.col("logicalName").alias("LOGICAL_NAME"),
        F.col("description").alias("DESCRIPTION"),
        yes_no(F.col("viewYn")).alias("VIEW_YN"),
        F.col("serviceCd").alias("SERVICE_CD"),
        F.col("_actor").alias("OWNER_EMP_ID"),
        yes_no(F.col("keyTableYn")).alias("KEY_TABLE_YN"),
        yes_no(F.col("isolationYn")).alias("ISOLATION_YN"),
        F.col("isolationLevelCd").alias("ISOLATION_LEVEL_CD"),
        yes_no(F.col("pciYn")).alias("PCI_YN"),
        F.col("retentionPeriodCd").alias("RETENTION_PERIOD_CD"),
        F.col("retentionBasis").alias("RETENTION_BASIS"),
        F.col("tosCd").alias("TOS_CD"),
        F.lit("ACTIVE").alias("STATUS_CD"),
        F.col("remark").alias("REMARK"),
    )
    placed_columns = audit(placed, as_of).select(
        "TABLE_ID", *kept,
        F.posexplode("columns").alias("_pos", "c"),
    )
    columns = placed_columns.select(
        "TABLE_ID", *kept,
        F.upper("c.colName").alias("COLUMN_NAME"),
        (F.col("_pos") + 1).alias("COLUMN_ORDER"),
        F.col("c.logicalName").alias("LOGICAL_NAME"),
        F.col("c.description").alias("DESCRIPTION"),
        F.col("c.dataType").alias("DATA_TYPE"),
        number_or_null(F.col("c.dataLength")).alias("DATA_LENGTH"),
        number_or_null(F.col("c.dataPrecision")).alias("DATA_PRECISION"),
        number_or_null(F.col("c.dataScale")).alias("DATA_SCALE"),
        yes_no(_nullable(F.col("c"))).alias("NULLABLE_YN"),
        F.col("c.defaultValue").alias("DEFAULT_VALUE"),
        yes_no(F.col("c.pkYn")).alias("PK_YN"),
        yes_no(F.col("c.ukYn")).alias("UK_YN"),
        yes_no(F.col("c.fkYn")).alias("FK_YN"),
        yes_no(F.col("c.pciYn")).alias("PCI_YN"),
        F.col("c.pciCategoryCd").alias("PCI_CATEGORY_CD"),
        F.lit("LOW").alias("SENSITIVITY_CD"),
        yes_no(F.col("c.encryptionYn")).alias("ENCRYPTION_YN"),
        yes_no(F.col("c.maskingYn")).alias("MASKING_YN"),
        F.col("c.maskingRuleCd").alias("MASKING_RULE_CD"),
        F.lit("ACTIVE").alias("STATUS_CD"),
    )
    columns = assign_ids(
        columns, "COLUMN_ID", last_id(main["column"], "COLUMN_ID"), ["TABLE_ID", "COLUMN_ORDER"]
    )
    number = "decimal(38,0)"
    sequences = audit(good.filter(F.col("_sequence").isNotNull()), as_of).select(
        *kept,
        F.col("_schema").alias("SCHEMA_NAME"),
        F.col("_sequence").alias("SEQUENCE_NAME"),
        F.lit(1).cast(number).alias("INCREMENT_BY"),
        F.lit(1).cast(number).alias("START_WITH"),
        F.lit(20).cast(number).alias("CACHE_SIZE"),
        F.lit("N").alias("CYCLE_YN"),
        F.lit("N").alias("ORDER_YN"),
        F.lit("PK").alias("PURPOSE_CD"),
        F.col("_table").alias("USED_FOR_TABLE"),
        F.col("_key").alias("USED_FOR_COLUMN"),
        F.col("_sequence_ddl").alias("CREATE_DDL"),
        F.lit("ACTIVE").alias("STATUS_CD"),
    )
    sequences = assign_ids(
        sequences, "SEQUENCE_ID", last_id(main["sequence"], "SEQUENCE_ID"), ["SCHEMA_NAME", "SEQUENCE_NAME"]
    )
    parts = {"table": (TABLE, tables), "column": (COLUMN, columns), "sequence": (SEQUENCE, sequences)}
    return Change(
        ddl=_create_statements(good),
        rejects=batch.rejects,
        append={n: conform(rows, e.schema) for n, (e, rows) in parts.items()},
        history={
            n: snapshot(with_request(rows, e), e, "I", F.col("reason"), F.col("_actor"), as_of)
            for n, (e, rows) in parts.items()
        },
    )


def _removal(main: dict[str, DataFrame], hard: DataFrame):
    """Rows that go with their tables, with the request's reason and actor, and the children that stay."""
    gone = hard.select("TABLE_ID", "reason", "_actor")
    removed = {n: main[n].join(gone, "TABLE_ID") for n in ("table", "column", "index")}
    removed["index_column"] = main["index_column"].join(
        removed["index"].select("INDEX_ID", "reason", "_actor"), "INDEX_ID"
    )
    on_table = {"TABLE_ID": "TABLE_ID"}
    rest = {
        n: not_in(main[n], hard, on_table, unique=True) for n in ("column", "index")
    }
    rest["index_column"] = not_in(
        main["index_column"], removed["index"], {"INDEX_ID": "INDEX_ID"}, unique=True
    )
    return removed, rest


def table_drop(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """Tables put out of use (SOFT), or removed with columns, indexes and index columns (HARD).

    Sequences stay: they name their table but do not belong to it. A table may be put out of use and removed
    later in the same batch; what comes after its removal finds it no more.
    """
    rows = begin(requests, "table_drop").withColumns(
        {"_schema": F.upper("schema"), "_table": ensure_prefix(F.col("tableName"), "TB")}
    )
    known_mode = F.coalesce(F.col("mode").isin("SOFT", "HARD"), F.lit(False))
    rows = with_errors(
        rows,
        [
            check_present("schema", F.col("schema")),
            check_present("tableName", F.col("tableName")),
            F.when(~known_mode, problem("mode", F.col("mode"), "value")),
        ],
    )
    rows = reject_after_removal(rows, ["_schema", "_table"], F.col("mode") == "HARD", "tableName")
    batch = settle(find_table(rows, main["table"]))
    good = batch.good
    soft, hard = good.filter("mode = 'SOFT'"), good.filter("mode = 'HARD'")
    key = {"TABLE_ID": "TABLE_ID"}
    folded = fold_patches(soft, key, {"STATUS_CD": (F.lit(True), F.lit(OUT_OF_USE))})
    patched = patch(main["table"], folded, key, as_of).select(*TABLE.names)
    images = patch(main["table"], folded, key, as_of, "every")
    updated = snapshot(images, TABLE, "U", F.col("_reason"), F.col("_actor"), as_of)
    replace, history = {"table": patched}, {"table": updated}
    update = {"table": patch(main["table"], folded, key, as_of, "changed").select(*TABLE.names)}
    remove = {}
    if not hard.isEmpty():
        removed, rest = _removal(main | {"table": patched}, hard)
        update = {"table": not_in(update["table"], hard, key, unique=True)}
        remove = removed
        deleted = {
            n: snapshot(rows, ENTITIES[n], "D", F.col("reason"), F.col("_actor"), as_of)
            for n, rows in removed.items()
        }
        history = deleted | {"table": updated.unionByName(deleted["table"])}
        replace = rest | {
            "table": not_in(
                replace["table"], hard, {"TABLE_ID": "TABLE_ID"}, unique=True
            )
        }
    drop = F.concat(F.lit("DROP TABLE "), F.concat_ws(".", "_schema", "_table"), F.lit(";"))
    return Change(
        ddl=statements(good, [(F.col("mode") == "HARD", drop)]),
        rejects=batch.rejects, replace=replace, history=history, update=update, remove=remove,
    )


def leftover_sequences(sequences: DataFrame, tables: DataFrame) -> DataFrame:
    """Sequences whose table is no longer registered."""
    used = sequences.filter(F.col("USED_FOR_TABLE").isNotNull())
    return not_in(
        used, tables, {"SCHEMA_NAME": "SCHEMA_NAME", "USED_FOR_TABLE": "TABLE_NAME"}, unique=True
    )
