"""Queries that apply batches of change requests to the derived registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.filters import conform
from tablewarden.operators.integrity import children_of
from tablewarden.plans import changes
from tablewarden.schemas import ENTITIES
from tablewarden.session import durable
from workload.business import AS_OF
from workload.derived import collector, relation

query, QUERIES, ORACLES = collector()


def registry(spark: SparkSession, sf_dir: str, *entities: str) -> dict[str, DataFrame]:
    """Derived registry; entities that are not named stay empty."""
    return {
        n: conform(relation(spark, sf_dir, f"meta_{n}"), e.schema) if n in entities
        else spark.createDataFrame([], e.schema)
        for n, e in ENTITIES.items()
    }


def _prefixed(name: str, prefix: str) -> str:
    upper = f"upper(trim({name}))"
    return f"CASE WHEN starts_with({upper}, '{prefix}_') THEN {upper} ELSE '{prefix}_' || {upper} END"


_NAME = "regexp_full_match({}, '[A-Z][A-Z0-9_]*')"
_TABLE_OF = _prefixed("tableName", "TB")


# Tables

def _table_requests(spark, sf_dir) -> DataFrame:
    def column(name, kind, length=None, precision=None, scale=None, key=False, masked=None):
        flag = F.lit(False) if masked is None else masked
        return F.struct(
            F.lit(name).alias("colName"), F.lit(None).cast("string").alias("logicalName"),
            F.lit(kind).alias("dataType"),
            (F.lit(None) if length is None else length).cast("string").alias("dataLength"),
            F.lit(precision).cast("string").alias("dataPrecision"), F.lit(scale).cast("string").alias("dataScale"),
            F.lit(True).alias("nullableYn"), F.lit(key).alias("pkYn"), F.lit(False).alias("ukYn"),
            F.lit(False).alias("fkYn"), F.lit(False).alias("pciYn"), F.lit(None).cast("string").alias("pciCategoryCd"),
            F.lit(False).alias("encryptionYn"), flag.alias("maskingYn"),
            F.when(flag, "NAME").alias("maskingRuleCd"), F.lit(None).cast("string").alias("defaultValue"),
            F.lit(None).cast("string").alias("description"),
        )

    asked = relation(spark, sf_dir, "req_table_create")
    return asked.withColumn(
        "columns",
        F.array(
            column("id", "NUMBER", precision="19", key=True),
            column("name", "VARCHAR2", F.length("name"), masked=F.col("segment") == "HOUSEHOLD"),
            column("bal", "NUMBER", F.col("balLength"), "10", "2"),
        ),
    )


def _create(spark, sf_dir):
    known = registry(spark, sf_dir, "table")
    return changes.table_create(known, _table_requests(spark, sf_dir), AS_OF)


_GOOD_TABLES = f"""good AS (
    SELECT *, upper(schema) AS SCHEMA_NAME, {_TABLE_OF} AS TABLE_NAME, coalesce(emp_id, 'UNKNOWN') AS actor,
           (SELECT max(TABLE_ID) FROM {{meta_table}}) + row_number() OVER (ORDER BY upper(schema), {_TABLE_OF}) AS TABLE_ID
    FROM {{req_table_create}} WHERE trim(reason) <> '' AND segment <> 'MACHINERY' AND balLength IS NULL)"""


@query(f"""
    WITH {_GOOD_TABLES}
    SELECT TABLE_ID, SCHEMA_NAME, TABLE_NAME, logicalName AS LOGICAL_NAME, CASE WHEN viewYn THEN 'Y' ELSE 'N' END AS VIEW_YN,
           actor AS OWNER_EMP_ID, 'Y5' AS RETENTION_PERIOD_CD, 'ACTIVE' AS STATUS_CD, actor AS CREATED_BY,
           TIMESTAMP '2024-01-01 00:00:00' AS UPDATED_AT FROM good""")
def change_table_create(spark, sf_dir):
    return _create(spark, sf_dir).append["table"].select(
        "TABLE_ID", "SCHEMA_NAME", "TABLE_NAME", "LOGICAL_NAME", "VIEW_YN", "OWNER_EMP_ID",
        "RETENTION_PERIOD_CD", "STATUS_CD", "CREATED_BY", "UPDATED_AT",
    )


@query(f"""
    WITH {_GOOD_TABLES}, listed AS (
    SELECT TABLE_ID, 'ID' AS COLUMN_NAME, 1 AS COLUMN_ORDER, 'NUMBER' AS DATA_TYPE, NULL AS DATA_LENGTH, 19 AS DATA_PRECISION,
           NULL AS DATA_SCALE, 'N' AS NULLABLE_YN, 'Y' AS PK_YN, 'N' AS MASKING_YN, NULL AS MASKING_RULE_CD FROM good
    UNION ALL SELECT TABLE_ID, 'NAME', 2, 'VARCHAR2', CAST(length(name) AS INTEGER), NULL, NULL, 'Y', 'N',
           CASE WHEN segment = 'HOUSEHOLD' THEN 'Y' ELSE 'N' END, CASE WHEN segment = 'HOUSEHOLD' THEN 'NAME' END FROM good
    UNION ALL SELECT TABLE_ID, 'BAL', 3, 'NUMBER', NULL, 10, 2, 'Y', 'N', 'N', NULL FROM good)
    SELECT row_number() OVER (ORDER BY TABLE_ID, COLUMN_ORDER) AS COLUMN_ID, * FROM listed""")
def change_table_create_columns(spark, sf_dir):
    return _create(spark, sf_dir).append["column"].select(
        "COLUMN_ID", "TABLE_ID", "COLUMN_NAME", "COLUMN_ORDER", "DATA_TYPE", "DATA_LENGTH",
        "DATA_PRECISION", "DATA_SCALE", "NULLABLE_YN", "PK_YN", "MASKING_YN", "MASKING_RULE_CD",
    )


_SEQUENCE_DDL = """'CREATE SEQUENCE ' || SCHEMA_NAME || '.SEQ_' || substring(TABLE_NAME, 4) || '_ID' || chr(10) || '  START WITH 1'
    || chr(10) || '  INCREMENT BY 1' || chr(10) || '  NOCYCLE' || chr(10) || '  CACHE 20' || chr(10) || '  NOORDER;'"""


@query(f"""
    WITH {_GOOD_TABLES}
    SELECT row_number() OVER (ORDER BY SCHEMA_NAME, 'SEQ_' || substring(TABLE_NAME, 4) || '_ID') AS SEQUENCE_ID, SCHEMA_NAME, 'SEQ_' || substring(TABLE_NAME, 4) || '_ID' AS SEQUENCE_NAME,
           'ID' AS USED_FOR_COLUMN, TABLE_NAME AS USED_FOR_TABLE, {_SEQUENCE_DDL} AS CREATE_DDL FROM good WHERE pkSeqGenYn""")
def change_key_sequences(spark, sf_dir):
    return _create(spark, sf_dir).append["sequence"].select(
        "SEQUENCE_ID", "SCHEMA_NAME", "SEQUENCE_NAME", "USED_FOR_COLUMN", "USED_FOR_TABLE", "CREATE_DDL"
    )


@query(f"""
    WITH {_GOOD_TABLES}, full_names AS (SELECT *, SCHEMA_NAME || '.' || TABLE_NAME AS fq, substring(TABLE_NAME, 4) AS base, chr(10) AS nl FROM good)
    SELECT request_id, 1 AS step, 'CREATE TABLE ' || fq || ' (' || nl || '    ' || rpad('ID', 30, ' ') || ' ' || rpad('NUMBER(19)', 18, ' ') || ' NOT NULL,' || nl
           || '    ' || rpad('NAME', 30, ' ') || ' ' || rpad('VARCHAR2(' || length(name) || ')', 18, ' ') || ',' || nl
           || '    ' || rpad('BAL', 30, ' ') || ' ' || rpad('NUMBER(10,2)', 18, ' ') || ',' || nl
           || '    CONSTRAINT PK_' || base || ' PRIMARY KEY (ID)' || nl || ');' AS statement FROM full_names
    UNION ALL SELECT request_id, 2, 'COMMENT ON TABLE ' || fq || ' IS ''' || replace(logicalName, '''', '''''') || ''';' FROM full_names WHERE logicalName IS NOT NULL
    UNION ALL SELECT request_id, 4, 'CREATE OR REPLACE VIEW ' || SCHEMA_NAME || '.VW_' || base || ' AS' || nl || 'SELECT' || nl || '    ID,' || nl
           || '    NAME,' || nl || '    BAL' || nl || 'FROM ' || fq || ';' FROM full_names WHERE viewGenYn
    UNION ALL SELECT request_id, 5, {_SEQUENCE_DDL} FROM full_names WHERE pkSeqGenYn""")
def change_table_create_ddl(spark, sf_dir):
    return _create(spark, sf_dir).ddl


@query(f"""
    SELECT request_id, 'reason' AS field, 'required' AS rule FROM {{req_table_create}} WHERE trim(reason) = ''
    UNION ALL SELECT request_id, 'tableName', 'charset' FROM {{req_table_create}} WHERE NOT {_NAME.format(_TABLE_OF)}
    UNION ALL SELECT request_id, 'columns.3', 'number_length' FROM {{req_table_create}} WHERE balLength IS NOT NULL""")
def change_request_errors(spark, sf_dir):
    rejects = _create(spark, sf_dir).rejects
    return rejects.select("request_id", F.explode("errors").alias("e")).select("request_id", "e.field", "e.rule")


_GOOD_DROPS = f"""good AS (
    SELECT TABLE_ID, reason, coalesce(emp_id, 'UNKNOWN') AS actor, mode
    FROM {{req_table_drop}} JOIN {{meta_table}} ON SCHEMA_NAME = upper(schema) AND TABLE_NAME = {_TABLE_OF} WHERE mode IN ('SOFT', 'HARD'))"""


def _history(change) -> DataFrame:
    """History of all entities of a change, by key."""
    parts = []
    for name, rows in change.history.items():
        key = [F.col(k).cast("long").alias(f"key{i}") for i, k in enumerate(ENTITIES[name].primary_key)]
        second = [] if len(key) > 1 else [F.lit(None).cast("long").alias("key1")]
        parts.append(rows.select(F.lit(name).alias("entity"), "HIST_TYPE", "HIST_BY", "CHANGE_REASON", *key, *second))
    return reduce(DataFrame.unionByName, parts)


@query(f"""
    WITH {_GOOD_DROPS}
    SELECT 'table' AS entity, CASE mode WHEN 'SOFT' THEN 'U' ELSE 'D' END AS HIST_TYPE, actor AS HIST_BY, reason AS CHANGE_REASON,
           TABLE_ID AS key0, CAST(NULL AS BIGINT) AS key1 FROM good
    UNION ALL SELECT 'column', 'D', actor, reason, COLUMN_ID, NULL FROM good JOIN {{meta_column}} USING (TABLE_ID) WHERE mode = 'HARD'
    UNION ALL SELECT 'index', 'D', actor, reason, INDEX_ID, NULL FROM good JOIN {{meta_index}} USING (TABLE_ID) WHERE mode = 'HARD'
    UNION ALL SELECT 'index_column', 'D', actor, reason, INDEX_ID, COLUMN_POS FROM good JOIN {{meta_index}} USING (TABLE_ID)
           JOIN {{meta_index_column}} USING (INDEX_ID) WHERE mode = 'HARD'""")
def change_table_drop_history(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "column", "index", "index_column")
    return _history(changes.table_drop(known, relation(spark, sf_dir, "req_table_drop"), AS_OF))


@query(f"""
    WITH {_GOOD_DROPS}
    SELECT m.TABLE_ID, SCHEMA_NAME, TABLE_NAME, CASE g.mode WHEN 'SOFT' THEN 'DEPRECATED' ELSE STATUS_CD END AS STATUS_CD, g.actor AS UPDATED_BY
    FROM {{meta_table}} m LEFT JOIN good g ON g.TABLE_ID = m.TABLE_ID WHERE coalesce(g.mode, 'SOFT') = 'SOFT'""")
def change_table_drop(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "column", "index", "index_column")
    done = changes.table_drop(known, relation(spark, sf_dir, "req_table_drop"), AS_OF)
    return done.replace["table"].select("TABLE_ID", "SCHEMA_NAME", "TABLE_NAME", "STATUS_CD", "UPDATED_BY")


@query(f"""
    WITH {_GOOD_DROPS}, gone AS (SELECT TABLE_ID FROM good WHERE mode = 'HARD')
    SELECT 'column' AS entity, 'parent removed' AS rule, CAST(COLUMN_ID AS VARCHAR) AS key FROM {{meta_column}} WHERE TABLE_ID IN (SELECT TABLE_ID FROM gone)
    UNION ALL SELECT 'index', 'parent removed', CAST(INDEX_ID AS VARCHAR) FROM {{meta_index}} WHERE TABLE_ID IN (SELECT TABLE_ID FROM gone)""")
def governed_removed_parents(spark, sf_dir):
    """Columns and indexes that stand in the way if tables alone were removed."""
    known = registry(spark, sf_dir, "table", "column", "index", "index_column")
    gone = changes.table_drop(known, relation(spark, sf_dir, "req_table_drop"), AS_OF).remove["table"]
    keys = durable(gone.select("TABLE_ID"))
    return children_of(known["column"], ENTITIES["column"], keys).unionByName(children_of(known["index"], ENTITIES["index"], keys))


# Columns

def _good_columns(request: str, extra: str, known: bool | None) -> str:
    found = "" if known is None else (
        f"AND {'' if known else 'NOT '}EXISTS (SELECT 1 FROM {{meta_column}} c WHERE c.TABLE_ID = t.TABLE_ID AND c.COLUMN_NAME = upper(colName))")
    return f"""good AS (
        SELECT r.*, t.TABLE_ID, upper(colName) AS COLUMN_NAME FROM {{{request}}} r
        JOIN {{meta_table}} t ON t.SCHEMA_NAME = upper(schema) AND t.TABLE_NAME = {_TABLE_OF}
        WHERE {_NAME.format(_TABLE_OF)} AND {extra} {found})"""


@query(f"""
    WITH {_good_columns('req_column_add', "NOT (dataType = 'NUMBER' AND dataLength IS NOT NULL)", False)},
    highest AS (
        SELECT TABLE_ID, max(o) AS o FROM (
            SELECT TABLE_ID, COLUMN_ORDER AS o FROM {{meta_column}}
            UNION ALL SELECT TABLE_ID, CAST(columnOrder AS INTEGER) FROM good WHERE columnOrder IS NOT NULL) GROUP BY TABLE_ID),
    placed AS (
        SELECT good.*, CAST(columnOrder AS INTEGER) AS COLUMN_ORDER FROM good WHERE columnOrder IS NOT NULL
        UNION ALL
        SELECT good.*, CAST(coalesce(o, 0) + row_number() OVER (PARTITION BY good.TABLE_ID ORDER BY request_seq) AS INTEGER)
        FROM good LEFT JOIN highest ON highest.TABLE_ID = good.TABLE_ID WHERE columnOrder IS NULL)
    SELECT (SELECT max(COLUMN_ID) FROM {{meta_column}}) + row_number() OVER (ORDER BY TABLE_ID, COLUMN_NAME) AS COLUMN_ID,
           TABLE_ID, COLUMN_NAME, COLUMN_ORDER, dataType AS DATA_TYPE, CAST(dataLength AS INTEGER) AS DATA_LENGTH,
           CAST(dataPrecision AS INTEGER) AS DATA_PRECISION, CASE WHEN nullableYn THEN 'Y' ELSE 'N' END AS NULLABLE_YN,
           CASE WHEN ukYn THEN 'Y' ELSE 'N' END AS UK_YN, 'LOW' AS SENSITIVITY_CD
    FROM placed""")
def change_column_add(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "column")
    done = changes.column_add(known, relation(spark, sf_dir, "req_column_add"), AS_OF)
    return done.append["column"].select(
        "COLUMN_ID", "TABLE_ID", "COLUMN_NAME", "COLUMN_ORDER", "DATA_TYPE", "DATA_LENGTH",
        "DATA_PRECISION", "NULLABLE_YN", "UK_YN", "SENSITIVITY_CD",
    )


@query(f"""
    WITH {_good_columns('req_column_modify', "sensitivityCd IS NOT NULL", True)}
    SELECT m.TABLE_ID, m.COLUMN_NAME, CASE WHEN g.tax = 1 THEN CAST(g.dataLength AS INTEGER) ELSE m.DATA_LENGTH END AS DATA_LENGTH,
           CASE WHEN g.TABLE_ID IS NULL THEN m.NULLABLE_YN WHEN g.nullableYn THEN 'Y' ELSE 'N' END AS NULLABLE_YN,
           CASE WHEN g.TABLE_ID IS NULL THEN m.PCI_YN WHEN g.pciYn THEN 'Y' ELSE 'N' END AS PCI_YN,
           coalesce(g.sensitivityCd, m.SENSITIVITY_CD) AS SENSITIVITY_CD,
           CASE WHEN g.TABLE_ID IS NULL THEN m.MASKING_YN ELSE 'Y' END AS MASKING_YN,
           CASE WHEN g.tax = 2 THEN g.maskingRuleCd ELSE m.MASKING_RULE_CD END AS MASKING_RULE_CD,
           coalesce(g.statusCd, m.STATUS_CD) AS STATUS_CD, g.emp_id AS UPDATED_BY
    FROM {{meta_column}} m LEFT JOIN good g ON g.TABLE_ID = m.TABLE_ID AND g.COLUMN_NAME = m.COLUMN_NAME""")
def change_column_modify(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "column")
    touched = F.when(F.col("tax") == 1, F.array(F.lit("logicalName"), F.lit("dataLength"))).when(
        F.col("tax") == 2, F.array(F.lit("maskingRuleCd"))
    )
    asked = relation(spark, sf_dir, "req_column_modify").withColumn("touched", touched)
    return changes.column_modify(known, asked, AS_OF).replace["column"].select(
        "TABLE_ID", "COLUMN_NAME", "DATA_LENGTH", "NULLABLE_YN", "PCI_YN", "SENSITIVITY_CD",
        "MASKING_YN", "MASKING_RULE_CD", "STATUS_CD", "UPDATED_BY",
    )


@query(f"""
    WITH asked AS (
        SELECT request_seq, emp_id, reason, schema, tableName, colName, CAST(dataLength AS INTEGER) AS dataLength, nullableYn, sensitivityCd,
               maskingRuleCd, tax = 1 AS sized, tax = 2 AS ruled, statusCd
        FROM {{req_column_modify}} WHERE sensitivityCd IS NOT NULL
        UNION ALL SELECT request_seq + 1000000000, 'E2', 'again', schema, tableName, colName, CAST(dataLength AS INTEGER) + 1, true, 'LOW',
               NULL, tax >= 4, tax <= 2, NULL
        FROM {{req_column_modify}} WHERE NOT nullableYn),
    good AS (
        SELECT asked.*, t.TABLE_ID, upper(colName) AS COLUMN_NAME FROM asked
        JOIN {{meta_table}} t ON t.SCHEMA_NAME = upper(schema) AND t.TABLE_NAME = {_TABLE_OF} WHERE {_NAME.format(_TABLE_OF)})
    SELECT m.TABLE_ID, m.COLUMN_NAME, emp_id AS HIST_BY, g.reason AS CHANGE_REASON, CASE WHEN g.nullableYn THEN 'Y' ELSE 'N' END AS NULLABLE_YN,
           sensitivityCd AS SENSITIVITY_CD, coalesce(last_value(CASE WHEN sized THEN g.dataLength END IGNORE NULLS) OVER upto, m.DATA_LENGTH) AS DATA_LENGTH,
           CASE WHEN coalesce(max(CASE WHEN ruled THEN 1 END) OVER upto, 0) = 1
                THEN nullif(last_value(CASE WHEN ruled THEN coalesce(g.maskingRuleCd, '') END IGNORE NULLS) OVER upto, '')
                ELSE m.MASKING_RULE_CD END AS MASKING_RULE_CD,
           coalesce(last_value(statusCd IGNORE NULLS) OVER upto, m.STATUS_CD) AS STATUS_CD
    FROM {{meta_column}} m JOIN good g ON g.TABLE_ID = m.TABLE_ID AND g.COLUMN_NAME = m.COLUMN_NAME
    WINDOW upto AS (PARTITION BY m.TABLE_ID, m.COLUMN_NAME ORDER BY request_seq)""")
def change_column_modify_twice(spark, sf_dir):
    """History of columns that are modified up to twice in one batch: an image after each request."""
    known = registry(spark, sf_dir, "table", "column")
    first = relation(spark, sf_dir, "req_column_modify")
    size, rule = F.array(F.lit("dataLength")), F.array(F.lit("maskingRuleCd"))
    second = first.filter(~F.col("nullableYn")).withColumns(
        {
            "request_seq": F.col("request_seq") + 1000000000, "emp_id": F.lit("E2"), "reason": F.lit("again"),
            "dataLength": (F.col("dataLength").cast("int") + 1).cast("string"), "nullableYn": F.lit(True),
            "sensitivityCd": F.lit("LOW"), "maskingRuleCd": F.lit(None).cast("string"), "statusCd": F.lit(None).cast("string"),
            "touched": F.when(F.col("tax") >= 4, size).when(F.col("tax") <= 2, rule),
        }
    )
    first = first.withColumn("touched", F.when(F.col("tax") == 1, size).when(F.col("tax") == 2, rule))
    done = changes.column_modify(known, first.unionByName(second), AS_OF)
    return done.history["column"].select(
        "TABLE_ID", "COLUMN_NAME", "HIST_BY", "CHANGE_REASON", "NULLABLE_YN", "SENSITIVITY_CD", "DATA_LENGTH", "MASKING_RULE_CD", "STATUS_CD"
    )


_DROPPED_COLUMNS = _good_columns("req_column_drop", "true", True) + """,
    hard AS (SELECT * FROM good WHERE mode = 'HARD'),
    entries AS (
        SELECT i.INDEX_ID, i.TABLE_ID, ic.COLUMN_POS, ic.COLUMN_NAME, h.request_seq, h.reason FROM {meta_index} i
        LEFT JOIN {meta_index_column} ic ON ic.INDEX_ID = i.INDEX_ID
        LEFT JOIN hard h ON h.TABLE_ID = i.TABLE_ID AND h.COLUMN_NAME = ic.COLUMN_NAME
        WHERE i.TABLE_ID IN (SELECT TABLE_ID FROM hard)),
    emptied AS (
        SELECT INDEX_ID, max_by(reason, request_seq) AS reason FROM entries GROUP BY INDEX_ID
        HAVING count(*) FILTER (WHERE COLUMN_POS IS NOT NULL AND request_seq IS NULL) = 0)"""


@query(f"""
    WITH {_DROPPED_COLUMNS}
    SELECT 'column' AS entity, CASE mode WHEN 'HARD' THEN 'D' ELSE 'U' END AS HIST_TYPE, emp_id AS HIST_BY, g.reason AS CHANGE_REASON,
           m.COLUMN_ID AS key0, CAST(NULL AS BIGINT) AS key1
    FROM good g JOIN {{meta_column}} m ON m.TABLE_ID = g.TABLE_ID AND m.COLUMN_NAME = g.COLUMN_NAME
    UNION ALL SELECT 'index', 'D', 'E1', reason, INDEX_ID, NULL FROM emptied
    UNION ALL SELECT 'index_column', 'D', 'E1', reason, INDEX_ID, COLUMN_POS FROM entries WHERE request_seq IS NOT NULL""")
def change_column_drop_history(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "column", "index", "index_column")
    asked = relation(spark, sf_dir, "req_column_drop")
    return _history(changes.column_drop(known, asked, AS_OF, full_history=True))


@query(f"""
    WITH {_DROPPED_COLUMNS}
    SELECT 'index' AS entity, INDEX_ID, CAST(NULL AS INTEGER) AS COLUMN_POS FROM {{meta_index}} WHERE INDEX_ID NOT IN (SELECT INDEX_ID FROM emptied)
    UNION ALL SELECT 'index_column', INDEX_ID, COLUMN_POS FROM {{meta_index_column}} m
           WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.INDEX_ID = m.INDEX_ID AND e.COLUMN_POS = m.COLUMN_POS AND request_seq IS NOT NULL)""")
def change_column_drop_indexes(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "column", "index", "index_column")
    done = changes.column_drop(known, relation(spark, sf_dir, "req_column_drop"), AS_OF).replace
    headers = done["index"].select(F.lit("index").alias("entity"), "INDEX_ID", F.lit(None).cast("int").alias("COLUMN_POS"))
    return headers.unionByName(done["index_column"].select(F.lit("index_column").alias("entity"), "INDEX_ID", "COLUMN_POS"))


# Indexes

_PREFIX = "CASE WHEN indexTypeCd = 'UNIQUE' THEN 'UIX' ELSE 'IX' END"
_GOOD_INDEXES = f"""named AS (
    SELECT r.*, t.TABLE_ID, t.SCHEMA_NAME, t.TABLE_NAME, {_PREFIX} || '_' || coalesce(upper(indexName), substring(t.TABLE_NAME, 4) || '_01') AS INDEX_NAME
    FROM {{req_index_create}} r JOIN {{meta_table}} t ON t.SCHEMA_NAME = upper(schema) AND t.TABLE_NAME = {_TABLE_OF}
    WHERE {_NAME.format(_TABLE_OF)} AND indexColumns <> 'a b c'),
    good AS (SELECT *, (SELECT max(INDEX_ID) FROM {{meta_index}}) + row_number() OVER (ORDER BY TABLE_ID, INDEX_NAME) AS INDEX_ID FROM named)"""


def _index_create(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "index")
    return changes.index_create(known, relation(spark, sf_dir, "req_index_create"), AS_OF)


@query(f"""
    WITH {_GOOD_INDEXES}
    SELECT INDEX_ID, TABLE_ID, INDEX_NAME, indexTypeCd AS INDEX_TYPE_CD, upper(tablespaceName) AS TABLESPACE_NAME,
           'CREATE' || CASE WHEN indexTypeCd IN ('UNIQUE', 'BITMAP') THEN ' ' || indexTypeCd ELSE '' END || ' INDEX ' || SCHEMA_NAME || '.' || INDEX_NAME
           || ' ON ' || SCHEMA_NAME || '.' || TABLE_NAME || ' (C' || request_id || ', D DESC, F)'
           || CASE WHEN tablespaceName IS NOT NULL THEN chr(10) || 'TABLESPACE ' || upper(tablespaceName) ELSE '' END || ';' AS CREATE_DDL
    FROM good""")
def change_index_create(spark, sf_dir):
    return _index_create(spark, sf_dir).append["index"].select(
        "INDEX_ID", "TABLE_ID", "INDEX_NAME", "INDEX_TYPE_CD", "TABLESPACE_NAME", "CREATE_DDL"
    )


@query(f"""
    WITH {_GOOD_INDEXES}
    SELECT INDEX_ID, 1 AS COLUMN_POS, 'C' || request_id AS COLUMN_NAME, 'ASC' AS SORT_ORDER FROM good
    UNION ALL SELECT INDEX_ID, 2, 'D', 'DESC' FROM good UNION ALL SELECT INDEX_ID, 3, 'F', 'ASC' FROM good""")
def change_index_create_columns(spark, sf_dir):
    return _index_create(spark, sf_dir).append["index_column"].select(
        "INDEX_ID", "COLUMN_POS", "COLUMN_NAME", "SORT_ORDER"
    )


_DROPPED_INDEXES = f"""gone AS (
    SELECT DISTINCT i.INDEX_ID FROM {{req_index_drop}} r JOIN {{meta_index}} i ON i.INDEX_NAME = upper(indexName)
    LEFT JOIN {{meta_table}} t ON t.SCHEMA_NAME = upper(schema) AND t.TABLE_NAME = {_TABLE_OF}
    WHERE tableName IS NULL OR (t.TABLE_ID = i.TABLE_ID AND {_NAME.format(_TABLE_OF)}))"""


@query(f"""
    WITH {_DROPPED_INDEXES}
    SELECT 'index' AS entity, 'D' AS HIST_TYPE, 'E1' AS HIST_BY, 'unused' AS CHANGE_REASON, INDEX_ID AS key0, CAST(NULL AS BIGINT) AS key1 FROM gone
    UNION ALL SELECT 'index_column', 'D', 'E1', 'unused', INDEX_ID, COLUMN_POS FROM {{meta_index_column}} WHERE INDEX_ID IN (SELECT INDEX_ID FROM gone)""")
def change_index_drop_history(spark, sf_dir):
    known = registry(spark, sf_dir, "table", "index", "index_column")
    return _history(changes.index_drop(known, relation(spark, sf_dir, "req_index_drop"), AS_OF, full_history=True))


# Sequences

_SEQUENCE_OF = _prefixed("seqName", "SEQ")
_USABLE = "coalesce(usedForTable, 'X') <> 'no table'"


@query(f"""
    SELECT (SELECT max(SEQUENCE_ID) FROM {{meta_sequence}}) + row_number() OVER (ORDER BY upper(schema), {_SEQUENCE_OF}) AS SEQUENCE_ID,
           upper(schema) AS SCHEMA_NAME, {_SEQUENCE_OF} AS SEQUENCE_NAME, upper(usedForTable) AS USED_FOR_TABLE,
           CAST(coalesce(incrementBy, '1') AS DECIMAL(38,0)) AS INCREMENT_BY, CAST(1 AS DECIMAL(38,0)) AS START_WITH,
           CAST(20 AS DECIMAL(38,0)) AS CACHE_SIZE, 'N' AS CYCLE_YN,
           'CREATE SEQUENCE ' || upper(schema) || '.' || {_SEQUENCE_OF} || chr(10) || '  START WITH 1' || chr(10) || '  INCREMENT BY ' || coalesce(incrementBy, '1')
           || chr(10) || '  NOCYCLE' || chr(10) || '  CACHE 20' || chr(10) || '  NOORDER;' AS CREATE_DDL
    FROM {{req_sequence}} WHERE {_USABLE} AND NOT EXISTS (
        SELECT 1 FROM {{meta_sequence}} m WHERE m.SCHEMA_NAME = upper(schema) AND m.SEQUENCE_NAME = {_SEQUENCE_OF})""")
def change_sequence_create(spark, sf_dir):
    known = registry(spark, sf_dir, "sequence")
    done = changes.sequence_create(known, relation(spark, sf_dir, "req_sequence"), AS_OF)
    return done.append["sequence"].select(
        "SEQUENCE_ID", "SCHEMA_NAME", "SEQUENCE_NAME", "USED_FOR_TABLE", "INCREMENT_BY", "START_WITH",
        "CACHE_SIZE", "CYCLE_YN", "CREATE_DDL",
    )


@query(f"""
    WITH good AS (SELECT * FROM {{req_sequence}} WHERE {_USABLE})
    SELECT m.SEQUENCE_ID, m.SEQUENCE_NAME, coalesce(CAST(g.incrementBy AS DECIMAL(38,0)), m.INCREMENT_BY) AS INCREMENT_BY, m.CACHE_SIZE,
           coalesce(upper(g.usedForTable), m.USED_FOR_TABLE) AS USED_FOR_TABLE, CASE WHEN g.p_type = 'LARGE' THEN 'Y' ELSE m.ORDER_YN END AS ORDER_YN,
           CASE WHEN g.p_type = 'LARGE' THEN 'ALTER SEQUENCE ' || m.SCHEMA_NAME || '.' || m.SEQUENCE_NAME
                || CASE WHEN g.incrementBy IS NOT NULL THEN chr(10) || '  INCREMENT BY ' || g.incrementBy ELSE '' END
                || chr(10) || '  NOCYCLE' || chr(10) || '  ORDER;' END AS CREATE_DDL, g.emp_id AS UPDATED_BY
    FROM {{meta_sequence}} m LEFT JOIN good g ON upper(g.schema) = m.SCHEMA_NAME AND {_SEQUENCE_OF.replace('seqName', 'g.seqName')} = m.SEQUENCE_NAME""")
def change_sequence_alter(spark, sf_dir):
    known = registry(spark, sf_dir, "sequence")
    large = F.col("p_type") == "LARGE"
    asked = relation(spark, sf_dir, "req_sequence").withColumns(
        {"orderYn": large, "touched": F.when(large, F.array(F.lit("orderYn")))}
    )
    return changes.sequence_alter(known, asked, AS_OF).replace["sequence"].select(
        "SEQUENCE_ID", "SEQUENCE_NAME", "INCREMENT_BY", "CACHE_SIZE", "USED_FOR_TABLE", "ORDER_YN", "CREATE_DDL", "UPDATED_BY"
    )


@query("""
    SELECT 'kept' AS fate, SEQUENCE_ID, SEQUENCE_NAME FROM {meta_sequence} WHERE PURPOSE_CD IS NULL OR PURPOSE_CD <> 'ODD'
    UNION ALL SELECT 'D', SEQUENCE_ID, SEQUENCE_NAME FROM {meta_sequence} WHERE PURPOSE_CD = 'ODD'""")
def change_sequence_drop(spark, sf_dir):
    known = registry(spark, sf_dir, "sequence")
    asked = relation(spark, sf_dir, "req_sequence").filter("p_type = 'MEDIUM'")
    done = changes.sequence_drop(known, asked, AS_OF)
    return done.replace["sequence"].select(F.lit("kept").alias("fate"), "SEQUENCE_ID", "SEQUENCE_NAME").unionByName(
        done.history["sequence"].select(F.col("HIST_TYPE").alias("fate"), "SEQUENCE_ID", "SEQUENCE_NAME")
    )


@query("""
    SELECT SEQUENCE_ID, SEQUENCE_NAME, USED_FOR_TABLE FROM {meta_sequence} s
    WHERE NOT EXISTS (SELECT 1 FROM {meta_table} t WHERE t.SCHEMA_NAME = s.SCHEMA_NAME AND t.TABLE_NAME = s.USED_FOR_TABLE)""")
def change_leftover_sequences(spark, sf_dir):
    known = registry(spark, sf_dir, "sequence", "table")
    return changes.leftover_sequences(known["sequence"], known["table"]).select(
        "SEQUENCE_ID", "SEQUENCE_NAME", "USED_FOR_TABLE"
    )
