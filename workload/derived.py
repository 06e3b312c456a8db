"""Catalog, registry and request relations that are derived from the given tables.

Every order is taken as a table, its part lines as columns, its supplier lines as indexes, every
customer as a view and every part as a sequence, so all of them grow with the data. The relations
are plain SELECTs that Spark and DuckDB read alike; only the operators under test differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}
OWNERS = ["SVC1", "SVC2", "SVC3"]

RELATIONS = {
    # Tables and views of the catalog
    "objects": """
        SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'SVC1' WHEN '2-HIGH' THEN 'SVC2'
                    WHEN '3-MEDIUM' THEN 'SVC3' ELSE 'SVC4' END AS OWNER,
               CASE month(o_orderdate) WHEN 1 THEN 'BIN$' WHEN 2 THEN 'TB_META_'
                    WHEN 3 THEN 'TBXMETAY' ELSE 'TB_O' END || CAST(o_orderkey AS STRING) AS TABLE_NAME
        FROM {orders}""",
    "view_objects": """
        SELECT c_custkey, c_acctbal, c_mktsegment,
               CASE n_regionkey WHEN 0 THEN 'SVC1' WHEN 1 THEN 'SVC2' WHEN 2 THEN 'SVC3' ELSE 'SVC4' END AS OWNER,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'BIN$C' WHEN 'FURNITURE' THEN 'TB_META_C'
                    ELSE 'V_C' END || CAST(c_custkey AS STRING) AS VIEW_NAME
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "real_tables": """
        SELECT OWNER, TABLE_NAME,
               CASE WHEN day(o_orderdate) = 1 THEN 'Y' ELSE 'N' END AS TEMPORARY,
               CASE WHEN day(o_orderdate) = 2 THEN 'YES' ELSE 'NO' END AS NESTED,
               CASE day(o_orderdate) WHEN 3 THEN 'IOT_OVERFLOW' WHEN 4 THEN 'IOT_MAPPING' WHEN 5 THEN 'IOT' END AS IOT_TYPE
        FROM {objects} WHERE o_totalprice >= 20000""",
    "real_views": """
        SELECT OWNER, VIEW_NAME FROM {view_objects} WHERE c_acctbal < 9000""",
    "tab_comments": """
        SELECT OWNER, TABLE_NAME, text AS COMMENTS FROM {objects} JOIN {documents} ON doc_id = o_orderkey
        UNION ALL
        SELECT OWNER, VIEW_NAME, text FROM {view_objects} JOIN {documents} ON doc_id = c_custkey""",
    "meta_table": """
        SELECT o_orderkey + 1 AS TABLE_ID, OWNER AS SCHEMA_NAME, TABLE_NAME, 'N' AS VIEW_YN,
               CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'SVC_PAY' ELSE 'UNASSIGNED' END AS SERVICE_CD,
               CASE o_orderstatus WHEN 'F' THEN 'Y5' ELSE 'Y7' END AS RETENTION_PERIOD_CD,
               CASE WHEN o_totalprice > 450000 THEN 'DEPRECATED' WHEN o_totalprice > 440000 THEN 'RETIRED' ELSE 'ACTIVE' END AS STATUS_CD
        FROM {objects} WHERE o_orderstatus <> 'P'
        UNION ALL
        SELECT -1 - c_custkey, OWNER, VIEW_NAME, 'Y', 'UNASSIGNED', 'PERM',
               CASE WHEN c_acctbal < 0 THEN 'DEPRECATED' ELSE 'ACTIVE' END
        FROM {view_objects} WHERE c_mktsegment <> 'HOUSEHOLD'""",
    # Columns
    "column_objects": """
        SELECT l_orderkey, l_partkey, 'C' || CAST(l_partkey AS STRING) AS COLUMN_NAME,
               min(l_linenumber) AS ord, min(l_returnflag) AS flag, max(l_linestatus) AS st,
               max(CAST(l_quantity AS INT)) AS qty, max(CAST(round(l_discount * 100) AS INT)) AS disc,
               max(CAST(round(l_tax * 100) AS INT)) AS tax, max(year(l_shipdate)) AS ship
        FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "real_columns": """
        SELECT OWNER, TABLE_NAME, COLUMN_NAME, ord AS COLUMN_ID,
               CASE flag WHEN 'A' THEN 'NUMBER' WHEN 'N' THEN 'VARCHAR2' ELSE 'DATE' END AS DATA_TYPE,
               qty AS DATA_LENGTH, CASE flag WHEN 'A' THEN disc END AS DATA_PRECISION,
               CASE WHEN flag = 'A' AND tax > 0 THEN tax END AS DATA_SCALE,
               CASE st WHEN 'O' THEN 'Y' ELSE 'N' END AS NULLABLE
        FROM {column_objects} JOIN {objects} ON l_orderkey = o_orderkey WHERE ship <> 1996""",
    "char_columns": """
        SELECT OWNER, TABLE_NAME, COLUMN_NAME, COLUMN_ID, DATA_TYPE, DATA_LENGTH * 4 AS DATA_LENGTH, DATA_PRECISION, DATA_SCALE, NULLABLE,
               CASE DATA_TYPE WHEN 'VARCHAR2' THEN 'C' END AS CHAR_USED,
               CASE DATA_TYPE WHEN 'VARCHAR2' THEN DATA_LENGTH END AS CHAR_LENGTH
        FROM {real_columns}""",
    "meta_column": """
        SELECT l_partkey AS COLUMN_ID, l_orderkey + 1 AS TABLE_ID, COLUMN_NAME, ord AS COLUMN_ORDER,
               CASE WHEN disc >= 9 THEN 'CHAR' WHEN flag = 'A' THEN 'NUMBER' WHEN flag = 'N' THEN 'VARCHAR2' ELSE 'DATE' END AS DATA_TYPE,
               CASE WHEN qty > 45 THEN qty + 1 ELSE qty END AS DATA_LENGTH,
               CASE WHEN flag = 'A' AND tax < 8 THEN disc END AS DATA_PRECISION,
               CASE flag WHEN 'A' THEN tax END AS DATA_SCALE,
               CASE WHEN ord = 7 THEN NULL WHEN st = 'O' THEN 'Y' ELSE 'N' END AS NULLABLE_YN,
               CASE flag WHEN 'R' THEN 'Y' ELSE 'N' END AS PCI_YN,
               CASE tax WHEN 1 THEN 'IDENT' WHEN 2 THEN 'OTHER' END AS PCI_CATEGORY_CD,
               CASE flag WHEN 'A' THEN 'LOW' WHEN 'N' THEN 'MID' ELSE 'TOP' END AS SENSITIVITY_CD,
               CASE WHEN qty > 40 THEN 'Y' ELSE 'N' END AS MASKING_YN,
               CASE disc WHEN 1 THEN 'NAME' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'ODD' END AS MASKING_RULE_CD,
               CASE ship WHEN 2000 THEN 'DEPRECATED' WHEN 2001 THEN NULL ELSE 'ACTIVE' END AS STATUS_CD
        FROM {column_objects} WHERE ship <> 1995""",
    "col_comments": """
        SELECT OWNER, TABLE_NAME, COLUMN_NAME, text AS COMMENTS
        FROM {column_objects} JOIN {objects} ON l_orderkey = o_orderkey JOIN {documents} ON doc_id = l_orderkey
        WHERE ord = 1""",
    "keyed_objects": """
        SELECT OWNER, CAST(o_orderkey AS STRING) AS key,
               CASE WHEN o_totalprice < 100000 THEN 'DISABLED' ELSE 'ENABLED' END AS STATUS,
               CAST(min(l_suppkey) AS STRING) AS sup
        FROM {lineitem} JOIN {objects} ON l_orderkey = o_orderkey GROUP BY OWNER, o_orderkey, o_totalprice""",
    "constraints": """
        SELECT OWNER, 'P_O' || key AS CONSTRAINT_NAME, 'P' AS CONSTRAINT_TYPE, STATUS, 'IX_O' || key || '_S' || sup AS INDEX_NAME
        FROM {keyed_objects}
        UNION ALL SELECT OWNER, 'U_O' || key, 'U', STATUS, NULL FROM {keyed_objects}
        UNION ALL SELECT OWNER, 'R_O' || key, 'R', STATUS, NULL FROM {keyed_objects}""",
    "cons_columns": """
        SELECT OWNER, CASE flag WHEN 'A' THEN 'P' WHEN 'N' THEN 'U' ELSE 'R' END || '_O' || CAST(o_orderkey AS STRING) AS CONSTRAINT_NAME,
               TABLE_NAME, COLUMN_NAME
        FROM {column_objects} JOIN {objects} ON l_orderkey = o_orderkey
        UNION ALL
        SELECT OWNER, 'U_O' || CAST(o_orderkey AS STRING), TABLE_NAME, COLUMN_NAME
        FROM {column_objects} JOIN {objects} ON l_orderkey = o_orderkey WHERE ord >= 6""",
    "encrypted_columns": """
        SELECT OWNER, TABLE_NAME, COLUMN_NAME, CASE st WHEN 'O' THEN 'AES256' ELSE 'AES128' END AS ENCRYPTION_ALG
        FROM {column_objects} JOIN {objects} ON l_orderkey = o_orderkey WHERE disc = 10""",
    # Indexes
    "index_objects": """
        SELECT l_orderkey, l_suppkey,
               'IX_O' || CAST(l_orderkey AS STRING) || '_S' || CAST(l_suppkey AS STRING) AS INDEX_NAME,
               min(l_returnflag) AS flag, max(l_linestatus) AS st, max(CAST(l_quantity AS INT)) AS qty,
               max(year(l_shipdate)) AS ship
        FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "indexes": """
        SELECT OWNER AS TABLE_OWNER, TABLE_NAME, INDEX_NAME,
               CASE WHEN flag = 'A' AND st = 'O' THEN 'BITMAP' WHEN flag = 'N' AND st = 'O' THEN 'FUNCTION-BASED NORMAL'
                    WHEN flag = 'N' THEN 'NORMAL/REV' ELSE 'NORMAL' END AS INDEX_TYPE,
               CASE WHEN qty > 25 THEN 'UNIQUE' ELSE 'NONUNIQUE' END AS UNIQUENESS,
               'TS_' || flag AS TABLESPACE_NAME
        FROM {index_objects} JOIN {objects} ON l_orderkey = o_orderkey""",
    "index_ids": """
        SELECT l_orderkey + 1 AS INDEX_ID, l_orderkey + 1 AS TABLE_ID, l_orderkey, min(l_suppkey) AS l_suppkey
        FROM {lineitem} GROUP BY l_orderkey""",
    "meta_index": """
        SELECT INDEX_ID, TABLE_ID, INDEX_NAME,
               CASE flag WHEN 'A' THEN 'BITMAP' WHEN 'N' THEN 'HASH' ELSE 'NORMAL' END AS INDEX_TYPE_CD,
               CASE WHEN qty > 45 THEN NULL WHEN qty > 40 THEN 'PK' ELSE 'SEARCH' END AS PURPOSE_CD,
               'ACTIVE' AS STATUS_CD
        FROM {index_ids} a JOIN {index_objects} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey
        WHERE ship <> 1999""",
    "ind_columns": """
        SELECT OWNER AS TABLE_OWNER, TABLE_NAME,
               'IX_O' || CAST(l_orderkey AS STRING) || '_S' || CAST(l_suppkey AS STRING) AS INDEX_NAME,
               l_linenumber AS COLUMN_POSITION,
               CASE WHEN l_linenumber <= 2 THEN 'SYS_NC' || CAST(min(l_partkey) AS STRING) || '$'
                    ELSE 'C' || CAST(min(l_partkey) AS STRING) END AS COLUMN_NAME,
               CASE min(l_returnflag) WHEN 'R' THEN 'DESC' ELSE 'ASC' END AS DESCEND
        FROM {lineitem} JOIN {objects} ON l_orderkey = o_orderkey
        GROUP BY OWNER, TABLE_NAME, l_orderkey, l_suppkey, l_linenumber""",
    "meta_index_column": """
        SELECT INDEX_ID, l_linenumber AS COLUMN_POS,
               CASE WHEN l_linenumber <= 2 THEN 'SYS_NC' || CAST(min(l_partkey) AS STRING) || '$'
                    ELSE 'C' || CAST(min(l_partkey) AS STRING) END AS COLUMN_NAME,
               CASE min(l_returnflag) WHEN 'R' THEN 'DESC' ELSE 'ASC' END AS SORT_ORDER,
               CASE min(l_linestatus) WHEN 'F' THEN 'UPPER(C' || CAST(min(l_partkey) AS STRING) || ')' END AS FUNC_EXPRESSION
        FROM {index_ids} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey
        GROUP BY INDEX_ID, l_linenumber""",
    "ind_expressions": """
        SELECT OWNER AS INDEX_OWNER,
               'IX_O' || CAST(l_orderkey AS STRING) || '_S' || CAST(l_suppkey AS STRING) AS INDEX_NAME,
               l_linenumber AS COLUMN_POSITION,
               'LOWER(C' || CAST(min(l_partkey) AS STRING) || ')' AS COLUMN_EXPRESSION
        FROM {lineitem} JOIN {objects} ON l_orderkey = o_orderkey
        WHERE l_linenumber = 1
        GROUP BY OWNER, l_orderkey, l_suppkey, l_linenumber""",
    # Sequences
    "sequences": """
        SELECT CASE WHEN p_size <= 15 THEN 'SVC1' WHEN p_size <= 30 THEN 'SVC2' ELSE 'SVC9' END AS SEQUENCE_OWNER,
               CASE p_type WHEN 'PROMO' THEN 'SEQ_META_P' ELSE 'SEQ_P' END || CAST(p_partkey AS STRING) AS SEQUENCE_NAME,
               CAST(1 AS DECIMAL(38,0)) AS MIN_VALUE,
               CAST('9999999999999999999999999999' AS DECIMAL(38,0)) AS MAX_VALUE,
               CAST(p_size AS DECIMAL(38,0)) AS INCREMENT_BY, CAST(p_partkey AS DECIMAL(38,0)) AS LAST_NUMBER,
               CAST(20 AS DECIMAL(38,0)) AS CACHE_SIZE,
               CASE p_type WHEN 'SMALL' THEN 'Y' WHEN 'LARGE' THEN 'N' END AS CYCLE_FLAG,
               CASE p_type WHEN 'SMALL' THEN 'N' WHEN 'LARGE' THEN 'Y' END AS ORDER_FLAG
        FROM {part}""",
    "meta_sequence": """
        SELECT p_partkey + 1 AS SEQUENCE_ID,
               CASE WHEN p_size <= 15 THEN 'SVC1' WHEN p_size <= 30 THEN 'SVC2' ELSE 'SVC9' END AS SCHEMA_NAME,
               'SEQ_P' || CAST(p_partkey AS STRING) AS SEQUENCE_NAME,
               CAST(p_size AS DECIMAL(38,0)) AS INCREMENT_BY, CAST(20 AS DECIMAL(38,0)) AS CACHE_SIZE,
               'N' AS CYCLE_YN, 'N' AS ORDER_YN,
               CASE p_type WHEN 'LARGE' THEN 'PK' WHEN 'MEDIUM' THEN 'ODD' END AS PURPOSE_CD,
               'TB_O' || CAST(p_partkey AS STRING) AS USED_FOR_TABLE, 'ACTIVE' AS STATUS_CD
        FROM {part} WHERE p_type IN ('LARGE', 'MEDIUM', 'STANDARD')""",
    # History
    "meta_table_hist": """
        SELECT TABLE_ID, CASE WHEN STATUS_CD = 'ACTIVE' THEN 'I' ELSE 'U' END AS HIST_TYPE,
               CASE WHEN VIEW_YN = 'Y' OR SERVICE_CD = 'UNASSIGNED' THEN 'INITIAL_LOAD' ELSE 'new service' END AS CHANGE_REASON
        FROM {meta_table}""",
    "meta_index_column_hist": """
        SELECT INDEX_ID, COLUMN_POS, CASE SORT_ORDER WHEN 'ASC' THEN 'U' ELSE 'I' END AS HIST_TYPE,
               'FUNC_EXPRESSION_BACKFILL' AS CHANGE_REASON
        FROM {meta_index_column} WHERE FUNC_EXPRESSION IS NOT NULL AND COLUMN_POS = 1""",
    # Change requests
    "req_table_create": """
        SELECT c_custkey AS request_id, c_custkey AS request_seq,
               CASE WHEN c_acctbal < -500 THEN ' ' ELSE 'new service' END AS reason,
               CASE WHEN c_acctbal > 5000 THEN 'E' || CAST(c_nationkey AS STRING) END AS emp_id,
               'svc' || CAST(c_nationkey AS STRING) AS schema,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'bad-' ELSE ' cust' END || CAST(c_custkey AS STRING) AS tableName,
               CASE WHEN c_acctbal > 0 THEN 'it''s ' || c_name END AS logicalName, c_acctbal > 8000 AS viewYn,
               'UNASSIGNED' AS serviceCd, 'Y5' AS retentionPeriodCd, c_mktsegment = 'BUILDING' AS viewGenYn,
               c_mktsegment <> 'FURNITURE' AS pkSeqGenYn, c_name AS name, c_mktsegment AS segment,
               CASE WHEN c_acctbal > 9500 THEN '5' END AS balLength
        FROM {customer}""",
    "req_table_drop": """
        SELECT o_orderkey AS request_id, o_orderkey AS request_seq, 'cleanup' AS reason,
               CASE WHEN o_orderpriority <> '2-HIGH' THEN 'E1' END AS emp_id,
               lower(OWNER) AS schema, lower(TABLE_NAME) AS tableName,
               CASE WHEN o_totalprice < 200000 THEN 'HARD' WHEN o_totalprice < 400000 THEN 'SOFT' END AS mode
        FROM {objects} WHERE o_orderstatus <> 'O'""",
    "req_column": """
        SELECT l_orderkey AS request_id, l_partkey AS request_seq, 'wish' AS reason, 'E1' AS emp_id,
               lower(OWNER) AS schema, lower(TABLE_NAME) AS tableName, lower(COLUMN_NAME) AS colName,
               ord, flag, st, qty, disc, tax, ship
        FROM {column_objects} JOIN {objects} ON l_orderkey = o_orderkey WHERE ship BETWEEN 1995 AND 1998""",
    "req_column_add": """
        SELECT request_id, request_seq, reason, emp_id, schema, tableName, colName,
               CASE WHEN tax = 0 THEN CAST(20 + ord AS STRING) END AS columnOrder,
               CASE flag WHEN 'A' THEN 'NUMBER' WHEN 'N' THEN 'VARCHAR2' ELSE 'DATE' END AS dataType,
               CASE WHEN flag <> 'A' OR disc = 10 THEN CAST(qty AS STRING) END AS dataLength,
               CASE flag WHEN 'A' THEN CAST(qty AS STRING) END AS dataPrecision,
               st = 'O' AS nullableYn, qty > 48 AS ukYn
        FROM {req_column} WHERE ship <= 1996""",
    "req_column_modify": """
        SELECT request_id, request_seq, reason, emp_id, schema, tableName, colName,
               CAST(qty + 100 AS STRING) AS dataLength, st = 'O' AS nullableYn, flag = 'R' AS pciYn,
               CASE WHEN flag <> 'N' THEN 'HIGH' END AS sensitivityCd, false AS encryptionYn, true AS maskingYn,
               CASE WHEN disc > 5 THEN 'FULL' END AS maskingRuleCd, CASE disc WHEN 4 THEN 'PLANNED' END AS statusCd, tax
        FROM {req_column} WHERE ship = 1997""",
    "req_column_drop": """
        SELECT request_id, request_seq, CASE flag WHEN 'A' THEN 'unused' ELSE 'wish' END AS reason, emp_id,
               schema, tableName, colName, CASE WHEN flag <> 'N' THEN 'HARD' ELSE 'SOFT' END AS mode
        FROM {req_column} WHERE ship >= 1997""",
    "req_index_create": """
        SELECT o_orderkey AS request_id, o_orderkey AS request_seq, 'tuning' AS reason, 'E1' AS emp_id,
               lower(OWNER) AS schema, lower(TABLE_NAME) AS tableName,
               CASE WHEN o_totalprice < 100000 THEN 'my' || CAST(o_orderkey AS STRING) END AS indexName,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'UNIQUE' WHEN '2-HIGH' THEN 'BITMAP' ELSE 'NORMAL' END AS indexTypeCd,
               'SEARCH' AS purposeCd,
               CASE WHEN o_totalprice > 450000 THEN 'a b c' ELSE 'c' || CAST(o_orderkey AS STRING) || ', d  desc , e x,f' END AS indexColumns,
               CASE WHEN o_totalprice > 250000 THEN 'ts_idx' END AS tablespaceName
        FROM {objects} WHERE o_orderstatus = 'F'""",
    "req_index_drop": """
        SELECT l_orderkey AS request_id, l_suppkey AS request_seq, 'unused' AS reason, 'E1' AS emp_id,
               lower(OWNER) AS schema, CASE WHEN flag = 'A' THEN lower(TABLE_NAME) END AS tableName,
               lower(INDEX_NAME) AS indexName
        FROM {index_objects} JOIN {objects} ON l_orderkey = o_orderkey WHERE ship BETWEEN 1998 AND 1999""",
    "req_sequence": """
        SELECT p_partkey AS request_id, p_partkey AS request_seq, 'keys' AS reason, 'E1' AS emp_id,
               CASE WHEN p_size <= 15 THEN 'svc1' WHEN p_size <= 30 THEN 'svc2' ELSE 'svc9' END AS schema,
               'p' || CAST(p_partkey AS STRING) AS seqName, p_type, p_size,
               CASE WHEN p_size > 40 THEN 'no table' WHEN p_size > 20 THEN 'tb_x' END AS usedForTable,
               CASE WHEN p_size > 10 THEN CAST(p_size AS STRING) END AS incrementBy
        FROM {part}""",
}


def _needs(text: str) -> list[str]:
    return [n for n in [*GIVEN, *RELATIONS] if "{" + n + "}" in text]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Relations that join lines, grouped within an order, to their orders.
ON_ORDERS = {"real_columns", "col_comments", "cons_columns", "encrypted_columns", "indexes", "req_column"}


def relation(spark: SparkSession, sf_dir: str, name: str, by_order: bool = False) -> DataFrame:
    """A given or derived relation as a DataFrame. Lines that are dealt out ``by_order`` beforehand are shuffled once
    for the groups and the join to the orders."""
    if name in GIVEN:
        rows = given(spark, sf_dir, name)
        return rows.repartition("l_orderkey") if by_order and name == "lineitem" else rows
    text = RELATIONS[name]
    by_order = by_order or name in ON_ORDERS
    return spark.sql(text, **{n: relation(spark, sf_dir, n, by_order) for n in _needs(text)})


def _collect(name: str, seen: dict[str, str]) -> None:
    if name in GIVEN or name in seen:
        return
    text = RELATIONS[name]
    for other in _needs(text):
        _collect(other, seen)
    seen[name] = text


def oracle(body: str) -> str:
    """``body`` as one SQL statement for DuckDB, with the relations it names as CTEs before it."""
    seen: dict[str, str] = {}
    for name in _needs(body):
        _collect(name, seen)
    plain = {n: t for n, t in seen.items()} | {"": body}
    for n in [*GIVEN, *RELATIONS]:
        plain = {k: t.replace("{" + n + "}", n) for k, t in plain.items()}
    last = plain.pop("").strip()
    if not plain:
        return last
    shared = "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in plain.items())
    # A body that has CTEs of its own goes on with the list.
    return f"{shared},\n{last[5:]}" if last.startswith("WITH ") else f"{shared}\n{last}"


def collector():
    """A decorator that registers queries under their names, with the SQL that must give the same
    rows, and the two dictionaries that it fills."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str):
        def register(function):
            queries[function.__name__] = function
            oracles[function.__name__] = oracle(sql)
            return function

        return register

    return query, queries, oracles
