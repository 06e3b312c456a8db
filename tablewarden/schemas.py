"""Schemas, keys and declared rules of the catalog snapshots, the registry and the requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_SPARK = {
    "text": T.StringType(),
    "flag": T.StringType(),
    "id": T.LongType(),
    "int": T.IntegerType(),
    "number": T.DecimalType(38, 0),
    "time": T.TimestampType(),
}


@dataclass(frozen=True)
class Column:
    """One registry column: ``size`` is bytes for text, decimal digits for numbers."""

    name: str
    kind: str
    size: int | None = None
    required: bool = False
    default: object = None

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK[self.kind]


@dataclass(frozen=True)
class Entity:
    """One registry entity with the rules that Spark itself does not enforce."""

    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    unique_key: tuple[str, ...] | None = None
    parent: tuple[str, str] | None = None
    value_sets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    surrogate: str | None = None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])

    @property
    def history_schema(self) -> T.StructType:
        return T.StructType(list(HISTORY_HEADER.fields) + list(self.schema.fields))

    @property
    def defaults(self) -> dict[str, object]:
        return {c.name: c.default for c in self.columns if c.default is not None}


YES_NO = ("Y", "N")
HISTORY_TYPES = ("I", "U", "D")
HISTORY_HEADER = T.StructType(
    [
        T.StructField("HIST_ID", T.LongType()),
        T.StructField("HIST_TYPE", T.StringType()),
        T.StructField("HIST_AT", T.TimestampType()),
        T.StructField("HIST_BY", T.StringType()),
        T.StructField("CHANGE_REASON", T.StringType()),
    ]
)
HISTORY_RULES = (
    Column("HIST_ID", "id", 16, True),
    Column("HIST_TYPE", "flag", 1, True),
    Column("HIST_AT", "time", None, True),
    Column("HIST_BY", "text", 128, True),
    Column("CHANGE_REASON", "text", 2000, True),
)

_AUDIT = (
    Column("CREATED_BY", "text", 128, True),
    Column("CREATED_AT", "time", None, True),
    Column("UPDATED_BY", "text", 128, True),
    Column("UPDATED_AT", "time", None, True),
)
AUDIT_COLUMNS = tuple(c.name for c in _AUDIT)


def _text(name, size, required=False, default=None):
    return Column(name, "text", size, required, default)


def _flag(name, default="N"):
    return Column(name, "flag", 1, True, default)


# The registry's data model (names, sizes, keys, defaults).
CODE = Entity(
    "code",
    (
        _text("CODE_GROUP", 30, True),
        _text("CODE_VALUE", 30, True),
        _text("CODE_NAME", 200, True),
        _text("DESCRIPTION", 2000),
        Column("SORT_ORDER", "int", 4),
        _flag("USE_YN", "Y"),
        *_AUDIT,
    ),
    primary_key=("CODE_GROUP", "CODE_VALUE"),
    value_sets={"USE_YN": YES_NO},
)

TABLE = Entity(
    "table",
    (
        Column("TABLE_ID", "id", 12, True),
        _text("SCHEMA_NAME", 128, True),
        _text("TABLE_NAME", 128, True),
        _text("LOGICAL_NAME", 200),
        _text("DESCRIPTION", 2000),
        _flag("VIEW_YN"),
        _text("SERVICE_CD", 20, True),
        _text("OWNER_EMP_ID", 20, True),
        _text("SECONDARY_EMP_ID", 20),
        _flag("KEY_TABLE_YN"),
        _flag("ISOLATION_YN"),
        _text("ISOLATION_LEVEL_CD", 10),
        _flag("PCI_YN"),
        _text("RETENTION_PERIOD_CD", 10, True),
        _text("RETENTION_BASIS", 500),
        _text("TOS_CD", 20),
        _text("STATUS_CD", 10, True, "ACTIVE"),
        _text("REMARK", 4000),
        *_AUDIT,
    ),
    primary_key=("TABLE_ID",),
    unique_key=("SCHEMA_NAME", "TABLE_NAME"),
    value_sets={c: YES_NO for c in ("VIEW_YN", "KEY_TABLE_YN", "ISOLATION_YN", "PCI_YN")},
    surrogate="TABLE_ID",
)

COLUMN = Entity(
    "column",
    (
        Column("COLUMN_ID", "id", 14, True),
        Column("TABLE_ID", "id", 12, True),
        _text("COLUMN_NAME", 128, True),
        Column("COLUMN_ORDER", "int", 4, True),
        _text("LOGICAL_NAME", 200),
        _text("DESCRIPTION", 2000),
        _text("DATA_TYPE", 30, True),
        Column("DATA_LENGTH", "int", 6),
        Column("DATA_PRECISION", "int", 6),
        Column("DATA_SCALE", "int", 6),
        Column("NULLABLE_YN", "flag", 1, True),
        _text("DEFAULT_VALUE", 500),
        _flag("PK_YN"),
        _flag("UK_YN"),
        _flag("FK_YN"),
        _flag("PCI_YN"),
        _text("PCI_CATEGORY_CD", 20),
        _text("SENSITIVITY_CD", 10, True, "LOW"),
        _flag("ENCRYPTION_YN"),
        _text("ENCRYPTION_ALG", 50),
        _flag("MASKING_YN"),
        _text("MASKING_RULE_CD", 20),
        _text("RETENTION_PERIOD_CD", 10),
        _text("TOS_CD", 20),
        _text("STATUS_CD", 10, True, "ACTIVE"),
        _text("REMARK", 4000),
        *_AUDIT,
    ),
    primary_key=("COLUMN_ID",),
    unique_key=("TABLE_ID", "COLUMN_NAME"),
    parent=("table", "TABLE_ID"),
    value_sets={
        c: YES_NO
        for c in ("NULLABLE_YN", "PK_YN", "UK_YN", "FK_YN", "PCI_YN", "ENCRYPTION_YN", "MASKING_YN")
    },
    surrogate="COLUMN_ID",
)

INDEX = Entity(
    "index",
    (
        Column("INDEX_ID", "id", 12, True),
        Column("TABLE_ID", "id", 12, True),
        _text("INDEX_NAME", 128, True),
        _text("INDEX_TYPE_CD", 20, True),
        _text("TABLESPACE_NAME", 30),
        Column("INI_TRANS", "int", 4),
        Column("PCT_FREE", "int", 3),
        _text("PURPOSE_CD", 20, True),
        _text("PERFORMANCE_NOTE", 4000),
        _text("CREATE_DDL", None),
        _text("STATUS_CD", 10, True, "ACTIVE"),
        *_AUDIT,
    ),
    primary_key=("INDEX_ID",),
    unique_key=("TABLE_ID", "INDEX_NAME"),
    parent=("table", "TABLE_ID"),
    surrogate="INDEX_ID",
)

INDEX_COLUMN = Entity(
    "index_column",
    (
        Column("INDEX_ID", "id", 12, True),
        Column("COLUMN_POS", "int", 3, True),
        _text("COLUMN_NAME", 128, True),
        _text("SORT_ORDER", 4, True, "ASC"),
        _text("FUNC_EXPRESSION", 2000),
    ),
    primary_key=("INDEX_ID", "COLUMN_POS"),
    parent=("index", "INDEX_ID"),
    value_sets={"SORT_ORDER": ("ASC", "DESC")},
)

SEQUENCE = Entity(
    "sequence",
    (
        Column("SEQUENCE_ID", "id", 12, True),
        _text("SCHEMA_NAME", 128, True),
        _text("SEQUENCE_NAME", 128, True),
        Column("MIN_VALUE", "number"),
        Column("MAX_VALUE", "number"),
        Column("INCREMENT_BY", "number", None, True),
        Column("START_WITH", "number"),
        Column("CACHE_SIZE", "number"),
        _flag("CYCLE_YN"),
        _flag("ORDER_YN"),
        _text("PURPOSE_CD", 20, True),
        _text("USED_FOR_TABLE", 128),
        _text("USED_FOR_COLUMN", 128),
        _text("CREATE_DDL", None),
        _text("STATUS_CD", 10, True, "ACTIVE"),
        *_AUDIT,
    ),
    primary_key=("SEQUENCE_ID",),
    unique_key=("SCHEMA_NAME", "SEQUENCE_NAME"),
    value_sets={c: YES_NO for c in ("CYCLE_YN", "ORDER_YN")},
    surrogate="SEQUENCE_ID",
)

ENTITIES = {e.name: e for e in (CODE, TABLE, COLUMN, INDEX, INDEX_COLUMN, SEQUENCE)}

# The catalog snapshots and the columns that the jobs read from them.
CATALOG = {
    "tables": "OWNER STRING, TABLE_NAME STRING, TEMPORARY STRING, NESTED STRING, IOT_TYPE STRING",
    "views": "OWNER STRING, VIEW_NAME STRING",
    "tab_comments": "OWNER STRING, TABLE_NAME STRING, COMMENTS STRING",
    "tab_columns": (
        "OWNER STRING, TABLE_NAME STRING, COLUMN_NAME STRING, COLUMN_ID INT, DATA_TYPE STRING, "
        "DATA_LENGTH INT, DATA_PRECISION INT, DATA_SCALE INT, NULLABLE STRING, "
        "CHAR_USED STRING, CHAR_LENGTH INT"
    ),
    "col_comments": "OWNER STRING, TABLE_NAME STRING, COLUMN_NAME STRING, COMMENTS STRING",
    "constraints": (
        "OWNER STRING, CONSTRAINT_NAME STRING, CONSTRAINT_TYPE STRING, STATUS STRING, INDEX_NAME STRING"
    ),
    "cons_columns": "OWNER STRING, CONSTRAINT_NAME STRING, TABLE_NAME STRING, COLUMN_NAME STRING",
    "encrypted_columns": (
        "OWNER STRING, TABLE_NAME STRING, COLUMN_NAME STRING, ENCRYPTION_ALG STRING"
    ),
    "indexes": (
        "TABLE_OWNER STRING, TABLE_NAME STRING, INDEX_NAME STRING, INDEX_TYPE STRING, "
        "UNIQUENESS STRING, TABLESPACE_NAME STRING"
    ),
    "ind_columns": (
        "TABLE_OWNER STRING, TABLE_NAME STRING, INDEX_NAME STRING, COLUMN_POSITION INT, "
        "COLUMN_NAME STRING, DESCEND STRING"
    ),
    "ind_expressions": (
        "INDEX_OWNER STRING, INDEX_NAME STRING, COLUMN_POSITION INT, COLUMN_EXPRESSION STRING"
    ),
    "sequences": (
        "SEQUENCE_OWNER STRING, SEQUENCE_NAME STRING, MIN_VALUE DECIMAL(38,0), "
        "MAX_VALUE DECIMAL(38,0), INCREMENT_BY DECIMAL(38,0), LAST_NUMBER DECIMAL(38,0), "
        "CACHE_SIZE DECIMAL(38,0), CYCLE_FLAG STRING, ORDER_FLAG STRING"
    ),
}

_REQUEST = "request_id BIGINT, request_seq BIGINT, reason STRING, emp_id STRING, schema STRING, "
_COLUMN_FORM = (
    "tableName STRING, colName STRING, logicalName STRING, columnOrder STRING, dataType STRING, "
    "dataLength STRING, dataPrecision STRING, dataScale STRING, pkYn BOOLEAN, ukYn BOOLEAN, "
    "fkYn BOOLEAN, nullableYn BOOLEAN, defaultValue STRING, description STRING, pciYn BOOLEAN, "
    "pciCategoryCd STRING, sensitivityCd STRING, encryptionYn BOOLEAN, encryptionAlg STRING, "
    "maskingYn BOOLEAN, maskingRuleCd STRING, retentionPeriodCd STRING, tosCd STRING, statusCd STRING"
)
_SEQUENCE_FORM = (
    "seqName STRING, purposeCd STRING, usedForTable STRING, usedForColumn STRING, "
    "incrementBy STRING, startWith STRING, minValue STRING, maxValue STRING, cacheSize STRING, "
    "cycleYn BOOLEAN, orderYn BOOLEAN"
)
# The fields of each kind of change request.
REQUESTS = {
    "table_create": _REQUEST
    + "tableName STRING, logicalName STRING, viewYn BOOLEAN, description STRING, serviceCd STRING, "
    "keyTableYn BOOLEAN, isolationYn BOOLEAN, isolationLevelCd STRING, pciYn BOOLEAN, "
    "retentionPeriodCd STRING, retentionBasis STRING, tosCd STRING, viewGenYn BOOLEAN, "
    "viewName STRING, pkSeqGenYn BOOLEAN, tablespace STRING, remark STRING, "
    "columns ARRAY<STRUCT<colName: STRING, logicalName: STRING, dataType: STRING, "
    "dataLength: STRING, dataPrecision: STRING, dataScale: STRING, nullableYn: BOOLEAN, "
    "pkYn: BOOLEAN, ukYn: BOOLEAN, fkYn: BOOLEAN, pciYn: BOOLEAN, pciCategoryCd: STRING, "
    "encryptionYn: BOOLEAN, maskingYn: BOOLEAN, maskingRuleCd: STRING, defaultValue: STRING, "
    "description: STRING>>",
    "table_drop": _REQUEST + "tableName STRING, mode STRING",
    "column_add": _REQUEST + _COLUMN_FORM,
    "column_modify": _REQUEST + _COLUMN_FORM + ", touched ARRAY<STRING>",
    "column_drop": _REQUEST + "tableName STRING, colName STRING, mode STRING",
    "index_create": _REQUEST
    + "tableName STRING, indexName STRING, indexTypeCd STRING, purposeCd STRING, "
    "indexColumns STRING, tablespaceName STRING, iniTrans STRING, pctFree STRING, "
    "performanceNote STRING",
    "index_drop": _REQUEST + "tableName STRING, indexName STRING",
    "sequence_create": _REQUEST + _SEQUENCE_FORM,
    "sequence_alter": _REQUEST + _SEQUENCE_FORM + ", touched ARRAY<STRING>",
    "sequence_drop": _REQUEST + "seqName STRING",
}
