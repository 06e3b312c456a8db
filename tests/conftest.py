import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablewarden.schemas import CATALOG, ENTITIES  # noqa: E402
from tablewarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows given as dicts, completed with NULLs to an entity's or a snapshot's schema."""
    from pyspark.sql import types as T

    def build(name, rows, history=False):
        if name in ENTITIES:
            schema = ENTITIES[name].history_schema if history else ENTITIES[name].schema
        else:
            schema = T.StructType.fromDDL(CATALOG.get(name, name))
        exact = [isinstance(f.dataType, T.DecimalType) for f in schema.fields]
        return spark.createDataFrame(
            [
                tuple(Decimal(v) if d and v is not None else v for d, v in zip(exact, map(r.get, schema.names)))
                for r in rows
            ],
            schema,
        )

    return build


@pytest.fixture(scope="session")
def registry(frame):
    """The small registry and catalog that the semantic tests share."""
    tables = [
        dict(TABLE_ID=i, SCHEMA_NAME=s, TABLE_NAME=n, VIEW_YN=v, STATUS_CD=st, SERVICE_CD=sv,
             RETENTION_PERIOD_CD="Y5")
        for i, s, n, v, st, sv in [
            (1, "SVC1", "TB_A", "N", "ACTIVE", "UNASSIGNED"),
            (2, "SVC1", "V_B", "Y", "ACTIVE", "SVC_PAY"),
            (3, "SVC1", "TB_OLD", "N", "DEPRECATED", "UNASSIGNED"),
            (4, "SVC1", "TB_GONE", "N", "ACTIVE", None),
            (5, "SVC9", "V_X", "Y", "ACTIVE", "UNASSIGNED"),
        ]
    ]
    columns = [
        dict(COLUMN_ID=i, TABLE_ID=t, COLUMN_NAME=n, COLUMN_ORDER=o, DATA_TYPE=ty, DATA_LENGTH=ln,
             DATA_PRECISION=p, DATA_SCALE=sc, NULLABLE_YN=nu, PCI_YN=pci, STATUS_CD=st)
        for i, t, n, o, ty, ln, p, sc, nu, pci, st in [
            (1, 1, "ID", 1, "NUMBER", None, 19, None, "N", "N", "ACTIVE"),
            (2, 1, "AMT", 2, "NUMBER", 22, 10, None, "Y", "N", "ACTIVE"),
            (3, 1, "NM", 3, "VARCHAR2", 0, None, None, "Y", "Y", "ACTIVE"),
            (4, 1, "LOST", 4, "DATE", 7, None, None, "Y", "N", "ACTIVE"),
            (5, 1, "SOFT", 5, "DATE", 7, None, None, "Y", "N", "DEPRECATED"),
            (6, 2, "ID", 2, "NUMBER", 22, None, None, "N", "N", "ACTIVE"),
            (7, 2, "A", 1, "CHAR", 1, None, None, "Y", "N", "ACTIVE"),
            (8, 2, "RRN", 3, "CHAR", 13, None, None, "Y", "Y", "ACTIVE"),
            (9, 5, "CARD", 1, "CHAR", 16, None, None, "Y", "Y", "ACTIVE"),
        ]
    ]
    real = [
        dict(OWNER=o, TABLE_NAME=t, COLUMN_NAME=c, DATA_TYPE=ty, DATA_LENGTH=ln, DATA_PRECISION=p,
             DATA_SCALE=sc, NULLABLE=nu)
        for o, t, c, ty, ln, p, sc, nu in [
            ("SVC1", "TB_A", "ID", "NUMBER", 22, 19, 0, "N"),
            ("SVC1", "TB_A", "AMT", "NUMBER", 22, 10, -1, "Y"),
            ("SVC1", "TB_A", "NM", "VARCHAR2", None, None, None, "Y"),
            ("SVC1", "TB_A", "NEWC", "DATE", 7, None, None, None),
            ("SVC1", "TB_A", "SOFT", "CHAR", 1, None, None, "Y"),
            ("SVC1", "V_B", "ID", "NUMBER", 22, None, None, "N"),
            ("SVC1", "V_B", "A", "CHAR", 1, None, None, "N"),
            ("SVC1", "V_B", "RRN", "CHAR", 13, None, None, "Y"),
            ("SVC9", "V_X", "CARD", "CHAR", 16, None, None, "Y"),
            ("SVC1", "TB_OLD", "Z", "CHAR", 1, None, None, "Y"),
        ]
    ]
    real_tables = [
        dict(OWNER=o, TABLE_NAME=n, TEMPORARY=te, NESTED=ne, IOT_TYPE=i)
        for o, n, te, ne, i in [
            ("SVC1", "TB_A", "N", "NO", None),
            ("SVC1", "TB_NEW", "N", "NO", "IOT"),
            ("SVC1", "TB_GTT", "Y", "NO", None),
            ("SVC1", "TB_NT", "N", "YES", None),
            ("SVC1", "SYS_IOT_OVER_1", "N", "NO", "IOT_OVERFLOW"),
            ("SVC1", "BIN$abc", "N", "NO", None),
            ("SVC1", "TBXMETAY1", "N", "NO", None),
            ("SVC9", "TB_Z", "N", "NO", None),
            ("SVC1", "TB_OLD", "N", "NO", None),
            ("SVC1", "V_B", "N", "NO", None),
        ]
    ]
    history = [
        dict(HIST_ID=1, TABLE_ID=1, HIST_TYPE="I", CHANGE_REASON="INITIAL_LOAD"),
        dict(HIST_ID=2, TABLE_ID=2, HIST_TYPE="I", CHANGE_REASON="new service"),
        dict(HIST_ID=3, TABLE_ID=3, HIST_TYPE="U", CHANGE_REASON="INITIAL_LOAD"),
    ]
    return {
        "table": frame("table", tables),
        "column": frame("column", columns),
        "code": frame("code", [dict(CODE_GROUP="CD_SERVICE", CODE_VALUE="UNASSIGNED", USE_YN="N")]),
        "table_history": frame("table", history, history=True),
        "tab_columns": frame("tab_columns", real),
        "tables": frame("tables", real_tables),
        "views": frame("views", [dict(OWNER="SVC1", VIEW_NAME="V_NEW"), dict(OWNER="SVC9", VIEW_NAME="V_X")]),
    }


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)
