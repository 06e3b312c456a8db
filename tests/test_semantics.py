"""The traps in the governance semantics, on one small registry and catalog."""

from conftest import rows

from tablewarden.operators import drift, history, integrity, views
from tablewarden.schemas import TABLE

OWNERS = ["SVC1"]


def test_missing_in_registry(registry):
    found = drift.missing_in_registry(registry["tables"], registry["views"], registry["table"], OWNERS)
    assert rows(found) == [("SVC1", "TB_NEW", "N"), ("SVC1", "V_NEW", "Y")]


def test_missing_in_source(registry):
    found = drift.missing_in_source(registry["table"], registry["tables"], registry["views"])
    assert rows(found) == [("SVC1", "TB_GONE", "N"), ("SVC1", "V_B", "Y")]


def test_column_drift_both_ways_of_joining(registry):
    args = registry["column"], registry["table"], registry["tab_columns"]
    found = drift.column_drift(*args)
    assert rows(found, "TABLE_NAME", "COLUMN_NAME", "diff_kind") == [
        ("TB_A", "ID", "MISMATCH"),
        ("TB_A", "LOST", "MISSING_IN_DB"),
        ("TB_A", "NEWC", "MISSING_IN_META"),
        ("V_B", "A", "MISMATCH"),
    ]
    lost = found.filter("COLUMN_NAME = 'LOST'").first()
    assert lost.real_null == "N" and lost.real_type is None
    assert found.filter("COLUMN_NAME = 'NEWC'").first().real_null == "N"
    assert len(found.columns) == 14
    assert rows(found) == rows(drift.column_drift(*args, one_pass=False))


def test_column_drift_of_stored_types(registry, frame):
    tables = frame("table", [dict(TABLE_ID=1, SCHEMA_NAME="S", TABLE_NAME="T", STATUS_CD="ACTIVE")])
    stored = [("N", "NUMBER", None), ("V", "VARCHAR2", None), ("T", "TIMESTAMP", 11), ("C", "CHAR", 40)]
    real = [("N", "NUMBER", 22), ("V", "VARCHAR2", 1), ("T", "TIMESTAMP(6)", 11), ("C", "CHAR", 40)]
    columns = frame("column", [
        dict(COLUMN_ID=i, TABLE_ID=1, COLUMN_NAME=n, DATA_TYPE=t, DATA_LENGTH=ln, NULLABLE_YN="Y",
             STATUS_CD="ACTIVE") for i, (n, t, ln) in enumerate(stored)])
    catalog = frame("tab_columns", [
        dict(OWNER="S", TABLE_NAME="T", COLUMN_NAME=n, DATA_TYPE=t, DATA_LENGTH=ln, NULLABLE="Y",
             CHAR_USED="C", CHAR_LENGTH=10 if n == "C" else ln) for n, t, ln in real])
    strict = drift.column_drift(columns, tables, catalog)
    assert rows(strict, "COLUMN_NAME") == [("N",), ("T",), ("V",)]
    assert rows(drift.column_drift(columns, tables, catalog, normalize_types=True)) == []
    chars = drift.column_drift(columns, tables, catalog, char_lengths=True, normalize_types=True)
    assert rows(chars, "COLUMN_NAME", "real_len") == [("C", 10)]


def test_initial_history_guard(registry):
    found = history.initial_history(
        registry["table"], registry["table_history"], TABLE, "2024-01-01", "ME")
    assert rows(found, "TABLE_ID") == [(2,), (3,), (4,), (5,)]


def test_code_violations(registry):
    found = integrity.code_violations(
        registry["table"], ["TABLE_ID"], integrity.TABLE_CODES[:1], registry["code"], "bad {column}: ")
    assert rows(found) == [(2, "bad SERVICE_CD: SVC_PAY"), (4, "bad SERVICE_CD: ")]


def test_code_violations_skip_null_only_where_allowed(registry):
    found = integrity.code_violations(
        registry["column"].limit(1), ["COLUMN_ID"], integrity.COLUMN_CODES, registry["code"], "{column}:")
    assert rows(found) == [(1, "STATUS_CD:ACTIVE")]


def test_view_ddl(registry):
    found = views.restricted_view_ddl(registry["table"], registry["column"])
    assert rows(found, "DDL") == [("CREATE OR REPLACE VIEW SVC1.VW_V_B AS SELECT A, ID FROM SVC1.V_B;",)]


def test_closed_views(registry):
    found = views.closed_views(registry["table"], registry["column"])
    assert rows(found) == [("SVC9", "V_X", 1, 0, 1)]


def test_long_names_count_bytes(frame):
    names = ["A" * 125, "B" * 126, "가" * 42, "나" * 41]
    tables = frame("table", [
        dict(TABLE_ID=i, SCHEMA_NAME="S", TABLE_NAME=n, VIEW_YN="Y", STATUS_CD="ACTIVE")
        for i, n in enumerate(names)])
    assert [r.GEN_NAME_BYTES for r in views.long_view_names(tables).collect()] == [129, 129]


def test_masked_view_keeps_unflagged_personal_data(spark, frame):
    meta = frame("column", [
        dict(COLUMN_ID=1, TABLE_ID=1, COLUMN_NAME="ID", COLUMN_ORDER=1, PCI_YN="N", MASKING_YN="N", STATUS_CD="ACTIVE"),
        dict(COLUMN_ID=2, TABLE_ID=1, COLUMN_NAME="NM", COLUMN_ORDER=2, PCI_YN="Y", MASKING_YN="Y",
             MASKING_RULE_CD="NAME", STATUS_CD="ACTIVE"),
        dict(COLUMN_ID=3, TABLE_ID=1, COLUMN_NAME="RRN", COLUMN_ORDER=3, PCI_YN="Y", MASKING_YN="N", STATUS_CD="ACTIVE"),
        dict(COLUMN_ID=4, TABLE_ID=1, COLUMN_NAME="OLD", COLUMN_ORDER=4, PCI_YN="N", MASKING_YN="N", STATUS_CD="DEPRECATED"),
    ])
    data = spark.createDataFrame([(1, "Kim", "900101", 0)], "id int, nm string, rrn string, old int")
    assert rows(views.masked_view(data, meta)) == [(1, "K**", "900101")]
    assert rows(views.restricted_view(data, meta)) == [(1,)]
    tables = frame("table", [dict(TABLE_ID=1, SCHEMA_NAME="S", TABLE_NAME="TB_T")])
    ddl = views.masked_view_ddl(tables, meta.filter("STATUS_CD = 'ACTIVE'")).first().DDL
    assert ddl == (
        "CREATE OR REPLACE VIEW S.VW_T AS\nSELECT\n    ID,\n    FN_MASK_NAME(NM) AS NM,\n    RRN\nFROM S.TB_T;")


def test_declared_rules(frame):
    good = dict(TABLE_ID=1, SCHEMA_NAME="S", TABLE_NAME="T", VIEW_YN="N", SERVICE_CD="U",
                OWNER_EMP_ID="E", KEY_TABLE_YN="N", ISOLATION_YN="N", PCI_YN="N",
                RETENTION_PERIOD_CD="Y5", STATUS_CD="ACTIVE", CREATED_BY="E", UPDATED_BY="E")
    import datetime as dt
    good |= dict(CREATED_AT=dt.datetime(2024, 1, 1), UPDATED_AT=dt.datetime(2024, 1, 1))
    bad = good | dict(TABLE_ID=10**12, VIEW_YN="X", SERVICE_CD=None, STATUS_CD="가나다라")
    found = integrity.declared_violations(frame("table", [good, bad]), TABLE)
    assert rows(found) == sorted([
        (10**12, "TABLE_ID", "too large"), (10**12, "SERVICE_CD", "null"),
        (10**12, "STATUS_CD", "too long"), (10**12, "VIEW_YN", "value")], key=repr)


def test_views_take_the_strictest_of_several_descriptions(spark, frame):
    def told(name, pci, masking="N", rule=None, order=1):
        return dict(TABLE_ID=1, COLUMN_NAME=name, COLUMN_ORDER=order, PCI_YN=pci, MASKING_YN=masking, MASKING_RULE_CD=rule, STATUS_CD="ACTIVE")

    given = [told("SSN", "N"), told("ssn", "Y"), told("B", None, order=2), told("c", "N", "Y", "NAME", 3), told("C", "N", order=4),
             told("D", "N", "Y", "CARD", 5), told("d", "N", "Y", "NAME", 5), told("E", "N", "Y", "", 6)]
    meta = frame("column", [dict(COLUMN_ID=i, **row) for i, row in enumerate(given)])
    data = spark.createDataFrame([("s", "b", "Kim", "Lee", "e")], "ssn string, b string, c string, d string, e string")
    for order in (meta, meta.orderBy("COLUMN_ID"), meta.orderBy(meta["COLUMN_ID"].desc())):
        assert views.restricted_view(data, order).columns == ["c", "d", "e"]
        assert rows(views.masked_view(data, order)) == [("s", "b", "K**", "********", "e")]
