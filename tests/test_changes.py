import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.operators import integrity
from tablewarden.plans import changes
from tablewarden.schemas import ENTITIES, REQUESTS
from tablewarden.sources.registry import current_version, part_of, publish, read_all

AS_OF = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def ask(spark):
    def build(kind, *requests):
        schema = T.StructType.fromDDL(REQUESTS[kind])
        full = []
        for i, r in enumerate(requests, 1):
            r = dict(request_id=i, request_seq=i, reason="why", emp_id="E1", schema="svc1") | r
            full.append(tuple(r.get(n) for n in schema.names))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="module")
def main(frame):
    tables = [
        dict(TABLE_ID=1, SCHEMA_NAME="SVC1", TABLE_NAME="TB_A", STATUS_CD="ACTIVE"),
        dict(TABLE_ID=2, SCHEMA_NAME="SVC1", TABLE_NAME="TB_B", STATUS_CD="ACTIVE"),
    ]
    columns = [
        dict(COLUMN_ID=i, TABLE_ID=t, COLUMN_NAME=n, COLUMN_ORDER=o, LOGICAL_NAME="old", DATA_TYPE="CHAR",
             DATA_LENGTH=3, NULLABLE_YN="Y", PCI_YN="N", MASKING_YN="N", ENCRYPTION_YN="N", STATUS_CD="ACTIVE")
        for i, t, n, o in [(1, 1, "X", 1), (2, 1, "Y", 2), (3, 1, "Z", 7), (4, 2, "X", 1)]
    ]
    indexes = [dict(INDEX_ID=i, TABLE_ID=t, INDEX_NAME=n, STATUS_CD="ACTIVE") for i, t, n in [
        (1, 1, "IX_X"), (2, 1, "IX_XY"), (3, 1, "IX_EMPTY"), (4, 2, "IX_X"), (5, 1, "IX_Z")]]
    entries = [dict(INDEX_ID=i, COLUMN_POS=p, COLUMN_NAME=c, SORT_ORDER="ASC") for i, p, c in [
        (1, 1, "X"), (2, 1, "X"), (2, 2, "Y"), (4, 1, "X"), (5, 1, "Z")]]
    sequences = [dict(SEQUENCE_ID=1, SCHEMA_NAME="SVC1", SEQUENCE_NAME="SEQ_A", INCREMENT_BY=1, CACHE_SIZE=20,
                      CYCLE_YN="N", ORDER_YN="N", PURPOSE_CD="PK", USED_FOR_TABLE="TB_A", CREATE_DDL="old",
                      STATUS_CD="ACTIVE")]
    return {
        "code": frame("code", []), "table": frame("table", tables), "column": frame("column", columns),
        "index": frame("index", indexes), "index_column": frame("index_column", entries),
        "sequence": frame("sequence", sequences),
    }


def reasons(change):
    return {r.request_id: sorted((e.field, e.rule) for e in r.errors) for r in change.rejects.collect()}


def texts(change):
    return [r.statement for r in change.ddl.orderBy("request_id", "step").collect()]


def col(name, kind="VARCHAR2", **more):
    return dict(colName=name, dataType=kind) | more


@pytest.fixture(scope="module")
def made(spark, ask, main):
    names = T.StructType.fromDDL(REQUESTS["table_create"])["columns"].dataType.elementType.names

    def table(name, *columns, **more):
        return dict(tableName=name, columns=[tuple(c.get(n) for n in names) for c in columns],
                    serviceCd="SVC_PAY", retentionPeriodCd="Y5") | more

    requests = ask(
        "table_create",
        table(" member ", col("id", "NUMBER", dataPrecision="19", pkYn=True, nullableYn=True),
              col("nm", dataLength="40", logicalName="it's", nullableYn=False, ukYn=True, maskingYn=True,
                  maskingRuleCd="NAME", defaultValue="'x'"), col(None),
              viewGenYn=True, viewYn=True, tablespace="ts_a", logicalName="Members"),
        table("TB_A", col("c")),
        table("bad-name", col("n", "NUMBER", dataLength="3"), col("1x"), reason="  "),
        table("empty"),
        table("TB_MEMBER", col("z")),
        table("two", col("a", "NUMBER", pkYn=True), col("b", "NUMBER", pkYn=True), emp_id=None, pkSeqGenYn=True),
    )
    return changes.table_create(main, requests, AS_OF)


def test_table_create_rejects(made):
    assert reasons(made) == {
        2: [("tableName", "exists")],
        3: [("columns.1", "number_length"), ("columns.2", "charset"), ("reason", "required"), ("tableName", "charset")],
        4: [("columns", "required")],
        5: [("request", "duplicate")],
    }


def test_table_create_rows(made):
    tables = made.append["table"]
    assert rows(tables, "TABLE_ID", "TABLE_NAME", "VIEW_YN", "OWNER_EMP_ID", "CREATED_AT") == [
        (3, "TB_MEMBER", "Y", "E1", AS_OF), (4, "TB_TWO", "N", "UNKNOWN", AS_OF)]
    columns = made.append["column"]
    assert rows(columns, "COLUMN_ID", "TABLE_ID", "COLUMN_NAME", "COLUMN_ORDER", "NULLABLE_YN", "SENSITIVITY_CD") == [
        (5, 3, "ID", 1, "N", "LOW"), (6, 3, "NM", 2, "N", "LOW"), (7, 4, "A", 1, "N", "LOW"), (8, 4, "B", 2, "N", "LOW")]
    assert rows(made.append["sequence"], "SEQUENCE_ID", "SEQUENCE_NAME", "USED_FOR_COLUMN", "CACHE_SIZE") == [
        (2, "SEQ_MEMBER_ID", "ID", 20)]
    for name in ("table", "column", "sequence"):
        entity = ENTITIES[name]
        snapshots = made.history[name]
        assert rows(snapshots, *entity.names) == rows(made.append[name], *entity.names)
        assert rows(snapshots, "HIST_TYPE", "CHANGE_REASON")[0] == ("I", "why")


def test_table_create_statements(made):
    assert texts(made) == [
        "CREATE TABLE SVC1.TB_MEMBER (\n"
        "    ID                             NUMBER(19)         NOT NULL,\n"
        "    NM                             VARCHAR2(40)       DEFAULT 'x' NOT NULL,\n"
        "    CONSTRAINT PK_MEMBER PRIMARY KEY (ID),\n"
        "    CONSTRAINT UK_MEMBER_01 UNIQUE (NM)\n"
        ")\nTABLESPACE TS_A;",
        "COMMENT ON TABLE SVC1.TB_MEMBER IS 'Members';",
        "COMMENT ON COLUMN SVC1.TB_MEMBER.NM IS 'it''s';",
        "CREATE OR REPLACE VIEW SVC1.VW_MEMBER AS\nSELECT\n    ID,\n    FN_MASK_NAME(NM) AS NM\nFROM SVC1.TB_MEMBER;",
        "CREATE SEQUENCE SVC1.SEQ_MEMBER_ID\n  START WITH 1\n  INCREMENT BY 1\n  NOCYCLE\n  CACHE 20\n  NOORDER;",
        "CREATE TABLE SVC1.TB_TWO (\n"
        "    A                              NUMBER             NOT NULL,\n"
        "    B                              NUMBER             NOT NULL,\n"
        "    CONSTRAINT PK_TWO PRIMARY KEY (A, B)\n);",
    ]


def test_table_drop(ask, main):
    done = changes.table_drop(main, ask(
        "table_drop", dict(tableName="A", mode="HARD"), dict(tableName="b", mode="SOFT", emp_id="E2"),
        dict(tableName="C", mode="SOFT"), dict(tableName="B", mode=None)), AS_OF)
    assert reasons(done) == {3: [("tableName", "unknown")], 4: [("mode", "value")]}
    assert rows(done.replace["table"], "TABLE_ID", "STATUS_CD", "UPDATED_BY") == [(2, "DEPRECATED", "E2")]
    assert rows(done.replace["column"], "COLUMN_ID") == [(4,)]
    assert rows(done.replace["index"], "INDEX_ID") == [(4,)]
    assert rows(done.replace["index_column"], "INDEX_ID") == [(4,)]
    assert rows(done.history["table"], "HIST_TYPE", "TABLE_ID", "STATUS_CD") == [("D", 1, "ACTIVE"), ("U", 2, "DEPRECATED")]
    assert done.history["column"].count() == 3
    assert done.history["index"].count() == 4
    assert done.history["index_column"].count() == 4
    assert texts(done) == ["DROP TABLE SVC1.TB_A;"]
    assert rows(changes.leftover_sequences(main["sequence"], done.replace["table"]), "SEQUENCE_NAME") == [("SEQ_A",)]


def test_column_add(ask, main):
    done = changes.column_add(main, ask(
        "column_add",
        dict(tableName="a", colName="n2", dataType="DATE"),
        dict(tableName="a", colName="n1", dataType="NUMBER", dataPrecision="5", columnOrder="9", nullableYn=False, ukYn=True),
        dict(tableName="a", colName="n3", dataType="CHAR", pkYn=True, fkYn=True, logicalName="L", defaultValue="0"),
        dict(tableName="b", colName="x", dataType="DATE"),
        dict(tableName="b", colName="n", dataType="NUMBER", dataLength="4")), AS_OF)
    assert reasons(done) == {4: [("colName", "exists")], 5: [("dataLength", "number_length")]}
    assert rows(done.append["column"], "COLUMN_NAME", "COLUMN_ORDER", "NULLABLE_YN", "DATA_PRECISION", "PK_YN") == [
        ("N1", 9, "N", 5, "N"), ("N2", 10, "Y", None, "N"), ("N3", 11, "Y", None, "Y")]
    assert texts(done) == [
        "ALTER TABLE SVC1.TB_A ADD (N2 DATE);",
        "ALTER TABLE SVC1.TB_A ADD (N1 NUMBER(5) NOT NULL);",
        "ALTER TABLE SVC1.TB_A ADD CONSTRAINT UK_A_N1 UNIQUE (N1);",
        "ALTER TABLE SVC1.TB_A ADD (N3 CHAR(1) DEFAULT 0);",
        "COMMENT ON COLUMN SVC1.TB_A.N3 IS 'L';",
        "ALTER TABLE SVC1.TB_A ADD CONSTRAINT PK_A PRIMARY KEY (N3);",
        "-- TODO ALTER TABLE SVC1.TB_A ADD CONSTRAINT FK_A_N3 FOREIGN KEY (N3) REFERENCES ...",
    ]


def test_column_modify(ask, main):
    flags = dict(nullableYn=False, pciYn=True, sensitivityCd="HIGH", encryptionYn=False, maskingYn=True)
    done = changes.column_modify(main, ask(
        "column_modify",
        dict(tableName="a", colName="x", touched=["logicalName", "dataLength"], dataLength="9",
             dataType="DATE", statusCd="PLANNED", **flags),
        dict(tableName="a", colName="y", sensitivityCd="LOW"),
        dict(tableName="a", colName="nope", **flags)), AS_OF)
    assert [e for e in reasons(done)[2]] == [(f, "required") for f in ("encryptionYn", "maskingYn", "nullableYn", "pciYn")]
    assert reasons(done)[3] == [("colName", "unknown")]
    after = {r.COLUMN_ID: r for r in done.replace["column"].collect()}
    assert len(after) == 4
    x = after[1]
    assert (x.LOGICAL_NAME, x.DATA_LENGTH, x.DATA_TYPE, x.STATUS_CD, x.SENSITIVITY_CD) == (None, 9, "CHAR", "PLANNED", "HIGH")
    assert (x.NULLABLE_YN, x.PCI_YN, x.MASKING_YN, x.UPDATED_BY) == ("N", "Y", "Y", "E1")
    assert after[2].LOGICAL_NAME == "old" and after[2].UPDATED_BY is None
    assert rows(done.history["column"], "HIST_TYPE", "COLUMN_ID", "DATA_LENGTH") == [("U", 1, 9)]
    assert texts(done) == ["ALTER TABLE SVC1.TB_A MODIFY (X DATE NOT NULL);"]


def test_column_drop(ask, main):
    done = changes.column_drop(main, ask(
        "column_drop", dict(tableName="a", colName="x", mode="HARD", reason="rx"),
        dict(tableName="a", colName="y", mode="HARD", reason="ry"),
        dict(tableName="a", colName="z", mode="SOFT")), AS_OF, full_history=True)
    assert rows(done.replace["column"], "COLUMN_ID", "STATUS_CD") == [(3, "DEPRECATED"), (4, "ACTIVE")]
    assert rows(done.replace["index"], "INDEX_ID") == [(4,), (5,)]
    assert rows(done.replace["index_column"], "INDEX_ID") == [(4,), (5,)]
    assert rows(done.history["index"], "INDEX_ID", "CHANGE_REASON") == [(1, "rx"), (2, "ry"), (3, "rx")]
    assert rows(done.history["column"], "HIST_TYPE", "COLUMN_ID") == [("D", 1), ("D", 2), ("U", 3)]
    assert done.history["index_column"].count() == 3
    strict = changes.column_drop(main, ask("column_drop", dict(tableName="a", colName="x", mode="HARD")), AS_OF)
    assert "index_column" not in strict.history
    # The index on X and Y keeps its second position, without renumbering.
    assert rows(strict.replace["index_column"], "INDEX_ID", "COLUMN_POS") == [(2, 2), (4, 1), (5, 1)]
    assert rows(strict.replace["index"], "INDEX_ID") == [(2,), (4,), (5,)]


def test_index_create(ask, main):
    done = changes.index_create(main, ask(
        "index_create",
        dict(tableName="a", indexTypeCd="UNIQUE", purposeCd="PK", indexColumns="x, y desc , z q", tablespaceName="ts", iniTrans="2"),
        dict(tableName="a", indexName="ix_x", indexTypeCd="NORMAL", indexColumns="x"),
        dict(tableName="a", indexName="foo", indexTypeCd="BITMAP", indexColumns="y", pctFree="5"),
        dict(tableName="a", indexTypeCd="NORMAL", indexColumns="a b c"),
        dict(tableName="a", indexName="i2", indexTypeCd="NORMAL", indexColumns="1a"),
        dict(tableName="none", indexTypeCd="NORMAL", indexColumns="x")), AS_OF)
    assert reasons(done) == {
        2: [("indexName", "exists")], 4: [("indexColumns", "required")],
        5: [("indexColumns.1", "charset")], 6: [("tableName", "unknown")]}
    assert rows(done.append["index"], "INDEX_ID", "INDEX_NAME", "TABLESPACE_NAME", "INI_TRANS", "PCT_FREE") == [
        (6, "IX_FOO", None, None, 5), (7, "UIX_A_01", "TS", 2, None)]
    assert rows(done.append["index_column"], "INDEX_ID", "COLUMN_POS", "COLUMN_NAME", "SORT_ORDER") == [
        (6, 1, "Y", "ASC"), (7, 1, "X", "ASC"), (7, 2, "Y", "DESC")]
    assert list(done.history) == ["index"]
    assert texts(done) == [
        "CREATE UNIQUE INDEX SVC1.UIX_A_01 ON SVC1.TB_A (X, Y DESC)\nTABLESPACE TS\nINITRANS 2;",
        "CREATE BITMAP INDEX SVC1.IX_FOO ON SVC1.TB_A (Y)\nPCTFREE 5;"]


def test_index_drop(ask, main):
    done = changes.index_drop(main, ask(
        "index_drop", dict(indexName="ix_x", reason="all"), dict(tableName="a", indexName="ix_x", reason="one"),
        dict(tableName="b", indexName="ix_z"), dict(tableName="a", indexName="ix_z"),
        dict(indexName="ix_none"), dict(tableName="none", indexName="ix_x")), AS_OF)
    assert reasons(done) == {
        3: [("indexName", "unknown")], 5: [("indexName", "unknown")], 6: [("indexName", "unknown"), ("tableName", "unknown")]}
    assert rows(done.replace["index"], "INDEX_ID") == [(2,), (3,)]
    assert rows(done.replace["index_column"], "INDEX_ID") == [(2,), (2,)]
    assert rows(done.history["index"], "INDEX_ID", "CHANGE_REASON") == [(1, "all"), (4, "all"), (5, "why")]


def test_sequences(ask, main):
    done = changes.sequence_create(main, ask(
        "sequence_create", dict(seqName="b", purposeCd="PK", usedForTable="tb_b", maxValue="9" * 28, cycleYn=True),
        dict(seqName="a", purposeCd="PK"), dict(seqName="x-y"), dict(seqName=None)), AS_OF)
    assert reasons(done) == {
        2: [("seqName", "exists")], 3: [("seqName", "charset")], 4: [("seqName", "required")]}
    made = done.append["sequence"].first()
    assert (made.SEQUENCE_NAME, made.MAX_VALUE, made.CACHE_SIZE, made.CYCLE_YN, made.USED_FOR_TABLE) == (
        "SEQ_B", 10**28 - 1, 20, "Y", "TB_B")
    assert made.CREATE_DDL == (
        f"CREATE SEQUENCE SVC1.SEQ_B\n  START WITH 1\n  INCREMENT BY 1\n  MAXVALUE {'9' * 28}\n  CYCLE\n  CACHE 20\n  NOORDER;")
    done = changes.sequence_alter(main, ask(
        "sequence_alter", dict(seqName="a", incrementBy="5", orderYn=True, cycleYn=True, touched=["incrementBy", "orderYn"])), AS_OF)
    after = done.replace["sequence"].first()
    assert (after.INCREMENT_BY, after.CACHE_SIZE, after.CYCLE_YN, after.ORDER_YN, after.PURPOSE_CD) == (5, 20, "N", "Y", "PK")
    assert after.CREATE_DDL == "ALTER SEQUENCE SVC1.SEQ_A\n  INCREMENT BY 5\n  CYCLE\n  ORDER;"
    done = changes.sequence_alter(main, ask("sequence_alter", dict(seqName="a", purposeCd="ETC")), AS_OF)
    assert done.ddl.count() == 0
    assert rows(done.replace["sequence"], "PURPOSE_CD", "CREATE_DDL") == [("ETC", "old")]
    assert rows(done.history["sequence"], "HIST_TYPE", "PURPOSE_CD") == [("U", "ETC")]
    done = changes.sequence_drop(main, ask("sequence_drop", dict(seqName="a"), dict(seqName="zz")), AS_OF)
    assert reasons(done) == {2: [("seqName", "unknown")]}
    assert done.replace["sequence"].count() == 0
    assert rows(done.history["sequence"], "HIST_TYPE", "SEQUENCE_NAME") == [("D", "SEQ_A")]


def test_requests_with_one_turn_go_by_their_id(ask, main):
    done = changes.sequence_create(main, ask(
        "sequence_create", dict(seqName="t", request_seq=1, emp_id="first"), dict(seqName="SEQ_T", request_seq=1)), AS_OF)
    assert reasons(done) == {2: [("request", "duplicate")]}
    assert rows(done.append["sequence"], "CREATED_BY") == [("first",)]


def complete(main):
    """The rows with something in every required column."""
    blank = {"text": "X", "flag": "N", "time": "2020-01-01", "id": 0, "int": 0, "number": 0}
    done = {}
    for name, df in main.items():
        entity = ENTITIES[name]
        for c in entity.columns:
            if c.required:
                value = c.default or entity.value_sets.get(c.name, (blank[c.kind],))[0]
                df = df.withColumn(c.name, F.coalesce(c.name, F.lit(value).cast(c.spark_type)))
        done[name] = df
    return done


def test_a_batch_that_breaks_a_rule_is_not_published(spark, ask, main, tmp_path):
    root = str(tmp_path)
    publish(spark, root, AS_OF, append=complete(main))
    before = current_version(spark, root)
    with pytest.raises(ValueError, match="INDEX_TYPE_CD null"):
        changes.run_changes(spark, root, changes.index_create, ask("index_create", dict(tableName="a", indexColumns="x")), AS_OF)
    assert current_version(spark, root) == before
    with pytest.raises(RuntimeError):
        publish(spark, root, AS_OF, base=before.number - 1)
    assert current_version(spark, root) == before


def test_a_version_published_meanwhile_is_not_lost(spark, main, tmp_path, monkeypatch):
    from tablewarden.sources import registry

    root = str(tmp_path)
    publish(spark, root, AS_OF, append=complete(main))
    wrote = registry._write_parts

    def interrupted(*given):
        monkeypatch.setattr(registry, "_write_parts", wrote)
        publish(spark, root, AS_OF)  # another batch, while this one writes
        return wrote(*given)

    monkeypatch.setattr(registry, "_write_parts", interrupted)
    with pytest.raises(RuntimeError, match="version 2 was published"):
        publish(spark, root, AS_OF, replace={"table": complete(main)["table"].limit(0)})
    assert current_version(spark, root).number == 2
    assert registry.read_registry(spark, root, "table").count() == main["table"].count()


def test_rows_are_appended_or_replaced_not_both(spark, main, tmp_path):
    table = complete(main)["table"]
    with pytest.raises(ValueError, match="table"):
        publish(spark, str(tmp_path), AS_OF, append={"table": table}, replace={"table": table})
    assert current_version(spark, str(tmp_path)).number == 0


def test_violations_of_added_rows(frame, main):
    known = complete(main)["column"]
    twice = known.filter("COLUMN_ID = 1")
    fresh = twice.withColumn("COLUMN_ID", F.lit(99).cast("long"))
    added = twice.unionByName(fresh.withColumn("COLUMN_NAME", F.lit("NEW"))).unionByName(
        fresh.withColumns({"TABLE_ID": F.lit(77).cast("long"), "PK_YN": F.lit("?"), "COLUMN_NAME": F.lit("N" * 200)}))
    found = integrity.publish_violations(ENTITIES["column"], added, known, main["table"])
    assert {(r.rule, r.key) for r in found.collect()} >= {
        ("primary key", "1"), ("primary key", "99"), ("unique key", "1, X"), ("foreign key", "99"), ("COLUMN_NAME too long", "99")}


def test_batch_is_published_with_its_history(spark, ask, main, tmp_path):
    root = str(tmp_path)
    publish(spark, root, AS_OF, append=complete(main))
    done = changes.run_changes(
        spark, root, changes.column_drop, ask("column_drop", dict(tableName="a", colName="x", mode="SOFT")), AS_OF)
    assert done.rejects.count() == 0
    after, history = read_all(spark, root)
    assert after["column"].filter("STATUS_CD = 'DEPRECATED'").count() == 1 and after["column"].count() == 4
    assert rows(history["column"], "HIST_ID", "HIST_TYPE", "STATUS_CD") == [(1, "U", "DEPRECATED")]
    changes.run_changes(
        spark, root, changes.table_drop, ask("table_drop", dict(tableName="a", mode="HARD")), AS_OF)
    after, history = read_all(spark, root)
    assert rows(after["table"], "TABLE_ID") == [(2,)]
    assert rows(history["column"], "HIST_ID") == [(1,), (2,), (3,), (4,)]


def test_requests_need_an_own_id_and_turn(ask, main):
    done = changes.column_drop(main, ask(
        "column_drop", dict(tableName="a", colName="x", mode="SOFT", request_id=1, request_seq=1),
        dict(tableName="a", colName="x", mode="SOFT", request_id=1, request_seq=1),
        dict(tableName="a", colName="y", mode="SOFT", request_id=None, request_seq=None),
        dict(tableName="a", colName="z", mode="sofft", request_id=4, request_seq=4)), AS_OF)
    found = sorted(((r.request_id, sorted((e.field, e.rule) for e in r.errors)) for r in done.rejects.collect()), key=repr)
    assert found == [
        (1, [("request_id", "duplicate")]), (1, [("request_id", "duplicate")]), (4, [("mode", "value")]),
        (None, [("request_id", "required"), ("request_seq", "required")])]
    assert rows(done.replace["column"], "COLUMN_ID", "STATUS_CD") == [(i, "ACTIVE") for i in (1, 2, 3, 4)]


def test_all_errors_of_a_request_are_listed(ask, main):
    done = changes.column_drop(main, ask(
        "column_drop", dict(tableName="none", colName="x", mode="HARD", reason=" ")), AS_OF)
    assert reasons(done) == {1: [("colName", "unknown"), ("reason", "required"), ("tableName", "unknown")]}


def test_table_create_refuses_repeated_columns_and_sequence_clashes(ask, main):
    names = T.StructType.fromDDL(REQUESTS["table_create"])["columns"].dataType.elementType.names

    def table(name, *columns):
        return dict(tableName=name, columns=[tuple(c.get(n) for n in names) for c in columns],
                    serviceCd="SVC_PAY", retentionPeriodCd="Y5")

    def key(name):
        return col(name, "NUMBER", pkYn=True)

    taken = main | {"sequence": main["sequence"].selectExpr(*[
        f"'SEQ_OLD_K' AS {c}" if c == "SEQUENCE_NAME" else c for c in main["sequence"].columns])}
    done = changes.table_create(taken, ask(
        "table_create", table("twice", col("c"), col("C"), col("d")), table("old", key("k")),
        table("a_b", key("c")), table("a", col("x")), table("a2", key("k")), table("n_b", key("c_d")), table("n_b_c", key("d"))), AS_OF)
    assert reasons(done) == {
        1: [("columns", "duplicate")], 2: [("pkSeqGenYn", "exists")], 4: [("tableName", "exists")],
        7: [("pkSeqGenYn", "duplicate")]}
    assert rows(done.append["sequence"], "SEQUENCE_NAME") == [("SEQ_A2_K",), ("SEQ_A_B_C",), ("SEQ_N_B_C_D",)]


def test_several_requests_for_one_column_fold_in_their_order(ask, main):
    flags = dict(nullableYn=False, pciYn=True, sensitivityCd="HIGH", encryptionYn=False, maskingYn=True)
    done = changes.column_modify(main, ask(
        "column_modify",
        dict(tableName="a", colName="x", request_seq=9, emp_id="late", touched=["dataLength"], dataLength="9", **flags | {"pciYn": False}),
        dict(tableName="a", colName="x", request_seq=2, emp_id="early", touched=["logicalName", "dataLength"],
             logicalName="first", dataLength="5", **flags),
        dict(tableName="a", colName="y", request_seq=1, touched=["logicalName"], **flags)), AS_OF)
    assert done.rejects.count() == 0
    after = {r.COLUMN_ID: r for r in done.update["column"].collect()}
    assert sorted(after) == [1, 2]
    x = after[1]
    assert (x.LOGICAL_NAME, x.DATA_LENGTH, x.PCI_YN, x.UPDATED_BY) == ("first", 9, "N", "late")
    # A field that was touched and empty is NULL, not the value before.
    assert after[2].LOGICAL_NAME is None
    images = done.history["column"].filter("COLUMN_ID = 1")
    assert rows(images, "HIST_BY", "LOGICAL_NAME", "DATA_LENGTH", "PCI_YN") == [
        ("early", "first", 5, "Y"), ("late", "first", 9, "N")]
    assert done.history["column"].count() == 3
    whole = {r.COLUMN_ID: r for r in done.replace["column"].collect()}
    assert len(whole) == 4 and whole[1] == x


def test_a_table_is_put_out_of_use_and_then_removed(ask, main):
    done = changes.table_drop(main, ask(
        "table_drop", dict(tableName="a", mode="SOFT", emp_id="s1"), dict(tableName="a", mode="SOFT", emp_id="s2"),
        dict(tableName="a", mode="HARD", emp_id="h"), dict(tableName="a", mode="SOFT")), AS_OF)
    assert reasons(done) == {4: [("tableName", "unknown")]}
    assert done.update["table"].count() == 0
    assert rows(done.remove["table"], "TABLE_ID") == [(1,)]
    assert rows(done.history["table"], "HIST_TYPE", "HIST_BY", "STATUS_CD", "UPDATED_BY") == [
        ("D", "h", "DEPRECATED", "s2"), ("U", "s1", "DEPRECATED", "s1"), ("U", "s2", "DEPRECATED", "s2")]
    done = changes.column_drop(main, ask(
        "column_drop", dict(tableName="a", colName="x", mode="SOFT"), dict(tableName="a", colName="x", mode="HARD")), AS_OF)
    assert rows(done.history["column"], "HIST_TYPE", "STATUS_CD") == [("D", "DEPRECATED"), ("U", "DEPRECATED")]
    assert rows(done.remove["column"], "COLUMN_ID") == [(1,)]


def test_a_batch_writes_only_the_parts_it_touches(spark, ask, main, tmp_path):
    root = str(tmp_path)
    many = spark.range(200).select(
        F.lit(None).cast("string").alias("_"), (F.col("id") + 100).alias("COLUMN_ID"), F.lit(2).cast("long").alias("TABLE_ID"),
        F.concat(F.lit("M"), "id").alias("COLUMN_NAME"), F.lit("CHAR").alias("DATA_TYPE"), F.lit("ACTIVE").alias("STATUS_CD")).drop("_")
    filled = complete(main | {"column": main["column"].unionByName(many, allowMissingColumns=True)})
    publish(spark, root, AS_OF, append=filled, parts=8)
    before = current_version(spark, root)
    assert before.parts == 8 and len(before.main["column"]) == 8
    changes.run_changes(spark, root, changes.column_drop, ask("column_drop", dict(tableName="a", colName="x", mode="SOFT")), AS_OF)
    soft = current_version(spark, root)
    kept = set(before.main["column"]) & set(soft.main["column"])
    assert len(kept) == 7 and len(soft.main["column"]) == 8
    assert all(soft.main[n] == before.main[n] for n in before.main if n != "column")
    found = rows(read_all(spark, root)[0]["column"], "COLUMN_ID", "STATUS_CD")
    assert found == sorted((
        (r.COLUMN_ID, "DEPRECATED" if r.COLUMN_ID == 1 else r.STATUS_CD) for r in filled["column"].collect()), key=repr)
    # Removing every row of a part leaves no folder for it; nothing else is written.
    key = part_of(ENTITIES["column"], 8)
    gone = filled["column"].filter(key == 3)
    publish(spark, root, AS_OF, remove={"column": gone})
    last = current_version(spark, root)
    assert [p for p in soft.main["column"] if not p.endswith("part=3")] == last.main["column"]
    publish(spark, root, AS_OF, remove={"column": gone.limit(0)}, update={"column": gone.limit(0)})
    assert current_version(spark, root).main["column"] == last.main["column"]


def test_a_parent_with_children_is_not_removed(spark, main, tmp_path):
    root = str(tmp_path)
    publish(spark, root, AS_OF, append=complete(main))
    gone = main["table"].filter("TABLE_ID = 1")
    with pytest.raises(ValueError, match="parent removed"):
        publish(spark, root, AS_OF, remove={"table": gone}, check=True)
    assert current_version(spark, root).number == 1
    publish(spark, root, AS_OF, check=True, remove={
        "table": gone, "column": main["column"].filter("TABLE_ID = 1"), "index": main["index"].filter("TABLE_ID = 1"),
        "index_column": main["index_column"].join(main["index"].filter("TABLE_ID = 1"), "INDEX_ID", "left_semi")})
    assert rows(read_all(spark, root)[0]["table"], "TABLE_ID") == [(2,)]
