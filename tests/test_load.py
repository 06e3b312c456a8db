import datetime as dt

import pytest
from conftest import rows

from tablewarden.operators import backfill, drift, integrity
from tablewarden.operators.history import backfill_history, with_history_ids
from tablewarden.plans.load import Stamp, load_indexes, new_indexes, run_initial_load
from tablewarden.schemas import ENTITIES, INDEX_COLUMN
from tablewarden.sources.codes import TERMS_SEED, code_seed
from tablewarden.sources.registry import current_version, publish, read_all, read_history, read_registry

STAMP = Stamp(dt.datetime(2024, 1, 1), "LOADER")


@pytest.fixture(scope="module")
def catalog(frame, registry):
    def columns(t, *named):
        return [dict(OWNER="SVC1", TABLE_NAME=t, COLUMN_NAME=n, COLUMN_ID=i, DATA_TYPE="NUMBER",
                     DATA_LENGTH=22, NULLABLE="N") for i, n in enumerate(named, 1)]

    cons = [("PK_A", "P", "ENABLED", "IX_PK"), ("UK_A", "U", "ENABLED", None), ("FK_A", "R", "DISABLED", None)]
    return {
        "tables": registry["tables"],
        "views": registry["views"],
        "tab_comments": frame("tab_comments", [dict(OWNER="SVC1", TABLE_NAME="TB_A", COMMENTS="c" * 2100)]),
        "tab_columns": frame("tab_columns", columns("TB_A", "ID", "X") + columns("V_NEW", "ID") + columns("TB_GTT", "ID")),
        "col_comments": frame("col_comments", [dict(OWNER="SVC1", TABLE_NAME="TB_A", COLUMN_NAME="X", COMMENTS="the x")]),
        "constraints": frame("constraints", [
            dict(OWNER="SVC1", CONSTRAINT_NAME=n, CONSTRAINT_TYPE=t, STATUS=s, INDEX_NAME=i) for n, t, s, i in cons]),
        "cons_columns": frame("cons_columns", [
            dict(OWNER="SVC1", CONSTRAINT_NAME=n, TABLE_NAME="TB_A", COLUMN_NAME=c)
            for n, c in [("PK_A", "ID"), ("UK_A", "ID"), ("UK_A", "X"), ("FK_A", "X")]]),
        "encrypted_columns": frame("encrypted_columns", [
            dict(OWNER="SVC1", TABLE_NAME="TB_A", COLUMN_NAME="X", ENCRYPTION_ALG="AES")]),
        "indexes": frame("indexes", [
            dict(TABLE_OWNER="SVC1", TABLE_NAME="TB_A", INDEX_NAME=n, INDEX_TYPE=t, UNIQUENESS=u)
            for n, t, u in [("IX_PK", "NORMAL", "UNIQUE"), ("IX_B", "BITMAP", "UNIQUE"),
                            ("IX_F", "FUNCTION-BASED NORMAL", "UNIQUE"), ("IX_R", "NORMAL/REV", "UNIQUE"),
                            ("IX_N", "NORMAL", "NONUNIQUE")]]),
        "ind_columns": frame("ind_columns", [
            dict(TABLE_OWNER="SVC1", TABLE_NAME="TB_A", INDEX_NAME=n, COLUMN_POSITION=p, COLUMN_NAME=c, DESCEND="ASC")
            for n, p, c in [("IX_PK", 1, "ID"), ("IX_F", 1, "SYS_NC00003$"), ("IX_F", 2, "X")]]),
        "ind_expressions": frame("ind_expressions", [
            dict(INDEX_OWNER="SVC1", INDEX_NAME="IX_F", COLUMN_POSITION=1, COLUMN_EXPRESSION="UPPER(X)")]),
        "sequences": frame("sequences", [
            dict(SEQUENCE_OWNER="SVC1", SEQUENCE_NAME=n, MAX_VALUE=10**28 - 1, INCREMENT_BY=1, LAST_NUMBER=41,
                 CACHE_SIZE=20, CYCLE_FLAG=None, ORDER_FLAG="Y") for n in ("SEQ_A", "SEQ_META_X")]),
    }


@pytest.fixture(scope="module")
def loaded(spark, catalog, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("registry"))
    run_initial_load(spark, catalog, root, ["SVC1"], code_seed(spark), STAMP)
    return root


def test_tables_and_views(spark, loaded):
    tables = read_registry(spark, loaded, "table")
    assert rows(tables, "TABLE_NAME", "VIEW_YN", "SERVICE_CD", "RETENTION_PERIOD_CD") == [
        (n, v, "UNASSIGNED", "Y5") for n, v in
        [("TB_A", "N"), ("TB_NEW", "N"), ("TB_OLD", "N"), ("V_B", "N"), ("V_NEW", "Y")]]
    assert len(tables.filter("TABLE_NAME = 'TB_A'").first().DESCRIPTION) == 2000
    assert rows(tables, "TABLE_ID") == [(i,) for i in range(1, 6)]


def test_column_flags(spark, loaded):
    found = read_registry(spark, loaded, "column")
    assert rows(found, "COLUMN_NAME", "PK_YN", "UK_YN", "FK_YN", "ENCRYPTION_YN", "ENCRYPTION_ALG", "DESCRIPTION") == [
        ("ID", "N", "N", "N", "N", None, None),
        ("ID", "Y", "Y", "N", "N", None, None),
        ("X", "N", "Y", "N", "Y", "AES", "the x")]


def test_index_classes(spark, loaded):
    found = read_registry(spark, loaded, "index")
    assert rows(found, "INDEX_NAME", "INDEX_TYPE_CD", "PURPOSE_CD") == [
        ("IX_B", "BITMAP", "SEARCH"), ("IX_F", "FUNCTION", "SEARCH"), ("IX_N", "NORMAL", "SEARCH"),
        ("IX_PK", "UNIQUE", "PK"), ("IX_R", "REVERSE", "SEARCH")]


def test_sequences(spark, loaded):
    found = read_registry(spark, loaded, "sequence")
    assert rows(found, "SEQUENCE_NAME", "START_WITH", "CYCLE_YN", "ORDER_YN", "PURPOSE_CD") == [
        ("SEQ_A", 41, "N", "Y", "ETC")]
    assert found.first().MAX_VALUE == 10**28 - 1


def test_codes_and_counts(spark, loaded):
    main, history = read_all(spark, loaded)
    assert main["code"].count() == 43
    report = integrity.code_group_report(main["code"])
    assert report.filter("cnt <> expected").count() == 0 and report.count() == 10
    counts = integrity.main_history_counts(main, history).collect()
    assert [r.src for r in counts] == ["TABLE", "COLUMN", "INDEX", "INDEX_COL", "SEQUENCE", "CODE"]
    assert all(r.main == r.hist > 0 for r in counts)


def test_nothing_violates_the_rules_after_a_load(spark, loaded):
    main, history = read_all(spark, loaded)
    for name, entity in ENTITIES.items():
        assert integrity.declared_violations(main[name], entity).count() == 0
        assert integrity.declared_violations(history[name], entity, history=True).count() == 0
        for repeated in integrity.key_violations(main[name], entity).values():
            assert repeated.count() == 0
        assert integrity.duplicate_keys(history[name], ["HIST_ID"]).count() == 0
    assert integrity.orphans(main["column"], main["table"], {"TABLE_ID": "TABLE_ID"}).count() == 0
    assert integrity.orphans(main["index_column"], main["index"], {"INDEX_ID": "INDEX_ID"}).count() == 0


def test_no_drift_after_a_load(spark, loaded, catalog):
    tables = read_registry(spark, loaded, "table")
    assert drift.missing_in_registry(catalog["tables"], catalog["views"], tables, ["SVC1"]).count() == 0
    assert drift.missing_in_source(tables, catalog["tables"], catalog["views"]).count() == 0
    assert drift.column_drift(read_registry(spark, loaded, "column"), tables, catalog["tab_columns"]).count() == 0


def test_second_load_adds_nothing_and_terms_can_follow(spark, loaded, catalog):
    before = {n: df.count() for n, df in read_all(spark, loaded)[0].items()}
    run_initial_load(spark, catalog, loaded, ["SVC1"], code_seed(spark), STAMP)
    main, history = read_all(spark, loaded)
    assert {n: df.count() for n, df in main.items()} == before
    assert all(r.main == r.hist for r in integrity.main_history_counts(main, history).collect())
    run_initial_load(spark, catalog, loaded, ["SVC1"], code_seed(spark, TERMS_SEED), STAMP)
    assert read_registry(spark, loaded, "code").count() == 46
    assert read_history(spark, loaded, "code").count() == 46


def test_backfill(spark, loaded, catalog):
    main, history = read_all(spark, loaded)
    args = main["index"], main["table"], catalog["ind_expressions"]
    pending = backfill.pending_expressions(main["index_column"], *args)
    assert rows(pending, "INDEX_OWNER", "INDEX_NAME", "COLUMN_POSITION", "COLUMN_EXPRESSION") == [
        ("SVC1", "IX_F", 1, "UPPER(X)")]

    def phases(index_columns, hist):
        return {r.phase: r.cnt for r in backfill.backfill_phases(index_columns, hist).collect()}

    assert phases(main["index_column"], history["index_column"]) == {
        "PENDING": 1, "BACKFILLED": 0, "HIST_BACKFILL": 0}
    assert backfill_history(main["index_column"], history["index_column"], INDEX_COLUMN, STAMP.as_of, "ME").count() == 0
    filled = backfill.apply_expressions(main["index_column"], pending)
    new = with_history_ids(
        backfill_history(filled, history["index_column"], INDEX_COLUMN, STAMP.as_of, "ME"), 1000)
    publish(spark, loaded, STAMP.as_of, replace={"index_column": filled}, history={"index_column": new})
    main, history = read_all(spark, loaded)
    assert phases(main["index_column"], history["index_column"]) == {
        "PENDING": 0, "BACKFILLED": 1, "HIST_BACKFILL": 1}
    assert backfill_history(main["index_column"], history["index_column"], INDEX_COLUMN, STAMP.as_of, "ME").count() == 0


def test_two_constraints_on_one_index_name_show_as_repeated_keys(frame):
    tables = frame("table", [dict(TABLE_ID=1, SCHEMA_NAME="S", TABLE_NAME="T")])
    one = dict(TABLE_OWNER="S", TABLE_NAME="T", INDEX_NAME="IX", INDEX_TYPE="NORMAL", UNIQUENESS="UNIQUE")
    found = new_indexes(frame("indexes", [one, one]), tables, frame("constraints", []), frame("index", []), ["S"])
    assert integrity.duplicate_keys(found, ["TABLE_ID", "INDEX_NAME"]).first().cnt == 2


def test_unpublished_rows_stay_invisible(spark, loaded):
    before = current_version(spark, loaded)
    count = read_registry(spark, loaded, "table").count()

    bad = read_registry(spark, loaded, "table")
    with pytest.raises(Exception):
        publish(spark, loaded, STAMP.as_of, append={"table": bad}, history={"table": bad.select("TABLE_ID")})
    assert current_version(spark, loaded) == before
    assert read_registry(spark, loaded, "table").count() == count


def test_indexes_with_several_key_constraints_get_one_id_each(frame):
    tables = frame("table", [dict(TABLE_ID=1, SCHEMA_NAME="S", TABLE_NAME="T")])
    index = dict(TABLE_OWNER="S", TABLE_NAME="T", INDEX_TYPE="NORMAL", UNIQUENESS="UNIQUE")
    keys = [dict(OWNER="S", CONSTRAINT_NAME=n, CONSTRAINT_TYPE="P", STATUS="ENABLED", INDEX_NAME="IX") for n in ("P1", "P2")]
    found = load_indexes(
        frame("indexes", [index | dict(INDEX_NAME="IX"), index | dict(INDEX_NAME="IY")]), tables,
        frame("constraints", keys), frame("index", []), ["S"], STAMP)
    assert rows(found, "INDEX_ID", "INDEX_NAME", "PURPOSE_CD") == [(1, "IX", "PK"), (2, "IY", "SEARCH")]
