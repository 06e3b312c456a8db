import json

from conftest import rows

from tablewarden.sources import catalog, export


def test_snapshot_from_csv_and_parquet(spark, registry, tmp_path):
    export.export_csv(registry["tables"], str(tmp_path / "csv"))
    back = catalog.read_snapshot(spark, str(tmp_path / "csv"), "tables", "csv")
    assert rows(back) == rows(registry["tables"])
    registry["tab_columns"].write.parquet(str(tmp_path / "pq"))
    assert rows(catalog.read_snapshot(spark, str(tmp_path / "pq"), "tab_columns")) == rows(registry["tab_columns"])


def test_requests_are_trimmed_and_completed(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r) for r in [
        {"request_id": 1, "tableName": " a\t", "reason": "  ", "columns": [{"colName": " x ", "dataType": ""}, {"colName": " "}]},
        {"request_id": 2},
    ]))
    found = catalog.read_requests(spark, str(path), "table_create").orderBy("request_id").collect()
    assert (found[0].tableName, found[0].reason, found[1].tableName) == ("a", None, None)
    assert [(c.colName, c.dataType) for c in found[0]["columns"]] == [("x", None)]
    assert found[1]["columns"] is None


def test_statements_one_per_row(spark, tmp_path):
    frame = spark.createDataFrame([("DROP TABLE A;",), ("DROP TABLE B;",)], "ddl string")
    export.export_text(frame, str(tmp_path / "ddl"))
    assert rows(spark.read.text(str(tmp_path / "ddl"))) == [("DROP TABLE A;",), ("DROP TABLE B;",)]
