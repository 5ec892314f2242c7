import pandas as pd
import pytest
from pyspark.errors import PySparkException

from raritas import numeric_projection, read_table, string_projection, with_row_id
from raritas.catalog.workbook_bytes import workbook_bytes


def test_csv_parquet_and_unknown(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    pd.DataFrame({"id": [1, 2], "x": [0.5, 1.5], "s": ["a", "b"]}).to_csv(path, index=False)
    table = read_table(spark, path)
    assert dict(table.dtypes) == {"id": "int", "x": "double", "s": "string"}
    assert read_table(spark, path, "id bigint, x double, s string").schema["id"].dataType.simpleString() == "bigint"
    table.write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "t.json")


def test_folder_of_workbooks(spark, tmp_path):
    folder = tmp_path / "books.xlsx"
    folder.mkdir()
    for i in range(3):
        rows = pd.DataFrame({"id": [10 * i, 10 * i + 1], "x": [0.25 + i, -1.0], "s": ["a & b", f"é{i}"]})
        (folder / f"{i}.xlsx").write_bytes(workbook_bytes(rows))
    table = read_table(spark, str(folder))
    assert dict(table.dtypes) == {"id": "double", "x": "double", "s": "string"}
    found = sorted(tuple(r) for r in table.collect())
    assert found[:2] == [(0.0, 0.25, "a & b"), (1.0, -1.0, "é0")] and len(found) == 6
    typed = read_table(spark, str(folder), "id bigint, s string")
    assert sorted(r["id"] for r in typed.collect()) == [0, 1, 10, 11, 20, 21]


def test_workbook_types_follow_all_rows(spark, tmp_path):
    folder = tmp_path / "odd.xlsx"
    folder.mkdir()
    first = pd.DataFrame({"n": [None, 2.0, 3.0], "mixed": [1.0, 2.0, 3.0], "none": [None, None, None]}).astype(object)
    second = pd.DataFrame({"n": [4.0], "mixed": ["text"], "more": [5.0]}).astype(object)
    for name, rows in (("a", first), ("b", second)):
        (folder / f"{name}.xlsx").write_bytes(workbook_bytes(rows.where(rows.notna(), None)))
    table = read_table(spark, str(folder))
    assert dict(table.dtypes) == {"n": "double", "mixed": "string", "none": "string", "more": "double"}
    assert sorted(r["mixed"] for r in table.collect()) == ["1", "2", "3", "text"]
    assert sorted(r["n"] for r in table.where("n is not null").collect()) == [2.0, 3.0, 4.0]


def test_projections_and_missing_values(spark):
    df = spark.createDataFrame([(1, 2, "a", True), (2, None, None, False)], "id int, n int, s string, b boolean")
    assert numeric_projection(df, "id", "drop").columns == ["id", "n"]
    assert numeric_projection(df, "id", "drop").count() == 1
    assert string_projection(df, "id", "drop").columns == ["id", "s"]
    for project in (numeric_projection, string_projection):
        with pytest.raises(PySparkException):
            project(df, "id").collect()
    nan = spark.createDataFrame([(1, float("nan"))], "id int, x double")
    assert numeric_projection(nan, "id", "drop").count() == 0


def test_row_numbers(spark):
    numbered = with_row_id(spark.range(1000, numPartitions=7).withColumnRenamed("id", "v"))
    rows = sorted((r["row_id"], r["v"]) for r in numbered.collect())
    assert rows == [(i, i) for i in range(1000)]
