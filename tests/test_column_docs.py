"""Documentation of columns with long names, without documentation, and of payload columns."""

import datetime as dt

from tallyloom.queries import metadata


def test_columns_with_docs(spark, tmp_path):
    columns = {"weight_kg": ("FLOAT64", "in kilograms"), "payload": ("JSON", "raw"), "id": ("INT64", None)}
    rows = [("model.a", dt.date(2025, 1, 1), dt.datetime(2025, 1, 1), 0, columns), ("model.b", dt.date(2025, 1, 1), dt.datetime(2025, 1, 1), 1, {})]
    spark.createDataFrame(rows, "unique_id string, snapshot_date date, loaded_at timestamp, pos int, columns map<string, struct<data_type: string, description: string>>").write.parquet(f"{tmp_path}/manifest_nodes.parquet")
    out = metadata.QUERIES["columns_with_docs"](spark, str(tmp_path)).select("column", "description").collect()
    assert sorted(map(tuple, out)) == [("id", ""), ("payload", "raw"), ("weight_kg", "in kilograms")]
