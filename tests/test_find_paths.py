"""Paths of all models by name and by schema.table."""

import datetime as dt

from tallyloom.queries import metadata


def test_find_paths(spark, tmp_path):
    at = (dt.date(2025, 1, 1), dt.datetime(2025, 1, 1))
    rows = [("model.p.a", *at, 1, "s", "aa", "a", "a.sql"), ("model.q.a", *at, 0, "s", "aa", "a", "first.sql"), ("model.p.b", *at, 2, None, None, "b", "b.sql"), ("test.t", *at, 3, "s", "t", "t", "t.sql")]
    spark.createDataFrame(rows, "unique_id string, snapshot_date date, loaded_at timestamp, pos int, schema string, alias string, name string, original_file_path string").write.parquet(f"{tmp_path}/manifest_nodes.parquet")
    out = metadata.QUERIES["find_path"](spark, str(tmp_path)).select("name", "original_file_path").collect()
    assert dict(map(tuple, out)) == {"a": "first.sql", "s.aa": "first.sql", "s.a": "first.sql", "b": "b.sql"}
