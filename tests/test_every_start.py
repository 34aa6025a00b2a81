"""The closure queries from every name of the graph, whatever its prefix."""

import datetime as dt

from tallyloom.queries import structure

LINKS = {"model.a": ["model.b"], "model.b": ["model.c", "test.t"], "model.c": None, "source.s": ["model.c"]}


def test_every_start(spark, tmp_path):
    spark.createDataFrame(list(LINKS.items()), "unique_id string, children array<string>").write.parquet(f"{tmp_path}/child_map.parquet")
    day = dt.date(2025, 1, 1)
    spark.createDataFrame([(x, day, dt.datetime(2025, 1, 1), i) for i, x in enumerate(["model.a", "model.b", "model.c"])], "unique_id string, snapshot_date date, loaded_at timestamp, pos int").write.parquet(f"{tmp_path}/manifest_nodes.parquet")
    spark.createDataFrame([("source.s",)], "unique_id string").write.parquet(f"{tmp_path}/manifest_sources.parquet")
    run = lambda name: sorted(tuple(r) for r in structure.QUERIES[name](spark, str(tmp_path)).collect())
    below = [("model.a", "model.b", 1), ("model.a", "model.c", 2), ("model.a", "test.t", 2), ("model.b", "model.c", 1), ("model.b", "test.t", 1), ("source.s", "model.c", 1)]
    assert run("descendants") == below
    assert run("ancestors") == sorted((y, x) for x, y, _ in below)
    assert run("downstream_models") == [r for r in below if r[1] != "test.t"]
    assert run("relation_edges") == [("model.a", "model.a", "model.b"), ("model.a", "model.b", "model.c"), ("model.b", "model.b", "model.c"), ("source.s", "source.s", "model.c")]
    assert run("query_closure") == sorted(("all", q, t) for q, ts in {"model.a": "abc", "model.b": "bc", "model.c": "c", "source.s": "sc", "test.t": "t"}.items() for t in ts)
