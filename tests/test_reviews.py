"""Reviews, refresh helpers, relation trees, remote calls and other small operators on fixtures."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import advisors, bi, graph, resolve, select
from tallyloom.operators.shredding import Edge, SchemaGraph, Shredder, shape_paths, undeclared
from tallyloom.plans import usage
from tallyloom.sources import artifacts


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_branch_recommendations(spark):
    layout = spark.createDataFrame([("r", None, ["k"]), ("s", "d", None)], "root string, root_partition string, root_clusters array<string>")
    up = spark.createDataFrame([("r", "p1", "HIGH"), ("r", "p2", "MEDIUM"), ("s", "p1", "ALIGNED")], "root string, model string, alignment string")
    down = spark.createDataFrame([("r", "c1", "POOR", ["a", "K", "b"]), ("r", "c2", "POOR", ["a", "b"]), ("r", "c3", "SUBOPTIMAL", ["b", "z", "k"]), ("s", "c1", "GOOD", ["d"]), ("s", "c2", "GOOD", ["d"]), ("s", "c3", "GOOD", None)],
                                 "root string, model string, alignment string, filters array<string>")
    assert got(advisors.branch_recommendations(up, down, layout)) == [
        ("r", "add_clustering", "a", 2, "MEDIUM"), ("r", "add_clustering", "b", 3, "MEDIUM"), ("r", "add_partition", "b", 3, "HIGH"), ("r", "upstream_partition", "p1", None, "HIGH")
    ]
    assert got(advisors.branch_recommendations(up.limit(0), down.limit(0), layout)) == []


def test_matches_current(spark):
    wanted = spark.createDataFrame([("a", "x"), ("a", "Y"), ("b", "x"), ("c", "x")], "target string, column string")
    current = spark.createDataFrame([("a", ["y", "X"]), ("b", ["x", "z"]), ("c", None)], "target string, columns array<string>")
    assert [(r["target"], r["matches"]) for r in sorted(advisors.matches_current(wanted, current).collect())] == [("a", True), ("b", False), ("c", False)]


def test_refresh_helpers(spark):
    assert advisors.parse_columns(["m:A, b", "m:c", "n:"]) == {"m": {"a", "b", "c"}, "n": set()}
    with pytest.raises(ValueError, match="MODEL:column"):
        advisors.parse_columns(["m"])
    changed = spark.createDataFrame([("m", "*"), ("o", "*")], "model string, column string")
    assert got(advisors.narrowed(changed, {"m": {"a", "b"}, "n": set()})) == [("m", "a"), ("m", "b"), ("o", "*")]
    plan = spark.createDataFrame([("b", "full", ""), ("a", "full", ""), ("c", "incremental", ""), ("d", "skip", "")], "model string, bucket string, reason string")
    assert got(advisors.refresh_summary(plan)) == [("full", 2, "a b"), ("incremental", 1, "c"), ("skip", 1, "d")]
    assert got(advisors.refresh_commands(plan)) == [("full", "dbt run --full-refresh --select a b"), ("incremental", "dbt run --select c")]
    names = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "name string")
    assert got(advisors.missing_models(names.where("name IS NOT NULL"), plan.select(F.col("model").alias("name")))) == [("x",)]


def walked(below, start):
    """The tree by plain recursion."""
    out, expanded = [], set()

    def go(x, level):
        if x not in expanded:
            expanded.add(x)
            for y in below.get(x, []):
                out.append((y, level))
                go(y, level + 1)

    go(start, 0)
    return out


def test_relation_tree(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(25)]
    below = {x: rng.sample(names, rng.randint(0, 4)) for x in names[:18]}
    edges = spark.createDataFrame([(x, y, i) for x, ys in below.items() for i, y in enumerate([*ys, "t1", "gone"])], "src string, dst string, pos long")
    known = graph.describe(spark.createDataFrame([(n, f"models/a/{n}.sql", "s", None, n, "model") for n in names] + [("t1", None, None, None, "t1", "test")], "node string, original_file_path string, schema string, alias string, name string, resource_type string"))
    starts = spark.createDataFrame([(x,) for x in names], "start string")
    made = {}
    for r in graph.relation_tree(edges, known, starts).orderBy("start", "row_no").collect():
        made.setdefault(r["start"], []).append((r["node"], r["level"]))
        assert r["path"] == f"a/{r['node']}.sql" and r["table_name"] == f"s.{r['node']}"
    assert made == {x: t for x in names if (t := walked(below, x))}
    assert graph.neighbours(edges, known).where("node = 't1' OR node = 'gone'").count() == 0


def test_resolved_lineage_and_usage(spark):
    """Tables that are nodes go by the node, others by their own name."""
    nodes = spark.createDataFrame([("model.p.stg", "db", "s", "stg_t", "stg", 0, "stg"), ("model.p.core", "db", "c", None, "core", 1, "core")], "id string, database string, schema string, alias string, name string, pos int, short_name string")
    sql = spark.createDataFrame([("model.p.core", "select t.a as b, j.x from db.s.stg_t as t join `db.out.side` as j on j.x = t.a where t.a > 3"), ("model.p.stg", "select ((("), ("model.p.none", None)], "m string, q string")
    _, edges = graph.column_lineage(usage.extract_lineage(sql, "m", "q"), nodes, spark.createDataFrame([], "id string, column string, data_type string"), outside=True)
    assert got(edges) == [("db.out.side.x", "core.x", "passthrough"), ("stg.a", "core.b", "passthrough")]
    events = usage.extract_all_usage(sql, "m", "q")
    assert [tuple(r) for r in events.where("status = 'unreadable'").select("model", "target").collect()] == [("model.p.stg", None)]
    named = graph.resolve_tables(events.where("status = 'ok'").withColumnRenamed("target", "table_name"), graph.table_keys(nodes))
    assert got(named.select("table_name", "node", "column", "clause", "operator").distinct()) == [
        ("db.out.side", None, "x", "join", "eq"), ("db.out.side", None, "x", "select", "none"), ("db.s.stg_t", "model.p.stg", "a", "join", "eq"), ("db.s.stg_t", "model.p.stg", "a", "select", "none"), ("db.s.stg_t", "model.p.stg", "a", "where", "gt"),
    ]


def test_elements_that_hold_each_other(spark):
    g = SchemaGraph("r", [Edge("r", "a", "as", "array"), Edge("a", "b", "bs", "array"), Edge("b", "a", "as", "array"), Edge("b", "one", "one"), Edge("one", "a", "deep", "array")], {"a": {"n": "n"}, "b": {"m": "m"}})
    doc = {"as": [{"n": 1, "bs": [{"m": 2, "as": [{"n": 3, "bs": [{"m": 4}]}], "one": {"deep": [{"n": 5}]}}]}, None]}
    roots = spark.createDataFrame([("d", json.dumps(doc)), ("e", None)], "id string, j string").select("id", F.expr("try_parse_json(j)").alias("_v"))
    s = Shredder(g, roots, "id")
    a, b = s.table("a"), s.table("b")
    assert got(a.where("n IS NOT NULL").select("_level", "n", "_parent")) == [(0, "1", "r"), (2, "3", "b"), (3, "5", "one")]
    assert got(b.select("_level", "m", "_parent")) == [(1, "2", "a"), (3, "4", "a")]
    ids = {r["_id"] for t in (a, b, s.table("one")) for r in t.collect()} | {"d"}
    assert {r["_parent_id"] for t in (a, b) for r in t.collect()} <= ids


def test_observed_schema(spark):
    assert shape_paths("OBJECT<a: ARRAY<OBJECT<`b c`: STRING, d: DECIMAL(2,1)>>, e: VOID>") == [
        ("$", "OBJECT"), ("$.a", "ARRAY"), ("$.a[]", "OBJECT"), ("$.a[].b c", "STRING"), ("$.a[].d", "DECIMAL(2,1)"), ("$.e", "VOID")
    ]
    g = SchemaGraph("r", [Edge("r", "x", "xs", "array")], {"r": {"n": "name"}})
    roots = spark.createDataFrame([("d", '{"name":"q","xs":[{"k":1}],"more":{"z":[1]}}')], "id string, j string").select("id", F.expr("try_parse_json(j)").alias("_v"))
    rows = undeclared(g, {"r": Shredder(g, roots, "id").shape("r")})
    assert {p: known for _, p, _, known in rows} == {"$.more": False, "$.more.z": False, "$.more.z[]": False, "$.name": True, "$.xs": True, "$.xs[]": True, "$.xs[].k": True}


def test_remote_calls(spark):
    calls = []

    def flaky(key):
        if key["k"] == "a":
            return [{"k": "a", "v": 1}]
        raise ValueError(f"no {key['k']}")

    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert got(artifacts.fetch_rows(keys, flaky, "k string, v int", attempts=2, wait=0.0)) == [("a", 1, None), ("b", None, "ValueError: no b")]
    states = iter(["Running", "Succeeded"])
    assert artifacts.polled(lambda: "j", lambda _: next(states), lambda j: calls.append(j) or {"modifiedBy": "x", "k": 1}, wait=0.0) == {"k": 1} and calls == ["j"]
    for state in ("Failed", "Running"):
        with pytest.raises(artifacts.ArtifactError, match="did not succeed"):
            artifacts.polled(lambda: "j", lambda _: state, lambda _: None, polls=2, wait=0.0)  # noqa: B023


def test_layouts_and_scans(spark, tmp_path):
    part = lambda path, text: (path, base64.b64encode(text.encode()).decode() if text is not None else None)
    rows = spark.createDataFrame([("a", [part("x/other.json", "{}"), part("x/report.json", '{"é":1}')]), ("b", [part("report.json", "{broken")]), ("c", [("report.json", "%%%")]), ("d", []), ("e", None), ("f", [part("report.json", None)])], "k string, parts array<struct<path: string, payload: string>>")
    assert {r["k"]: r["layout"] for r in artifacts.decoded_layouts(rows).collect()} == {"a": '{"é":1}', "b": None, "c": None, "d": None, "e": None, "f": None}
    scan = {"workspaces": [{"datasets": [{"tables": [{}, {}]}], "reports": [{"users": [{"displayName": "n", "emailAddress": "e"}]}]}]}
    path = str(tmp_path / "scan.json")
    assert artifacts.write_scan(scan, path) == {"workspaces": 1, "datasets": 1, "reports": 1, "tables": 2, "output": path}
    assert "emailAddress" not in (tmp_path / "scan.json").read_text()
    assert got(artifacts.warnings_frame(spark, [{"type": "t", "severity": "info", "message": "m"}])) == [("t", "info", "m", None, None)]


def test_bi_readers(spark):
    assert bi.read_m('let S = Value.NativeQuery(db, "select 1 -- ""x""", null), j = Table.NestedJoin(S, {"a", "b"}, Other, {"a"}, "o") in j') == ("native_sql", 'select 1 -- "x"', None, ["Other"])
    assert bi.read_m("let S = Value.NativeQuery(db") == ("unknown", None, None, []) and bi.read_m(None)[0] == "dax"
    assert bi.read_dax("SUM('My T'[Net-1]) + T.x[a b] // U[c]\n + \"V[d]\"") == ["My T[Net-1]", "T.x[a b]"] and bi.read_dax(None) == []
    rows = spark.createDataFrame([(1, "SUM(T[a])"), (2, None)], "k int, x string")
    assert got(bi.dax_references(rows, "x").select("k", F.array_join("refs", ","))) == [(1, "T[a]"), (2, "")]
    fields = spark.createDataFrame([("d", "Net", True), ("d", "Net", False), ("e", "Net", False), (None, "Net", False)], "dataset_id string, field_name string, is_measure boolean")
    assert got(bi.with_measures(fields, bi.dataset_measures(fields)).select("dataset_id", "is_measure")) == [("d", True), ("d", True), ("e", False), (None, False)]


def test_files_and_bytes(spark):
    names = spark.createDataFrame([("core__orders",), ("plain",)], "name string")
    files = spark.createDataFrame([("m/orders.sql",), ("core__orders.sql",), ("m/xorders.sql",), ("plain.yml",), (None,)], "path string")
    assert got(select.file_matches(names, files)) == [("core__orders", "core__orders.sql"), ("core__orders", "m/orders.sql")]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024**4,), (None,)], "n long")
    assert [r[0] for r in sizes.select(resolve.readable_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "5.00 TB", None]


def test_lineage_budget_and_tables(spark, tmp_path):
    text = "select a from t"
    assert usage.lineage_rows(text, 1e-9)[1] == "timeout" and usage.lineage_rows(text, 30)[1] == usage.lineage_rows(text)[1] == "ok"
    rows = spark.createDataFrame([("m", text), ("n", None), ("o", "((")], "m string, q string")
    timed = usage.time_lineage(rows, "m", "q")
    assert {r["model"]: r["status"] for r in timed.collect()} == {"m": "ok", "n": "no_sql", "o": "unreadable"}
    assert usage.slowest(timed, 2).count() == 2 and usage.slowest(timed, 5, 100.0).count() == 0
    rows.write.json(str(tmp_path / "t"))
    assert artifacts.read_table(spark, str(tmp_path / "t"), "json").count() == 3 and artifacts.read_table(spark, str(tmp_path / "t"), "json", 2).count() == 2
