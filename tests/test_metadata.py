"""Selection, monitoring, scoring, advice, resolution, BI, graph and artifacts on small rows with gaps."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import advisors, bi, graph, monitoring, resolve, select
from tallyloom.sources import artifacts


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


MODEL = "unique_id string, name string, alias string, schema string, database string, package_name string, tags array<string>, config string, original_file_path string, description string, compiled_code string, raw_code string, pos int, columns map<string,struct<data_type:string,description:string>>"


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([
        ("model.p.a", "a", "aa", "s", "d", "p", ["x", "y"], '{"materialized":"incremental","enabled":true,"cluster_by":"c","partition_by":{"field":"day"},"meta":{"t":{"k":1}}}', "models/a.sql", "First", "select 1", "raw", 1, {"c": ("STRING", None)}),
        ("model.p.b", "b", None, "s", None, "q", None, None, None, None, None, None, 2, None),
        ("model.q.a", "a", "", None, None, None, ["y"], "{broken", "models/x/a.sql", "", " ", None, 3, {}),
        ("test.p.t", "t", None, None, None, "p", ["x"], '{"enabled":false,"cluster_by":["c","d"],"partition_by":5}', "tests/t.sql", None, None, None, 0, None),
    ], MODEL)


def test_selection(few):
    ids = lambda df: [r[0] for r in got(df.select("unique_id"))]
    assert ids(select.select_models(few, ["tag:x", "tag:y"])) == ["model.p.a", "model.q.a", "test.p.t"]
    assert ids(select.select_models(few, ["tag:x", "tag:y"], all_tags=True)) == ["model.p.a"]
    assert ids(select.select_models(few, ["config.meta.t.k:1"])) == ["model.p.a"]
    assert ids(select.select_models(few, ["config.enabled:False"])) == ["test.p.t"]
    assert ids(select.select_models(few, ["path:models/", "package:p"])) == ["model.p.a"]
    assert len(ids(select.select_models(few, ["nothing", "odd:one"]))) == 4
    assert select.get_model(few, "a").first()["unique_id"] == "model.p.a"
    assert ids(select.search(few, "Q.A")) == ["model.q.a"]
    assert got(select.tag_groups(few, ["y", "x"])) == [("x", "t"), ("x+y", "a"), ("y", "a")]
    assert got(select.find_path(few, "s.aa")) == [("models/a.sql",)]
    assert got(few.select(F.array_join(select.config_list("cluster_by"), ","), F.array_join(select.config_list("partition_by", "field"), ","))) == [("", ""), ("", ""), ("c", "day"), ("c,d", "")]
    assert select.select_models(few.limit(0), ["tag:x"]).count() == 0
    assert select.column_reference("m.c") == ("m", "c") and select.column_reference("a.b:c") == ("a.b", "c")
    with pytest.raises(ValueError, match="names no column"):
        select.column_reference("mc")


def test_modified(spark, few):
    files = spark.createDataFrame([("repo/models/a.sql", "committed"), ("repo/models/a.sql", "untracked"), ("models/b.sql", "committed"), (None, "committed")], "path string, origin string")
    assert got(select.modified(few, files)) == [("model.p.a", "untracked")]


def test_staleness(spark):
    rows = spark.createDataFrame([("2025-01-01T00:00:00Z",), ("2024-12-30T00:00:00Z",), ("nonsense",), (None,)], "t string")
    now = F.to_timestamp(F.lit("2025-01-01T12:00:00Z"))
    assert [r[0] for r in rows.select(select.is_stale(F.col("t"), now, 24)).collect()] == [False, True, True, True]


def test_filter_columns(spark):
    from tallyloom.plans.usage import extract_filters, filter_columns

    text = "select a from t where t.Country = 'x = 5' and d >= 3 -- and e = 1\n and lower(z) != 'q' and country in (1) and not Country = 2 or k is not null group by g having h = 1"
    assert filter_columns(text) == ["Country", "d", "country", "k"]
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "select 1"), ("d", "")], "m string, q string")
    assert [r["columns"] for r in extract_filters(rows, "m", "q").collect()] == [["Country", "d", "country", "k"], [], [], []]


FACTS = "dataset_id string, table_id string, is_model boolean, enabled boolean, materialized string, total_gb double, n_queries long, cost double, slot_ms long, bytes_processed long, has_partition boolean, has_cluster boolean, days_unused int"


def test_hotspots(spark):
    rows = spark.createDataFrame([
        ("d", "slot", True, None, "table", 0.5, 1000, None, 700_000_000, None, None, None, None), ("d", "mild", True, True, "table", 0.5, 100, None, 5_000_000, None, None, None, None),
        ("d", "big", True, True, "table", 250.0, 50, 0.001, 0, 0, False, False, None), ("raw_d", "big", True, True, "table", 250.0, 50, None, 0, 0, False, False, 40),
        ("d", "view", True, True, "view", 250.0, 50, 9.0, 0, 0, False, False, None), ("d", "none", False, None, None, 250.0, 50, 9.0, 0, 0, None, None, None),
        ("d", "part", True, True, "table", 2.0, 6, None, None, 11_000_000_000, True, True, None), ("d", "nulls", True, None, "table", None, None, None, None, None, None, None, None),
    ], FACTS)
    scored = {(r["dataset_id"], r["table_id"]): r for r in monitoring.score_hotspots(rows).collect()}
    assert scored["d", "slot"]["high_slot"] == 75 and 0 < scored["d", "mild"]["high_slot"] <= 40
    assert scored["d", "big"]["no_partition"] == 75 and scored["d", "big"]["no_clustering"] == 50 and scored["d", "big"]["query_cost"] == 1
    assert scored["raw_d", "big"]["no_partition"] == 0 and scored["raw_d", "big"]["unused"] == 500
    assert scored["d", "view"]["score"] == scored["d", "none"]["score"] == scored["d", "nulls"]["score"] == 0
    assert scored["d", "part"]["ineffective_partition"] == 28
    hot = monitoring.score_hotspots(rows)
    assert monitoring.top_hotspots(hot, 2).count() == 2 and monitoring.hotspot_details(hot).count() > 3
    assert monitoring.hotspot_summary(hot.limit(0)).first()["n_hot"] == 0


EVENT = "target string, column string, clause string, operator string, wrapping_fn string, downstream_model string"


def test_advisors(spark):
    ev = spark.createDataFrame([("t", "a", "where", "eq", "", "m1"), ("t", "a", "where", "neq", "", "m1"), ("t", "b", "where", "eq", "lower", "m1"), ("t", "p", "where", "between", "", "m1"), ("t", "p", "where", "ge", "date", "m2"),
                                ("t", "j", "where", "eq", "", "m1"), ("t", "y", "where", "eq", "extract", "m1"), ("t", "g", "having", "eq", "", "m1")], EVENT)
    types = spark.createDataFrame([("t", "a", "STRING", False), ("t", "p", "TIMESTAMP", True), ("t", "j", "JSON", False), ("t", "y", "DATE", False)], "target string, column string, data_type string, is_partition boolean")
    scores = {r["column"]: r["score"] for r in advisors.cluster_scores(ev).collect()}
    assert scores == {"a": 3.0, "b": 0.5, "p": pytest.approx(2.5 * 1.58, abs=0.02), "j": 3.0, "y": 0.5}
    advice = {r["column"]: (r["rank_no"], r["excluded"]) for r in advisors.cluster_advice(advisors.cluster_scores(ev), types).collect()}
    assert advice == {"a": (1, ""), "b": (2, ""), "y": (3, ""), "j": (None, "type JSON"), "p": (None, "partition column")}
    best = {r["column"]: (r["score"], r["granularity"], r["n_models"]) for r in advisors.partition_scores(ev, types.drop("is_partition")).collect()}
    assert best["p"] == (pytest.approx(5.5 * 1.5 * 1.585, abs=0.02), "DAY", 2) and best["y"][0] == 0
    assert [r["column"] for r in advisors.partition_advice(advisors.partition_scores(ev, types.drop("is_partition"))).collect()] == ["p"]
    assert advisors.cluster_scores(ev.limit(0)).count() == 0


def test_refresh(spark):
    pair = "parent string, model string"
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "s"), ("a", "n"), ("a", "u"), ("c", "a")], pair)
    uses = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("a", "u", "other")], pair + ", column string")
    stars = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("a", "s", True), ("a", "u", False)], pair + ", bare_star boolean")
    no_sql = spark.createDataFrame([("n",)], "model string")
    run = lambda c: got(advisors.propagate_changes(spark.createDataFrame([("a", c)], "model string, column string"), edges, uses, stars, no_sql))
    assert run("x") == [("a", "x"), ("b", "x"), ("c", "x"), ("n", "*"), ("s", "*")]
    assert {m for m, _ in run("*")} == {"a", "b", "c", "s", "n", "u"}
    models = spark.createDataFrame([("a", "table", [], [], True), ("b", "incremental", ["x"], [], True), ("c", "incremental", ["z"], ["q"], True), ("s", "table", None, None, True), ("n", "incremental", [], [], False), ("u", None, [], [], True)],
                                   "model string, materialized string, unique_keys array<string>, partition_cols array<string>, has_sql boolean")
    changed = spark.createDataFrame([("a", "x")], "model string, column string")
    affected = advisors.propagate_changes(changed, edges, uses, stars, no_sql)
    below = edges.select("model").distinct()
    assert got(advisors.refresh_plan(below, affected, changed, models)) == [
        ("a", "full", "changed model itself"), ("b", "full", "unique key affected"), ("c", "incremental", "safe"), ("n", "full", "no SQL"), ("s", "full", "whole row affected"), ("u", "skip", "not affected")
    ]


def test_levels_and_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("l", "m"), ("m", "l"), ("m", "n"), ("a", "b")], "src string, dst string")
    names = e.select(F.col("src").alias("x")).union(e.select("dst")).distinct()
    assert got(advisors.topological_levels(e, names)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("l", 4), ("m", 4), ("n", 4)]
    starts = spark.createDataFrame([("a",), ("l",), ("unknown",)], "start string")
    assert got(graph.reach(e, starts)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("l", "l", 2), ("l", "m", 1), ("l", "n", 2)]
    assert graph.reach(e.limit(0), starts).count() == 0


def test_column_lineage(spark):
    nodes = spark.createDataFrame([("source.p.raw.t", "D", "Raw", None, "t", "t", 0), ("model.p.stg", "d", "s", "stg", "stg", "stg", 1), ("model.p.core", "d", "s", "core", "core", "core", 2)], "id string, database string, schema string, alias string, name string, short_name string, pos int")
    cols = spark.createDataFrame([("source.p.raw.t", "id", "INT64"), ("source.p.raw.t", "x", None)], "id string, column string, data_type string")
    sym = spark.createDataFrame([("model.p.stg", "*", "d.raw.t", "*", "passthrough", "ok"), ("model.p.stg", "*", "d.raw.t", "x", "except", "ok"), ("model.p.core", "cid", "s.stg", "id", "passthrough", "ok"), ("model.p.core", "q", "nowhere", "q", "derived", "ok"), ("model.p.z", None, None, None, None, "no_sql")],
                                "model string, output string, table_name string, column string, transform string, status string")
    made, edges = graph.column_lineage(sym, nodes, cols)
    assert got(edges) == [("stg.id", "core.cid", "passthrough"), ("t.id", "stg.id", "passthrough")]
    ids = spark.createDataFrame([("core.cid",), ("no.such",)], "start string")
    assert got(graph.lineage_query(made, edges, ids, downstream=False).select("node", "is_direct")) == [("stg.id", True), ("t.id", False)]


def test_resolution(spark):
    rows = spark.createDataFrame([("a b",), ("1x",), ("",), (None,), ("ok-1_",)], "t string")
    assert [r[0] for r in rows.select(resolve.sanitize_identifier("t")).collect()] == ["a_b", "_1x", "_", None, "ok-1_"]
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "name string")
    level = lambda *names: spark.createDataFrame([(n, f"id.{n}") for n in names], "name string, unique_id string")
    assert got(resolve.fallback(asked, [("prod", level("a")), ("dev", level("a", "b"))])) == [("a", "prod", "id.a", "prod"), ("b", "dev", "id.b", "prod,dev"), ("c", None, None, "prod,dev")]
    git = spark.createDataFrame([("??", "x"), ("R ", "old.sql -> new.sql"), (" M", "x"), (" D", "x"), (None, None)], "code string, path string")
    flags = git.select(*[v.alias(k) for k, v in resolve.git_flags("code", "path").items()]).collect()
    assert flags[0]["is_new"] and not flags[0]["is_tracked"] and flags[1]["renamed_to"] == "new.sql" and flags[2]["is_modified"] and flags[3]["is_deleted"] and not flags[4]["is_new"]
    assert resolve.safe_path("models/a.sql") == "models/a.sql"
    for bad in ("../x", "a;b", "/etc/passwd", "a$(b)"):
        with pytest.raises(ValueError, match="not a safe path"):
            resolve.safe_path(bad)
    assert resolve.validate_query(spark, "select 1 as x")[0] and not resolve.validate_query(spark, "select nope from nowhere")[0]


def test_bi(spark):
    refs = spark.createDataFrame([("Sum(Orders.Net)",), ("Plan v2.code",), ("bare",), (None,)], "q string")
    t, n, m = bi.query_reference("q")
    assert [tuple(r) for r in refs.select(t, n, m).collect()][:3] == [("Orders", "Net", True), ("Plan v2", "code", False), ("", "bare", False)]
    column = {"Column": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "c"}}
    where = lambda c: {"expression": column, "filter": {"Where": [{"Condition": c}]}, "type": "Advanced"}
    lit = lambda v: {"Literal": {"Value": v}}
    cmp_ = {"Comparison": {"ComparisonKind": 1, "Left": column, "Right": lit("100L")}}
    texts = json.dumps([where({"In": {"Expressions": [column], "Values": [[lit("'a'")], [lit("2D")]]}}), where(cmp_), where({"And": {"Left": cmp_, "Right": {"Not": {"Expression": cmp_}}}}), {"expression": column, "type": "TopN", "filter": {"Where": [{"Condition": {"x": lit("10L")}}], "OrderBy": [{"Expression": column}]}},
                        {"expression": column, "type": "RelativeDate", "filter": {"Where": [{"Condition": {"Comparison": {"Left": column, "Right": {"DateSpan": {"Expression": lit("30L"), "TimeUnit": 0}}}}}]}}, {"expression": column}, 5, None])
    rows = spark.createDataFrame([(1, texts), (2, "{broken"), (3, None), (4, "{}")], "k int, f string")
    assert [tuple(r)[1:] for r in bi.extract_filters(rows, ["k"], "f").orderBy("filter_no").collect()] == [
        (0, "T", "c", "column", "in", ["a", "2"], "c in (a, 2)"), (1, "T", "c", "column", "cmp", [">", "100"], "c > 100"), (2, "T", "c", "column", "advanced", ["100", "100"], "c > 100 and not c > 100"), (3, "T", "c", "column", "top_n", ["10"], "top 10 by c"),
        (4, "T", "c", "column", "relative_date", ["30", "days"], "c — last 30 days"), (5, "T", "c", "column", "advanced", [], "c (advanced)"),
    ]
    assert bi.read_filter({"filter": {}}) is None and bi.read_filter({"expression": {"Aggregation": {"Function": 0, "Expression": column}}})[:3] == ("T", "c", "measure")
    deep = cmp_
    for _ in range(3000):
        deep = {"Or": {"Left": deep, "Right": cmp_}}
    assert bi.render_condition(deep).count(" or ") == 3000
    assert bi.scrub_people({"users": [{"displayName": "n", "emailAddress": "e"}], "a": [{"modifiedBy": "x", "k": 1}]}) == {"users": [{"displayName": "n"}], "a": [{"k": 1}]}
    reports = spark.createDataFrame([(1, "r1", "Sales review", "ds", ["p.d.t"]), (2, "r2", "Review", None, None), (3, "r3", None, "x", [])], "pos int, report_id string, report_name string, dataset_id string, tables array<string>")
    assert bi.show_report(reports, "review").first()["report_id"] == "r2" and bi.find_reports(reports, "P.D").count() == 1


def test_artifacts(spark, tmp_path):
    manifest = {"nodes": {"model.p.a": {"name": "a", "tags": ["x"], "config": {"partition_by": "d"}, "columns": {"c": {"data_type": "STRING"}}, "depends_on": {"nodes": ["source.p.s.t"]}}, "model.p.b": {"name": "b"}},
                "sources": {"source.p.s.t": {"schema": "s", "name": "t"}}, "child_map": {"source.p.s.t": ["model.p.a", "model.p.b"]}}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(manifest))
    read = artifacts.read_manifest(spark, str(path))
    assert got(read["models"].select("unique_id", "pos", "config")) == [("model.p.a", 0, '{"partition_by":"d"}'), ("model.p.b", 1, None)]
    assert got(read["edges"].select("src", "dst", "pos")) == [("source.p.s.t", "model.p.a", 0), ("source.p.s.t", "model.p.b", 1)]
    for name, text in (("broken.json", "{"), ("missing.json", None)):
        if text:
            (tmp_path / name).write_text(text)
        with pytest.raises(artifacts.ArtifactError):
            artifacts.read_document(spark, str(tmp_path / name))
    catalog = tmp_path / "catalog.json"
    catalog.write_text(json.dumps({"metadata": {"generated_at": "2025-01-01T00:00:00Z"}, "nodes": {"model.p.a": {"columns": {"b": {"type": "INT64", "index": 2}, "a": {"type": "STRING"}}, "stats": {"num_rows": {"value": 5}}}}}))
    cat = artifacts.read_catalog(spark, str(catalog))
    assert [tuple(r)[:4] for r in select.catalog_columns(cat["columns"]).collect()] == [("model.p.a", "b", "integer", 2), ("model.p.a", "a", "string", 999)]
    nodes, edges = spark.createDataFrame([("a.b", "a")], "id string, model string"), spark.createDataFrame([("a.b", "c.d", "derived")], "src string, dst string, transform string")
    artifacts.write_lineage(nodes, edges, str(tmp_path / "lineage"), "2025-01-01T00:00:00Z")
    back = artifacts.read_lineage(spark, str(tmp_path / "lineage"))
    assert got(back[0]) == got(nodes) and got(back[1]) == got(edges)
    reports = spark.createDataFrame([("r", ["p"], None), ("s", [], "t")], "id string, pages array<string>, title string")
    artifacts.write_index(reports, str(tmp_path / "index"))
    assert got(artifacts.read_index(spark, str(tmp_path / "index"), reports)) == got(reports)
    scan = tmp_path / "scan.json"
    scan.write_text(json.dumps({"workspaces": [{"id": "w", "datasets": [{"id": "d", "tables": [{"name": "t", "source": [{"expression": ""}, {"expression": "let x"}], "measures": [{"name": "m", "expression": "SUM(t[a])"}]}]}], "reports": [{"id": "r", "name": "R", "datasetId": "d", "users": [{"displayName": "o", "reportUserAccessRight": "Owner", "emailAddress": "secret"}]}]}]}))
    parts = artifacts.read_scan(spark, str(scan))
    assert got(bi.owners(parts["reports"])) == [("r", "o")] and parts["measures"].count() == 1
    assert parts["tables"].select(bi.first_expression("source")).first()[0] == "let x"
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "a.sql").write_text("select 1")
    assert got(artifacts.read_compiled_sql(spark, str(tmp_path))) == [("models/a.sql", "select 1")]
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert got(artifacts.fetch_rows(keys, lambda key: [{"k": key["k"], "v": 1}] if key["k"] == "a" else 1 / 0, "k string, v int", attempts=1).where("error IS NULL")) == [("a", 1, None)]
    assert got(artifacts.scrubbed(spark.createDataFrame([('{"modifiedBy":"x","a":1}',), ("{",), (None,)], "t string"), "t")) == [("{\"a\": 1}",), (None,), (None,)]


def test_reports_and_models(spark):
    tables = spark.createDataFrame([("r1", "core_a"), ("r1", "core_a"), ("r2", "core_a"), ("r2", "stg_b"), ("r3", None)], "report_id string, model string")
    costs = spark.createDataFrame([("p.core_a", 2.0), ("core_a", 1.0), (None, 5.0)], "dbt_model_name string, query_cost double")
    assert got(bi.report_costs(tables.where("model IS NOT NULL"), costs, "p.")) == [("r1", "core_a", 3.0), ("r2", "core_a", 3.0), ("r2", "stg_b", 0.0)]
    assert got(bi.reports_for_model(tables, "CORE")) == [("core_a", "r1"), ("core_a", "r2")]
    with pytest.raises(ValueError, match="several models"):
        bi.reports_for_model(tables, "_")
    analyses = spark.createDataFrame([("r1", ["p.d.a"], ["X"], ["k"]), ("r2", [], ["x"], [])], "report_id string, tables array<string>, where_columns array<string>, join_columns array<string>")
    mapped, known = spark.createDataFrame([("p.d.a", "a")], "table_name string, model string"), spark.createDataFrame([("a.x",), ("b.x",)], "id string")
    assert got(bi.report_lineage(analyses, mapped, known)) == [("r1", "a.x")]
    reports = spark.createDataFrame([("1", "Sales"), ("2", "Sales EU"), ("3", "Sales US"), ("4", None)], "report_id string, report_name string")
    assert bi.report_lookup(reports, "sales").first()["report_id"] == "1" and bi.report_lookup(reports, "us").first()["report_id"] == "3" and bi.report_lookup(reports, "none").count() == 0
    with pytest.raises(ValueError, match="several reports"):
        bi.report_lookup(reports, "sales ")


def test_table_parts_and_monitoring_on_empty_rows(spark):
    names = spark.createDataFrame([("a__b__c",), ("plain",), (None,)], "n string")
    late, early = resolve.table_parts("n"), resolve.table_parts("n", at_first=True)
    assert tuple(names.select(*late, *early).first()) == ("a__b", "c", "a", "b__c")
    refs = spark.createDataFrame([], "dataset_id string, table_id string, day date, reference_count long")
    assert monitoring.query_frequency(refs, "2025-06-01").count() == monitoring.unused_tables(refs, "2025-06-01").count() == 0
    costs = spark.createDataFrame([], "dbt_model_name string, hour timestamp, total_query_cost decimal(18,6), query_count long, total_slot_ms long, total_bytes_processed long, cache_hit long")
    assert tuple(monitoring.total_costs(costs, "2025-06-01").first()) == (0.0, 0.0, 0) and monitoring.model_query_costs(costs, "2025-06-01").count() == 0


def test_alignment(spark):
    kids = spark.createDataFrame([("r", "a", ["d", "x"], "d", ["x"]), ("r", "b", ["z"], "d", None), ("r", "c", ["z"], None, None), ("r", "e", None, None, None)], "root string, model string, filters array<string>, root_partition string, root_clusters array<string>")
    assert [r[2] for r in got(advisors.downstream_alignment(kids).select("root", "model", "alignment"))] == ["GOOD", "SUBOPTIMAL", "POOR", "GOOD"]
    up = spark.createDataFrame([("r", "v", "view", True, ["d"], True, ["d"]), ("r", "h", "table", False, [], True, ["d"]), ("r", "m", "table", True, ["d"], True, ["x"]), ("r", "ok", "table", True, ["x"], True, ["x"])],
                               "root string, model string, materialized string, has_partition boolean, layout array<string>, root_has_partition boolean, root_filters array<string>")
    assert {r[1]: r[2] for r in got(advisors.upstream_alignment(up))} == {"v": "N/A", "h": "HIGH", "m": "MEDIUM", "ok": "ALIGNED"}
    assert got(advisors.common_filters(kids, 2, 2)) == [("r", "z", 2, 1)]
