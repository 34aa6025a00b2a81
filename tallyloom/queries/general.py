"""Queries of the general training-data operators (p1 to p5) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import blank_to_zero, json_core, keep_last_duplicate_keys, sql_core
from tallyloom.operators.hierarchy import Hierarchy, tree_pairs
from tallyloom.operators.hotkeys import key_totals, latest_versions, list_totals
from tallyloom.operators.rolling import trailing_totals
from tallyloom.operators.shredding import Edge, SchemaGraph, Shredder, latest_rows, undeclared
from tallyloom.operators.snapshots import snapshot_changes

MODEL_PREFIX = "lumen_dwh."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_changes(nodes: DataFrame) -> DataFrame:
    keep_last_duplicate_keys(nodes.sparkSession)
    return snapshot_changes(
        nodes, "snapshot_date", "unique_id", "loaded_at",
        {"compiled_code": sql_core("compiled_code"), "config": json_core("config")},
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = node_changes(table(spark, sf_dir, "manifest_nodes"))
    return changes.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "unique_id", "change_kind")


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per snapshot, kind and columns that differ."""
    return (
        node_changes(table(spark, sf_dir, "manifest_nodes"))
        .groupBy(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "change_kind", "changed_columns")
        .agg(F.count(F.lit(1)).alias("n_nodes"))
    )


def _child_map(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return Hierarchy(table(spark, sf_dir, "child_map"), "unique_id", "children")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _child_map(spark, sf_dir)
    placed = made.depths().select(F.col("x").alias("unique_id"), "root_id", F.col("depth").cast("int"))
    looping = made.status.select(F.col("x").alias("unique_id"), F.col("status").alias("root_id"), F.lit(-1).cast("int").alias("depth"))
    return placed.unionByName(looping).where(F.col("unique_id").startswith("model."))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, root, depth and number of descendants of every model.

    ``n_descendants`` counts everything below a model in the graph, p2_descendants has the
    names. Models on or below loops have no path.
    """
    made = _child_map(spark, sf_dir)
    paths = made.paths()
    more = made.pairs(tree_pairs(paths)).where(F.col("x").startswith("model.")).groupBy("x").agg(F.count(F.lit(1)).alias("_more"))
    placed = paths.select("x", "root_id", "depth", F.array_join("path", " > ").alias("path"), (F.col("size") - 1).alias("_own"))
    looping = made.status.select("x", F.col("status").alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("_own"))
    return (
        placed.unionByName(looping).where(F.col("x").startswith("model.")).join(more, "x", "left")
        .select(F.col("x").alias("unique_id"), "root_id", "depth", "path", (F.col("_own") + F.coalesce("_more", F.lit(0))).alias("n_descendants"))
    )


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preorder interval of every name clear of loops: below it are the names of its root in (first_no, last_no]."""
    return _child_map(spark, sf_dir).intervals().select(F.col("x").alias("unique_id"), "root_id", F.col("first").alias("first_no"), F.col("last").alias("last_no"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model with each name below it; a model on a loop is below itself."""
    made = _child_map(spark, sf_dir)
    tree = tree_pairs(made.paths())
    return tree.where("x <> descendant").unionByName(made.pairs(tree)).where(F.col("x").startswith("model.")).select(F.col("x").alias("unique_id"), "descendant")


def reference_records(refs: DataFrame) -> DataFrame:
    """Latest delivery of each reference record, with its table and count."""
    rows = refs.select(
        "ref_id", "loaded_at", "day",
        F.when(F.col("table_id").isNotNull(), F.concat_ws(".", "dataset_id", "table_id")).alias("table_name"),
        blank_to_zero("reference_count", "bigint").alias("n_refs"),
    )
    return latest_versions(rows, "ref_id", "loaded_at", ["table_name", "day", "n_refs"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = key_totals(reference_records(table(spark, sf_dir, "table_reference_incremental")), "table_name", "n_refs")
    children = list_totals(table(spark, sf_dir, "child_map"), "unique_id", "children")
    named = lambda df, n: df.select(F.lit(n).alias("table_name"), "key_id", "n_records", "total")
    return named(refs, "table_reference_incremental").unionByName(named(children, "child_map"))


def model_hours(costs: DataFrame) -> DataFrame:
    """Latest delivery of each model and hour; the warehouse prefix is not part of the name."""
    rows = costs.where(F.col("dbt_model_name").isNotNull()).select(
        F.struct(F.expr(f"if(startswith(dbt_model_name, '{MODEL_PREFIX}'), substr(dbt_model_name, {len(MODEL_PREFIX) + 1}), dbt_model_name)").alias("model"), "hour").alias("slot"),
        "loaded_at",
        blank_to_zero("total_query_cost", "decimal(30,12)").alias("cost"),
    )
    return latest_versions(rows, "slot", "loaded_at", ["cost"]).select(
        F.col("slot.model").alias("dbt_model_name"), F.to_date("slot.hour").alias("day"), "cost"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = table(spark, sf_dir, "models_costs_incremental")
    last = costs.agg(F.max(F.to_date("hour")).alias("_last"))
    sums = trailing_totals(model_hours(costs), "dbt_model_name", "day", F.col("cost"), [7, 30], last)
    micro = lambda n: F.round(F.col(f"_sum_{n}") * 1_000_000).cast("bigint").alias(f"cost_{n}d_micro")
    return sums.select("dbt_model_name", F.date_format("day", "yyyy-MM-dd").alias("day"), micro(7), micro(30))


def _with_averages(sums: DataFrame, name: str) -> DataFrame:
    """Totals, and averages rounded half away from zero at six decimals, from whole millionths."""
    out = [name, F.date_format("day", "yyyy-MM-dd").alias("day")]
    for n in (7, 30):
        micro = F.round(F.col(f"_sum_{n}") * 1_000_000).cast("bigint")
        average = F.signum(micro) * F.expr(f"(2 * abs(bigint(round(_sum_{n} * 1000000))) + {n}) div {2 * n}") / 1_000_000
        out += [(micro / 1_000_000).alias(f"total_{n}d"), average.alias(f"average_{n}d")]
    return sums.select(*out)


def p4_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of total_query_cost; the average is over all days of the period."""
    costs = table(spark, sf_dir, "models_costs_incremental")
    last = costs.agg(F.max(F.to_date("hour")).alias("_last"))
    return _with_averages(trailing_totals(model_hours(costs), "dbt_model_name", "day", F.col("cost"), [7, 30], last), "dbt_model_name")


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of reference_count for each table and day."""
    refs = table(spark, sf_dir, "table_reference_incremental")
    last = refs.agg(F.max("day").alias("_last"))
    sums = trailing_totals(reference_records(refs), "table_name", "day", F.col("n_refs"), [7, 30], last)
    return _with_averages(sums, "table_name")


#: Report layouts: containment as the layout format defines it.
LAYOUT = SchemaGraph(
    "report",
    [
        Edge("report", "page", "sections", "array"),
        Edge("page", "visual", "visualContainers", "array"),
        Edge("visual", "visual_config", "config", json=True),
        Edge("visual_config", "single_visual", "singleVisual"),
        Edge("single_visual", "role", "projections", "map"),
        Edge("role", "field", "", "array"),
        Edge("report", "filter", "filters", "array", json=True),
        Edge("page", "filter", "filters", "array", json=True),
        Edge("visual", "filter", "filters", "array", json=True),
        Edge("report", "report_config", "config", json=True),
        Edge("report_config", "bookmark", "bookmarks", "array"),
        Edge("bookmark", "bookmark", "children", "array"),
    ],
    {
        "report": {"report_name": "name"},
        "page": {"page_name": "name", "display_name": "displayName"},
        "visual_config": {"visual_name": "name"},
        "single_visual": {"visual_type": "visualType", "title": "$.vcObjects.title[0].properties.text.expr.Literal.Value"},
        "field": {"query_ref": "queryRef", "active": "active"},
        "filter": {"filter_type": "type", "filter_name": "name"},
        "report_config": {"version": "version"},
        "bookmark": {"bookmark_name": "name", "bookmark_title": "displayName"},
    },
)


def layouts(reports: DataFrame) -> Shredder:
    latest = latest_rows(reports, "report_id", "scanned_at", ["name", "config", "filters", "sections"])
    return Shredder(LAYOUT, latest.select("report_id", F.expr("to_variant_object(struct(name, config, filters, sections))").alias("_v")), "report_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = layouts(table(spark, sf_dir, "bi_reports")).table("field")
    return (
        fields.where((F.col("query_ref_kind") == "STRING") & F.col("query_ref").rlike(r"\S"))
        .select(
            "report_id", F.col("page_no").cast("int"), F.col("visual_no").cast("int"), F.col("role_key").alias("role_name"),
            F.col("field_no").cast("int").alias("item_no"), F.regexp_replace("query_ref", r"^\s+|\s+$", "").alias("query_ref"),
        )
        .distinct()
    )


def _layout_table(name: str, keys: list[str], columns: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = layouts(table(spark, sf_dir, "bi_reports")).table(name)
        return rows.select("report_id", F.col("_id").alias("row_id"), F.col("_parent_id").alias("parent_id"), F.col("_parent").alias("parent_kind"), *keys, *columns).distinct()

    query.__doc__ = f"The {name} table of the shredded layouts."
    return query


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found in the layouts below each element of the schema graph, and whether the graph leads to them."""
    made = layouts(table(spark, sf_dir, "bi_reports"))
    elements = ["report_config", "visual_config", "single_visual", "filter", "bookmark"]
    rows = undeclared(LAYOUT, {e: made.shape(e) for e in elements})
    placed = LAYOUT.placement()
    return spark.createDataFrame([(e, placed[e], p, k, known) for e, p, k, known in rows], "element string, placement string, path string, kind string, declared boolean")


QUERIES = {
    "p1_found": p1_found,
    "p1_summary": p1_summary,
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_intervals": p2_intervals,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_models": p4_models,
    "p4_tables": p4_tables,
    "p5_found": p5_found,
    "p5_pages": _layout_table("page", ["page_no"], ["page_name", "display_name"]),
    "p5_visuals": _layout_table("visual", ["page_no", "visual_no"], ["visual_name", "visual_type"]),
    "p5_filters": _layout_table("filter", ["page_no", "visual_no", "filter_no"], ["filter_type", "filter_name"]),
    "p5_bookmarks": _layout_table("bookmark", ["_level"], ["bookmark_name", "bookmark_title"]),
    "p5_schema": p5_schema,
}

_LINKS_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT unique_id AS src, unnest(children) AS dst FROM child_map) WHERE src IS NOT NULL AND dst IS NOT NULL),
  names AS (SELECT unique_id AS x FROM child_map WHERE unique_id IS NOT NULL UNION SELECT dst FROM e),
  anc(x, a) AS (SELECT dst, src FROM e UNION SELECT anc.x, e.src FROM anc JOIN e ON e.dst = anc.a),
  looping AS (SELECT x FROM anc WHERE x = a), below AS (SELECT DISTINCT anc.x FROM anc JOIN looping l ON anc.a = l.x),
  up AS (SELECT dst AS x, min(src) AS p FROM e GROUP BY 1),
  climb(x, top, depth, path) AS (SELECT x, x, 0, x FROM names WHERE x NOT IN (SELECT x FROM below) AND x NOT IN (SELECT x FROM looping) UNION ALL SELECT c.x, up.p, c.depth + 1, up.p || ' > ' || c.path FROM climb c JOIN up ON up.x = c.top),
  tops AS (SELECT x AS unique_id, arg_max(top, depth) AS root_id, max(depth) AS depth, arg_max(path, depth) AS path FROM climb GROUP BY 1),
  placed AS (SELECT * FROM tops UNION ALL SELECT x, 'cycle', -1, NULL FROM looping UNION ALL SELECT x, 'below_cycle', -1, NULL FROM below WHERE x NOT IN (SELECT x FROM looping))"""
_HOURS_SQL = """h AS (SELECT * FROM (SELECT CASE WHEN starts_with(dbt_model_name, 'lumen_dwh.') THEN substr(dbt_model_name, 11) ELSE dbt_model_name END AS model, CAST(hour AS DATE) AS day,
   coalesce(try_cast(trim(total_query_cost) AS DECIMAL(18,6)), 0) AS cost, row_number() OVER (PARTITION BY CASE WHEN starts_with(dbt_model_name, 'lumen_dwh.') THEN substr(dbt_model_name, 11) ELSE dbt_model_name END, hour ORDER BY loaded_at DESC) AS i
   FROM models_costs_incremental WHERE dbt_model_name IS NOT NULL) WHERE i = 1),
  g AS (SELECT model, day, sum(cost) AS c FROM h GROUP BY 1, 2), b AS (SELECT model, min(day) AS a FROM g GROUP BY 1), z AS (SELECT max(CAST(hour AS DATE)) AS z FROM models_costs_incremental),
  cal AS (SELECT model, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b, z),
  t AS (SELECT cal.model, cal.day, sum(coalesce(c, 0)) OVER (PARTITION BY cal.model ORDER BY cal.day ROWS 6 PRECEDING) AS s7, sum(coalesce(c, 0)) OVER (PARTITION BY cal.model ORDER BY cal.day ROWS 29 PRECEDING) AS s30
   FROM cal LEFT JOIN g ON g.model = cal.model AND g.day = cal.day)"""
_RECORDS_SQL = """v AS (SELECT * FROM (SELECT ref_id, day, CASE WHEN table_id IS NOT NULL THEN dataset_id || '.' || table_id END AS name, coalesce(try_cast(trim(reference_count) AS BIGINT), 0) AS n,
  row_number() OVER (PARTITION BY ref_id ORDER BY loaded_at DESC) AS i FROM table_reference_incremental) WHERE i = 1)"""
_AVERAGES = ", ".join(f"CAST({{0}}{n} * 1000000 AS BIGINT) / 1000000 AS total_{n}d, sign({{0}}{n}) * ((2 * abs(CAST({{0}}{n} * 1000000 AS BIGINT)) + {n}) // {2 * n}) / 1000000 AS average_{n}d" for n in (7, 30))
_SQL_NOISE = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|--[^\n\r]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|\s+""".replace("'", "''")

CHANGES_SQL = f"""d AS (SELECT * FROM (SELECT snapshot_date, unique_id, regexp_replace(compiled_code, '{_SQL_NOISE}', '\\1', 'gs') AS code, config,
    row_number() OVER (PARTITION BY snapshot_date, unique_id ORDER BY loaded_at DESC) AS i FROM manifest_nodes) WHERE i = 1),
  j AS (SELECT d.snapshot_date, d.unique_id, string_agg(t.fullkey || t.type || coalesce(t.atom->>'$', ''), chr(10) ORDER BY t.fullkey) AS conf FROM d, json_tree(d.config) t GROUP BY 1, 2),
  r AS (SELECT d.snapshot_date, d.unique_id, d.code, j.conf FROM d LEFT JOIN j USING (snapshot_date, unique_id)),
  s AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM d)),
  n AS (SELECT r.*, s.snapshot_date AS pair FROM r JOIN s ON r.snapshot_date = s.snapshot_date WHERE before IS NOT NULL), o AS (SELECT r.*, s.snapshot_date AS pair FROM r JOIN s ON r.snapshot_date = s.before),
  ch AS (SELECT CAST(coalesce(n.pair, o.pair) AS VARCHAR) AS snapshot_date, coalesce(n.unique_id, o.unique_id) AS unique_id, CASE WHEN o.unique_id IS NULL THEN 'added' WHEN n.unique_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    CASE WHEN o.unique_id IS NULL OR n.unique_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.code IS DISTINCT FROM o.code THEN 'compiled_code' END, CASE WHEN n.conf IS DISTINCT FROM o.conf THEN 'config' END) END AS changed_columns
  FROM n FULL JOIN o ON n.pair = o.pair AND n.unique_id = o.unique_id WHERE o.unique_id IS NULL OR n.unique_id IS NULL OR n.code IS DISTINCT FROM o.code OR n.conf IS DISTINCT FROM o.conf)"""
_REPORTS_SQL = """l AS (SELECT DISTINCT report_id, name, config, filters, sections FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY scanned_at DESC) AS i FROM bi_reports) WHERE i = 1)"""
_JSON = "CASE WHEN json_valid({0}) AND NOT regexp_matches({0}, ',\\s*[}}\\]]') THEN CAST({0} AS JSON) END"

ORACLES = {
    "p1_found": f"WITH {CHANGES_SQL} SELECT snapshot_date, unique_id, change_kind FROM ch",
    "p1_summary": f"WITH {CHANGES_SQL} SELECT snapshot_date, change_kind, changed_columns, count(*) AS n_nodes FROM ch GROUP BY ALL",
    "p2_found": f"{_LINKS_SQL} SELECT unique_id, root_id, depth FROM placed WHERE unique_id LIKE 'model.%'",
    "p2_paths": f"{_LINKS_SQL} SELECT p.*, coalesce(n, 0) AS n_descendants FROM placed p LEFT JOIN (SELECT a, count(*) AS n FROM anc GROUP BY 1) d ON d.a = p.unique_id WHERE unique_id LIKE 'model.%'",
    "p2_descendants": """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT unique_id AS src, unnest(children) AS dst FROM child_map) WHERE dst IS NOT NULL),
  below(x, y) AS (SELECT src, dst FROM e UNION SELECT below.x, e.dst FROM below JOIN e ON e.src = below.y) SELECT x AS unique_id, y AS descendant FROM below WHERE x LIKE 'model.%'""",
    "p3_found": f"""WITH {_RECORDS_SQL}, k AS (SELECT unique_id, unnest(children) AS c FROM child_map)
  SELECT 'table_reference_incremental' AS table_name, name AS key_id, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS total FROM v WHERE name IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'child_map', a.unique_id, count(c), count(DISTINCT c) FROM (SELECT DISTINCT unique_id FROM child_map) a LEFT JOIN k USING (unique_id) GROUP BY 2""",
    "p4_found": f"""WITH {_HOURS_SQL} SELECT model AS dbt_model_name, CAST(day AS VARCHAR) AS day, CAST(s7 * 1000000 AS BIGINT) AS cost_7d_micro, CAST(s30 * 1000000 AS BIGINT) AS cost_30d_micro FROM t""",
    "p4_models": f"WITH {_HOURS_SQL} SELECT model AS dbt_model_name, CAST(day AS VARCHAR) AS day, {_AVERAGES.format('s')} FROM t",
    "p4_tables": f"""WITH {_RECORDS_SQL}, g AS (SELECT name, day, sum(n) AS c FROM v WHERE name IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2), b AS (SELECT name, min(day) AS a FROM g GROUP BY 1), z AS (SELECT max(day) AS z FROM table_reference_incremental),
  cal AS (SELECT name, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b, z),
  t AS (SELECT cal.name, cal.day, sum(coalesce(c, 0)) OVER (PARTITION BY cal.name ORDER BY cal.day ROWS 6 PRECEDING) AS s7, sum(coalesce(c, 0)) OVER (PARTITION BY cal.name ORDER BY cal.day ROWS 29 PRECEDING) AS s30 FROM cal LEFT JOIN g ON g.name = cal.name AND g.day = cal.day)
  SELECT name AS table_name, CAST(day AS VARCHAR) AS day, {_AVERAGES.format('s')} FROM t""",
    "p5_found": """WITH l AS (SELECT * FROM (SELECT report_id, sections, row_number() OVER (PARTITION BY report_id ORDER BY scanned_at DESC) AS i FROM bi_reports) WHERE i = 1),
  p AS (SELECT report_id, unnest(range(len(sections))) AS page_no, unnest(sections) AS s FROM l), v AS (SELECT report_id, page_no, unnest(range(len(s.visualContainers))) AS visual_no, unnest(s.visualContainers) AS c FROM p),
  c AS (SELECT report_id, page_no, visual_no, CASE WHEN json_valid(c.config) AND NOT regexp_matches(c.config, ',\\s*[}\\]]') THEN CAST(c.config AS JSON) END AS j FROM v),
  r AS (SELECT report_id, page_no, visual_no, e.key AS role_name, e.value AS items FROM c, json_each(j->'$.singleVisual.projections') e WHERE json_type(j, '$.singleVisual.projections') = 'OBJECT'),
  f AS (SELECT report_id, page_no, visual_no, role_name, e.key AS item_no, e.value AS item FROM r, json_each(items) e WHERE json_type(items) = 'ARRAY')
  SELECT report_id, CAST(page_no AS INT) AS page_no, CAST(visual_no AS INT) AS visual_no, role_name, CAST(item_no AS INT) AS item_no, trim(item->>'$.queryRef', ' ' || chr(9) || chr(10) || chr(13)) AS query_ref
  FROM f WHERE json_type(item, '$.queryRef') = 'VARCHAR' AND trim(item->>'$.queryRef', ' ' || chr(9) || chr(10) || chr(13)) <> ''""",
    "p5_pages": """WITH l AS (SELECT * FROM (SELECT report_id, sections, row_number() OVER (PARTITION BY report_id ORDER BY scanned_at DESC) AS i FROM bi_reports) WHERE i = 1),
  p AS (SELECT report_id, unnest(range(len(sections))) AS page_no, unnest(sections) AS s FROM l)
  SELECT report_id, report_id || '/sections:' || page_no AS row_id, report_id AS parent_id, 'report' AS parent_kind, CAST(page_no AS INT) AS page_no, s.name AS page_name, s.displayName AS display_name FROM p""",
    "p5_visuals": """WITH l AS (SELECT * FROM (SELECT report_id, sections, row_number() OVER (PARTITION BY report_id ORDER BY scanned_at DESC) AS i FROM bi_reports) WHERE i = 1),
  p AS (SELECT report_id, unnest(range(len(sections))) AS page_no, unnest(sections) AS s FROM l), v AS (SELECT report_id, page_no, unnest(range(len(s.visualContainers))) AS visual_no, unnest(s.visualContainers) AS c FROM p),
  c AS (SELECT report_id, page_no, visual_no, CASE WHEN json_valid(c.config) AND NOT regexp_matches(c.config, ',\\s*[}\\]]') THEN CAST(c.config AS JSON) END AS j FROM v)
  SELECT report_id, report_id || '/sections:' || page_no || '/visualContainers:' || visual_no AS row_id, report_id || '/sections:' || page_no AS parent_id, 'page' AS parent_kind, CAST(page_no AS INT) AS page_no, CAST(visual_no AS INT) AS visual_no,
  json_extract_string(j, '$.name') AS visual_name, json_extract_string(j, '$.singleVisual.visualType') AS visual_type FROM c""",
    "p5_filters": f"""WITH {_REPORTS_SQL}, pg AS (SELECT report_id, unnest(range(len(sections))) AS page_no, unnest(sections) AS s FROM l), vs AS (SELECT report_id, page_no, unnest(range(len(s.visualContainers))) AS visual_no, unnest(s.visualContainers) AS c FROM pg),
  sc AS (SELECT report_id, report_id AS parent_id, 'report' AS parent_kind, NULL AS page_no, NULL AS visual_no, filters AS f FROM l UNION ALL SELECT report_id, report_id || '/sections:' || page_no, 'page', page_no, NULL, s.filters FROM pg
   UNION ALL SELECT report_id, report_id || '/sections:' || page_no || '/visualContainers:' || visual_no, 'visual', page_no, visual_no, c.filters FROM vs),
  j AS (SELECT *, {_JSON.format('f')} AS j FROM sc), e AS (SELECT j.*, k.key AS filter_no, k.value AS x FROM j, json_each(j.j) k WHERE json_type(j.j) = 'ARRAY')
  SELECT report_id, parent_id || '/filters:' || filter_no AS row_id, parent_id, parent_kind, CAST(page_no AS INT) AS page_no, CAST(visual_no AS INT) AS visual_no, CAST(filter_no AS INT) AS filter_no, x->>'$.type' AS filter_type, x->>'$.name' AS filter_name FROM e""",
    "p5_bookmarks": f"""WITH RECURSIVE {_REPORTS_SQL}, c AS (SELECT report_id, {_JSON.format('config')} AS j FROM l), b(report_id, row_id, parent_id, parent_kind, _level, x) AS (
   SELECT report_id, report_id || '/bookmarks:' || k.key, report_id, 'report', 0, k.value FROM (SELECT report_id, j->'$.bookmarks' AS a FROM c) q, json_each(q.a) k WHERE json_type(q.a) = 'ARRAY'
   UNION ALL SELECT b.report_id, b.row_id || '/children:' || k.key, b.row_id, 'bookmark', b._level + 1, k.value FROM b, json_each(b.x->'$.children') k WHERE json_type(b.x, '$.children') = 'ARRAY')
  SELECT report_id, row_id, parent_id, parent_kind, _level, x->>'$.name' AS bookmark_name, x->>'$.displayName' AS bookmark_title FROM b""",
}
