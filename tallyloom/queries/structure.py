"""Queries of the graph, SQL-text, lineage, refresh and BI operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import advisors, bi, graph, select
from tallyloom.plans import usage as texts
from tallyloom.queries.base import COSTS_SQL, EDGES_SQL, FILTERS_SQL, MODELS_SQL, NODES_SQL, USES_SQL, Registry, costs, models, nodes, table
from tallyloom.queries import metadata
from tallyloom.queries.general import CHANGES_SQL
from tallyloom.queries.general import ORACLES as GENERAL_SQL
from tallyloom.queries.general import latest_rows, layouts
from tallyloom.queries.metadata import FACTS_SQL

R = Registry()
Q = R.add


# -- graph --------------------------------------------------------------------

def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_table(table(spark, d, "child_map"), "unique_id", "children").select("src", "dst").distinct()


def every_start(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("start")).distinct()


def known(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select(F.col("unique_id").alias("id")).union(table(spark, d, "manifest_sources").select("unique_id")).distinct()


_REACH_SQL = f"WITH RECURSIVE {EDGES_SQL}, w(s, x) AS (SELECT src, dst FROM e UNION SELECT w.s, e.dst FROM w JOIN e ON e.src = w.x)"
#: Least numbers of hops; a way without repeated names has fewer hops than there are names.
_LEVELS_SQL = _REACH_SQL + """, z AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)),
  v(s, x, level) AS (SELECT src, dst, 1 FROM e UNION SELECT v.s, e.dst, v.level + 1 FROM v JOIN e ON e.src = v.x, z WHERE v.level < z.n), lv AS (SELECT s, x, min(level) AS level FROM v GROUP BY 1, 2)"""


@Q("children_direct", f"WITH {EDGES_SQL} SELECT src AS start, dst AS node FROM e")
def children_direct(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.direct(e, e.select(F.col("src").alias("start")))


@Q("parents_direct", f"WITH {EDGES_SQL} SELECT dst AS start, src AS node FROM e")
def parents_direct(spark: SparkSession, d: str) -> DataFrame:
    e = graph.reverse(edges(spark, d))
    return graph.direct(e, e.select(F.col("src").alias("start")))


@Q("descendants", f"{_LEVELS_SQL} SELECT s AS start, x AS node, level FROM lv")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    """What lies below every name that has children, with the least number of hops."""
    e = edges(spark, d)
    return graph.reach(e, every_start(e))


@Q("ancestors", f"{_REACH_SQL} SELECT x AS start, s AS node FROM w")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """What lies above every name that has parents."""
    up = graph.reverse(edges(spark, d))
    return graph.reach(up, every_start(up)).select("start", "node")


@Q("downstream_models", f"{_LEVELS_SQL}, {NODES_SQL} SELECT s AS start, x AS model, level FROM lv WHERE x LIKE 'model.%' AND (x IN (SELECT unique_id FROM n) OR x IN (SELECT unique_id FROM manifest_sources))")
def downstream_models(spark: SparkSession, d: str) -> DataFrame:
    """Known models below every name that has children."""
    e = edges(spark, d)
    return graph.downstream_models(e, every_start(e), known(spark, d))


@Q("relation_edges", f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, k AS (SELECT unique_id FROM n UNION SELECT unique_id FROM manifest_sources), l AS (SELECT * FROM e WHERE dst NOT LIKE 'test.%' AND dst IN (SELECT unique_id FROM k)),
  w(s, x) AS (SELECT src, src FROM l UNION SELECT w.s, l.dst FROM w JOIN l ON l.src = w.x) SELECT w.s AS start, l.src, l.dst FROM w JOIN l ON l.src = w.x""")
def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links that the relation tree of every name lists."""
    e = edges(spark, d)
    return graph.relation_edges(e, known(spark, d), every_start(e))


@Q("topo_levels", f"""WITH RECURSIVE {EDGES_SQL}, x AS (SELECT src AS x FROM e UNION SELECT dst FROM e), anc(x, a) AS (SELECT dst, src FROM e UNION SELECT anc.x, e.src FROM anc JOIN e ON e.dst = anc.a),
  bad AS (SELECT DISTINCT a.x FROM anc a JOIN (SELECT x FROM anc WHERE x = a) l ON a.a = l.x), f AS (SELECT * FROM e WHERE dst NOT IN (SELECT x FROM bad) AND src NOT IN (SELECT x FROM bad)),
  lv(x, level) AS (SELECT x, 0 FROM x WHERE x NOT IN (SELECT x FROM bad) AND x NOT IN (SELECT dst FROM e) UNION SELECT f.dst, lv.level + 1 FROM lv JOIN f ON f.src = lv.x), q AS (SELECT x, max(level) AS level FROM lv GROUP BY 1)
  SELECT * FROM q UNION ALL SELECT x, (SELECT coalesce(max(level), 0) + 1 FROM q) FROM (SELECT x FROM bad UNION SELECT x FROM anc WHERE x = a)""")
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return advisors.topological_levels(e, e.select(F.col("src").alias("x")).union(e.select("dst")).distinct())


# -- SQL texts ----------------------------------------------------------------

def _named(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and sources with what queries may call them."""
    own = nodes(spark, d).select(F.col("unique_id").alias("id"), "database", "schema", "alias", "name", "pos")
    others = table(spark, d, "manifest_sources").select(F.col("unique_id").alias("id"), "database", "schema", F.col("identifier").alias("alias"), "name", F.lit(-1).alias("pos"))
    return own.unionByName(others).withColumn("short_name", select.short_name("id"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """Tables named by every model's SQL, with the node they are, or else their own name in ``target``."""
    found = texts.extract_references(models(spark, d), "unique_id", "compiled_code")
    return graph.resolve_tables(found, graph.table_keys(_named(spark, d))).withColumn("target", F.coalesce("node", "table_name"))


def usage_of_tables(spark: SparkSession, d: str) -> DataFrame:
    """Usage events of every model on the tables its SQL names: target (node, or the table's own name), column, ..., downstream_model."""
    events = texts.extract_all_usage(models(spark, d), "unique_id", "compiled_code").where("status = 'ok'").withColumnRenamed("target", "table_name")
    named = graph.resolve_tables(events, graph.table_keys(_named(spark, d)))
    return named.select(F.coalesce("node", "table_name").alias("target"), "column", "clause", "operator", "selectivity", "wrapping_fn", F.col("model").alias("downstream_model"), "event_no")


@Q("usage_events", f'WITH {USES_SQL} SELECT * FROM us')
def usage_events(spark: SparkSession, d: str) -> DataFrame:
    return usage_of_tables(spark, d).drop("event_no")


@Q("table_references", f"""WITH {USES_SQL}, tr AS (SELECT unique_id, ft AS name, true AS in_from FROM sp WHERE ft <> '' UNION ALL SELECT unique_id, jt, false FROM sp WHERE jt <> '')
  SELECT unique_id AS model, name AS table_name, false AS bare_star, bool_or(in_from) AS in_from, CAST(NULL AS VARCHAR) AS node FROM tr GROUP BY 1, 2""")
def table_references(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).drop("target")


@Q("native_sql_analysis", f"""WITH {USES_SQL}, o AS (SELECT sp.unique_id AS key, CASE WHEN jt <> '' AND jt <> ft THEN ft || ',' || jt ELSE ft END AS tables, list_transform(regexp_extract_all(w, 't\\.(\\w+)', 1), lambda x: x) AS l,
   CASE WHEN jt <> '' THEN [regexp_extract(t, 'on\\s+j\\.(\\w+)', 1), regexp_extract(t, 'on\\s+j\\.\\w+\\s*=\\s*t\\.(\\w+)', 1)] ELSE [] END AS j FROM sp)
  SELECT unique_id AS key, coalesce(tables, '') AS tables, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS where_columns, coalesce(array_to_string(list_filter(j, lambda x, i: list_position(j, x) = i), ','), '') AS join_columns,
  '' AS group_columns, CASE WHEN key IS NULL THEN 'partial' ELSE 'ok' END AS status FROM m LEFT JOIN o ON o.key = m.unique_id""")
def native_sql_analysis(spark: SparkSession, d: str) -> DataFrame:
    rows = texts.extract_analysis(models(spark, d), "unique_id", "compiled_code")
    return rows.select("key", *[F.array_join(c, ",").alias(c) for c in ("tables", "where_columns", "join_columns", "group_columns")], "status")


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return select.documented_columns(nodes(spark, d)).select(F.col("unique_id").alias("id"), "column", "data_type")


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """(target, column, data_type): declared columns of nodes; a table that is no node has those its readers declare by the same name."""
    read = references(spark, d).where("node IS NULL").select("target", F.col("model").alias("id")).distinct()
    others = read.join(_columns(spark, d), "id").groupBy("target", F.lower("column").alias("column")).agg(F.min("data_type").alias("data_type"))
    return _columns(spark, d).select(F.col("id").alias("target"), "column", "data_type").unionByName(others)


_TYPED_SQL = """kc AS (SELECT unique_id, unnest(map_entries(columns)) AS c FROM m), tc AS (SELECT target, lower(c.key) AS "column", min(coalesce(c.value.data_type, 'unknown')) AS data_type
  FROM (SELECT DISTINCT * FROM (SELECT unique_id, ft AS target FROM sp WHERE ft <> '' UNION ALL SELECT unique_id, jt FROM sp WHERE jt <> '')) JOIN kc USING (unique_id) GROUP BY 1, 2)"""
_BASE = "upper(trim(split_part(split_part(coalesce(data_type, ''), '(', 1), '<', 1)))"


def _phrases(*kinds: tuple[str, str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {n} = 1 THEN '1 {one}' WHEN {n} > 1 THEN {n} || ' {many}' END" for n, one, many in kinds)
    return f"coalesce(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '; '), '')"


@Q("cluster_advice_models", f"""WITH {USES_SQL}, {_TYPED_SQL}, p AS (SELECT *, clause = 'where' AND operator IN ('eq','in','gt','ge','lt','le','between') AS known FROM us),
  g AS (SELECT target, "column", count(DISTINCT downstream_model) AS n_models, sum(CASE WHEN known AND wrapping_fn <> '' THEN 5 WHEN known AND operator = 'eq' THEN 30 WHEN known AND operator = 'in' THEN 25 WHEN known THEN 20 ELSE 20 END) AS pts,
   CAST(count_if(known AND wrapping_fn = '' AND operator = 'eq') AS BIGINT) AS n_eq, CAST(count_if(known AND wrapping_fn = '' AND operator = 'in') AS BIGINT) AS n_in, CAST(count_if(known AND wrapping_fn = '' AND operator NOT IN ('eq','in')) AS BIGINT) AS n_range,
   CAST(count_if(known AND wrapping_fn <> '') AS BIGINT) AS n_wrapped, CAST(count_if(clause = 'join') AS BIGINT) AS n_join FROM p WHERE known OR clause = 'join' GROUP BY 1, 2),
  a AS (SELECT g.*, coalesce(data_type, '') AS data_type, round(pts / 10.0 * greatest(log2(n_models + 1), 1), 2) AS score, CASE WHEN {_BASE} IN ('STRUCT','ARRAY','GEOGRAPHY','JSON') THEN 'type ' || {_BASE} ELSE '' END AS excluded FROM g LEFT JOIN tc USING (target, "column")),
  r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY (excluded <> '')::INT, score DESC, "column") AS i FROM a)
  SELECT target, "column", data_type, score, CASE WHEN excluded = '' THEN i END AS rank_no, excluded, {_phrases(('n_eq', 'equality filter', 'equality filters'), ('n_in', 'IN filter', 'IN filters'), ('n_range', 'range filter', 'range filters'), ('n_wrapped', 'filter under a function', 'filters under functions'), ('n_join', 'join', 'joins'))} AS reasons
  FROM r WHERE excluded <> '' OR i <= 4""")
def cluster_advice_models(spark: SparkSession, d: str) -> DataFrame:
    """Cluster keys for every table that models read, from how their SQL uses its columns."""
    parts = models(spark, d).select(F.col("unique_id").alias("target"), F.explode(select.config_list("partition_by", "field")).alias("column"), F.lit(True).alias("is_partition")).distinct()
    typed = table_columns(spark, d).join(parts, ["target", "column"], "left")
    advice = advisors.cluster_advice(advisors.cluster_scores(usage_of_tables(spark, d)), typed)
    return advice.select("target", "column", "data_type", "score", F.col("rank_no").cast("bigint").alias("rank_no"), "excluded", advisors.cluster_reasons().alias("reasons"))


@Q("partition_advice_models", f"""WITH {USES_SQL}, {_TYPED_SQL}, p AS (SELECT us.*, {_BASE} AS base FROM us JOIN tc USING (target, "column") WHERE clause = 'where'),
  q AS (SELECT *, wrapping_fn <> '' AS bad, CASE WHEN wrapping_fn <> '' THEN 0 WHEN operator IN ('gt','ge','lt','le') THEN 25 WHEN operator = 'eq' THEN 20 WHEN operator = 'in' THEN 15 END AS p FROM p WHERE base IN ('TIMESTAMP','DATE','DATETIME','INT64','INTEGER','INT','BIGINT')),
  g AS (SELECT target, "column", base, sum(p) AS pts, count(DISTINCT CASE WHEN NOT bad THEN downstream_model END) AS n_models, count_if(bad) AS n_wrapped, count_if(NOT bad AND operator IN ('gt','ge','lt','le')) AS n_range, count_if(NOT bad AND operator = 'eq') AS n_eq, count_if(NOT bad AND operator = 'in') AS n_in FROM q WHERE p IS NOT NULL GROUP BY 1, 2, 3),
  z AS (SELECT *, round(pts / 10.0 * CASE WHEN base IN ('TIMESTAMP','DATE') THEN 1.5 WHEN base = 'DATETIME' THEN 1.3 ELSE 1.0 END * greatest(log2(n_models + 1), 1), 2) AS score FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, "column") AS rank_no FROM z WHERE score > 0)
  SELECT target, "column", base AS data_type, score, rank_no, CASE WHEN base IN ('TIMESTAMP','DATE','DATETIME') THEN 'DAY' ELSE 'RANGE_BUCKET' END AS granularity, {_phrases(('n_range', 'range filter', 'range filters'), ('n_eq', 'equality filter', 'equality filters'), ('n_in', 'IN filter', 'IN filters'), ('n_wrapped', 'filter whose function defeats pruning', 'filters whose functions defeat pruning'))} AS reasons FROM r WHERE rank_no <= 5""")
def partition_advice_models(spark: SparkSession, d: str) -> DataFrame:
    """Partition columns for every table that models read."""
    advice = advisors.partition_advice(advisors.partition_scores(usage_of_tables(spark, d), table_columns(spark, d)))
    return advice.select("target", "column", "data_type", "score", F.col("rank_no").cast("bigint").alias("rank_no"), "granularity", advisors.partition_reasons().alias("reasons"))


def lineage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbolic = texts.extract_lineage(models(spark, d), "unique_id", "compiled_code")
    return graph.column_lineage(symbolic, _named(spark, d), _columns(spark, d), outside=True)


_OUTPUTS_SQL = f"""{USES_SQL}, oi AS (SELECT unique_id, ft, unnest(regexp_extract_all(sel, 't\\.\\w+(?:\\s+as\\s+\\w+)?')) AS item FROM sp WHERE ft <> ''),
  le AS (SELECT DISTINCT ft || '.' || regexp_extract(item, 't\\.(\\w+)', 1) AS src, regexp_extract(unique_id, '([^.]*)$', 1) || '.' || coalesce(nullif(regexp_extract(item, '\\sas\\s+(\\w+)', 1), ''), regexp_extract(item, 't\\.(\\w+)', 1)) AS dst, 'passthrough' AS transform FROM oi)"""


@Q("lineage_edges", f"WITH {_OUTPUTS_SQL} SELECT * FROM le")
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    """Column to column, for all models; a table that is no node goes by its own name."""
    return lineage(spark, d)[1]


@Q("lineage_nodes", f"""WITH {_OUTPUTS_SQL}, dc AS (SELECT unique_id, unnest(map_entries(columns)) AS c FROM n), dn AS (SELECT regexp_extract(unique_id, '([^.]*)$', 1) || '.' || lower(c.key) AS id, max(upper(coalesce(c.value.data_type, 'unknown'))) AS data_type FROM dc GROUP BY 1),
  ids AS (SELECT src AS id FROM le UNION SELECT dst FROM le UNION SELECT id FROM dn) SELECT id, regexp_replace(id, '[.][^.]*$', '') AS model, regexp_extract(id, '([^.]*)$', 1) AS "column", data_type FROM ids LEFT JOIN dn USING (id)""")
def lineage_nodes(spark: SparkSession, d: str) -> DataFrame:
    return lineage(spark, d)[0]


@Q("lineage_downstream", f"WITH {_OUTPUTS_SQL} SELECT src AS start, dst AS node, true AS is_direct, regexp_replace(dst, '[.][^.]*$', '') AS model FROM le WHERE src NOT IN (SELECT dst FROM le)")
def lineage_downstream(spark: SparkSession, d: str) -> DataFrame:
    """Direct and transitive lineage of every column that no other column feeds."""
    made, links = lineage(spark, d)
    tops = links.select(F.col("src").alias("start")).distinct().join(links.select(F.col("dst").alias("start")), "start", "left_anti")
    return graph.lineage_query(made, links, tops, downstream=True).drop("data_type")


@Q("lineage_stats", f"""WITH {_OUTPUTS_SQL}, st AS (SELECT CASE WHEN coalesce(trim(compiled_code), '') = '' THEN 'no_sql' ELSE 'ok' END AS status, count(*) AS n FROM m GROUP BY 1)
  SELECT * FROM st UNION ALL SELECT 'nodes', count(*) FROM (SELECT src FROM le UNION SELECT dst FROM le) UNION ALL SELECT 'edges', count(*) FROM le""")
def lineage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Models by outcome of lineage extraction, and the numbers of columns with lineage and of links."""
    rows = texts.extract_lineage(models(spark, d), "unique_id", "compiled_code")
    links = lineage(spark, d)[1]
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("status"), "n")
    return rows.groupBy("status").agg(F.count_distinct("model").alias("n")).unionByName(count(ends, "nodes")).unionByName(count(links, "edges"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that changed between the two newest snapshots."""
    from tallyloom.queries.general import node_changes

    every = table(spark, d, "manifest_nodes")
    newest = node_changes(every).where(F.col("snapshot_date") == every.agg(F.max("snapshot_date")).scalar())
    return newest.where("change_kind = 'changed'").select(F.col("unique_id").alias("model"), F.lit("*").alias("column"))


def _plan(spark: SparkSession, d: str, changed: DataFrame) -> DataFrame:
    """What to rebuild after changes of nodes, or of tables that are no node."""
    own = models(spark, d)
    found = references(spark, d)
    stars = found.select(F.col("target").alias("parent"), "model", "bare_star")
    events = texts.extract_all_usage(own, "unique_id", "compiled_code")
    used = usage_of_tables(spark, d).select(F.col("target").alias("parent"), F.col("downstream_model").alias("model"), "column")
    depends = own.select(F.explode("depends_on.nodes").alias("parent"), F.col("unique_id").alias("model")).where("parent IS NOT NULL")
    depends = depends.unionByName(found.where("node IS NULL").select(F.col("target").alias("parent"), "model")).distinct()
    # a text that can't be read tells as little as none
    no_sql = own.where("compiled_code IS NULL OR trim(compiled_code) = ''").select(F.col("unique_id").alias("model")).union(events.where("status = 'unreadable'").select("model"))
    affected = advisors.propagate_changes(changed, depends, used, stars, no_sql)
    below = graph.reach(depends.select(F.col("parent").alias("src"), F.col("model").alias("dst")), changed.select(F.col("model").alias("start"))).select(F.col("node").alias("model")).where(F.col("model").startswith("model.")).distinct()
    facts = own.select(
        F.col("unique_id").alias("model"), select.config_value("materialized").alias("materialized"), select.config_list("unique_key").alias("unique_keys"),
        select.config_list("partition_by", "field").alias("partition_cols"), (F.trim(F.coalesce("compiled_code", F.lit(""))) != "").alias("has_sql"),
    )
    return advisors.refresh_plan(below, affected, changed, facts)


def _plan_sql(changed: str) -> str:
    return f"""WITH RECURSIVE {USES_SQL}, ro AS (SELECT unique_id AS model, ft AS parent FROM sp WHERE ft <> '' UNION SELECT unique_id, jt FROM sp WHERE jt <> ''),
  dep AS (SELECT parent, model FROM (SELECT unnest(depends_on.nodes) AS parent, unique_id AS model FROM m) WHERE parent IS NOT NULL UNION SELECT parent, model FROM ro), ns AS (SELECT unique_id AS model FROM m WHERE trim(coalesce(compiled_code, '')) = ''),
  chg AS ({changed}), st AS (SELECT dep.parent, NULL AS need, dep.model, '*' AS got FROM dep JOIN ns USING (model) UNION SELECT parent, '*', model, '*' FROM ro UNION SELECT target, "column", downstream_model, "column" FROM us),
  aff(model, col) AS (SELECT model, col FROM chg UNION SELECT st.model, st.got FROM aff JOIN st ON st.parent = aff.model AND (st.need IS NULL OR st.need = aff.col)),
  blw(model) AS (SELECT dep.model FROM chg JOIN dep ON dep.parent = chg.model UNION SELECT dep.model FROM blw JOIN dep ON dep.parent = blw.model),
  ac AS (SELECT model, list(DISTINCT col) AS cols FROM aff GROUP BY 1), cv AS (SELECT unique_id AS model, json_extract_string(config, '$.materialized') AS mat, json_extract(config, '$.unique_key') AS k, json_extract(config, '$.partition_by') AS p, trim(coalesce(compiled_code, '')) <> '' AS has_sql FROM m),
  ft AS (SELECT model, mat, has_sql, CASE json_type(k) WHEN 'VARCHAR' THEN [k->>'$'] WHEN 'ARRAY' THEN from_json(k, '["VARCHAR"]') ELSE [] END AS keys, CASE json_type(p) WHEN 'VARCHAR' THEN [p->>'$'] WHEN 'ARRAY' THEN from_json(p, '["VARCHAR"]') WHEN 'OBJECT' THEN [coalesce(p->>'$.field', p->>'$.column')] ELSE [] END AS parts FROM cv),
  al AS (SELECT model FROM blw WHERE model LIKE 'model.%' UNION SELECT model FROM chg), rs AS (SELECT al.model, CASE WHEN al.model IN (SELECT model FROM chg) THEN 'changed model itself' WHEN cols IS NULL THEN 'not affected' WHEN NOT coalesce(has_sql, false) THEN 'no SQL' WHEN list_contains(cols, '*') THEN 'whole row affected'
   WHEN coalesce(mat, '') NOT IN ('incremental', 'materialized_view') THEN 'not incremental' WHEN len(list_intersect(keys, cols)) > 0 THEN 'unique key affected' WHEN len(list_intersect(parts, cols)) > 0 THEN 'partition column affected' ELSE 'safe' END AS reason FROM al LEFT JOIN ac USING (model) LEFT JOIN ft USING (model)),
  pl AS (SELECT model, CASE reason WHEN 'not affected' THEN 'skip' WHEN 'safe' THEN 'incremental' ELSE 'full' END AS bucket, reason FROM rs)"""


_PLAN_SQL = _plan_sql(f"SELECT unique_id AS model, '*' AS col FROM (WITH {CHANGES_SQL} SELECT * FROM ch WHERE change_kind = 'changed' AND snapshot_date = (SELECT CAST(max(snapshot_date) AS VARCHAR) FROM manifest_nodes))")


@Q("refresh_plan", f"{_PLAN_SQL} SELECT * FROM pl")
def refresh_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to rebuild after the changes between the two newest snapshots."""
    return _plan(spark, d, _changes(spark, d))


#: Columns taken as changed in every table that is no node.
CHANGED_COLUMNS = ("status", "event_date", "id")


@Q("refresh_plan_columns", _plan_sql("SELECT parent AS model, unnest(['status', 'event_date', 'id']) AS col FROM (SELECT DISTINCT parent FROM ro)") + " SELECT * FROM pl WHERE model LIKE 'model.%'")
def refresh_plan_columns(spark: SparkSession, d: str) -> DataFrame:
    """What to rebuild when some columns of the tables outside the project change."""
    outside = references(spark, d).where("node IS NULL").select(F.col("target").alias("model")).distinct()
    changed = outside.select("model", F.explode(F.array(*[F.lit(c) for c in CHANGED_COLUMNS])).alias("column"))
    return _plan(spark, d, changed).where(F.col("model").startswith("model."))


@Q("refresh_summary", f"""{_PLAN_SQL}, g AS (SELECT bucket, count(*) AS n_models, string_agg(model, ' ' ORDER BY model) AS models FROM pl GROUP BY 1)
  SELECT *, CASE bucket WHEN 'full' THEN 'dbt run --full-refresh --select ' || models WHEN 'incremental' THEN 'dbt run --select ' || models END AS command FROM g""")
def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    """Models of each bucket of refresh_plan, and the command that builds them."""
    plan = refresh_plan(spark, d)
    return advisors.refresh_summary(plan).join(advisors.refresh_commands(plan), "bucket", "left")


# -- reviews of a model and its neighbours -----------------------------------------

def child_filters(spark: SparkSession, d: str) -> DataFrame:
    """(root, model, filters): columns that each child's SQL compares, for every model and each child of it."""
    own = models(spark, d)
    filters = texts.extract_filters(own, "unique_id", "compiled_code").withColumnRenamed("columns", "filters")
    pairs = edges(spark, d).select(F.col("src").alias("root"), F.col("dst").alias("model"))
    return pairs.join(own.select(F.col("unique_id").alias("root")), "root", "left_semi").join(filters, "model").select("root", "model", "filters")


_REVIEW_SQL = f"""{FILTERS_SQL}, {EDGES_SQL}, cf AS (SELECT e.src AS root, e.dst AS model, coalesce(fc.l, []) AS l FROM e JOIN m ON m.unique_id = e.src JOIN fc ON fc.unique_id = e.dst),
  jc AS (SELECT unique_id, coalesce(json_extract_string(config, '$.materialized'), 'view') AS mat, json_extract(config, '$.cluster_by') AS v, json_extract(config, '$.partition_by') AS p FROM m),
  lay AS (SELECT unique_id AS root, mat, CASE json_type(v) WHEN 'VARCHAR' THEN [lower(v->>'$')] WHEN 'ARRAY' THEN list_transform(from_json(v, '["VARCHAR"]'), lambda x: lower(x)) ELSE [] END AS c,
   lower(CASE json_type(p) WHEN 'VARCHAR' THEN p->>'$' WHEN 'ARRAY' THEN p->>'$[0]' WHEN 'OBJECT' THEN coalesce(p->>'$.field', p->>'$.column') END) AS p FROM jc),
  da AS (SELECT root, model, l, p, c, list_filter(list_slice(l, 1, 5), lambda x: NOT coalesce(lower(x) = p, false) AND NOT list_contains(c, lower(x))) AS missed FROM cf JOIN lay USING (root)),
  dn AS (SELECT *, CASE WHEN len(missed) = 0 THEN 'GOOD' WHEN p IS NULL AND len(c) = 0 THEN 'POOR' ELSE 'SUBOPTIMAL' END AS alignment FROM da),
  ua AS (SELECT e.dst AS root, e.src AS model, CASE WHEN pl.mat = 'view' THEN 'N/A' WHEN rl.p IS NOT NULL AND pl.p IS NULL THEN 'HIGH' WHEN len(list_filter(list_slice(coalesce(fc.l, []), 1, 3), lambda x: NOT coalesce(lower(x) = pl.p, false) AND NOT list_contains(pl.c, lower(x)))) > 0 THEN 'MEDIUM' ELSE 'ALIGNED' END AS alignment
   FROM e JOIN lay rl ON rl.root = e.dst JOIN lay pl ON pl.root = e.src LEFT JOIN fc ON fc.unique_id = e.dst)"""


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    """(root, root_partition, root_clusters, materialized) of every model."""
    return models(spark, d).select(
        F.col("unique_id").alias("root"), F.try_element_at(select.config_list("partition_by", "field"), F.lit(1)).alias("root_partition"),
        select.config_list("cluster_by").alias("root_clusters"), F.coalesce(select.config_value("materialized"), F.lit("view")).alias("materialized"),
    )


def _downstream(spark: SparkSession, d: str) -> DataFrame:
    return advisors.downstream_alignment(child_filters(spark, d).join(_layouts(spark, d), "root"))


def _upstream(spark: SparkSession, d: str) -> DataFrame:
    layout = _layouts(spark, d)
    own = texts.extract_filters(models(spark, d), "unique_id", "compiled_code").select(F.col("model").alias("root"), F.col("columns").alias("root_filters"))
    parents = layout.select(F.col("root").alias("model"), "materialized", F.col("root_partition").isNotNull().alias("has_partition"), F.array_compact(F.concat(F.array("root_partition"), "root_clusters")).alias("layout"))
    pairs = edges(spark, d).select(F.col("dst").alias("root"), F.col("src").alias("model")).join(layout.select("root", F.col("root_partition").isNotNull().alias("root_has_partition")), "root")
    return advisors.upstream_alignment(pairs.join(parents, "model").join(own, "root", "left"))


@Q("branch_alignment", f"WITH {_REVIEW_SQL} SELECT root, model, alignment, coalesce(array_to_string(missed, ','), '') AS missed FROM dn")
def branch_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How well each child's filters meet the layout of the model it hangs below."""
    return _downstream(spark, d).select("root", "model", "alignment", F.array_join("missed", ",").alias("missed"))


@Q("upstream_alignment", f"WITH {_REVIEW_SQL} SELECT * FROM ua")
def upstream_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How well each parent is laid out for what the model below it filters on."""
    return _upstream(spark, d)


@Q("branch_recommendations", f"""WITH {_REVIEW_SQL}, bu AS (SELECT DISTINCT root, model, alignment, p, unnest(list_slice(l, 1, 5)) AS subject, c FROM dn),
  mc AS (SELECT root, subject, count(DISTINCT model) AS n FROM bu WHERE alignment <> 'GOOD' AND NOT coalesce(lower(subject) = p, false) AND NOT list_contains(c, lower(subject)) GROUP BY 1, 2 HAVING count(DISTINCT model) >= 2),
  mp AS (SELECT root, subject, count(DISTINCT model) AS n FROM bu WHERE p IS NULL GROUP BY 1, 2 HAVING count(DISTINCT model) >= 2)
  SELECT DISTINCT root, 'upstream_partition' AS kind, model AS subject, CAST(NULL AS BIGINT) AS n_models, 'HIGH' AS priority FROM ua WHERE alignment = 'HIGH'
  UNION ALL SELECT root, 'add_clustering', subject, n, 'MEDIUM' FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, subject) AS i FROM mc) WHERE i <= 2
  UNION ALL SELECT root, 'add_partition', subject, n, 'HIGH' FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, subject) AS i FROM mp) WHERE i = 1""")
def branch_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What to change around each model: partitions of parents, cluster keys and partition of its own."""
    down = _downstream(spark, d).join(child_filters(spark, d), ["root", "model"])
    return advisors.branch_recommendations(_upstream(spark, d), down, _layouts(spark, d))


@Q("common_filters", f"""WITH {_REVIEW_SQL}, g AS (SELECT root, unnest(l) AS "column", model FROM cf), k AS (SELECT root, "column", count(DISTINCT model) AS n_models FROM g GROUP BY 1, 2 HAVING count(DISTINCT model) >= 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n_models DESC, "column") AS rank_no FROM k) WHERE rank_no <= 5""")
def common_filters(spark: SparkSession, d: str) -> DataFrame:
    """The five columns that most children of a model filter on, at least two of them."""
    return advisors.common_filters(child_filters(spark, d), 5, 2).withColumn("rank_no", F.col("rank_no").cast("bigint"))


@Q("cluster_matches", f"""WITH {_REVIEW_SQL}, g AS (SELECT root, unnest(l) AS col, model FROM cf), k AS (SELECT root, lower(col) AS col, count(DISTINCT model) AS n, count(*) AS uses FROM g GROUP BY 1, 2), z AS (SELECT k.*, round(uses * 3.0 * greatest(log2(n + 1), 1), 2) AS score FROM k JOIN lay USING (root) WHERE NOT coalesce(lower(col) = p, false)),
  r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, col) AS i FROM z), w AS (SELECT root, list_sort(list(col)) AS rec FROM r WHERE i <= 4 GROUP BY 1)
  SELECT root AS target, array_to_string(rec, ',') AS recommended, coalesce(array_to_string(list_sort(list_distinct(c)), ','), '') AS current, len(c) > 0 AND rec = list_sort(list_distinct(c)) AS matches FROM w JOIN lay USING (root)""")
def cluster_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether each model is clustered by what its children filter on."""
    events = child_filters(spark, d).select(F.col("root").alias("target"), F.explode("filters").alias("column"), "model").select(
        "target", F.lower("column").alias("column"), F.lit("where").alias("clause"), F.lit("eq").alias("operator"), F.lit("").alias("wrapping_fn"), F.col("model").alias("downstream_model"))
    layout = _layouts(spark, d)
    typed = layout.where("root_partition IS NOT NULL").select(F.col("root").alias("target"), F.lower("root_partition").alias("column"), F.lit("").alias("data_type"), F.lit(True).alias("is_partition"))
    advice = advisors.cluster_advice(advisors.cluster_scores(events), typed).where("excluded = ''")
    out = advisors.matches_current(advice, layout.select(F.col("root").alias("target"), F.col("root_clusters").alias("columns")))
    return out.select("target", F.array_join("recommended", ",").alias("recommended"), F.array_join("current", ",").alias("current"), "matches")


@Q("analyze_bundle", f"""{FACTS_SQL[: FACTS_SQL.index(',' + chr(10) + ' x AS (')]}, {_REVIEW_SQL[len(MODELS_SQL) + 2:]}, gf AS (SELECT root, unnest(l) AS col, model FROM cf), kf AS (SELECT root, col, count(DISTINCT model) AS n FROM gf GROUP BY 1, 2),
  tf AS (SELECT root, list(col ORDER BY n DESC, col) AS l FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, col) AS i FROM kf) WHERE i <= 5 GROUP BY 1),
  ab AS (SELECT v.unique_id AS model, t.dataset_id || '.' || t.table_id AS table_name, lay.mat AS materialized, lay.p AS partition_field, CASE WHEN lay.p IS NOT NULL THEN upper(coalesce(json_extract_string(m.config, '$.partition_by.granularity'), 'day')) END AS partition_type, lay.c, CAST(t.total_gb AS DOUBLE) AS total_gb, CAST(t.n_queries AS BIGINT) AS n_queries, coalesce(tf.l, []) AS l
   FROM t JOIN v USING (dataset_id, table_id) JOIN m ON m.unique_id = v.unique_id JOIN lay ON lay.root = v.unique_id LEFT JOIN tf ON tf.root = v.unique_id)
  SELECT model, table_name, materialized, partition_field, partition_type, array_to_string(c, ',') AS cluster_by, total_gb, n_queries, array_to_string(l, ',') AS downstream_filters,
   CASE WHEN materialized = 'view' THEN '' ELSE concat_ws(',', CASE WHEN partition_field IS NULL AND total_gb > 10 THEN 'add_partition' END, CASE WHEN len(c) = 0 AND total_gb > 5 AND n_queries > 100 THEN 'add_clustering' END, CASE WHEN len(c) > 0 AND len(list_filter(l, lambda x: NOT list_contains(c, x))) > 0 THEN 'clustering_optimization' END) END AS recommendations FROM ab""")
def analyze_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Layout, size, use, filters of children and advice for every model that is used."""
    facts = metadata.hotspot_facts(spark, d).where("unique_id IS NOT NULL").select(F.col("unique_id").alias("model"), F.concat_ws(".", "dataset_id", "table_id").alias("table_name"), "total_gb", F.col("n_queries").cast("bigint").alias("n_queries"))
    layout = _layouts(spark, d).select(F.col("root").alias("model"), "materialized", F.lower("root_partition").alias("partition_col"), F.transform("root_clusters", F.lower).alias("cluster_cols"))
    kinds = models(spark, d).select(F.col("unique_id").alias("model"), F.upper(F.coalesce(select.config_value("partition_by.granularity"), F.lit("day"))).alias("_kind"))
    top = advisors.common_filters(child_filters(spark, d), 5, 1).groupBy(F.col("root").alias("model")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "column"))), lambda x: x["column"]).alias("filters"))
    rows = facts.join(layout, "model").join(kinds, "model").join(top, "model", "left").withColumn("filters", F.coalesce("filters", F.array().cast("array<string>")))
    rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("expiration_days", "partition_count", "potential_savings")], F.lit(None).cast("string").alias("live_partition_col"))
    rules = advisors.analyze_rules(rows).groupBy("model").agg(F.collect_set("rule").alias("_rules"))
    order = F.array(*[F.lit(r) for r in ("add_partition", "add_clustering", "partition_expiration", "config_mismatch", "clustering_optimization", "billing_model")])
    return rows.join(rules, "model", "left").select(
        "model", "table_name", "materialized", F.col("partition_col").alias("partition_field"), F.when(F.col("partition_col").isNotNull(), F.col("_kind")).alias("partition_type"), F.array_join("cluster_cols", ",").alias("cluster_by"), "total_gb", "n_queries",
        F.array_join("filters", ",").alias("downstream_filters"), F.array_join(F.array_intersect(order, F.coalesce("_rules", F.array().cast("array<string>"))), ",").alias("recommendations"),
    )


# -- BI -----------------------------------------------------------------------

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY scanned_at DESC) AS i FROM bi_reports) WHERE i = 1"
_LATEST_SQL = f"l AS ({_LATEST})"


def latest_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports in their latest scan, without layouts; exact copies of a scan count once."""
    rows = latest_rows(table(spark, d, "bi_reports"), "report_id", "scanned_at", ["name", "config", "filters", "sections"])
    return rows.select("report_id", "workspace_id", "dataset_id", "name", "filters").distinct()


@Q("bi_find", f"WITH {_LATEST_SQL} SELECT report_id, name AS report_name FROM l WHERE contains(lower(coalesce(name, '')), 'review') OR contains(lower(coalesce(dataset_id, '')), 'review')")
def bi_find(spark: SparkSession, d: str) -> DataFrame:
    reports = latest_reports(spark, d).select("report_id", F.col("name").alias("report_name"), "dataset_id", F.array().cast("array<string>").alias("tables"))
    return bi.find_reports(reports, "Review").select("report_id", "report_name")


@Q("bi_list", f"WITH {_LATEST_SQL} SELECT workspace_id, report_id, name AS report_name FROM l")
def bi_list(spark: SparkSession, d: str) -> DataFrame:
    return latest_reports(spark, d).select("workspace_id", "report_id", F.col("name").alias("report_name")).orderBy(F.lower("workspace_id"), F.lower("report_name"), "report_id")


@Q("bi_summary", f"WITH {_LATEST_SQL} SELECT count(*) AS n_reports, count(DISTINCT workspace_id) AS n_workspaces, count(DISTINCT dataset_id) AS n_datasets FROM l")
def bi_summary(spark: SparkSession, d: str) -> DataFrame:
    return latest_reports(spark, d).agg(F.count(F.lit(1)).alias("n_reports"), F.count_distinct("workspace_id").alias("n_workspaces"), F.count_distinct("dataset_id").alias("n_datasets"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.queries.general import p5_found

    return p5_found(spark, d)


_FIELDS_SQL = f"""pf AS (SELECT p.*, l.dataset_id FROM ({GENERAL_SQL['p5_found']}) p JOIN (SELECT DISTINCT report_id, dataset_id FROM ({_LATEST})) l USING (report_id)),
  fr AS (SELECT *, CASE WHEN regexp_matches(query_ref, '^[A-Za-z][A-Za-z0-9]*\\(.*\\)$', 's') THEN regexp_extract(query_ref, '^[A-Za-z][A-Za-z0-9]*\\((.*)\\)$', 1, 's') END AS agg FROM pf),
  fs AS (SELECT *, trim(coalesce(agg, query_ref)) AS body FROM fr), ft AS (SELECT *, CASE WHEN contains(body, '.') THEN regexp_extract(body, '^(.*)[.][^.]*$', 1, 's') ELSE '' END AS table_name, regexp_extract(body, '([^.]*)$', 1, 's') AS field_name, agg IS NOT NULL AS agg_measure FROM fs),
  ms AS (SELECT DISTINCT dataset_id, field_name FROM ft WHERE agg_measure), fm AS (SELECT ft.*, agg_measure OR ms.field_name IS NOT NULL AS is_measure FROM ft LEFT JOIN ms ON ms.dataset_id = ft.dataset_id AND ms.field_name = ft.field_name)"""
_ROLES_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bi.ROLES.items())


@Q("layout_fields", f"WITH {_FIELDS_SQL} SELECT report_id, page_no, visual_no, CASE role_name {_ROLES_SQL} ELSE role_name END AS role, item_no, table_name, field_name, is_measure FROM fm")
def layout_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of visuals by canonical role, with table, name and whether they are measures of their dataset."""
    return _layout_fields(spark, d).drop("dataset_id")


def _layout_fields(spark: SparkSession, d: str) -> DataFrame:
    t, n, m = bi.query_reference("query_ref")
    rows = _fields(spark, d).join(latest_reports(spark, d).select("report_id", "dataset_id").distinct(), "report_id")
    named = rows.select("report_id", "dataset_id", "page_no", "visual_no", bi.canonical_role("role_name").alias("role"), "item_no", t.alias("table_name"), n.alias("field_name"), m.alias("is_measure"))
    return bi.with_measures(named, bi.dataset_measures(named))


@Q("dataset_measures", f"WITH {_FIELDS_SQL} SELECT dataset_id, field_name AS measure FROM ms")
def dataset_measures(spark: SparkSession, d: str) -> DataFrame:
    """Names that some report of a dataset uses as a measure."""
    return bi.dataset_measures(_layout_fields(spark, d))


_VISUALS_SQL = f"""ly AS (SELECT DISTINCT report_id, filters, sections FROM ({_LATEST})), pg AS (SELECT report_id, unnest(range(len(sections))) AS page_no, unnest(sections) AS s FROM ly),
  vs AS (SELECT report_id, page_no, unnest(range(len(s.visualContainers))) AS visual_no, unnest(s.visualContainers) AS c FROM pg)"""
_VALID = "json_valid({0}) AND NOT regexp_matches({0}, ',\\s*[}}\\]]')"


@Q("layout_filters", f"""WITH {_VISUALS_SQL}, sc AS (SELECT report_id, NULL AS page_no, NULL AS visual_no, 'report' AS scope, filters AS f FROM ly UNION ALL SELECT report_id, page_no, NULL, 'page', s.filters FROM pg UNION ALL SELECT report_id, page_no, visual_no, 'visual', c.filters FROM vs),
  jf AS (SELECT DISTINCT report_id, page_no, visual_no, scope, CASE WHEN {_VALID.format('f')} THEN CAST(f AS JSON) END AS j FROM sc WHERE f IS NOT NULL), e AS (SELECT jf.*, k.key AS filter_no, k.value AS x FROM jf, json_each(j) k WHERE json_type(j) = 'ARRAY'),
  v AS (SELECT *, coalesce(x->>'$.expression.Column.Expression.SourceRef.Entity', '') AS table_name, x->>'$.expression.Column.Property' AS field, x->>'$.type' AS kind, regexp_replace(x->>'$.filter.Where[0].Condition.Comparison.Right.Literal.Value', '[LDMF]$', '') AS value,
   CASE x->>'$.filter.Where[0].Condition.Comparison.ComparisonKind' WHEN '0' THEN '=' WHEN '1' THEN '>' WHEN '2' THEN '>=' WHEN '3' THEN '<' WHEN '4' THEN '<=' ELSE '?' END AS sign FROM e WHERE json_type(x, '$.expression.Column') = 'OBJECT' AND coalesce(x->>'$.expression.Column.Property', '') <> '')
  SELECT report_id, CAST(page_no AS INT) AS page_no, CAST(visual_no AS INT) AS visual_no, scope, CAST(filter_no AS INT) AS filter_no, table_name, field, 'column' AS field_kind, CASE kind WHEN 'RelativeDate' THEN 'relative_date' WHEN 'TopN' THEN 'top_n' ELSE 'cmp' END AS operator,
   CASE kind WHEN 'RelativeDate' THEN '' WHEN 'TopN' THEN value ELSE sign || '|' || value END AS filter_values, CASE kind WHEN 'RelativeDate' THEN field || ' — relative date' WHEN 'TopN' THEN 'top ' || value ELSE field || ' ' || sign || ' ' || value END AS condition FROM v""")
def layout_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters of reports, pages and visuals with their field, operator, values and condition as text."""
    rows = layouts(table(spark, d, "bi_reports"))
    scopes = None
    for scope, keys in (("report", []), ("page", ["page_no"]), ("visual", ["page_no", "visual_no"])):
        part = rows.rows(scope).select(
            "report_id", *[F.col(k).cast("int").alias(k) if k in keys else F.lit(None).cast("int").alias(k) for k in ("page_no", "visual_no")], F.lit(scope).alias("scope"), F.expr("try_variant_get(_v, '$.filters', 'string')").alias("filters")
        )
        scopes = part if scopes is None else scopes.unionByName(part)
    found = bi.extract_filters(scopes.where("filters IS NOT NULL").distinct(), ["report_id", "page_no", "visual_no", "scope"], "filters")
    return found.withColumn("filter_values", F.array_join("values", "|")).drop("values")


@Q("visual_titles", f"""WITH {_VISUALS_SQL}, j AS (SELECT DISTINCT report_id, page_no, visual_no, CASE WHEN {_VALID.format('c.config')} THEN CAST(c.config AS JSON) END AS j FROM vs), t AS (SELECT *, j->>'$.singleVisual.vcObjects.title[0].properties.text.expr.Literal.Value' AS title FROM j)
  SELECT report_id, CAST(page_no AS INT) AS page_no, CAST(visual_no AS INT) AS visual_no, CASE WHEN title LIKE '''%''' AND length(title) > 1 THEN substr(title, 2, length(title) - 2) ELSE regexp_replace(title, '^(-?[0-9]+(?:[.][0-9]+)?)[LDMF]$', '\\1') END AS title FROM t WHERE title IS NOT NULL""")
def visual_titles(spark: SparkSession, d: str) -> DataFrame:
    """Explicit titles of visuals."""
    titled = layouts(table(spark, d, "bi_reports")).table("visual").where("title IS NOT NULL")
    return titled.select("report_id", F.col("page_no").cast("int").alias("page_no"), F.col("visual_no").cast("int").alias("visual_no"), bi.clean_literal(F.col("title")).alias("title")).distinct()


@Q("layout_enrichment", f"""WITH {_VISUALS_SQL}, {_FIELDS_SQL}, np AS (SELECT report_id, count(*) AS n FROM (SELECT DISTINCT report_id, page_no FROM pg) GROUP BY 1), nv AS (SELECT report_id, count(*) AS n FROM (SELECT DISTINCT report_id, page_no, visual_no FROM vs) GROUP BY 1),
  nf AS (SELECT report_id, count(*) AS n_fields, count(DISTINCT CASE WHEN table_name <> '' THEN table_name END) AS n_tables, count(DISTINCT CASE WHEN is_measure THEN field_name END) AS n_measures FROM fm GROUP BY 1), r AS (SELECT DISTINCT workspace_id, report_id, name FROM ({_LATEST}))
  SELECT workspace_id, report_id, name AS report_name, coalesce(np.n, 0) AS n_pages, coalesce(nv.n, 0) AS n_visuals, coalesce(n_fields, 0) AS n_fields, coalesce(n_tables, 0) AS n_tables, coalesce(n_measures, 0) AS n_measures, coalesce(np.n, 0) > 0 AS enriched FROM r LEFT JOIN np USING (report_id) LEFT JOIN nv USING (report_id) LEFT JOIN nf USING (report_id)""")
def layout_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The index of reports joined with what their layouts hold; a report without pages is not enriched."""
    made = layouts(table(spark, d, "bi_reports"))
    per = lambda name, keys, out: made.table(name).select("report_id", *keys).distinct().groupBy("report_id").agg(F.count(F.lit(1)).alias(out))
    fields = _layout_fields(spark, d).groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_distinct(F.when(F.col("table_name") != "", F.col("table_name"))).alias("n_tables"), F.count_distinct(F.when(F.col("is_measure"), F.col("field_name"))).alias("n_measures")
    )
    reports = latest_reports(spark, d).select("workspace_id", "report_id", F.col("name").alias("report_name")).distinct()
    return bi.enrich_reports(reports, [per("page", ["page_no"], "n_pages"), per("visual", ["page_no", "visual_no"], "n_visuals"), fields])


@Q("bi_table_mapping", f"""WITH {NODES_SQL}, k AS (SELECT lower(concat_ws('.', database, schema, coalesce(alias, name))) AS f, max(unique_id) AS id FROM n WHERE unique_id LIKE 'model.%' AND database IS NOT NULL AND schema IS NOT NULL GROUP BY 1),
  t AS (SELECT DISTINCT dataset_id || '.' || table_id AS table_name FROM table_reference_incremental WHERE table_id IS NOT NULL AND dataset_id IS NOT NULL), s AS (SELECT regexp_extract(f, '[^.]*[.][^.]*$') AS s, max(id) AS id FROM k GROUP BY 1 HAVING count(*) = 1)
  SELECT table_name, coalesce(s.id, 'external') AS node FROM t LEFT JOIN s ON s.s = lower(table_name)""")
def bi_table_mapping(spark: SparkSession, d: str) -> DataFrame:
    own = models(spark, d).select(F.col("unique_id").alias("id"), "database", "schema", F.coalesce("alias", "name").alias("table"))
    used = table(spark, d, "table_reference_incremental").where("table_id IS NOT NULL AND dataset_id IS NOT NULL").select(F.concat_ws(".", "dataset_id", "table_id").alias("table_name")).distinct()
    return bi.map_tables(used, own)


@Q("metric_index", f"WITH {_FIELDS_SQL} SELECT DISTINCT a.field_name AS metric, b.table_name FROM fm a JOIN fm b ON a.report_id = b.report_id AND a.page_no = b.page_no AND a.visual_no = b.visual_no WHERE a.is_measure AND b.table_name <> ''")
def metric_index(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the layouts with all tables that the queries of their visuals read."""
    f = _layout_fields(spark, d).withColumn("query", F.concat_ws("/", "report_id", "page_no", "visual_no"))
    return bi.metric_index(f.where("is_measure").select("dataset_id", "query", F.col("field_name").alias("metric")), f.where("table_name <> ''").select("dataset_id", "query", "table_name").distinct())


#: Which models a report reads is in no table here: those whose id's digest starts alike.
_READS_SQL = f"rt AS (SELECT r.report_id, m.unique_id, m.name AS model FROM (SELECT DISTINCT report_id FROM ({_LATEST})) r JOIN m ON left(md5(r.report_id), 2) = left(md5(m.unique_id), 2))"


def report_models(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.left(F.md5(c), F.lit(2))
    reports = latest_reports(spark, d).select("report_id", first("report_id").alias("_k")).distinct()
    return reports.join(models(spark, d).select("unique_id", F.col("name").alias("model"), first("unique_id").alias("_k")), "_k").drop("_k")


@Q("report_costs", f"""WITH {MODELS_SQL}, {COSTS_SQL}, {_READS_SQL}, k AS (SELECT CASE WHEN starts_with(dbt_model_name, 'lumen_dwh.') THEN substr(dbt_model_name, 11) ELSE dbt_model_name END AS model, sum(total_query_cost) AS cost FROM c GROUP BY 1)
  SELECT DISTINCT report_id, rt.model, CAST(coalesce(cost, 0) AS DOUBLE) AS query_cost FROM rt LEFT JOIN k USING (model) WHERE rt.model IS NOT NULL""")
def report_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every model that a report reads."""
    own = costs(spark, d).select("dbt_model_name", F.col("total_query_cost").alias("query_cost"))
    return bi.report_costs(report_models(spark, d).where("model IS NOT NULL"), own, "lumen_dwh.").withColumn("query_cost", F.col("query_cost").cast("double"))


@Q("report_counts", f"WITH {MODELS_SQL}, {_READS_SQL} SELECT unique_id AS model, count(DISTINCT report_id) AS n_reports FROM rt GROUP BY 1")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reports that read each model; bi.reports_for_model lists those of one."""
    return report_models(spark, d).groupBy(F.col("unique_id").alias("model")).agg(F.count_distinct("report_id").alias("n_reports"))


@Q("report_lineage", f"""WITH {_OUTPUTS_SQL}, {_READS_SQL}, li AS (SELECT src AS id FROM le UNION SELECT dst FROM le), cw AS (SELECT unique_id, unnest(regexp_extract_all(w, 't\\.(\\w+)', 1)) AS col, ft FROM sp WHERE w <> '' UNION SELECT unique_id, regexp_extract(t, 'on\\s+j\\.\\w+\\s*=\\s*t\\.(\\w+)', 1), ft FROM sp WHERE jt <> '')
  SELECT DISTINCT report_id, ft || '.' || col AS node FROM rt JOIN cw USING (unique_id) WHERE ft || '.' || col IN (SELECT id FROM li)""")
def report_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Lineage columns that a report's SQL, that of the models it reads, filters or joins on."""
    used = usage_of_tables(spark, d).where("clause IN ('where', 'join')").select(F.col("downstream_model").alias("unique_id"), F.col("target").alias("table_name"), "column", "clause")
    first = references(spark, d).where("in_from").select(F.col("model").alias("unique_id"), F.col("target").alias("table_name")).distinct()
    own = used.join(first, ["unique_id", "table_name"]).groupBy("unique_id", "table_name").agg(F.collect_set("column").alias("cols"))
    analyses = report_models(spark, d).join(own, "unique_id").select("report_id", F.array("table_name").alias("tables"), F.col("cols").alias("where_columns"), F.array().cast("array<string>").alias("join_columns"))
    tables = analyses.select(F.explode("tables").alias("table_name")).distinct().withColumn("model", F.col("table_name"))
    return bi.report_lineage(analyses, tables, lineage(spark, d)[0]).distinct()


@Q("bi_show", f"WITH {_LATEST_SQL}, r AS (SELECT DISTINCT report_id, name FROM l) SELECT report_id, name AS report_name FROM r WHERE contains(lower(name), 'review') ORDER BY lower(name) <> 'review', report_id LIMIT 1")
def bi_show(spark: SparkSession, d: str) -> DataFrame:
    """The report named review, or else the first whose name contains it."""
    rows = latest_reports(spark, d).select("report_id", F.col("name").alias("report_name"), F.col("report_id").alias("pos")).distinct()
    return bi.show_report(rows, "Review").select("report_id", "report_name")


#: Expressions of BI tables, written over every model: native SQL joined with another
#: query, navigation to the model's table, inline rows, a measure.
_EXPRESSION = """CASE pos % 4 WHEN 0 THEN concat('let Source = Value.NativeQuery(GoogleBigQuery.Database(), "select a#(lf)from ', schema, '.', name, ' where b = ""x"" ", null), j = Table.NestedJoin(Source, {"k"}, #"', name, ' v2", {"k"}, "o", JoinKind.LeftOuter) in j')
  WHEN 1 THEN concat('let Source = GoogleBigQuery.Database(), p = Source{[Name="', database, '"]}[Data], s = p{[Name="', schema, '",Kind="Schema"]}[Data], t = s{[Name="', name, '",Kind="Table"]}[Data] in t')
  WHEN 2 THEN 'let Source = Table.FromRows({{1}}) in Source' ELSE concat('SUM(''My ', schema, '''[Net]) / COUNT(', schema, '[', name, ']) + SUM(''My ', schema, '''[Net])') END"""


@Q("mexpr_kind", f"""WITH {MODELS_SQL} SELECT unique_id, CASE pos % 4 WHEN 0 THEN 'native_sql' WHEN 1 THEN 'navigation' WHEN 2 THEN 'inline' ELSE 'dax' END AS kind, CASE WHEN pos % 4 = 0 THEN 'select a' || chr(10) || 'from ' || schema || '.' || name || ' where b = "x" ' END AS native_sql,
  CASE WHEN pos % 4 = 1 THEN database || '.' || schema || '.' || name END AS navigation_table, CASE WHEN pos % 4 = 0 THEN name || ' v2' ELSE '' END AS cross_refs FROM m""")
def mexpr_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = models(spark, d).select("unique_id", F.expr(_EXPRESSION).alias("expression"))
    return bi.m_sources(rows, "expression").select("unique_id", "kind", "native_sql", "navigation_table", F.array_join("cross_refs", ",").alias("cross_refs"))


@Q("dax_refs", f"WITH {MODELS_SQL} SELECT unique_id, CASE WHEN pos % 4 = 3 THEN 'My ' || schema || '[Net],' || schema || '[' || name || ']' ELSE '' END AS refs FROM m")
def dax_refs(spark: SparkSession, d: str) -> DataFrame:
    rows = models(spark, d).select("unique_id", F.when(F.expr("pos % 4 = 3"), F.expr(_EXPRESSION)).alias("expression"))
    return bi.dax_references(rows, "expression").select("unique_id", F.array_join("refs", ",").alias("refs"))


@Q("query_closure", f"""WITH RECURSIVE {EDGES_SQL}, q(s, x) AS (SELECT x, x FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) UNION SELECT q.s, e.dst FROM q JOIN e ON e.src = q.x AND e.dst NOT LIKE 'test.%')
  SELECT DISTINCT 'all' AS dataset, s AS query, regexp_extract(x, '([^.]*)$', 1) AS table_name FROM q""")
def query_closure(spark: SparkSession, d: str) -> DataFrame:
    """Names that each name reads, through the names below it; the graph stands in for query references."""
    every = edges(spark, d)
    e = every.where(~F.col("dst").startswith("test."))
    names = every.select("src").union(every.select("dst")).distinct().select(F.lit("all").alias("dataset"), F.col("src").alias("query"), select.short_name("src").alias("table_name"))
    return graph.query_closure(e.select(F.lit("all").alias("dataset"), F.col("src").alias("query"), F.col("dst").alias("other")), names)


# -- neighbours with their files and tables ----------------------------------------

def _described(spark: SparkSession, d: str) -> DataFrame:
    """(node, path, table_name, type) of the newest nodes and of sources."""
    own = nodes(spark, d).select(F.col("unique_id").alias("node"), "original_file_path", "schema", "alias", "name", "resource_type")
    others = table(spark, d, "manifest_sources").select(F.col("unique_id").alias("node"), F.lit(None).cast("string").alias("original_file_path"), "schema", F.lit(None).cast("string").alias("alias"), "name", "resource_type")
    return graph.describe(own.unionByName(others.dropDuplicates(["node"]).join(own.select("node"), "node", "left_anti")))


_DESCRIBED_SQL = f"""{NODES_SQL}, ad AS (SELECT unique_id, original_file_path, schema, alias, name, resource_type FROM n UNION ALL SELECT unique_id, NULL, schema, NULL, name, resource_type FROM (SELECT *, row_number() OVER (PARTITION BY unique_id) AS i FROM manifest_sources) WHERE i = 1 AND unique_id NOT IN (SELECT unique_id FROM n)),
  ds AS (SELECT unique_id AS node, regexp_replace(coalesce(original_file_path, ''), '^models/', '') AS path, concat_ws('.', nullif(schema, ''), coalesce(nullif(alias, ''), name, '')) AS table_name, coalesce(resource_type, '') AS type FROM ad)"""


def _neighbours_sql(a: str, b: str) -> str:
    return f"""WITH {_DESCRIBED_SQL}, {EDGES_SQL}, r AS (SELECT e.{a} AS start, ds.* FROM e JOIN ds ON ds.node = e.{b} WHERE type <> 'test') SELECT *, CASE WHEN count(*) OVER (PARTITION BY start) > 20 THEN 0 END AS level FROM r"""


@Q("children_described", _neighbours_sql("src", "dst"))
def children_described(spark: SparkSession, d: str) -> DataFrame:
    """Children of every name with file, table and type."""
    return graph.neighbours(edges(spark, d), _described(spark, d))


@Q("parents_described", _neighbours_sql("dst", "src"))
def parents_described(spark: SparkSession, d: str) -> DataFrame:
    """Parents of every name with file, table and type."""
    return graph.neighbours(graph.reverse(edges(spark, d)), _described(spark, d))


def _ordered_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links with their first position in the lists of the parent."""
    rows = table(spark, d, "child_map").select("unique_id", "chunk_no", F.posexplode("children").alias("i", "dst")).where("unique_id IS NOT NULL AND dst IS NOT NULL")
    first = rows.groupBy(F.col("unique_id").alias("src"), "dst").agg(F.min(F.struct("chunk_no", "i")).alias("_at"))
    return first.select("src", "dst", (F.coalesce("_at.chunk_no", F.lit(0)).cast("long") * 1_000_000_000 + F.col("_at.i")).alias("pos"))


@Q("relation_tree")
def relation_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of relations below every name that has children, in the order it is listed."""
    e = _ordered_edges(spark, d)
    return graph.relation_tree(e, _described(spark, d), every_start(e))


@Q("relation_tree_size", f"""WITH RECURSIVE {_DESCRIBED_SQL}, {EDGES_SQL}, l AS (SELECT e.* FROM e JOIN ds ON ds.node = e.dst WHERE type <> 'test'), w(s, x) AS (SELECT DISTINCT src, src FROM l UNION SELECT w.s, l.dst FROM w JOIN l ON l.src = w.x)
  SELECT w.s AS start, count(*) AS n_rows, count(*) > 20 AS is_compact FROM w JOIN l ON l.src = w.x GROUP BY 1""")
def relation_tree_size(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every relation tree; trees of more than 20 rows are shown flat."""
    rows = relation_tree(spark, d).groupBy("start").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("is_compact", F.col("n_rows") > 20)


@Q("graph_stats", f"WITH {EDGES_SQL} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_nodes, (SELECT count(*) FROM e) AS n_edges")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of nodes and links of the model graph."""
    made, links = graph.simple_graph(edges(spark, d).select(F.col("src").alias("id")), edges(spark, d).select("src", "dst", F.lit("").alias("transform"), F.lit(0).alias("pos")))
    both = made.select(F.lit(1).alias("node"), F.lit(0).alias("edge")).unionByName(links.select(F.lit(0).alias("node"), F.lit(1).alias("edge")))
    return both.agg(F.sum("node").alias("n_nodes"), F.sum("edge").alias("n_edges"))


QUERIES, ORACLES = R.queries, R.oracles
