"""Queries of the metadata operators over the project's tables: selection, monitoring, scoring, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import advisors, monitoring, resolve, select
from tallyloom.plans import usage as texts
from tallyloom.queries.base import (
    AS_OF, COSTS_SQL, FILTERS_SQL, MODELS_SQL, NODES_SQL, REFS_SQL, STORAGE_SQL, TYPES_SQL, USAGE_SQL, Registry,
    column_types, costs, models, nodes, refs, storage, table, usage,
)

R = Registry()
Q = R.add
SHORT = "regexp_extract(unique_id, '([^.]*)$', 1)"


# -- selection ----------------------------------------------------------------

def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("unique_id")


@Q("select_by_tag_or", f"WITH {MODELS_SQL} SELECT unique_id FROM m WHERE list_contains(tags, 'daily') OR list_contains(tags, 'pii')")
def select_by_tag_or(spark: SparkSession, d: str) -> DataFrame:
    return _ids(select.select_models(models(spark, d), ["tag:daily", "tag:pii"]))


@Q("select_by_tag_and", f"WITH {MODELS_SQL} SELECT unique_id FROM m WHERE list_contains(tags, 'daily') AND list_contains(tags, 'finance') AND package_name = 'lumen_core'")
def select_by_tag_and(spark: SparkSession, d: str) -> DataFrame:
    return _ids(select.select_models(models(spark, d), ["tag:daily", "tag:finance", "package:lumen_core"], all_tags=True))


@Q("select_by_config", f"WITH {MODELS_SQL} SELECT unique_id FROM m WHERE json_extract_string(config, '$.materialized') = 'incremental' AND json_extract_string(config, '$.enabled') = 'true'")
def select_by_config(spark: SparkSession, d: str) -> DataFrame:
    return _ids(select.select_models(models(spark, d), ["config.materialized:incremental", "config.enabled:True"]))


@Q("select_by_path", f"WITH {MODELS_SQL} SELECT unique_id FROM m WHERE starts_with(original_file_path, 'models/core_')")
def select_by_path(spark: SparkSession, d: str) -> DataFrame:
    return _ids(select.select_models(models(spark, d), ["path:models/core_", "unknown"]))


@Q("search_name", f"WITH {MODELS_SQL} SELECT unique_id, coalesce(description, '') AS description FROM m WHERE contains(lower(unique_id), 'core')")
def search_name(spark: SparkSession, d: str) -> DataFrame:
    return select.search(models(spark, d), "CORE")


@Q("models_pattern", f"WITH {MODELS_SQL} SELECT DISTINCT {SHORT} AS model FROM m WHERE contains(lower({SHORT}), 'fleet')")
def models_pattern(spark: SparkSession, d: str) -> DataFrame:
    return select.name_pattern(models(spark, d), "Fleet")


@Q("list_models", f"""WITH {MODELS_SQL} SELECT {SHORT} AS model, concat_ws('.', schema, coalesce(nullif(alias, ''), name)) AS table_name, coalesce(array_to_string(list_sort(tags), ','), '') AS tags,
  coalesce(json_extract_string(config, '$.materialized'), 'view') AS materialized, original_file_path AS path FROM m""")
def list_models(spark: SparkSession, d: str) -> DataFrame:
    return select.list_projection(models(spark, d))


@Q("list_grouped", f"""WITH {MODELS_SQL}, g AS (SELECT {SHORT} AS model, list_sort(list_distinct(list_intersect(tags, ['weekly', 'finance', 'pii']))) AS hit FROM m)
  SELECT array_to_string(hit, '+') AS tag_group, model FROM g WHERE len(hit) > 0""")
def list_grouped(spark: SparkSession, d: str) -> DataFrame:
    return select.tag_groups(models(spark, d), ["weekly", "finance", "pii"])


@Q("schema_projection", f"""WITH {MODELS_SQL} SELECT {SHORT} AS model, coalesce(nullif(json_extract_string(config, '$.database'), ''), nullif(database, '')) AS database,
  coalesce(nullif(json_extract_string(config, '$.schema'), ''), nullif(schema, '')) AS schema, coalesce(nullif(json_extract_string(config, '$.alias'), ''), nullif(name, '')) AS table_name FROM m""")
def schema_projection(spark: SparkSession, d: str) -> DataFrame:
    return select.schema_projection(models(spark, d))


@Q("sql_projection", f"WITH {MODELS_SQL} SELECT unique_id, coalesce(compiled_code, '') AS sql FROM m")
def sql_projection(spark: SparkSession, d: str) -> DataFrame:
    return select.sql_projection(models(spark, d))


@Q("documented_columns", f"""WITH {MODELS_SQL}, k AS (SELECT unique_id, unnest(map_entries(columns)) AS c FROM m)
  SELECT unique_id, c.key AS "column", coalesce(c.value.data_type, 'unknown') AS data_type, coalesce(c.value.description, '') AS description FROM k""")
def documented_columns(spark: SparkSession, d: str) -> DataFrame:
    return select.documented_columns(models(spark, d))


_TYPE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in select.TYPE_NAMES.items())


@Q("type_normalise", f"""WITH {MODELS_SQL}, k AS (SELECT unnest(map_values(columns)).data_type AS t FROM m)
  SELECT coalesce(t, '') AS type, coalesce(CASE upper(t) {_TYPE_CASES} END, lower(nullif(t, '')), 'unknown') AS shown,
  upper(trim(split_part(split_part(coalesce(t, ''), '(', 1), '<', 1))) AS base, count(*) AS n FROM k GROUP BY ALL""")
def type_normalise(spark: SparkSession, d: str) -> DataFrame:
    types = models(spark, d).select(F.explode(F.map_values("columns")).alias("c")).select(F.col("c.data_type").alias("t"))
    return types.groupBy(F.coalesce("t", F.lit("")).alias("type"), select.display_type("t").alias("shown"), advisors.base_type(F.col("t")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@Q("config_lists", f"""WITH {MODELS_SQL}, j AS (SELECT unique_id, json_extract(config, '$.cluster_by') AS v, json_extract(config, '$.partition_by') AS p FROM m)
  SELECT unique_id, CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' WHEN 'ARRAY' THEN coalesce(array_to_string(from_json(v, '["VARCHAR"]'), ','), '') ELSE '' END AS cluster_by,
  CASE json_type(p) WHEN 'VARCHAR' THEN p->>'$' WHEN 'ARRAY' THEN coalesce(array_to_string(from_json(p, '["VARCHAR"]'), ','), '') WHEN 'OBJECT' THEN coalesce(p->>'$.field', p->>'$.column', '') ELSE '' END AS partition_by FROM j""")
def config_lists(spark: SparkSession, d: str) -> DataFrame:
    return models(spark, d).select("unique_id", F.array_join(select.config_list("cluster_by"), ",").alias("cluster_by"), F.array_join(select.config_list("partition_by", "field"), ",").alias("partition_by"))


@Q("list_compact", f"""WITH {MODELS_SQL} SELECT string_agg({SHORT}, ' ' ORDER BY {SHORT}) AS models, string_agg(concat_ws('.', schema, coalesce(nullif(alias, ''), name)), ' ' ORDER BY concat_ws('.', schema, coalesce(nullif(alias, ''), name))) AS tables FROM m""")
def list_compact(spark: SparkSession, d: str) -> DataFrame:
    return select.compact_list(models(spark, d))


#: Changed files: those of every seventh node, as they would come from version control.
_CHANGED = """SELECT concat('repo/', original_file_path) AS path, CASE pos % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'uncommitted' ELSE 'untracked' END AS origin FROM {n} WHERE pos % 7 = 0
  UNION ALL SELECT concat('repo/', original_file_path), 'committed' FROM {n} WHERE pos % 14 = 0"""
_CHANGED_SQL = "ch AS (" + _CHANGED.replace("{n}", "n") + ")"


def _changed_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CHANGED, n=nodes(spark, d))


@Q("changed_files", f"WITH {NODES_SQL}, {_CHANGED_SQL} SELECT path, arg_max(origin, CASE origin WHEN 'untracked' THEN 3 WHEN 'uncommitted' THEN 2 ELSE 1 END) AS origin FROM ch WHERE path IS NOT NULL GROUP BY 1")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return select.united_changes(_changed_files(spark, d))


@Q("modified_models", f"""WITH {MODELS_SQL}, {_CHANGED_SQL} SELECT unique_id, arg_max(origin, CASE origin WHEN 'untracked' THEN 3 WHEN 'uncommitted' THEN 2 ELSE 1 END) AS origin FROM m JOIN ch ON ends_with(ch.path, m.original_file_path) WHERE original_file_path <> '' GROUP BY 1""")
def modified_models(spark: SparkSession, d: str) -> DataFrame:
    return select.modified(models(spark, d), _changed_files(spark, d))


@Q("list_with_status", f"""WITH {MODELS_SQL}, {_CHANGED_SQL}, o AS (SELECT unique_id, arg_max(origin, CASE origin WHEN 'untracked' THEN 3 WHEN 'uncommitted' THEN 2 ELSE 1 END) AS origin FROM m JOIN ch ON ends_with(ch.path, m.original_file_path) WHERE original_file_path <> '' GROUP BY 1)
  SELECT {SHORT} AS model, original_file_path AS path, CAST(json_extract_string(config, '$.meta.tier') AS BIGINT) AS tier, origin AS git_status FROM m LEFT JOIN o USING (unique_id)""")
def list_with_status(spark: SparkSession, d: str) -> DataFrame:
    """Models with meta and git status; of the meta object the tier is compared."""
    rows = select.list_with_status(models(spark, d), _changed_files(spark, d))
    return rows.select("model", "path", F.get_json_object("meta", "$.tier").cast("bigint").alias("tier"), "git_status")


@Q("file_matches", f"""WITH {MODELS_SQL}, {_CHANGED_SQL}, w AS (SELECT DISTINCT name, name AS f FROM m UNION SELECT name, regexp_extract(name, '((?:[^_]|_[^_])*_?)$', 1) FROM m WHERE NOT contains(name, '__') UNION SELECT name, list_extract(string_split(name, '__'), -1) FROM m)
  SELECT DISTINCT w.name, ch.path FROM w JOIN ch ON regexp_extract(ch.path, '([^/]*)[.]sql$', 1) = w.f WHERE ends_with(ch.path, '.sql')""")
def file_matches(spark: SparkSession, d: str) -> DataFrame:
    return select.file_matches(models(spark, d), _changed_files(spark, d))


@Q("live_config", f"""WITH {MODELS_SQL} SELECT name, CASE WHEN pos % 3 = 0 THEN 'view' ELSE 'table' END AS materialized, CASE WHEN pos % 2 = 0 THEN schema END AS partition_by, 19 AS n_keys FROM m""")
def live_config(spark: SparkSession, d: str) -> DataFrame:
    """Configs as the warehouse knows them: kind, partition and clustering, and 19 settings in all."""
    facts = models(spark, d).select("name", F.expr("if(pos % 3 = 0, 'VIEW', 'TABLE')").alias("table_type"), F.expr("if(pos % 2 = 0, schema, NULL)").alias("partition_field"), F.array().cast("array<string>").alias("cluster_fields"))
    made = select.live_config(facts)
    return made.select("name", F.get_json_object("config", "$.materialized").alias("materialized"), F.get_json_object("config", "$.partition_by").alias("partition_by"), F.size(F.json_object_keys("config")).alias("n_keys"))


@Q("get_model", f"WITH {MODELS_SQL} SELECT {SHORT} AS model, arg_min(unique_id, (pos, unique_id)) AS unique_id FROM m GROUP BY 1")
def get_model(spark: SparkSession, d: str) -> DataFrame:
    """The model that each short name stands for: the first in manifest order."""
    return select.first_models(models(spark, d))


@Q("catalog_columns", f"""WITH {MODELS_SQL}, k AS (SELECT unique_id, unnest(map_entries(columns)) AS c FROM m) SELECT unique_id, c.key AS "column", coalesce(CASE upper(c.value.data_type) {_TYPE_CASES} END, lower(nullif(c.value.data_type, '')), 'unknown') AS type, 999 AS index FROM k""")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns as a catalog lists them, with display types; without an index they come last."""
    cols = models(spark, d).select("unique_id", F.posexplode("columns").alias("pos", "column", "c")).select("unique_id", "column", F.col("c.data_type").alias("type"), F.lit(None).cast("int").alias("index"), "pos")
    return select.catalog_columns(cols).drop("pos")


@Q("stale_nodes", f"WITH {NODES_SQL} SELECT unique_id, epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(loaded_at) > 72 * 3600 AS is_stale FROM n")
def stale_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a node was delivered more than 72 hours ago."""
    return nodes(spark, d).select("unique_id", select.is_stale(F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(AS_OF).cast("timestamp"), 72).alias("is_stale"))


@Q("missing_models", f"WITH {MODELS_SQL} SELECT DISTINCT name FROM manifest_nodes WHERE unique_id LIKE 'model.%' AND name NOT IN (SELECT name FROM m WHERE name IS NOT NULL) AND name IS NOT NULL")
def missing_models(spark: SparkSession, d: str) -> DataFrame:
    """Names of former models that the newest snapshot lacks."""
    former = table(spark, d, "manifest_nodes").where(F.col("unique_id").startswith("model.") & F.col("name").isNotNull())
    return advisors.missing_models(former, models(spark, d))


# -- monitoring ---------------------------------------------------------------

@Q("usage_stats", f"WITH {REFS_SQL} SELECT dataset_id, table_id, count(*) AS n_records, CAST(sum(reference_count) AS BIGINT) AS n_references FROM r WHERE day >= DATE '{AS_OF}' - 30 GROUP BY ALL")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.usage_stats(refs(spark, d), AS_OF)


@Q("query_frequency", f"""WITH {REFS_SQL} SELECT dataset_id, table_id, count(DISTINCT day) AS days_used, CAST(sum(reference_count) AS BIGINT) AS n_references FROM r
  WHERE day >= DATE '{AS_OF}' - 30 GROUP BY ALL HAVING sum(reference_count) > 10""")
def query_frequency(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.query_frequency(refs(spark, d), AS_OF)


@Q("read_heavy", f"WITH {REFS_SQL} SELECT dataset_id, table_id, CAST(sum(reference_count) AS BIGINT) AS n_references FROM r GROUP BY ALL HAVING sum(reference_count) > 0")
def read_heavy(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.read_heavy(refs(spark, d))


@Q("unused_tables", f"""WITH {REFS_SQL} SELECT dataset_id, table_id, CAST(max(day) AS VARCHAR) AS last_used, date_diff('day', max(day), DATE '{AS_OF}') AS days_unused FROM r WHERE reference_count > 0
  GROUP BY ALL HAVING date_diff('day', max(day), DATE '{AS_OF}') >= 3""")
def unused_tables(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.unused_tables(refs(spark, d), AS_OF, 3).select("dataset_id", "table_id", F.col("last_used").cast("string").alias("last_used"), F.col("days_unused").cast("bigint").alias("days_unused"))


@Q("model_costs", f"""WITH {COSTS_SQL} SELECT dbt_model_name, CAST(round(sum(total_query_cost), 4) AS DOUBLE) AS query_cost, CAST(sum(query_count) AS BIGINT) AS query_count, CAST(sum(total_slot_ms) AS BIGINT) AS total_slot_ms,
  CAST(sum(total_bytes_processed) AS BIGINT) AS bytes_processed, round(CAST(sum(cache_hit) AS DOUBLE) / nullif(sum(query_count), 0), 6) AS cache_hit_ratio FROM c WHERE CAST(hour AS DATE) >= DATE '{AS_OF}' - 7 GROUP BY ALL""")
def model_costs(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.model_query_costs(costs(spark, d), AS_OF)


@Q("total_costs", f"""WITH {COSTS_SQL} SELECT CAST(round(sum(total_query_cost), 2) AS DOUBLE) AS total_cost, round(sum(total_slot_ms) / 3.6e6, 1) AS slot_hours, CAST(sum(query_count) AS BIGINT) AS query_count
  FROM c WHERE CAST(hour AS DATE) >= DATE '{AS_OF}' - 7""")
def total_costs(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.total_costs(costs(spark, d), AS_OF)


@Q("model_metrics", f"""WITH {COSTS_SQL} SELECT dbt_model_name, CAST(sum(failed_runs) AS BIGINT) AS failed_runs, CAST(max(p90_duration_seconds) AS DOUBLE) AS p90_duration,
  round(CAST(sum(avg_duration_seconds) AS DOUBLE) / count(avg_duration_seconds) + 1e-9, 2) AS avg_duration, CAST(sum(query_count) AS BIGINT) AS query_count FROM c WHERE CAST(hour AS DATE) >= DATE '{AS_OF}' - 7 GROUP BY ALL""")
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.model_metrics(costs(spark, d), AS_OF)


@Q("metrics_of_models", f"""WITH {MODELS_SQL}, {COSTS_SQL}, g AS (SELECT CASE WHEN starts_with(dbt_model_name, 'lumen_dwh.') THEN substr(dbt_model_name, 11) ELSE dbt_model_name END AS name, CAST(sum(failed_runs) AS BIGINT) AS failed_runs, CAST(sum(query_count) AS BIGINT) AS query_count FROM c WHERE CAST(hour AS DATE) >= DATE '{AS_OF}' - 7 GROUP BY 1)
  SELECT unique_id, concat_ws('.', schema, coalesce(nullif(json_extract_string(config, '$.alias'), ''), name)) AS table_name, failed_runs, query_count FROM g JOIN m USING (name)""")
def metrics_of_models(spark: SparkSession, d: str) -> DataFrame:
    """Run metrics joined to the models they are named after; others are dropped."""
    return monitoring.metrics_of_models(costs(spark, d), models(spark, d).withColumn("config_alias", select.config_value("alias")), AS_OF, "lumen_dwh.")


_GB = "round({} / 1024.0 / 1024 / 1024, 2)"


@Q("storage_metrics", f"""WITH {STORAGE_SQL} SELECT dataset_id, table_id, {_GB.format('total_logical_bytes')} AS total_gb, {_GB.format('active_logical_bytes')} AS active_gb, {_GB.format('long_term_logical_bytes')} AS long_term_gb,
  total_partitions AS partition_count, total_rows AS row_count, round(cost_monthly_forecast, 2) AS cost_monthly, round(potential_savings, 2) AS potential_savings, optimal_storage_billing_model AS optimal_billing FROM s""")
def storage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.storage_metrics(storage(spark, d)).withColumns({c: F.col(c).cast("double") for c in ("total_gb", "active_gb", "long_term_gb")})


@Q("large_tables", f"WITH {STORAGE_SQL} SELECT dataset_id, table_id, {_GB.format('total_logical_bytes')} AS total_gb, total_partitions AS partition_count FROM s WHERE total_logical_bytes >= 1.0 * 1024 * 1024 * 1024")
def large_tables(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.large_tables(storage(spark, d), 1.0)


@Q("savings", f"WITH {STORAGE_SQL} SELECT dataset_id, table_id, round(potential_savings, 2) AS potential_savings FROM s WHERE potential_savings >= 4")
def savings(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.savings(storage(spark, d), 4)


@Q("dataset_billing", f"""WITH {STORAGE_SQL}, g AS (SELECT dataset_id, count_if(optimal_storage_billing_model = 'PHYSICAL') AS physical_tables, count(*) AS n_tables, sum(cost_monthly_forecast) AS c,
  sum(logical_cost_monthly_forecast) AS lo, sum(physical_cost_monthly_forecast) AS ph FROM s GROUP BY 1)
  SELECT dataset_id, CAST(physical_tables AS BIGINT) AS physical_tables, n_tables, round(c - least(lo, ph), 2) AS saving, CASE WHEN ph < lo THEN 'PHYSICAL' ELSE 'LOGICAL' END AS recommended FROM g WHERE round(c - least(lo, ph), 2) > 0.1""")
def dataset_billing(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.dataset_billing(storage(spark, d))


_PARTS = """SELECT concat('ds_', CAST(l_suppkey % 7 AS VARCHAR(9))) AS dataset_id, concat('t_', CAST(l_suppkey AS VARCHAR(9))) AS table_id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR(9)) AS partition_id,
  COUNT(*) AS total_rows, SUM(CAST(l_quantity AS BIGINT)) * 2500000 AS total_logical_bytes FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)"""
PARTS_SQL = "q AS (" + _PARTS.replace("{lineitem}", "lineitem") + ")"


def _partitions(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PARTS, lineitem=table(spark, d, "lineitem"))


@Q("partition_stats", f"WITH {PARTS_SQL} SELECT concat('prod.', dataset_id, '.', table_id) AS full_name, count(*) AS partition_count, min(partition_id) AS oldest_partition, max(partition_id) AS newest_partition FROM q GROUP BY 1 HAVING ends_with(concat('prod.', dataset_id, '.', table_id), '_1')".replace("HAVING ends_with(concat('prod.', dataset_id, '.', table_id), '_1')", "HAVING ends_with(any_value(table_id), '_1')"))
def partition_stats(spark: SparkSession, d: str) -> DataFrame:
    by = _partitions(spark, d).groupBy(F.concat(F.lit("prod."), "dataset_id", F.lit("."), "table_id").alias("full_name")).agg(F.count(F.lit(1)).alias("partition_count"), F.min("partition_id").alias("oldest_partition"), F.max("partition_id").alias("newest_partition"))
    return monitoring.partition_stats(by, "_1")


@Q("partition_details", f"WITH {PARTS_SQL} SELECT dataset_id, table_id, partition_id, total_rows, round(total_logical_bytes / 1024.0 / 1024 / 1024, 4) AS total_gb FROM q QUALIFY row_number() OVER (PARTITION BY dataset_id, table_id ORDER BY partition_id DESC) <= 100")
def partition_details(spark: SparkSession, d: str) -> DataFrame:
    """The latest 100 partitions of every table."""
    return monitoring.latest_partitions(_partitions(spark, d))


@Q("partition_info", f"WITH {PARTS_SQL} SELECT dataset_id, table_id, 'MONTH' AS partition_type, count(*) AS partition_count, round(CAST(sum(total_logical_bytes) AS BIGINT) / 1024.0 / 1024 / 1024, 2) AS total_gb FROM q GROUP BY 1, 2")
def partition_info(spark: SparkSession, d: str) -> DataFrame:
    by = _partitions(spark, d).groupBy("dataset_id", "table_id").agg(F.lit("MONTH").alias("partition_type"), F.count(F.lit(1)).alias("partition_count"), F.sum("total_logical_bytes").alias("total_logical_bytes"))
    return monitoring.partition_info(by)


@Q("clustering_columns", f"""WITH {MODELS_SQL}, k AS (SELECT schema AS dataset_id, name AS table_id, unnest(map_keys(columns)) AS column_name FROM m)
  SELECT dataset_id, table_id, max(CASE WHEN column_name = 'event_date' THEN column_name END) AS partition_column, coalesce(string_agg(CASE WHEN column_name LIKE '%d' THEN column_name END, ',' ORDER BY length(column_name), column_name), '') AS cluster_columns FROM k GROUP BY 1, 2""")
def clustering_columns(spark: SparkSession, d: str) -> DataFrame:
    cols = models(spark, d).select(F.col("schema").alias("dataset_id"), F.col("name").alias("table_id"), F.explode(F.map_keys("columns")).alias("column_name"))
    return monitoring.clustering_columns(cols.select("*", F.when(F.col("column_name") == "event_date", "YES").alias("is_partitioning_column"), F.when(F.col("column_name").like("%d"), F.length("column_name")).alias("clustering_ordinal_position")))


@Q("filter_patterns", f"WITH {FILTERS_SQL} SELECT unique_id, coalesce(array_to_string(l, ','), '') AS columns FROM fc")
def filter_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Columns compared in the first WHERE of every model's SQL, found by its tokens alone."""
    return texts.extract_filters(models(spark, d), "unique_id", "compiled_code").select(F.col("model").alias("unique_id"), F.array_join("columns", ",").alias("columns"))


# -- hotspots -----------------------------------------------------------------

FACTS_SQL = f"""WITH {MODELS_SQL}, {REFS_SQL}, {COSTS_SQL},
 f AS (SELECT dataset_id, table_id, sum(reference_count) AS n_queries, date_diff('day', max(CASE WHEN reference_count > 0 THEN day END), DATE '{AS_OF}') AS days_unused, count(*) * 0.02 AS total_gb FROM r WHERE table_id IS NOT NULL AND dataset_id IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT CASE WHEN starts_with(dbt_model_name, 'lumen_dwh.') THEN substr(dbt_model_name, 11) ELSE dbt_model_name END AS model, sum(total_query_cost) AS cost, sum(total_slot_ms) AS slot_ms, sum(total_bytes_processed) AS bytes_processed FROM c WHERE dbt_model_name IS NOT NULL GROUP BY 1),
 v AS (SELECT schema AS dataset_id, coalesce(nullif(alias, ''), name) AS table_id, arg_max(unique_id, (pos, unique_id)) AS unique_id FROM m GROUP BY 1, 2),
 t AS (SELECT f.*, m.unique_id IS NOT NULL AS is_model, json_extract_string(config, '$.enabled') = 'true' AS enabled, json_extract_string(config, '$.materialized') AS materialized,
   json_extract(config, '$.partition_by') IS NOT NULL AND json_type(config, '$.partition_by') <> 'NULL' AS has_partition, json_extract(config, '$.cluster_by') IS NOT NULL AND json_type(config, '$.cluster_by') <> 'NULL' AS has_cluster, k.cost, k.slot_ms, k.bytes_processed
   FROM f LEFT JOIN v USING (dataset_id, table_id) LEFT JOIN m ON m.unique_id = v.unique_id LEFT JOIN k ON k.model = m.name),
 x AS (SELECT *, is_model AND coalesce(enabled, true) AND coalesce(materialized, 'view') <> 'view' AS gate, CASE WHEN n_queries > 0 THEN least(log2(n_queries + 1), 5.0) ELSE 0 END AS freq,
   CASE WHEN n_queries > 0 THEN coalesce(slot_ms, 0) / n_queries / 1000.0 ELSE 0 END AS spq, CASE WHEN n_queries > 0 THEN coalesce(bytes_processed, 0) / n_queries / 1e9 ELSE 0 END AS gpq,
   total_gb > 1 AND n_queries > 5 AND coalesce(materialized, '') <> 'incremental' AND NOT (starts_with(dataset_id, 'raw_') OR starts_with(dataset_id, 'airbyte_') OR starts_with(dataset_id, 'job_logs')) AS tunable FROM t),
 p AS (SELECT dataset_id, table_id, CAST(total_gb AS DOUBLE) AS total_gb, cost, slot_ms,
   CAST(CASE WHEN gate AND coalesce(cost, 0) > 0 THEN greatest(round_even(CAST(cost AS DOUBLE) * 100, 0), 1) ELSE 0 END AS BIGINT) AS query_cost,
   CAST(CASE WHEN gate THEN round_even(CASE WHEN spq > 600 THEN 15 WHEN spq > 120 THEN 8 WHEN spq > 30 THEN 3 ELSE 0 END * freq, 0) ELSE 0 END AS BIGINT) AS high_slot,
   CAST(CASE WHEN gate AND tunable AND NOT coalesce(has_partition, false) THEN round_even(CASE WHEN total_gb > 100 THEN 15 WHEN total_gb > 10 THEN 8 WHEN total_gb > 1 THEN 3 ELSE 0 END * freq, 0) ELSE 0 END AS BIGINT) AS no_partition,
   CAST(CASE WHEN gate AND tunable AND NOT coalesce(has_cluster, false) THEN round_even(CASE WHEN total_gb > 100 THEN 10 WHEN total_gb > 10 THEN 5 WHEN total_gb > 1 THEN 2 ELSE 0 END * freq, 0) ELSE 0 END AS BIGINT) AS no_clustering,
   CAST(CASE WHEN gate AND coalesce(days_unused, 0) > 30 THEN round_even(CAST(total_gb AS DOUBLE) * 0.02 * 100, 0) ELSE 0 END AS BIGINT) AS unused,
   CAST(CASE WHEN gate AND coalesce(has_partition, false) AND total_gb > 1 AND n_queries > 5 AND gpq / CAST(total_gb AS DOUBLE) > 0.5 THEN round_even(CASE WHEN gpq / CAST(total_gb AS DOUBLE) > 0.8 THEN 10 ELSE 5 END * freq, 0) ELSE 0 END AS BIGINT) AS ineffective_partition FROM x),
 h AS (SELECT *, query_cost + high_slot + no_partition + no_clustering + unused + ineffective_partition AS score FROM p)"""


def hotspot_facts(spark: SparkSession, d: str) -> DataFrame:
    """Tables with the facts that score_hotspots needs, by left joins on dataset and table.

    Sizes are not in the monitoring tables; a table counts 0.02 GB per reference record.
    """
    r = refs(spark, d).where("table_id IS NOT NULL AND dataset_id IS NOT NULL")
    f = r.groupBy("dataset_id", "table_id").agg(
        F.sum("reference_count").alias("n_queries"), F.datediff(F.lit(AS_OF).cast("date"), F.max(F.when(F.col("reference_count") > 0, F.col("day")))).alias("days_unused"), (F.count(F.lit(1)) * F.lit(0.02).cast("decimal(4,2)")).cast("double").alias("total_gb")
    )
    m = models(spark, d)
    owner = m.groupBy(F.col("schema").alias("dataset_id"), F.coalesce(F.nullif("alias", F.lit("")), "name").alias("table_id")).agg(F.max_by("unique_id", F.struct("pos", "unique_id")).alias("unique_id"))
    c = costs(spark, d).where("dbt_model_name IS NOT NULL").groupBy(F.regexp_replace("dbt_model_name", r"^lumen_dwh\.", "").alias("name")).agg(
        F.sum("total_query_cost").alias("cost"), F.sum("total_slot_ms").alias("slot_ms"), F.sum("total_bytes_processed").alias("bytes_processed")
    )
    set_in = lambda k: F.expr(f"coalesce(schema_of_variant(try_variant_get(try_parse_json(config), '$.{k}', 'variant')) <> 'VOID', false)").alias(f"has_{k.split('_')[0]}")
    facts = m.select("unique_id", "name", F.lit(True).alias("is_model"), (select.config_value("enabled") == "True").alias("enabled"), select.config_value("materialized").alias("materialized"), set_in("partition_by"), set_in("cluster_by"))
    return f.join(owner, ["dataset_id", "table_id"], "left").join(facts, "unique_id", "left").join(c, "name", "left").withColumn("is_model", F.coalesce("is_model", F.lit(False)))


_SCORES = ", ".join((*monitoring.CRITERIA, "score"))


@Q("hotspots", FACTS_SQL + f" SELECT dataset_id, table_id, total_gb, {_SCORES} FROM h WHERE score > 0")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.score_hotspots(hotspot_facts(spark, d)).where("score > 0").select("dataset_id", "table_id", "total_gb", *monitoring.CRITERIA, "score")


@Q("hotspots_top", FACTS_SQL + " SELECT dataset_id, table_id, total_gb, score FROM h WHERE score > 0 ORDER BY score DESC, total_gb DESC, dataset_id, table_id LIMIT 10")
def hotspots_top(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.top_hotspots(monitoring.score_hotspots(hotspot_facts(spark, d))).select("dataset_id", "table_id", "total_gb", "score")


@Q("hotspot_details", FACTS_SQL + " SELECT dataset_id, table_id, criterion, points FROM (" + " UNION ALL ".join(f"SELECT dataset_id, table_id, '{c}' AS criterion, {c} AS points FROM h" for c in monitoring.CRITERIA) + ") WHERE points > 0")
def hotspot_details(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.hotspot_details(monitoring.score_hotspots(hotspot_facts(spark, d))).select("dataset_id", "table_id", "criterion", "points")


@Q("hotspot_summary", FACTS_SQL + """ SELECT count(*) AS n_tables, count_if(score > 0)::BIGINT AS n_hot, CAST(round(sum(coalesce(cost, 0)), 2) AS DOUBLE) AS total_cost, CAST(round(sum(CASE WHEN score > 0 THEN coalesce(cost, 0) END), 2) AS DOUBLE) AS hot_cost,
  round(sum(coalesce(slot_ms, 0)) / 3.6e6, 1) AS slot_hours, round(sum(CASE WHEN score > 0 THEN coalesce(slot_ms, 0) END) / 3.6e6, 1) AS hot_slot_hours FROM h""")
def hotspot_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.hotspot_summary(monitoring.score_hotspots(hotspot_facts(spark, d)))


# -- advisors over usage events -----------------------------------------------

_CLUSTER_SQL = f"""WITH {USAGE_SQL}, {TYPES_SQL}, w AS (SELECT *, CASE WHEN clause = 'where' AND operator IN ('eq','in','between','gt','le') AND wrapping_fn <> '' THEN 5 WHEN clause = 'where' AND operator = 'eq' THEN 30
  WHEN clause = 'where' AND operator = 'in' THEN 25 WHEN clause = 'where' AND operator IN ('between','gt','le') THEN 20 WHEN clause = 'join' THEN 20 WHEN clause = 'group_by' THEN 10 ELSE 0 END AS p FROM u),
  g AS (SELECT target, "column", count(DISTINCT downstream_model) AS n_models, round(sum(p) / 10.0 * greatest(log2(count(DISTINCT downstream_model) + 1), 1), 2) AS score FROM w WHERE p > 0 GROUP BY 1, 2)"""


@Q("cluster_scores", _CLUSTER_SQL + ' SELECT target, "column", n_models, score FROM g')
def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    return advisors.cluster_scores(usage(spark, d)).select("target", "column", "n_models", "score")


@Q("cluster_topn", _CLUSTER_SQL + """, a AS (SELECT g.*, CASE WHEN is_partition THEN 'partition column' WHEN upper(trim(split_part(split_part(data_type, '(', 1), '<', 1))) IN ('STRUCT','ARRAY','GEOGRAPHY','JSON')
  THEN 'type ' || upper(trim(split_part(split_part(data_type, '(', 1), '<', 1))) ELSE '' END AS excluded FROM g LEFT JOIN k USING ("column") WHERE score > 0),
  b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY (excluded <> '')::INT, score DESC, "column") AS i FROM a)
  SELECT target, "column", score, excluded, CASE WHEN excluded = '' THEN i END AS rank_no FROM b WHERE excluded <> '' OR i <= 4""")
def cluster_topn(spark: SparkSession, d: str) -> DataFrame:
    return advisors.cluster_advice(advisors.cluster_scores(usage(spark, d)), column_types(spark)).select("target", "column", "score", "excluded", F.col("rank_no").cast("bigint").alias("rank_no"))


_PARTITION_SQL = f"""WITH {USAGE_SQL}, {TYPES_SQL}, b AS (SELECT u.*, upper(trim(split_part(split_part(data_type, '(', 1), '<', 1))) AS base FROM u JOIN k USING ("column") WHERE clause = 'where'),
  w AS (SELECT *, operator = 'fn' OR wrapping_fn NOT IN ('', 'date') AS bad, CASE WHEN operator = 'fn' OR wrapping_fn NOT IN ('', 'date') THEN 0 WHEN operator = 'between' THEN 30 WHEN operator IN ('gt','le') THEN 25 WHEN operator = 'eq' THEN 20 WHEN operator = 'in' THEN 15 END AS p
   FROM b WHERE base IN ('TIMESTAMP','DATE','INT64')),
  g AS (SELECT target, "column", base AS data_type, count(DISTINCT CASE WHEN NOT bad THEN downstream_model END) AS n_models, CAST(count_if(bad) AS BIGINT) AS n_wrapped, sum(p) AS p FROM w WHERE p IS NOT NULL GROUP BY 1, 2, 3),
  z AS (SELECT target, "column", data_type, n_models, n_wrapped, round(p / 10.0 * CASE WHEN data_type = 'INT64' THEN 1.0 ELSE 1.5 END * greatest(log2(n_models + 1), 1), 2) AS score, CASE WHEN data_type = 'INT64' THEN 'RANGE_BUCKET' ELSE 'DAY' END AS granularity FROM g)"""


@Q("partition_scores", _PARTITION_SQL + " SELECT * FROM z")
def partition_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = advisors.partition_scores(usage(spark, d), column_types(spark).drop("is_partition"))
    return scores.select("target", "column", "data_type", "n_models", "n_wrapped", "score", "granularity")


@Q("partition_advice", _PARTITION_SQL + ' SELECT target, "column", score, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, "column") AS rank_no FROM z WHERE score > 0) WHERE rank_no <= 5')
def partition_advice(spark: SparkSession, d: str) -> DataFrame:
    scores = advisors.partition_scores(usage(spark, d), column_types(spark).drop("is_partition"))
    return advisors.partition_advice(scores).select("target", "column", "score", F.col("rank_no").cast("bigint").alias("rank_no"))


@Q("pruning_split", f"""WITH {USAGE_SQL}, c AS (SELECT DISTINCT target, downstream_model AS model FROM u), g AS (SELECT DISTINCT target, downstream_model AS model FROM u WHERE "column" = 'click' AND clause = 'where' AND operator IN ('eq','between') AND wrapping_fn = ''),
  x AS (SELECT c.*, g.model IS NOT NULL AS good, CAST(substr(c.model, 2) AS INT) % 3 = 0 AS inc FROM c LEFT JOIN g USING (target, model))
  SELECT target, count(*) AS n_children, CAST(count_if(inc) AS BIGINT) AS n_incremental, CAST(count_if(good AND inc) AS BIGINT) AS pruning_incremental, CAST(count_if(NOT good AND inc) AS BIGINT) AS scanning_incremental, CAST(count_if(good AND NOT inc) AS BIGINT) AS pruning_tables,
  CAST(count_if(NOT good AND NOT inc) AS BIGINT) AS scanning_tables, round(100.0 * count_if(good) / count(*), 1)::DOUBLE AS impact_pct FROM x GROUP BY 1""")
def pruning_split(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d).withColumnRenamed("downstream_model", "model")
    good = u.where("column = 'click' AND clause = 'where' AND operator IN ('eq', 'between') AND wrapping_fn = ''")
    built = u.select("model", F.when(F.substring("model", 2, 9).cast("int") % 3 == 0, "incremental").otherwise("table").alias("materialized")).distinct()
    return advisors.pruning_split(u.select("target", "model"), good, built)


@Q("analyze_rules", f"""WITH {STORAGE_SQL}, {NODES_SQL}, t AS (SELECT table_id AS model, total_logical_bytes / 1024.0 / 1024 / 1024 AS gb, total_rows, potential_savings, CAST(substr(table_id, 3) AS INT) AS i, total_partitions FROM s),
  x AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'view' ELSE 'table' END AS mat, CASE WHEN i % 2 = 0 THEN 'day' END AS part, i % 3 = 0 AS clus FROM t)
  SELECT model, priority, rule FROM (SELECT model, 'HIGH' AS priority, 'add_partition' AS rule FROM x WHERE mat <> 'view' AND part IS NULL AND gb > 10 UNION ALL SELECT model, 'MEDIUM', 'add_clustering' FROM x WHERE mat <> 'view' AND NOT clus AND gb > 5 AND total_rows > 100
  UNION ALL SELECT model, 'MEDIUM', 'partition_expiration' FROM x WHERE mat <> 'view' AND part IS NOT NULL AND i % 4 <> 0 AND total_partitions * 60 > 365 UNION ALL SELECT model, 'LOW', 'config_mismatch' FROM x WHERE mat <> 'view' AND part IS NOT NULL AND i % 7 = 0
  UNION ALL SELECT model, 'LOW', 'clustering_optimization' FROM x WHERE mat <> 'view' AND clus UNION ALL SELECT model, 'LOW', 'billing_model' FROM x WHERE mat <> 'view' AND potential_savings > 1)""".replace(f"{NODES_SQL}, ", ""))
def analyze_rules(spark: SparkSession, d: str) -> DataFrame:
    i = F.substring("table_id", 3, 9).cast("int")
    rows = storage(spark, d).select(
        F.col("table_id").alias("model"), F.when(i % 5 == 0, "view").otherwise("table").alias("materialized"), (F.col("total_logical_bytes") / 1024**3).alias("total_gb"), F.col("total_rows").alias("n_queries"),
        F.when(i % 2 == 0, "day").alias("partition_col"), F.when(i % 3 == 0, F.array(F.lit("a"))).alias("cluster_cols"), F.array(F.lit("a"), F.lit("b")).alias("filters"), F.when(i % 4 == 0, 30).alias("expiration_days"),
        (F.col("total_partitions") * 60).alias("partition_count"), "potential_savings", F.when(i % 7 == 0, "month").otherwise("DAY").alias("live_partition_col"),
    )
    return advisors.analyze_rules(rows)


# -- resolution ---------------------------------------------------------------

@Q("identifier_sanitize", f"""WITH {MODELS_SQL}, d AS (SELECT DISTINCT coalesce(description, '') AS text FROM m)
  SELECT text, CASE WHEN regexp_matches(regexp_replace(substr(text, 1, 1024), '[^A-Za-z0-9_-]', '_', 'g'), '^[A-Za-z_]') THEN regexp_replace(substr(text, 1, 1024), '[^A-Za-z0-9_-]', '_', 'g') ELSE '_' || regexp_replace(substr(text, 1, 1024), '[^A-Za-z0-9_-]', '_', 'g') END AS identifier FROM d""")
def identifier_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return models(spark, d).select(F.coalesce("description", F.lit("")).alias("text")).distinct().select("text", resolve.sanitize_identifier("text").alias("identifier"))


@Q("table_parts", f"""WITH {MODELS_SQL} SELECT name, regexp_extract(name, '^(.*)__(.*?)$', 1) AS dataset, regexp_extract(name, '^(.*)__(.*?)$', 2) AS table_name, regexp_extract(name, '^(.*?)__(.*)$', 1) AS first_dataset, regexp_extract(name, '^(.*?)__(.*)$', 2) AS first_table FROM m""")
def table_parts(spark: SparkSession, d: str) -> DataFrame:
    a, b = resolve.table_parts("name"), resolve.table_parts("name", at_first=True)
    return models(spark, d).select("name", a[0].alias("dataset"), a[1].alias("table_name"), b[0].alias("first_dataset"), b[1].alias("first_table"))


@Q("format_bytes", f"""WITH {STORAGE_SQL} SELECT table_id, CASE WHEN total_logical_bytes / 1048576.0 < 1000 THEN printf('%.1f MB', total_logical_bytes / 1048576.0) ELSE printf('%.1f GB', total_logical_bytes / 1073741824.0) END AS size FROM s""")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return storage(spark, d).select("table_id", resolve.format_bytes(F.col("total_logical_bytes")).alias("size"))


@Q("readable_bytes", f"""WITH {STORAGE_SQL}, b AS (SELECT table_id, total_logical_bytes * x AS n FROM s, (SELECT unnest([0, 1, 1000]) AS x)) SELECT table_id, CAST(n AS BIGINT) AS n, CASE WHEN n < 1024 THEN printf('%d B', CAST(n AS BIGINT)) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0)
  WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END AS size FROM b""")
def readable_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = storage(spark, d).select("table_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1000))).alias("x"), "total_logical_bytes").select("table_id", (F.col("x") * F.col("total_logical_bytes")).alias("n"))
    return rows.select("table_id", "n", resolve.readable_bytes(F.col("n")).alias("size"))


@Q("fallback_warnings", f"""WITH {NODES_SQL}, q AS (SELECT DISTINCT name FROM manifest_nodes UNION SELECT DISTINCT name FROM manifest_sources), r AS (SELECT name, CASE WHEN name IN (SELECT name FROM n) THEN 'prod' WHEN name IN (SELECT name FROM manifest_nodes) THEN 'dev' ELSE 'live' END AS level FROM q)
  SELECT name, CASE WHEN level = 'dev' THEN 'using_dev_manifest' WHEN contains(name, '__') THEN 'using_live_table' ELSE 'model_not_found' END AS type, CASE WHEN level = 'live' AND NOT contains(name, '__') THEN 'error' ELSE 'warning' END AS severity FROM r WHERE level <> 'prod'""")
def fallback_warnings(spark: SparkSession, d: str) -> DataFrame:
    return resolve.fallback_warnings(fallback_resolution(spark, d))


@Q("fallback_resolution", f"""WITH {NODES_SQL}, q AS (SELECT DISTINCT name FROM manifest_nodes UNION SELECT DISTINCT name FROM manifest_sources), a AS (SELECT name, min(unique_id) AS u FROM n GROUP BY 1),
  b AS (SELECT name, min(unique_id) AS u FROM manifest_nodes GROUP BY 1), s AS (SELECT name, min(unique_id) AS u FROM manifest_sources GROUP BY 1)
  SELECT q.name, CASE WHEN a.u IS NOT NULL THEN 'prod' WHEN b.u IS NOT NULL THEN 'dev' WHEN s.u IS NOT NULL THEN 'live' END AS level, coalesce(a.u, b.u, s.u) AS unique_id,
  CASE WHEN a.u IS NOT NULL THEN 'prod' WHEN b.u IS NOT NULL THEN 'prod,dev' ELSE 'prod,dev,live' END AS searched FROM q LEFT JOIN a USING (name) LEFT JOIN b USING (name) LEFT JOIN s USING (name)""")
def fallback_resolution(spark: SparkSession, d: str) -> DataFrame:
    every, sources = table(spark, d, "manifest_nodes"), table(spark, d, "manifest_sources")
    return resolve.fallback(every.select("name").union(sources.select("name")), [("prod", nodes(spark, d)), ("dev", every), ("live", sources)])


_FLAGS = """SELECT l_orderkey, l_linenumber, l_orderkey % 11 <> 0 AS enabled, CASE WHEN l_partkey % 13 = 0 THEN 'models/deprecated/x.sql' ELSE 'models/core/x.sql' END AS file_path, l_partkey % 17 = 0 AS is_renamed, CASE WHEN l_suppkey % 2 = 0 THEN 'core/x.sql' ELSE 'y.sql' END AS renamed_from, 'z.sql' AS renamed_to, l_partkey % 23 <> 0 AS exists_here,
  l_partkey % 19 = 0 AS is_deleted, l_suppkey % 3 <> 0 AS in_prod, l_partkey % 2 = 0 AS in_dev, l_partkey % 5 = 0 AS is_new, l_partkey % 7 <> 0 AS is_tracked, l_orderkey % 3 = 0 AS is_modified, l_orderkey % 2 = 0 AS is_committed FROM {lineitem}"""


_STATE_SQL = """CASE WHEN NOT enabled THEN 'deprecated_disabled' WHEN contains(file_path, '/deprecated/') THEN 'deprecated_folder' WHEN is_renamed THEN CASE WHEN contains(file_path, renamed_from) THEN 'renamed_old' ELSE 'renamed_new' END
  WHEN is_deleted OR NOT exists_here THEN CASE WHEN in_prod THEN 'deleted_locally' ELSE 'not_found' END WHEN NOT in_prod AND is_new THEN 'new_uncommitted' WHEN NOT in_prod AND is_committed AND in_dev THEN 'new_in_dev_manifest' WHEN NOT in_prod AND is_committed THEN 'new_committed'
  WHEN NOT in_prod THEN 'new_uncommitted' WHEN is_modified AND in_dev THEN 'modified_in_dev_manifest' WHEN is_modified THEN 'modified_uncommitted' ELSE 'prod_stable' END"""


@Q("lifecycle_state", f"WITH g AS ({_FLAGS.replace('{lineitem}', 'lineitem')}) SELECT {_STATE_SQL} AS state, count(*) AS n FROM g GROUP BY 1")
def lifecycle_state(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_FLAGS, lineitem=table(spark, d, "lineitem"))
    return rows.withColumnRenamed("exists_here", "exists").select(resolve.lifecycle_state().alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@Q("sql_coverage", f"""WITH {MODELS_SQL}, g AS (SELECT count(*) AS n_models, CAST(count_if(trim(coalesce(compiled_code, '')) <> '') AS BIGINT) AS with_sql FROM m)
  SELECT *, 2 * with_sql >= n_models AS enough, CASE WHEN with_sql = 0 THEN 'none compiled' WHEN 2 * with_sql < n_models THEN 'mostly uncompiled' ELSE 'ok' END AS diagnosis FROM g""")
def sql_coverage(spark: SparkSession, d: str) -> DataFrame:
    return resolve.sql_coverage(models(spark, d))


@Q("context_bundle", f"""WITH {MODELS_SQL}, q AS (SELECT DISTINCT name FROM manifest_nodes WHERE unique_id LIKE 'model.%'), b AS (SELECT name, any_value(schema) AS schema, any_value(coalesce(json_extract_string(config, '$.materialized'), 'table')) AS materialized, any_value(cardinality(columns)) AS n_columns FROM m GROUP BY 1)
  SELECT q.name, schema, materialized, CAST(n_columns AS BIGINT) AS n_columns FROM q LEFT JOIN b USING (name)""")
def context_bundle(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "manifest_nodes").where(F.col("unique_id").startswith("model."))
    known = models(spark, d).select("name", "schema", F.coalesce(select.config_value("materialized"), F.lit("table")).alias("materialized"), F.size("columns").cast("bigint").alias("n_columns"))
    return resolve.context_bundle(every, known)


@Q("columns_with_docs", f"""WITH {MODELS_SQL}, k AS (SELECT unique_id, unnest(map_entries(columns)) AS c FROM m) SELECT unique_id, c.key AS "column", coalesce(c.value.description, '') AS description FROM k""")
def columns_with_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every column with its documentation, whatever its name."""
    docs = select.documented_columns(models(spark, d))
    return select.columns_with_docs(docs.select("unique_id", "column").distinct(), docs)


@Q("config_projection", f"WITH {MODELS_SQL} SELECT unique_id, json_extract_string(config, '$.meta.tier') AS tier, json_extract_string(config, '$.meta.checks.fresh_hours') AS fresh_hours FROM m")
def config_projection(spark: SparkSession, d: str) -> DataFrame:
    return models(spark, d).select("unique_id", select.config_value("meta.tier").alias("tier"), select.config_value("meta.checks.fresh_hours").alias("fresh_hours"))


@Q("find_path", f"""WITH {MODELS_SQL}, a AS (SELECT {SHORT} AS name, 0 AS rank, pos, unique_id, original_file_path FROM m UNION ALL SELECT schema || '.' || alias, 1, pos, unique_id, original_file_path FROM m WHERE alias IS NOT NULL
  UNION ALL SELECT schema || '.' || name, 1, pos, unique_id, original_file_path FROM m WHERE name IS NOT NULL)
  SELECT name, original_file_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, pos NULLS FIRST, unique_id) AS i FROM a WHERE name IS NOT NULL) WHERE i = 1""")
def find_path(spark: SparkSession, d: str) -> DataFrame:
    """Path of every model name and of every schema.table."""
    return select.find_paths(models(spark, d))


_CODES = """SELECT DISTINCT CASE event_id % 5 WHEN 0 THEN '??' WHEN 1 THEN ' M' WHEN 2 THEN 'R ' WHEN 3 THEN 'A ' ELSE ' D' END AS code, CASE WHEN event_id % 5 = 2 THEN concat('models/', event_type, '.sql -> models/new_', event_type, '.sql') ELSE concat('models/', event_type, '.sql') END AS path FROM {events}"""


@Q("git_flags", f"""WITH g AS ({_CODES.replace('{events}', 'events')}) SELECT code, path, code IN ('??', 'A ') AS is_new, code <> '??' AS is_tracked, contains(code, 'M') OR code = 'A ' AS is_modified, contains(code, 'D') AS is_deleted, starts_with(code, 'R') AS is_renamed,
  CASE WHEN starts_with(code, 'R') THEN split_part(path, ' -> ', 1) END AS renamed_from, CASE WHEN starts_with(code, 'R') THEN split_part(path, ' -> ', 2) END AS renamed_to FROM g""")
def git_flags(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CODES, events=table(spark, d, "events")).select("code", "path", *[v.alias(k) for k, v in resolve.git_flags("code", "path").items()])


@Q("git_warnings", f"""WITH g AS ({_FLAGS.replace('{lineitem}', 'lineitem')}) SELECT kind, count(*) AS n FROM (SELECT 'file_deleted' AS kind FROM g WHERE is_deleted UNION ALL SELECT 'file_not_compiled' FROM g WHERE NOT is_deleted AND is_new AND NOT in_dev
  UNION ALL SELECT 'modified_not_in_dev' FROM g WHERE NOT is_deleted AND is_modified AND NOT in_dev UNION ALL SELECT 'prod_is_older' FROM g WHERE NOT is_deleted AND is_modified AND in_prod UNION ALL SELECT 'untracked_file' FROM g WHERE NOT is_deleted AND NOT is_tracked
  UNION ALL SELECT 'renamed_file' FROM g WHERE NOT is_deleted AND is_renamed UNION ALL SELECT 'only_in_dev' FROM g WHERE NOT is_deleted AND in_dev AND NOT in_prod) GROUP BY 1""")
def git_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_FLAGS, lineitem=table(spark, d, "lineitem"))
    return rows.select(F.explode(resolve.state_warnings()).alias("w")).groupBy(F.col("w.type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_ASKED = "SELECT l_orderkey % 2 = 0 AS use_dev, l_partkey % 3 = 0 AS modified, l_partkey % 5 = 0 AS committed, l_suppkey % 3 <> 0 AS in_prod, l_suppkey % 4 <> 0 AS in_dev, l_linenumber <> 2 AS has_dev_manifest FROM {lineitem}"


@Q("git_manifest_warnings", f"""WITH g AS ({_ASKED.replace('{lineitem}', 'lineitem')}), h AS (SELECT *, CASE WHEN use_dev AND NOT in_dev THEN 1 WHEN modified AND NOT in_prod AND NOT in_dev THEN 2 ELSE 0 END AS stop FROM g), w AS (
  SELECT CASE WHEN modified OR committed THEN 'modified_not_compiled' ELSE 'dev_without_changes' END AS type, 'warning' AS severity FROM h WHERE stop = 1 UNION ALL SELECT 'file_not_compiled', 'error' FROM h WHERE stop = 2
  UNION ALL SELECT 'new_model_candidate', 'warning' FROM h WHERE stop = 0 AND NOT use_dev AND NOT in_prod AND in_dev AND modified UNION ALL SELECT 'dev_without_changes', 'warning' FROM h WHERE stop = 0 AND use_dev AND NOT modified AND NOT committed
  UNION ALL SELECT 'dev_committed_not_merged', 'info' FROM h WHERE stop = 0 AND use_dev AND NOT modified AND committed UNION ALL SELECT 'git_mismatch', 'warning' FROM h WHERE stop = 0 AND NOT use_dev AND modified
  UNION ALL SELECT 'git_committed', 'info' FROM h WHERE stop = 0 AND NOT use_dev AND NOT modified AND committed UNION ALL SELECT 'dev_manifest_missing', 'error' FROM h WHERE stop = 0 AND use_dev AND NOT has_dev_manifest) SELECT type, severity, count(*) AS n FROM w GROUP BY ALL""")
def git_manifest_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_ASKED, lineitem=table(spark, d, "lineitem")).select(F.explode(resolve.git_manifest_warnings()).alias("w"))
    return rows.groupBy("w.type", "w.severity").agg(F.count(F.lit(1)).alias("n"))


@Q("column_source_route", f"""WITH g AS ({_FLAGS.replace('{lineitem}', 'lineitem')}), s AS (SELECT {_STATE_SQL} AS state, in_prod, l_linenumber * 6 AS age FROM g)
  SELECT CASE WHEN NOT starts_with(state, 'new_') AND NOT starts_with(state, 'modified_') AND in_prod AND age <= 24 THEN 'catalog' ELSE 'live' END AS route, count(*) AS n FROM s GROUP BY 1""")
def column_source_route(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_FLAGS, lineitem=table(spark, d, "lineitem")).withColumnRenamed("exists_here", "exists")
    route = resolve.column_source(resolve.lifecycle_state(), F.col("in_prod"), F.col("l_linenumber") * 6)
    return rows.select(route.alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@Q("compiled_sql", f"WITH {MODELS_SQL} SELECT unique_id, length(CASE WHEN trim(coalesce(compiled_code, '')) <> '' THEN compiled_code ELSE raw_code END) AS n_chars, CASE WHEN trim(coalesce(compiled_code, '')) = '' AND trim(coalesce(raw_code, '')) = '' THEN 'no compiled SQL' END AS error FROM m")
def compiled_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL of each model, from the manifest or else from disk; the raw text stands in for the file on disk."""
    own = models(spark, d)
    disk = own.where("original_file_path IS NOT NULL").groupBy("original_file_path").agg(F.max("raw_code").alias("disk_sql"))
    return resolve.compiled_sql(own, disk).select("unique_id", F.length("sql").alias("n_chars"), "error")


QUERIES, ORACLES = R.queries, R.oracles
