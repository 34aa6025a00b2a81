"""What the query modules share: tables, the current models, and a registry with SQL beside each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: All dates of the monitoring questions are relative to this day.
AS_OF = "2025-06-01"


class Registry:
    """Queries by name, and the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A query in SQL text over the named tables, given as ``{name}`` in it."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


#: Nodes of the newest snapshot, each in its latest delivery.
NODES_SQL = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY loaded_at DESC, pos) AS rn
  FROM manifest_nodes WHERE snapshot_date = (SELECT max(snapshot_date) FROM manifest_nodes)) WHERE rn = 1)"""
MODELS_SQL = NODES_SQL + ", m AS (SELECT * FROM n WHERE unique_id LIKE 'model.%')"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest_nodes")
    newest = rows.where(F.col("snapshot_date") == rows.agg(F.max("snapshot_date")).scalar())
    w = Window.partitionBy("unique_id").orderBy(F.desc("loaded_at"), "pos")
    return newest.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("unique_id").startswith("model."))


EDGES_SQL = "e AS (SELECT DISTINCT src, dst FROM (SELECT unique_id AS src, unnest(children) AS dst FROM child_map) WHERE dst IS NOT NULL)"


def number(c: str, kind: str) -> F.Column:
    return F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS {kind})"), F.lit(0).cast(kind)).alias(c)


COSTS_SQL = """c AS (SELECT dbt_model_name, hour, coalesce(try_cast(trim(total_query_cost) AS DECIMAL(18,6)), 0) AS total_query_cost, coalesce(try_cast(trim(query_count) AS BIGINT), 0) AS query_count,
  coalesce(try_cast(trim(total_slot_ms) AS BIGINT), 0) AS total_slot_ms, coalesce(try_cast(trim(total_bytes_processed) AS BIGINT), 0) AS total_bytes_processed, coalesce(try_cast(trim(cache_hit) AS BIGINT), 0) AS cache_hit,
  coalesce(try_cast(trim(failed_runs) AS BIGINT), 0) AS failed_runs, try_cast(trim(avg_duration_seconds) AS DECIMAL(18,4)) AS avg_duration_seconds, try_cast(trim(p90_duration_seconds) AS DECIMAL(18,4)) AS p90_duration_seconds
  FROM models_costs_incremental)"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost rows with numbers; what is no number counts as 0, durations as unknown."""
    return table(spark, sf_dir, "models_costs_incremental").select(
        "dbt_model_name", "hour", number("total_query_cost", "decimal(18,6)"), *[number(c, "bigint") for c in ("query_count", "total_slot_ms", "total_bytes_processed", "cache_hit", "failed_runs")],
        *[F.expr(f"try_cast(trim({c}) AS decimal(18,4))").alias(c) for c in ("avg_duration_seconds", "p90_duration_seconds")],
    )


REFS_SQL = "r AS (SELECT dataset_id, table_id, day, coalesce(try_cast(trim(reference_count) AS BIGINT), 0) AS reference_count FROM table_reference_incremental)"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table_reference_incremental").select("dataset_id", "table_id", "day", number("reference_count", "bigint"))


#: Storage facts that the driver's tables don't have, made of line items: one table per supplier.
STORAGE = """SELECT concat('ds_', CAST(l_suppkey % 7 AS VARCHAR(9))) AS dataset_id, concat('t_', CAST(l_suppkey AS VARCHAR(9))) AS table_id,
  SUM(CAST(l_quantity AS BIGINT)) * 2500000 AS total_logical_bytes, SUM(CAST(l_quantity AS BIGINT)) * 1500000 AS active_logical_bytes, SUM(CAST(l_quantity AS BIGINT)) * 1000000 AS long_term_logical_bytes,
  COUNT(DISTINCT l_linenumber) AS total_partitions, COUNT(*) AS total_rows, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) / 1000000 AS DOUBLE) AS cost_monthly_forecast,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) / 1000000 AS DOUBLE) AS logical_cost_monthly_forecast, CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 1000 AS physical_cost_monthly_forecast,
  CAST(SUM(CAST(l_tax * 100 AS BIGINT)) AS DOUBLE) / 500 AS potential_savings, CASE WHEN l_suppkey % 3 = 0 THEN 'PHYSICAL' ELSE 'LOGICAL' END AS optimal_storage_billing_model
  FROM {lineitem} GROUP BY l_suppkey"""
STORAGE_SQL = "s AS (" + STORAGE.replace("{lineitem}", "lineitem") + ")"


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, STORAGE, "lineitem")


#: Usage events made of the events table: kinds of use by remainders of ids.
USAGE = """SELECT concat('t', CAST(user_id % 5 AS VARCHAR(9))) AS target, event_type AS column, CASE user_id % 4 WHEN 0 THEN 'where' WHEN 1 THEN 'where' WHEN 2 THEN 'join' ELSE 'group_by' END AS clause,
  CASE event_id % 6 WHEN 0 THEN 'eq' WHEN 1 THEN 'in' WHEN 2 THEN 'between' WHEN 3 THEN 'gt' WHEN 4 THEN 'neq' ELSE 'le' END AS operator,
  CASE WHEN event_id % 9 = 0 THEN 'upper' WHEN event_id % 11 = 0 THEN 'date' ELSE '' END AS wrapping_fn, concat('m', CAST(user_id % 50 AS VARCHAR(9))) AS downstream_model FROM {events}"""
USAGE_SQL = "u AS (" + USAGE.replace("{events}", "events").replace("AS column", 'AS "column"') + ")"
COLUMN_TYPES = [("click", "TIMESTAMP", False), ("error", "STRUCT<a INT64>", False), ("purchase", "NUMERIC(10,2)", False), ("signup", "DATE", True), ("view", "INT64", False)]
TYPES_SQL = 'k AS (SELECT * FROM (VALUES ' + ", ".join(f"('{c}', '{t}', {str(p).lower()})" for c, t, p in COLUMN_TYPES) + ') AS v("column", data_type, is_partition))'


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, USAGE, "events")


def column_types(spark: SparkSession) -> DataFrame:
    targets = spark.range(5).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("target"))
    return targets.withColumn("t", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("data_type"), F.lit(p).alias("is_partition")) for c, t, p in COLUMN_TYPES]))).select("target", "t.*")


#: SQL of models without comments, lower-case; each quoted text is one letter ``s``.
TEXTS_SQL = MODELS_SQL + r""", tx AS (SELECT unique_id, lower(regexp_replace(regexp_replace(compiled_code, '(''(?:[^''\\]|\\.)*'')|--[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/', '\1 ', 'g'), '''(?:[^''\\]|\\.)*''', 's', 'g')) AS t FROM m)"""
#: Columns compared in the first WHERE of each model, distinct and in order.
FILTERS_SQL = TEXTS_SQL + r""", fw AS (SELECT unique_id, regexp_extract_all(regexp_extract(t, '\bwhere\b(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\blimit\b|\bhaving\b|$)', 1, 's'), '\b([a-z_]\w*)\s*(?:=|<|>|!=|\bin\s*\(|\blike\b|\bbetween\b|\bis\s+(?:not\s+)?null\b)', 1) AS l FROM tx),
  fc AS (SELECT unique_id, list_filter(l, lambda x, i: list_position(l, x) = i AND x NOT IN ('and', 'or', 'not', 'where', 'in', 'is', 'null', 'like', 'between')) AS l FROM fw)"""
#: Usage events of all models: what their SQL does with columns of the tables it names.
USES_SQL = TEXTS_SQL + r""", sp AS (SELECT unique_id, t, regexp_extract(t, 'from\s+`([^`]+)`\s+as\s+t\b', 1) AS ft, regexp_extract(t, 'join\s+`([^`]+)`\s+as\s+j\b', 1) AS jt, regexp_extract(t, '^(.*?)\sfrom\s', 1, 's') AS sel, regexp_extract(t, '\bwhere\b(.*)$', 1, 's') AS w FROM tx WHERE t IS NOT NULL),
  wc AS (SELECT unique_id, ft AS target, unnest(regexp_extract_all('and ' || w, 'and\s+(?:coalesce\(\s*)?t\.\w+\s*(?:,[s\s]*\)\s*)?(?:>=|<=|!=|=|<|>|in\b)', 0)) AS c FROM sp WHERE w <> ''),
  us AS (SELECT target, regexp_extract(c, 't\.(\w+)', 1) AS "column", 'where' AS clause, CASE regexp_extract(c, '(>=|<=|!=|=|<|>|in)$', 1) WHEN '>=' THEN 'ge' WHEN '<=' THEN 'le' WHEN '!=' THEN 'neq' WHEN '=' THEN 'eq' WHEN '<' THEN 'lt' WHEN '>' THEN 'gt' ELSE 'in' END AS operator,
    CASE WHEN regexp_extract(c, '(>=|<=|!=|=|<|>|in)$', 1) IN ('>=', '<=', '<', '>') THEN 'range' ELSE 'literal' END AS selectivity, CASE WHEN contains(c, 'coalesce') THEN 'coalesce' ELSE '' END AS wrapping_fn, unique_id AS downstream_model FROM wc
   UNION ALL SELECT ft, regexp_extract(t, 'on\s+j\.\w+\s*=\s*t\.(\w+)', 1), 'join', 'eq', 'none', '', unique_id FROM sp WHERE jt <> '' UNION ALL SELECT jt, regexp_extract(t, 'on\s+j\.(\w+)', 1), 'join', 'eq', 'none', '', unique_id FROM sp WHERE jt <> ''
   UNION ALL SELECT ft, unnest(regexp_extract_all(sel, 't\.(\w+)', 1)), 'select', 'none', 'none', '', unique_id FROM sp)"""
