"""Queries that read project artifacts: each is written from the tables to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import bi, select
from tallyloom.queries.base import MODELS_SQL, NODES_SQL, Registry, models, nodes, table
from tallyloom.queries.structure import _OUTPUTS_SQL, latest_reports, lineage
from tallyloom.session import ensure_checkpoint_dir
from tallyloom.sources import artifacts

R = Registry()
Q = R.add


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/artifacts-{uuid.uuid4().hex}/{name}"


def _written(spark: SparkSession, document: DataFrame, name: str) -> str:
    """Path of a one-row document written as text."""
    path = _folder(spark, name)
    document.coalesce(1).write.text(path)
    return path


def _by_id(rows: DataFrame, body) -> DataFrame:
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("unique_id", body))).alias("_m"))


def _manifest(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    fields = "name alias schema database package_name resource_type compiled_code raw_code description original_file_path tags depends_on columns".split()
    own = _by_id(nodes(spark, d), F.struct(*fields, F.expr("try_parse_json(config)").alias("config")))
    others = _by_id(table(spark, d, "manifest_sources").dropDuplicates(["unique_id"]), F.struct("schema", "identifier", "name", "database", "resource_type"))
    lists = table(spark, d, "child_map").where("unique_id IS NOT NULL").groupBy("unique_id").agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.coalesce("children", F.array().cast("array<string>")))))).alias("_c"))
    parts = [own.withColumnRenamed("_m", "nodes"), others.withColumnRenamed("_m", "sources"), _by_id(lists, F.col("_c")).withColumnRenamed("_m", "child_map")]
    doc = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        doc = doc.join(p.withColumn("_k", F.lit(1)), "_k")
    return artifacts.read_manifest(spark, _written(spark, doc.select(F.to_json(F.struct("nodes", "sources", "child_map"))), "manifest"))


@Q("manifest_models", f"WITH {NODES_SQL} SELECT unique_id, name, schema, coalesce(array_to_string(list_sort(tags), ','), '') AS tags, json_extract_string(config, '$.materialized') AS materialized, coalesce(cardinality(columns), 0)::INT AS n_columns FROM n")
def manifest_models(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as a manifest file holds them."""
    rows = _manifest(spark, d)["models"]
    return rows.select("unique_id", "name", "schema", F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("tags"), select.config_value("materialized").alias("materialized"), F.when(F.col("columns").isNull(), 0).otherwise(F.size("columns")).alias("n_columns"))


@Q("manifest_edges", "SELECT unique_id AS src, dst, count(*) AS n FROM (SELECT unique_id, unnest(children) AS dst FROM child_map) WHERE unique_id IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2")
def manifest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of a manifest file's child map, with their repeats."""
    return _manifest(spark, d)["edges"].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@Q("catalog_stats", f"WITH {MODELS_SQL} SELECT unique_id, CAST(pos AS BIGINT) AS row_count, CAST(pos AS BIGINT) * 10 AS bytes, coalesce(cardinality(columns), 0)::BIGINT AS n_columns FROM m")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, bytes and columns of tables as a catalog file holds them; sizes are the nodes' positions."""
    value = lambda e: F.struct(F.expr(e).alias("value"))
    columns = F.transform_values("columns", lambda k, c: F.struct(c["data_type"].alias("type")))
    doc = _by_id(models(spark, d), F.struct(columns.alias("columns"), F.struct(value("pos").alias("num_rows"), value("bigint(pos) * 10").alias("num_bytes")).alias("stats"))).select(F.to_json(F.struct(F.col("_m").alias("nodes"))))
    made = artifacts.read_catalog(spark, _written(spark, doc, "catalog"))
    n = made["columns"].where("column IS NOT NULL").groupBy("unique_id").agg(F.count(F.lit(1)).alias("n_columns"))
    return made["stats"].join(n, "unique_id", "left").select("unique_id", "row_count", "bytes", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


@Q("lineage_artifact", f"WITH {_OUTPUTS_SQL} SELECT * FROM le")
def lineage_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Links of a lineage artifact that was written and read again."""
    made, links = lineage(spark, d)
    path = _folder(spark, "lineage")
    artifacts.write_lineage(made, links, path, "2025-06-01T00:00:00Z")
    return artifacts.read_lineage(spark, path)[1]


def _scan(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A workspace scan of the reports: a dataset has one table with one measure, a report is owned by its own id."""
    rows = latest_reports(spark, d).select("workspace_id", "report_id", "dataset_id", "name").distinct().where("workspace_id IS NOT NULL")
    user = lambda who, right: F.struct(F.col(who).alias("displayName"), F.lit(right).alias("reportUserAccessRight"), F.lit("x@example.invalid").alias("emailAddress"))
    reports = rows.groupBy("workspace_id").agg(F.collect_list(F.struct(F.col("report_id").alias("id"), "name", F.col("dataset_id").alias("datasetId"), F.array(user("report_id", "Owner"), user("workspace_id", "Read")).alias("users"))).alias("reports"))
    expressions = F.array(F.struct(F.lit(" ").alias("expression")), F.struct(F.concat(F.lit("let S = Table.FromRows({}) in "), "dataset_id").alias("expression")))
    measure = F.struct(F.concat(F.lit("m_"), "dataset_id").alias("name"), F.lit("SUM('My T'[a b]) + T[c]").alias("expression"), F.lit(False).alias("isHidden"))
    tables = F.array(F.struct(F.lit("Main").alias("name"), expressions.alias("source"), F.array(measure).alias("measures")))
    datasets = rows.where("dataset_id IS NOT NULL").select("workspace_id", "dataset_id").distinct().groupBy("workspace_id").agg(F.collect_list(F.struct(F.col("dataset_id").alias("id"), F.col("dataset_id").alias("name"), tables.alias("tables"))).alias("datasets"))
    spaces = reports.join(datasets, "workspace_id", "left").agg(F.collect_list(F.struct(F.col("workspace_id").alias("id"), F.col("workspace_id").alias("name"), "datasets", "reports")).alias("workspaces"))
    return artifacts.read_scan(spark, _written(spark, spaces.select(F.to_json(F.struct("workspaces"))), "scan"))


_ROWS_SQL = "r AS (SELECT DISTINCT workspace_id, report_id, dataset_id, name FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY scanned_at DESC) AS i FROM bi_reports) WHERE i = 1 AND workspace_id IS NOT NULL), ds AS (SELECT DISTINCT workspace_id, dataset_id FROM r WHERE dataset_id IS NOT NULL)"


@Q("scan_owners", f"WITH {_ROWS_SQL} SELECT report_id, report_id AS owner FROM r")
def scan_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners of the reports of a scan."""
    return bi.owners(_scan(spark, d)["reports"])


@Q("scan_measures", f"WITH {_ROWS_SQL} SELECT workspace_id, dataset_id, 'Main' AS query, 'm_' || dataset_id AS metric, 'My T[a b],T[c]' AS refs FROM ds")
def scan_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a scan with what they refer to."""
    return bi.dax_references(_scan(spark, d)["measures"], "expression").select("workspace_id", "dataset_id", "query", "metric", F.array_join("refs", ",").alias("refs"))


@Q("scan_expressions", f"WITH {_ROWS_SQL} SELECT workspace_id, dataset_id, 'let S = Table.FromRows({{}}) in ' || dataset_id AS expression, 'inline' AS kind FROM ds")
def scan_expressions(spark: SparkSession, d: str) -> DataFrame:
    """First expression of every table of a scan that is not blank, and its kind."""
    first = _scan(spark, d)["tables"].select("workspace_id", "dataset_id", bi.first_expression("source").alias("expression"))
    return bi.m_sources(first, "expression").select("workspace_id", "dataset_id", "expression", "kind")


@Q("report_datasets", f"WITH {_ROWS_SQL} SELECT report_id, workspace_id, dataset_id, CASE WHEN dataset_id IS NULL THEN 0 ELSE 1 END AS n_tables FROM r")
def report_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a scan with the tables of their dataset in the same workspace."""
    made = _scan(spark, d)
    tables = made["tables"].groupBy("workspace_id", "dataset_id").agg(F.count(F.lit(1)).cast("int").alias("n_tables"))
    return made["reports"].join(tables, ["workspace_id", "dataset_id"], "left").select("report_id", "workspace_id", "dataset_id", F.coalesce("n_tables", F.lit(0)).alias("n_tables"))


QUERIES, ORACLES = R.queries, R.oracles
