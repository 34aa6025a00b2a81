"""Questions to the warehouse's monitoring tables. Dates are compared with ``as_of``, never with today.

Bytes become GB by 1024**3 and two decimals unless said otherwise. Null numbers count as
0 in sums; empty tables give no rows, or one row of zeros for a grand total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gb(c: str, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.col(c), F.lit(0)) / 1024**3, digits)


def since(day: str, as_of: str, days: int) -> Column:
    return F.col(day).cast("date") >= F.date_sub(F.to_date(F.lit(as_of)), days)


def storage_metrics(storage: DataFrame, dataset: str | None = None, table: str | None = None) -> DataFrame:
    """Size, rows, cost and best billing model of tables; of one table if named."""
    rows = storage
    if dataset is not None:
        rows = rows.where((F.col("dataset_id") == dataset) & (F.col("table_id") == table))
    return rows.select(
        "dataset_id", "table_id", gb("total_logical_bytes").alias("total_gb"), gb("active_logical_bytes").alias("active_gb"),
        gb("long_term_logical_bytes").alias("long_term_gb"), F.col("total_partitions").alias("partition_count"), F.col("total_rows").alias("row_count"),
        F.round("cost_monthly_forecast", 2).alias("cost_monthly"), F.round("potential_savings", 2).alias("potential_savings"), F.col("optimal_storage_billing_model").alias("optimal_billing"),
    )


def large_tables(storage: DataFrame, min_gb: float) -> DataFrame:
    """Tables of at least ``min_gb``, largest first."""
    return storage.where(F.col("total_logical_bytes") >= min_gb * 1024**3).select(
        "dataset_id", "table_id", gb("total_logical_bytes").alias("total_gb"), F.col("total_partitions").alias("partition_count")
    ).orderBy(F.desc("total_gb"), "dataset_id", "table_id")


def savings(storage: DataFrame, least: float) -> DataFrame:
    return storage.where(F.col("potential_savings") >= least).select("dataset_id", "table_id", F.round("potential_savings", 2).alias("potential_savings")).orderBy(F.desc("potential_savings"), "dataset_id", "table_id")


def dataset_billing(storage: DataFrame, least: float = 0.1) -> DataFrame:
    """Datasets that the cheaper of the two billing models would save more than ``least``."""
    sums = storage.groupBy("dataset_id").agg(
        F.count_if(F.col("optimal_storage_billing_model") == "PHYSICAL").alias("physical_tables"), F.count(F.lit(1)).alias("n_tables"),
        F.sum("cost_monthly_forecast").alias("c"), F.sum("logical_cost_monthly_forecast").alias("lo"), F.sum("physical_cost_monthly_forecast").alias("ph"),
    )
    return sums.select(
        "dataset_id", "physical_tables", "n_tables", F.round(F.col("c") - F.least("lo", "ph"), 2).alias("saving"),
        F.when(F.col("ph") < F.col("lo"), "PHYSICAL").otherwise("LOGICAL").alias("recommended"),
    ).where(F.col("saving") > least)


def partition_stats(partitions: DataFrame, name: str) -> DataFrame:
    """Partition facts of the tables whose full name ends with ``name`` (taken literally)."""
    return partitions.where(F.col("full_name").endswith(name))


def partition_details(parts: DataFrame, dataset: str, table: str, most: int = 100) -> DataFrame:
    """The latest partitions of a table, by id descending, with GB to four decimals."""
    return (
        parts.where((F.col("dataset_id") == dataset) & (F.col("table_id") == table)).orderBy(F.desc("partition_id")).limit(most)
        .select("partition_id", "total_rows", gb("total_logical_bytes", 4).alias("total_gb"))
    )


def latest_partitions(parts: DataFrame, most: int = 100) -> DataFrame:
    """partition_details of every table at once; Spark drops all but ``most`` rows of a table before the shuffle."""
    w = Window.partitionBy("dataset_id", "table_id").orderBy(F.desc("partition_id"))
    return parts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("dataset_id", "table_id", "partition_id", "total_rows", gb("total_logical_bytes", 4).alias("total_gb"))


def clustering_columns(columns: DataFrame) -> DataFrame:
    """Partition column and cluster columns in order, for every table."""
    return columns.groupBy("dataset_id", "table_id").agg(
        F.max(F.when(F.col("is_partitioning_column") == "YES", F.col("column_name"))).alias("partition_column"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("clustering_ordinal_position").isNotNull(), F.struct("clustering_ordinal_position", "column_name")))), lambda s: s["column_name"]), ",").alias("cluster_columns"),
    )


def partition_info(partitions: DataFrame) -> DataFrame:
    return partitions.select("dataset_id", "table_id", "partition_type", "partition_count", gb("total_logical_bytes").alias("total_gb")).orderBy(F.desc("total_gb"), "dataset_id", "table_id")


def usage_stats(refs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Records and references of each table over the last ``days``."""
    return refs.where(since("day", as_of, days)).groupBy("dataset_id", "table_id").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("reference_count"), F.lit(0)).alias("n_references"))


def query_frequency(refs: DataFrame, as_of: str, days: int = 30, more_than: int = 10) -> DataFrame:
    """Tables referenced more than ``more_than`` times, with the days they were used on."""
    used = refs.where(since("day", as_of, days)).groupBy("dataset_id", "table_id", "day").agg(F.sum("reference_count").alias("n"))
    sums = used.groupBy("dataset_id", "table_id").agg(F.count(F.lit(1)).alias("days_used"), F.sum("n").alias("n_references"))
    return sums.where(F.col("n_references") > more_than)


def read_heavy(refs: DataFrame) -> DataFrame:
    return refs.groupBy("dataset_id", "table_id").agg(F.sum("reference_count").alias("n_references")).where("n_references > 0")


def unused_tables(refs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Tables last used at least ``days`` before ``as_of``."""
    last = refs.where(F.col("reference_count") > 0).groupBy("dataset_id", "table_id").agg(F.max("day").alias("last_used"))
    return last.withColumn("days_unused", F.datediff(F.to_date(F.lit(as_of)), "last_used")).where(F.col("days_unused") >= days)


def model_query_costs(costs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Cost, queries, slot time, bytes and cache ratio of each model over the last ``days``."""
    sums = costs.where(since("hour", as_of, days)).groupBy("dbt_model_name").agg(
        F.sum("total_query_cost").alias("c"), F.sum("query_count").alias("query_count"), F.sum("total_slot_ms").alias("total_slot_ms"),
        F.sum("total_bytes_processed").alias("bytes_processed"), F.sum("cache_hit").alias("h"),
    )
    return sums.select(
        "dbt_model_name", F.round("c", 4).cast("double").alias("query_cost"), "query_count", "total_slot_ms", "bytes_processed",
        F.round(F.try_divide(F.col("h").cast("double"), F.col("query_count").cast("double")), 6).alias("cache_hit_ratio"),
    )


def total_costs(costs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    sums = costs.where(since("hour", as_of, days)).agg(F.sum("total_query_cost").alias("c"), F.sum("total_slot_ms").alias("s"), F.sum("query_count").alias("q"))
    zero = F.lit(0)
    return sums.select(F.round(F.coalesce("c", zero), 2).cast("double").alias("total_cost"), F.round(F.coalesce("s", zero) / 3.6e6, 1).alias("slot_hours"), F.coalesce("q", zero).alias("query_count"))


def model_metrics(costs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Failed runs, 90th percentile and mean duration, and queries of each model; decimal ties of the mean round up."""
    return costs.where(since("hour", as_of, days)).groupBy("dbt_model_name").agg(
        F.sum("failed_runs").alias("failed_runs"), F.max("p90_duration_seconds").cast("double").alias("p90_duration"),
        F.round(F.sum("avg_duration_seconds").cast("double") / F.count("avg_duration_seconds") + 1e-9, 2).alias("avg_duration"), F.sum("query_count").alias("query_count"),
    )


def metrics_of_models(costs: DataFrame, models: DataFrame, as_of: str, prefix: str, days: int = 7) -> DataFrame:
    """(unique_id, table_name, failed_runs, query_count): metrics of the models whose name they have without ``prefix``."""
    name = F.when(F.col("dbt_model_name").startswith(prefix), F.expr(f"substr(dbt_model_name, {len(prefix) + 1})")).otherwise(F.col("dbt_model_name"))
    sums = costs.where(since("hour", as_of, days)).groupBy(name.alias("name")).agg(F.sum("failed_runs").alias("failed_runs"), F.sum("query_count").alias("query_count"))
    table = F.concat_ws(".", "schema", F.coalesce(F.nullif("config_alias", F.lit("")), "name"))
    return sums.join(models.select("unique_id", "name", "schema", "config_alias"), "name").select("unique_id", table.alias("table_name"), "failed_runs", "query_count")


# -- scoring ------------------------------------------------------------------

def frequency_factor(n: Column) -> Column:
    return F.when(n > 0, F.least(F.log2(n + 1), F.lit(5.0))).otherwise(0.0)


def _ladder(value: Column, steps: list[tuple[float, int]]) -> Column:
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(value > least, points).otherwise(out)
    return out


# fixed values: datasets of raw loads and logs, which are no subject for tuning
RAW_DATASETS = ("raw_", "airbyte_", "job_logs")


def score_hotspots(tables: DataFrame) -> DataFrame:
    """Adds the points of each criterion and their sum ``score`` to tables joined with their facts.

    Columns used: is_model, enabled, materialized, dataset_id, total_gb, n_queries, cost,
    slot_ms, bytes_processed, has_partition, has_cluster, days_unused. Null facts count
    as 0. Tables of no model, disabled models and views score 0.
    """
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    n, size = v("n_queries"), v("total_gb")
    slot_per_query = F.when(n > 0, v("slot_ms") / n / 1000).otherwise(0.0)
    gb_per_query = F.when(n > 0, v("bytes_processed") / n / 1e9).otherwise(0.0)
    freq = frequency_factor(n)
    raw = F.lit(False)
    for prefix in RAW_DATASETS:
        raw = raw | F.col("dataset_id").startswith(prefix)
    gate = F.col("is_model") & F.coalesce(F.col("enabled"), F.lit(True)) & (F.coalesce(F.col("materialized"), F.lit("view")) != "view")
    tunable = (size > 1) & (n > 5) & (F.coalesce(F.col("materialized"), F.lit("")) != "incremental") & ~raw
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    share = F.when(size > 0, gb_per_query / size).otherwise(0.0)
    points = {
        "query_cost": F.when(v("cost") > 0, F.greatest(F.bround(v("cost") * 100), F.lit(1.0))),
        "high_slot": F.bround(_ladder(slot_per_query, [(600, 15), (120, 8), (30, 3)]) * freq),
        "no_partition": F.when(tunable & ~yes("has_partition"), F.bround(_ladder(size, [(100, 15), (10, 8), (1, 3)]) * freq)),
        "no_clustering": F.when(tunable & ~yes("has_cluster"), F.bround(_ladder(size, [(100, 10), (10, 5), (1, 2)]) * freq)),
        "unused": F.when(v("days_unused") > 30, F.bround(size * 0.02 * 100)),
        "ineffective_partition": F.when(yes("has_partition") & (size > 1) & (n > 5) & (share > 0.5), F.bround(F.when(share > 0.8, 10).otherwise(5) * freq)),
    }
    out = tables
    for name, p in points.items():
        out = out.withColumn(name, F.when(gate, F.coalesce(p.cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("score", sum((F.col(c) for c in points), F.lit(0)).cast("bigint"))


CRITERIA = ("query_cost", "high_slot", "no_partition", "no_clustering", "unused", "ineffective_partition")
#: What to do about each criterion.
ADVICE = {
    "query_cost": "look for cheaper queries", "high_slot": "simplify joins and aggregates", "no_partition": "add partition_by",
    "no_clustering": "add cluster_by", "unused": "drop or archive", "ineffective_partition": "partition by the filtered column",
}


def hotspot_details(scored: DataFrame) -> DataFrame:
    """One row per table and criterion with points, in the order of CRITERIA."""
    entries = F.array(*[F.struct(F.lit(i).alias("criterion_no"), F.lit(c).alias("criterion"), F.col(c).alias("points"), F.lit(ADVICE[c]).alias("recommendation")) for i, c in enumerate(CRITERIA)])
    return scored.select("dataset_id", "table_id", F.explode(F.filter(entries, lambda e: e["points"] > 0)).alias("d")).select("dataset_id", "table_id", "d.*")


def top_hotspots(scored: DataFrame, most: int = 10) -> DataFrame:
    """The highest scores above 0; ties by size, then name."""
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc("total_gb"), "dataset_id", "table_id").limit(most)


def hotspot_summary(scored: DataFrame) -> DataFrame:
    hot = F.col("score") > 0
    cost, slot = F.coalesce(F.col("cost"), F.lit(0)).cast("decimal(38,6)"), F.coalesce(F.col("slot_ms"), F.lit(0))
    return scored.agg(
        F.count(F.lit(1)).alias("n_tables"), F.count_if(hot).alias("n_hot"), F.round(F.coalesce(F.sum(cost), F.lit(0)), 2).cast("double").alias("total_cost"),
        F.round(F.coalesce(F.sum(F.when(hot, cost)), F.lit(0)), 2).cast("double").alias("hot_cost"), F.round(F.coalesce(F.sum(slot), F.lit(0)) / 3.6e6, 1).alias("slot_hours"),
        F.round(F.coalesce(F.sum(F.when(hot, slot)), F.lit(0)) / 3.6e6, 1).alias("hot_slot_hours"),
    )


def batch_topk(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark drops the rest before the shuffle."""
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank_no") <= most)
