"""Per-key totals when a few keys hold most records.

Keys are reduced where the rows lie: the hash aggregate of each partition keeps one
mergeable state per key (spilling when it is full), and only those partial states are
shuffled. A hot key then costs one row per partition, not one row per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_versions(rows: DataFrame, record_id: str, version: str, kept: list[str]) -> DataFrame:
    """One row per record: the delivery with the greatest ``version``.

    Ties go to the greatest kept values, null versions are the oldest, rows without a
    record id are left out. Record ids are near-unique, so this shuffle is even
    whatever the keys are; partitions drop repeats before it.
    """
    return (
        rows.where(F.col(record_id).isNotNull())
        .groupBy(F.col(record_id))
        .agg(F.max(F.struct(F.col(version).alias("_v"), *kept)).alias("_row"))
        .select(record_id, *[F.col(f"_row.`{c}`").alias(c) for c in kept])
    )


def key_totals(rows: DataFrame, key: Column | str, amount: Column | str) -> DataFrame:
    """(key_id, n_records, total) by map-side combining; null keys are left out, null amounts add 0."""
    key = F.col(key) if isinstance(key, str) else key
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (
        rows.select(key.alias("key_id"), amount.cast("bigint").alias("_n"))
        .where(F.col("key_id").isNotNull())
        .groupBy("key_id")
        .agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total"))
    )


def list_totals(rows: DataFrame, key: str, entries: str) -> DataFrame:
    """(key_id, n_records, total): entries and distinct entries of all lists of a key.

    Null and empty lists give 0, 0 for a key that has nothing else; a null entry is an
    entry for ``n_records`` and none for ``total``; rows with a null key are left out.
    The first grouping is by (key, entry), so a hot key is spread over all tasks and
    comes back as one row per distinct entry and partition.
    """
    pairs = (
        rows.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key_id"), F.explode_outer(F.coalesce(F.col(entries), F.array())).alias("_e"), (F.coalesce(F.size(entries), F.lit(0)) > 0).alias("_real"))
        .groupBy("key_id", "_e")
        .agg(F.sum(F.col("_real").cast("bigint")).alias("_n"))
    )
    return pairs.groupBy("key_id").agg(F.sum("_n").alias("n_records"), F.count("_e").cast("bigint").alias("total"))
