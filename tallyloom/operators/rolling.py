"""Totals over trailing periods by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(rows: DataFrame, entity: str, day: str, amount: Column) -> DataFrame:
    """(entity, day, amount) with at most one row per entity and day, combined map-side."""
    return (
        rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity), F.col(day))
        .agg(F.sum(amount).alias("_amount"))
    )


def dense_calendar(daily: DataFrame, entity: str, day: str, last_day: DataFrame) -> DataFrame:
    """Every day of each entity from its first day to ``last_day`` (one row, column ``_last``).

    Idle days get 0. The gaps are filled from each row to the entity's next one, so
    there is no second pass over the data and no join on a hot entity.
    """
    w = Window.partitionBy(entity).orderBy(day)
    return (
        daily.withColumn("_last", last_day.scalar())
        .withColumn("_until", F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.greatest(F.col("_last"), F.col(day))))
        .withColumn("_d", F.explode(F.sequence(day, "_until")))
        .select(entity, F.col("_d").alias(day), F.when(F.col("_d") == F.col(day), F.col("_amount")).otherwise(F.lit(0)).alias("_amount"))
    )


def trailing_sums(dense: DataFrame, entity: str, day: str, windows: list[int]) -> DataFrame:
    """Adds ``_sum_N`` for each N: blocks of 1, 2, 4, 8, ... days, shifted and combined.

    ``dense`` has one row per entity and day without gaps. Block 2k of a day is its
    block k plus the block k of the day k before; a window is the sum of the blocks of
    its binary digits, each shifted past the larger ones. All shifts share one order.
    """
    w = Window.partitionBy(entity).orderBy(day)
    out, block, kind = dense.withColumn("_b1", F.col("_amount")), 1, dense.schema["_amount"].dataType
    zero = F.lit(0).cast(kind)
    shifted = lambda c, k: F.coalesce(F.lag(c, k).over(w), zero) if k else F.col(c)
    while 2 * block <= max(windows):
        out = out.withColumn(f"_b{2 * block}", (F.col(f"_b{block}") + shifted(f"_b{block}", block)).cast(kind))
        block *= 2
    sums = {}
    for n in windows:
        parts, done = [], 0
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                parts.append(shifted(f"_b{1 << bit}", done))
                done += 1 << bit
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        sums[f"_sum_{n}"] = total
    return out.select(entity, day, *[v.alias(k) for k, v in sums.items()])


def trailing_totals(
    rows: DataFrame, entity: str, day: str, amount: Column, windows: list[int], last_day: DataFrame | None = None
) -> DataFrame:
    """Totals over the trailing ``windows`` for each entity and calendar day, idle days included.

    Returns (entity, day, _sum_N...). Rows without entity or day are left out, null
    amounts add 0, an empty table gives no rows. Each entity starts at its first day
    and ends at ``last_day`` (default: the last day of all rows).
    """
    last = last_day if last_day is not None else rows.agg(F.max(day).alias("_last"))
    daily = daily_totals(rows, entity, day, F.coalesce(amount, F.lit(0)))
    return trailing_sums(dense_calendar(daily, entity, day, last), entity, day, windows)
