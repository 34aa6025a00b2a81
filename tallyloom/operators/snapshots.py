"""Changes between consecutive full snapshots, found with Merkle trees over hash ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyloom.session import cut

#: Every inner node of the tree has 2**FANOUT_BITS children.
FANOUT_BITS = 4


def leaf_bits_for(rows_per_snapshot: float, rows_per_leaf: int = 32) -> int:
    """Depth in bits that leaves about ``rows_per_leaf`` keys in a hash range."""
    wanted = math.log2(max(rows_per_snapshot / rows_per_leaf, 1))
    return min(max(FANOUT_BITS, FANOUT_BITS * math.ceil(wanted / FANOUT_BITS)), 32)


def row_digests(
    rows: DataFrame, snapshot: str, key: str, version: str, compared: dict[str, Column]
) -> DataFrame:
    """One row of fixed width per snapshot and key: a digest for each compared column.

    Texts are reduced to digests before the shuffle. Of several deliveries of a key
    the greatest ``version`` counts (null versions are the oldest; a tie goes to the
    greater digests, so the result never depends on row order).
    """
    digests = [
        F.md5(F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))).alias(name)
        for name, value in compared.items()
    ]
    return (
        rows.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
        .select(F.col(snapshot).alias("_snap"), F.col(key).alias("_key"), F.struct(F.col(version).alias("_v"), *digests).alias("_row"))
        .groupBy("_snap", "_key")
        .agg(F.max("_row").alias("_row"))
        .select("_snap", "_key", *[F.col(f"_row.{name}").alias(f"_d{i}") for i, name in enumerate(compared)])
    )


def _tree(rows: DataFrame, leaf_bits: int) -> list[DataFrame]:
    """Digests of all nodes by level, root first; the leaves are hash ranges of keys."""
    content = [c for c in rows.columns if c.startswith("_d")]
    level = cut(
        rows.groupBy("_at", "_node").agg(
            F.bit_xor(F.xxhash64("_key", *content)).alias("_x"),
            F.bit_xor(F.xxhash64(F.lit(leaf_bits), *content[::-1], "_key")).alias("_y"),
        )
    )
    levels = [level]
    for _ in range(leaf_bits // FANOUT_BITS):
        level = (
            level.withColumn("_up", F.shiftrightunsigned("_node", FANOUT_BITS))
            .groupBy("_at", "_up")
            .agg(F.bit_xor(F.xxhash64("_node", "_x", "_y")).alias("_x"), F.bit_xor(F.xxhash64("_y", "_x", "_node")).alias("_y"))
            .withColumnRenamed("_up", "_node")
        )
        levels.append(level)
    return levels[::-1]


def _facing(df: DataFrame, last: int) -> DataFrame:
    """Each row twice: as the later side of its own pair and the earlier side of the next."""
    sides = F.array(F.struct(F.col("_at").alias("pair"), F.lit(True).alias("later")), F.struct((F.col("_at") + 1).alias("pair"), F.lit(False).alias("later")))
    return (
        df.withColumn("_side", F.explode(sides))
        .select("*", "_side.*")
        .drop("_side", "_at")
        .where(F.col("pair").between(1, last))
    )


def changed_leaves(levels: list[DataFrame], last: int) -> DataFrame:
    """Walk the trees of neighbouring snapshots top-down; returns (pair, node) of unequal leaves."""
    alive = None
    for nodes in levels:
        both = _facing(nodes, last)
        if alive is not None:
            parents = alive.withColumnRenamed("_node", "_up")
            both = both.withColumn("_up", F.shiftrightunsigned("_node", FANOUT_BITS)).join(parents, ["pair", "_up"], "left_semi")
        side = lambda c, later: F.max(F.when(F.col("later") == later, F.col(c)))
        alive = (
            both.groupBy("pair", "_node")
            .agg(*[side(c, later).alias(f"{c}{int(later)}") for c in ("_x", "_y") for later in (True, False)])
            .where(~(F.col("_x1").eqNullSafe(F.col("_x0")) & F.col("_y1").eqNullSafe(F.col("_y0"))))
            .select("pair", "_node")
        )
    return alive


def snapshot_changes(
    rows: DataFrame,
    snapshot: str,
    key: str,
    version: str,
    compared: dict[str, Column],
    leaf_bits: int | None = None,
) -> DataFrame:
    """Keys added, removed or changed between each snapshot and the one before it.

    Returns (``snapshot``, ``key``, ``change_kind``, ``changed_columns``) for the later
    snapshot of each pair. Rows without a snapshot or key belong to none and are left
    out; null content equals null only; repeated rows count once; an empty table or a
    single snapshot gives no rows; other columns of ``rows`` are ignored.
    """
    names = list(compared)
    rows = cut(row_digests(rows, snapshot, key, version, compared))
    # one row per delivery: grows with the calendar, not with the data
    dates = cut(rows.select("_snap").distinct().withColumn("_at", F.row_number().over(Window.orderBy("_snap")) - 1))
    last = dates.count() - 1
    bits = leaf_bits or leaf_bits_for(rows.count() / max(last + 1, 1))
    rows = rows.join(dates, "_snap").drop("_snap").withColumn("_node", F.shiftrightunsigned(F.xxhash64("_key"), 64 - bits))
    leaves = changed_leaves(_tree(rows, bits), last)
    suspects = _facing(rows, last).join(leaves, ["pair", "_node"], "left_semi")
    digest = F.concat(*[F.col(f"_d{i}") for i in range(len(names))])
    at = lambda later: F.max(F.when(F.col("later") == later, digest))
    part = lambda c, i: F.substring(F.col(c), 32 * i + 1, 32)
    return (
        suspects.groupBy("pair", "_key")
        .agg(at(True).alias("_new"), at(False).alias("_old"))
        .where(~F.col("_new").eqNullSafe(F.col("_old")))
        .join(dates.withColumnRenamed("_at", "pair"), "pair")
        .select(
            F.col("_snap").alias(snapshot),
            F.col("_key").alias(key),
            F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change_kind"),
            F.array_join(F.array_compact(F.array(*[
                F.when(part("_new", i) != part("_old", i), F.lit(n)) for i, n in enumerate(names)
            ])), ",").alias("changed_columns"),
        )
    )
