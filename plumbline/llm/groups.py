"""Joins with a small table that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: At most this many groups are called hot, so the table of them may be broadcast.
HOT_GROUPS = 4096
LEAST_HOT = 128
BROADCAST_ROWS = 100_000


def attach(rows: DataFrame, groups: DataFrame, key: str, spread: Column, total: int) -> DataFrame:
    """Left join of rows with one row per key; `groups` has the key, `n` rows each and further columns.

    Groups with more than max(LEAST_HOT, total / HOT_GROUPS) rows are at most
    HOT_GROUPS and are broadcast. Their rows and rows of a null key travel to the
    other join under a key of their own, made of `spread`, and so lie evenly.
    """
    least = max(LEAST_HOT, -(-total // HOT_GROUPS))
    added = [c for c in groups.columns if c not in (key, "n")]
    hot = groups.where(F.col("n") > least).select(
        F.col(key).alias("__hot"), F.struct(*added).alias("__of_hot"))
    cold = groups.where((F.col("n") <= least) & F.col(key).isNotNull()).select(
        F.struct(F.lit(False).alias("own"), F.col(key).cast("string").alias("key")).alias("__key"),
        F.struct(*added).alias("__of_cold"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left")
    alone = F.col("__hot").isNotNull() | F.col(key).isNull()
    keyed = marked.withColumn("__key", F.struct(
        alone.alias("own"), F.when(alone, spread.cast("string")).otherwise(F.col(key).cast("string")).alias("key")))
    out = keyed.join(cold, "__key", "left").withColumn("__of", F.coalesce("__of_hot", "__of_cold"))
    return out.select(*rows.columns, *[F.col(f"__of.{c}").alias(c) for c in added])


def join_bounded(rows: DataFrame, small: DataFrame, key: str, spread: Column, copies: int = 64) -> DataFrame:
    """Inner join with a table that is broadcast up to BROADCAST_ROWS rows.

    A larger one is copied to `copies` places, and each row picks one by
    `spread`, so that a hot key is that many tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    place = F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int")
    dealt = small.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("__place", place).join(dealt, [key, "__place"]).drop("__place")
