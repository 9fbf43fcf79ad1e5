"""Quota samples, splits and other seeded selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline import config as C
from plumbline.operators.ordering import add_rank, hash_block, hash_order, take_ranked
from plumbline.session import written


def quota_targets(n: int, ratios: dict[str, float]) -> dict[str, int]:
    """Rounded targets whose sum is n; the difference goes to the first tier present."""
    targets = {t: int(round(n * r)) for t, r in ratios.items()}
    first = next((t for t in C.TIERS if t in targets), next(iter(targets)))
    targets[first] += n - sum(targets.values())
    return targets


def quota_sample(df: DataFrame, key: str, tier: str, n: int, ratios: dict[str, float],
                 seed: int = 42) -> DataFrame:
    """Up to the target per tier in seeded order, then leftovers of any tier up to n."""
    targets = quota_targets(n, ratios)
    wanted = {t: max(0, c) for t, c in targets.items() if t in C.TIERS}
    labelled = df.withColumn(tier, F.coalesce(F.col(tier), F.lit("C")))
    digest = hash_order(F.col(key), seed)
    chosen = written(take_ranked(labelled, digest, key, wanted, by=tier))  # at most n rows
    got = chosen.groupBy(tier).agg(F.count(F.lit(1)).alias("c")).collect()  # one row per tier
    missing = n - sum(r["c"] for r in got)
    if missing <= 0:
        return chosen
    rest = labelled.join(chosen.select(key), key, "left_anti")
    return chosen.unionByName(take_ranked(rest, digest, key, missing))


def split_dataset(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
                  seed: int = 42) -> DataFrame:
    """Exact seeded split: int(n*r) rows for train and validation, the rest test.

    Only the rows of the two hash blocks that straddle a boundary are sorted.
    """
    if abs(sum(ratios) - 1.0) > 1e-10:
        raise ValueError("Split ratios must sum to 1.0")
    digest = hash_order(F.col(key), seed)
    blocked = df.withColumn("__digest", digest).withColumn("__block", hash_block(F.col("__digest")))
    sizes = blocked.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    plan = sizes.select(
        "__block", (F.sum("__n").over(upto) - F.col("__n")).alias("__start"), "__n",
        F.sum("__n").over(everything).alias("__total"),
    )
    train = F.floor(F.col("__total") * ratios[0])
    held = train + F.floor(F.col("__total") * ratios[1])
    plan = plan.withColumn("__train", train).withColumn("__held", held)
    end = F.col("__start") + F.col("__n")
    straddles = F.lit(False)
    for bound in ("__train", "__held"):
        straddles = straddles | ((F.col("__start") < F.col(bound)) & (end > F.col(bound)))
    plan = plan.withColumn("__cut", straddles)
    marked = blocked.join(F.broadcast(plan), "__block")  # one row per hash block

    def part(position):
        return (
            F.when(position < F.col("__train"), "train").when(position < F.col("__held"), "validation")
            .otherwise("test")
        )

    inside = W.partitionBy("__block").orderBy("__digest", key)
    position = F.col("__start") + F.row_number().over(inside) - 1
    cut = marked.where("__cut").withColumn("split", part(position))
    whole = marked.where("NOT __cut").withColumn("split", part(F.col("__start")))
    return whole.select(*df.columns, "split").unionByName(cut.select(*df.columns, "split"))


def oversample_pool(df: DataFrame, key: str, count: int, factor: int = C.OVERSAMPLE_FACTOR,
                    seed: int = 42) -> DataFrame:
    return take_ranked(df, hash_order(F.col(key), seed), key, count * factor)


def first_examples(df: DataFrame, stage: str, order: str, k: int = 3) -> DataFrame:
    """First k rows per stage; Spark prunes to k rows per stage before the shuffle."""
    inside = W.partitionBy(stage).orderBy(order)
    return df.withColumn("example", F.row_number().over(inside)).where(F.col("example") <= k)


def shuffle_seeded(df: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """1-based position of each row in a seeded order."""
    digest = hash_order(F.col(key), seed)
    marked = df.withColumn("__digest", digest)
    return add_rank(marked, ["__digest", key], hash_block(F.col("__digest")), out=out).drop("__digest")
