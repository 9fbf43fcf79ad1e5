"""Exact ranks, carries and running sums without a one-task window.

A plain window over a big group puts the whole group into one task. Here a
table is cut into blocks by a rule on the row itself; only one small row per
block takes part in the step that needs the order of blocks, and the in-block
windows run in parallel. One hot group is many blocks.

Groups and block together form one struct key. A struct is never null, so rows
of a null group join too, and the join and the in-block window ask for the
same partitioning: the table is exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROWS_PER_BLOCK = 1_000_000
HASH_DIGITS = 4


def key_blocks(df: DataFrame, key: str | Column, cuts: int = 64, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block number that rises with a numeric key, for about `rows` rows a block.

    The key range is cut at approximate quantiles and each piece evenly. The
    cuts only balance the work: they are literals, so every pass sees the same
    ones, and any cuts give the same ranks.
    """
    k = (F.col(key) if isinstance(key, str) else key).cast("double")
    points = [i / cuts for i in range(1, cuts)]
    found = df.select(k.alias("k")).agg(
        F.percentile_approx("k", points, 10_000), F.min("k"), F.max("k"), F.count("k")
    ).first()
    if not found[3]:
        return F.lit(0)
    inner = sorted(set(found[0]))
    bounds = [found[1], *inner, found[2]]
    parts = max(1, -(-found[3] // (len(bounds) * rows)))
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in inner]), lambda c: c < k))
    ends = F.array(*[F.lit(b) for b in bounds])
    low, high = F.get(ends, piece), F.get(ends, piece + 1)
    inside = F.when(high > low, F.floor((k - low) / (high - low) * parts)).otherwise(0)
    return piece * parts + F.least(inside, F.lit(parts - 1))


def hash_order(key: Column, seed: int | str = 42) -> Column:
    """A seeded order that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_block(digest: Column, digits: int = HASH_DIGITS) -> Column:
    """Block of a hex digest; 16**digits even blocks, sorted like the digests."""
    return F.substring(digest, F.lit(1), F.lit(digits))


def _blocked(df: DataFrame, block: Column, by: list[str]) -> DataFrame:
    return df.withColumn("__key", F.struct(*by, block.alias("__block")))


def _earlier(by: list[str]):
    """All blocks of the group before the current one, over a table of block rows."""
    return W.partitionBy(*[F.col(f"__key.{b}") for b in by]).orderBy("__key.__block").rowsBetween(
        W.unboundedPreceding, -1
    )


def add_rank(df: DataFrame, order: list, block: Column, by: list[str] | None = None,
             out: str = "rn", total: str | None = None) -> DataFrame:
    """1-based row number per `by` in `order`; `block` must rise with the order."""
    by = by or []
    blocked = _blocked(df, block, by)
    sizes = blocked.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(_earlier(by)), F.lit(0)))
    if total:
        group = W.partitionBy(*[F.col(f"__key.{b}") for b in by])
        offsets = offsets.withColumn(total, F.sum("__n").over(group))
    ranked = blocked.join(offsets.drop("__n"), "__key")
    inside = W.partitionBy("__key").orderBy(*order)
    return ranked.withColumn(out, F.row_number().over(inside) + F.col("__offset")).drop("__key", "__offset")


def take_ranked(df: DataFrame, digest: Column, tie: str, wanted: int | dict[str, int],
                by: str | None = None) -> DataFrame:
    """The first n rows, or the first wanted[g] rows of each group g, in hash order.

    Counts per hash block tell which blocks are taken whole, which not at all
    and which one straddles the limit; only rows of straddling blocks are
    shuffled and sorted. The block table has at most 16**HASH_DIGITS rows per
    named group. Groups that are not named give no rows.
    """
    keys = [by] if by else []
    blocked = df.withColumn("__digest", digest).withColumn("__block", hash_block(F.col("__digest")))
    if by:
        blocked = blocked.where(F.col(by).isin(list(wanted)))
        limit = F.lit(None).cast("bigint")
        for g, n in wanted.items():
            limit = F.when(F.col(by) == g, F.lit(n)).otherwise(limit)
    else:
        limit = F.lit(wanted)
    sizes = blocked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, W.currentRow)
    plan = sizes.withColumn("__left", limit - F.sum("__n").over(upto) + F.col("__n"))
    marked = blocked.join(F.broadcast(plan.where("__left > 0")), [*keys, "__block"])
    whole = marked.where("__n <= __left")
    inside = W.partitionBy(*keys, "__block").orderBy("__digest", tie)
    cut = marked.where("__n > __left").withColumn("__rn", F.row_number().over(inside)).where("__rn <= __left")
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def running_sums(df: DataFrame, order: list, block: Column, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums per `by` in `order`, inclusive of the current row."""
    blocked = _blocked(df, block, by).withColumns({f"__v_{n}": v for n, v in sums.items()})
    totals = blocked.groupBy("__key").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    totals = totals.withColumns({
        f"__t_{n}": F.coalesce(F.sum(f"__t_{n}").over(_earlier(by)), F.lit(0)) for n in sums
    })
    inside = W.partitionBy("__key").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = blocked.join(totals, "__key").withColumns({
        n: F.sum(f"__v_{n}").over(inside) + F.col(f"__t_{n}") for n in sums
    })
    return out.drop("__key", *[f"__v_{n}" for n in sums], *[f"__t_{n}" for n in sums])


def fill_forward(df: DataFrame, order: str, block: Column, by: list[str], column: str, out: str) -> DataFrame:
    """Latest non-null value up to and including the current row."""
    blocked = _blocked(df, block, by)
    known = F.when(F.col(column).isNotNull(), F.col(order))
    last = blocked.groupBy("__key").agg(F.max_by(F.col(column), known).alias("__last"))
    carry = last.select("__key", F.last("__last", ignorenulls=True).over(_earlier(by)).alias("__carry"))
    inside = W.partitionBy("__key").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("__carry"))
    return blocked.join(carry, "__key").withColumn(out, filled).drop("__key", "__carry")


def with_preceding(df: DataFrame, rank: str, by: list[str], reach: int, columns: dict, size: int = 4096) -> DataFrame:
    """Window expressions that look back at most `reach` ranked rows.

    Blocks of `size` ranks; the last `reach` rows of a block are repeated in
    front of the next one. `columns` maps names to functions of a window
    ordered by rank inside the block.
    """
    block = F.floor((F.col(rank) - 1) / size)
    into_next = (F.col(rank) - 1) % size >= size - reach
    copies = F.when(into_next, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.withColumn("__home", block).withColumn("__block", F.explode(copies))
    window = W.partitionBy(*by, "__block").orderBy(rank)
    spread = spread.withColumns({name: make(window) for name, make in columns.items()})
    return spread.where("__home = __block").drop("__home", "__block")
