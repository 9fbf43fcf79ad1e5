"""Mixing sources to target weights, with built-in functions only.

Words are summed per source; targets share `total` times all words by weight, a
source's target stops at `cap` times its words, and the excess goes to the rest
by weight. That is one level for all: a source takes min(level * weight, cap
* words). Sorted by cap * words / weight, the sources that stop are a prefix, so
running sums give the level. A document is emitted floor(rate) times, and once
more if a seeded hash of its id falls below the fraction, where the rate is its
source's target over its words.

Text null or empty: size 0. A null source is a source of its own, sorted last.
A source without words has target 0 and rate 0. Repeated rows draw the same, as
the draw depends on the id alone; a null id draws like the text "null". An
empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.groups import join_bounded

WORD = "[^ \\t\\n\\x0B\\f\\r]+"
WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
CAP = 2


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(id_column: str, seed: int) -> Column:
    """Uniform number in [0, 1) from the id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
          percent: int = TOTAL_PERCENT, cap: int = CAP) -> DataFrame:
    """One row per source: __source (a struct, never null), source_size, target, rate."""
    sums = sized.groupBy(F.struct(F.col(source).alias("s")).alias("__source")).agg(
        F.sum(size).cast("bigint").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("__source.s").asc_nulls_last())) - 1
    weighed = sums.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("__cap", F.col("source_size") * cap)
    order = W.orderBy(F.col("__cap") / F.col("w"), F.col("__source.s").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    levelled = weighed.withColumns({
        "__left": F.sum("source_size").over(every) * percent / 100 - F.coalesce(F.sum("__cap").over(before), F.lit(0)),
        "__share": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    }).withColumn("__level", F.col("__left") / F.col("__share"))
    # The first source that its cap does not stop sets the level.
    level = F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("w"), F.struct(
        F.col("__cap") / F.col("w"), F.col("__level").alias("level")))).over(every)
    target = F.least(F.col("__cap").cast("double"), F.coalesce(level["level"] * F.col("w"), F.col("__cap").cast("double")))
    return levelled.withColumn("target", target).select(
        "__source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"))


def copies(rate: Column, chance: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(chance < rate - whole, 1).otherwise(0)).cast("bigint")


def _planned(docs: DataFrame, kept: list[str], id_column: str, text: str, source: str, seed: int) -> DataFrame:
    """The kept columns as a struct `__row`, with size, source_size, target and copies."""
    sized = docs.select(F.struct(*kept).alias("__row"), F.col(id_column).alias("__id"), size_of(text).alias("__size"),
                        F.struct(F.col(source).alias("s")).alias("__source"))
    table = rates(sized.withColumn("__s", F.col("__source.s")), "__s", "__size")
    joined = join_bounded(sized, table, "__source", F.col("__id"))
    return joined.select("__row", F.col("__size").alias("size"), "source_size", "target",
                         copies(F.col("__rate"), draw("__id", seed)).alias("copies"))


def plan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
         seed: int = 7) -> DataFrame:
    """The id of every row with its size, source_size, target and number of copies."""
    return _planned(docs, [id_column], id_column, text, source, seed).select(
        f"__row.{id_column}", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mixed table: every row as often as its copies say."""
    planned = _planned(docs, docs.columns, id_column, text, source, seed)
    return planned.select("__row", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select("__row.*")
