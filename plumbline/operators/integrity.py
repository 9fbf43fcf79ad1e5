"""Prompt-hash labels over whole tables, and evaluate-once keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import config as C
from plumbline.functions import labels as L
from plumbline.operators.ordering import add_rank, hash_order, take_ranked


def add_prompt_hash(df: DataFrame) -> DataFrame:
    """Attach the prompt hash to tier and scope; rows without prompt or tier are dropped.

    Labels that already hold a hash stay as they are. `hash_status` tells what
    happened to the row.
    """
    tier_done = F.contains("tier", F.lit(":"))
    scope_done = F.col("scope").isNull() | F.contains("scope", F.lit(":"))
    digest = L.prompt_hash(F.col("prompt"))
    return df.where("prompt IS NOT NULL AND tier IS NOT NULL").select(
        *[c for c in df.columns if c not in ("tier", "scope")],
        F.when(tier_done, F.col("tier")).otherwise(L.compound_label(F.col("tier"), digest)).alias("tier"),
        F.when(scope_done, F.col("scope")).otherwise(L.compound_label(F.col("scope"), digest)).alias("scope"),
        F.when(tier_done & scope_done, "kept").otherwise("hashed").alias("hash_status"),
        (~scope_done).alias("scope_hashed"),
    )


def hash_counts(df: DataFrame) -> DataFrame:
    """Counts of a hashing job over its input table."""
    missing = F.col("prompt").isNull() | F.col("tier").isNull()
    tier_done = F.contains("tier", F.lit(":"))
    scope_done = F.col("scope").isNull() | F.contains("scope", F.lit(":"))
    done = tier_done & scope_done
    return df.agg(
        F.count_if(~missing & ~done).alias("processed"),
        F.count_if(~missing & ~scope_done).alias("scope_processed"),
        F.count_if(missing | done).alias("skipped"),
    )


def verify(df: DataFrame, prompt: str = "prompt", label: str = "tier") -> DataFrame:
    return df.withColumn("hash_ok", L.verify_hash(F.col(prompt), F.col(label)))


def sampled_verify(df: DataFrame, key: str, rows: int, rate: float = C.VERIFY_SAMPLE_RATE,
                   seed: int = 42) -> DataFrame:
    """Verify a seeded share of the rows, at least one; `rows` is the table's count."""
    wanted = max(1, int(rows * rate))
    return verify(take_ranked(df, hash_order(F.col(key), seed), key, wanted))


def verified_label(df: DataFrame, label: str, out: str, strict: bool = False) -> DataFrame:
    """Label part of a compound label; strict mode raises on a mismatch."""
    ok = L.verify_hash(F.col("prompt"), F.col(label))
    part = L.extract_label(F.col(label))
    if strict:
        part = F.when(ok, part).otherwise(F.raise_error(F.concat(F.lit("hash mismatch: "), F.col(label))))
    return df.withColumn(out, part).withColumn("hash_ok", ok)


def batch_digest(df: DataFrame, batch: str, order: str, block: Column, columns: list[str],
                 size: int = 1024) -> DataFrame:
    """A stable id per batch over its rows in order.

    Digests of up to `size` rows are digested again, and so on until one is
    left: no batch is ever put into one array, however long it is.
    """
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    ranked = add_rank(df.select(batch, order, row.alias("__row")), [order], block, by=[batch])

    def fold(position: Column, value: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(position.alias("p"), F.col(value).alias("d"))))
        return F.sha2(F.concat_ws("", F.transform(ordered, lambda s: s["d"])), 256)

    blocks = ranked.groupBy(batch, F.floor((F.col("rn") - 1) / size).alias("__part")).agg(
        fold(F.col("rn"), "__row").alias("__digest"), F.count(F.lit(1)).alias("__n")
    )
    parts = (ranked.agg(F.max("rn")).first()[0] or 0) // size + 1
    while parts > size:
        up = F.floor(F.col("__part") / size).alias("__up")
        blocks = blocks.groupBy(batch, up).agg(
            fold(F.col("__part"), "__digest").alias("__digest"), F.sum("__n").alias("__n")
        ).withColumnRenamed("__up", "__part")
        parts = parts // size + 1
    return blocks.groupBy(batch).agg(
        F.concat(F.lit("batch_"), F.substring(fold(F.col("__part"), "__digest"), 1, 16)).alias("batch_id"),
        F.sum("__n").alias("n_rows"),
    )


def evaluate_once(requests: DataFrame, batch: str, item: str) -> DataFrame:
    """One scoring request per batch and item, however often it was asked."""
    return requests.groupBy(batch, item).agg(F.count(F.lit(1)).alias("n_requests"))


def group_complete(df: DataFrame, key: Column, size: int = C.GROUP_SIZE) -> DataFrame:
    """Rows per prompt group and whether they fill whole groups."""
    return (
        df.groupBy(key.alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("complete", F.col("n") % size == 0)
    )
