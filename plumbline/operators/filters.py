"""Curation filters over a table of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import labels as L, text as T
from plumbline.session import written

BROADCAST_BATCHES = 1_000_000
SALTS = 16


def validate_required(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row: every row has all needed fields, and there is a row at all."""
    fields = fields or ["prompt"]
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~complete).alias("n_invalid"),
    ).withColumn("is_valid", (F.col("n_rows") > 0) & (F.col("n_invalid") == 0))


def violations(df: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """The rows that lack needed fields, each with the names of what it lacks."""
    names = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields or ["prompt"]])
    return df.select(key, F.array_compact(names).alias("missing")).where(F.size("missing") > 0)


def union_batches(results: list) -> tuple[DataFrame, int]:
    """The rows of all batches that are tables, and the number of batches that are not.

    A batch whose call failed is an exception or None and is skipped. Columns
    that a batch lacks are null; without any table there is nothing to return.
    """
    tables = [r for r in results if isinstance(r, DataFrame)]
    if not tables:
        raise ValueError("all batches failed")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out, len(results) - len(tables)


def mark_artifacts(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Strip the prompt and name the first artifact rule it breaks."""
    stripped = df.withColumn(column, T.strip(F.col(column)))
    return stripped.withColumn("reject_reason", T.reject_reason(F.col(column)))


def filter_artifacts(df: DataFrame, column: str = "prompt") -> DataFrame:
    return mark_artifacts(df, column).where("reject_reason IS NULL").drop("reject_reason")


def clean_prompts(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Rows with a prompt, cleaned of label annotations, leftovers flagged."""
    cleaned = df.where(F.col(column).isNotNull()).withColumn(column, T.clean_annotations(F.col(column)))
    return cleaned.withColumn("still_mentions_tier", T.mentions_tier(F.col(column)))


def lexicon_gate(df: DataFrame, matched: Column, batch: str, enforce: bool) -> DataFrame:
    """Keep matching rows; a batch without any match is kept whole unless enforced.

    Enforcing needs no batches at all. Otherwise the batch ids that have a
    match are found by a partial aggregate, not by a window over each batch,
    and broadcast up to BROADCAST_BATCHES of them; more are joined with salt.
    """
    marked = df.withColumn("__match", matched)
    if enforce:
        return marked.where("__match").drop("__match")
    marked = written(marked)  # matched once
    hits = marked.where("__match").drop("__match")
    matching = written(marked.where("__match").select(batch).distinct())
    rest = marked.where("NOT __match").drop("__match")
    if matching.count() <= BROADCAST_BATCHES:
        return hits.unionByName(rest.join(F.broadcast(matching), batch, "left_anti"))
    # A hot batch is cut into as many places as the ids are copied to.
    place = F.pmod(F.xxhash64(*rest.columns), F.lit(SALTS)).cast("int")
    dealt = matching.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rest.withColumn("__place", place).join(dealt, [batch, "__place"], "left_anti").drop("__place")
    return hits.unionByName(left)


def exact_dedupe(df: DataFrame, key: str, column: str = "prompt") -> DataFrame:
    """Keep the row with the lowest key among equal prompts.

    The first keys come from a map-side combined aggregate over digests, so a
    prompt that makes up a third of the table is one small group; the full rows
    move only by their own key.
    """
    first = df.groupBy(F.sha2(F.col(column), 256).alias("__digest"), F.length(column).alias("__len")).agg(
        F.min(key).alias(key)
    )
    return df.join(first.select(key), key, "left_semi")


def anti_join_seen(df: DataFrame, seen: DataFrame, column: str = "prompt") -> DataFrame:
    """Drop prompts that an earlier table already holds."""
    done = seen.select(L.prompt_hash(F.col(column)).alias("__hash")).distinct()
    marked = df.withColumn("__hash", L.prompt_hash(F.col(column)))
    return marked.join(done, "__hash", "left_anti").drop("__hash")


def filter_funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows each stage removes; a row counts at its first failing stage."""
    stage = F
    for name, fails in stages.items():
        stage = stage.when(F.coalesce(fails, F.lit(False)), name)
    return df.groupBy(stage.otherwise("accepted").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
