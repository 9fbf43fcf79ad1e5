"""The reward chain of a training step as one plan: checks, scores, rewards, audit rows and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline import config as C
from plumbline.functions import labels as L
from plumbline.operators import scoring
from plumbline.operators.ordering import add_rank, hash_block, hash_order
from plumbline.operators.sequence import ema_mean_std
from plumbline.session import written

MODES = ["full", "reward_only", "policy_only"]
#: Batches of more rows are ranked by blocks, smaller ones whole in a task.
BATCH_ROWS = 100_000


def batch_status(calls: DataFrame, batch: str, key: str, prompt: str = "prompt", label: str = "label",
                 completion: str = "completion", rate: float = C.VERIFY_SAMPLE_RATE, seed: int = 42) -> DataFrame:
    """(batch, status): `length` if a prompt, label or completion is missing, else `hash` if a sampled label fails.

    A seeded share of a batch's rows, at least one, is verified. A batch of at most
    BATCH_ROWS rows is ranked by one window; ranks of larger ones come from hash
    blocks, so a batch of any size is many tasks.
    """
    digest = hash_order(F.col(key), seed)
    slim = calls.select(batch, key, digest.alias("__digest"), (
        F.col(prompt).isNull() | F.col(label).isNull() | F.col(completion).isNull()).alias("__missing"),
        L.verify_hash(F.col(prompt), F.col(label)).alias("__ok"))
    sizes = calls.groupBy(F.col(batch).alias("__batch")).agg(F.count(F.lit(1)).alias("__size"))
    large = written(sizes.where(F.col("__size") > BATCH_ROWS))
    hot = None if large.isEmpty() else F.col(batch).eqNullSafe(F.col("__batch"))
    small = slim if hot is None else slim.join(F.broadcast(large), hot, "left_anti")
    # A digest holds the key, so it alone gives the order; as bytes it takes half the room.
    small = small.select(batch, F.unhex("__digest").alias("__digest"), "__missing", "__ok")
    whole = W.partitionBy(batch)
    ranked = small.withColumns({"rn": F.row_number().over(whole.orderBy("__digest")), "rows": F.count(F.lit(1)).over(whole)})
    chosen = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("rows") * rate))

    def status(ranked: DataFrame) -> DataFrame:
        found = ranked.groupBy(batch).agg(
            F.bool_or("__missing").alias("short"), F.bool_or(chosen & ~F.coalesce("__ok", F.lit(False))).alias("broken"))
        return found.select(batch, F.when(F.col("short"), "length").when(F.col("broken"), "hash").otherwise("ok").alias("status"))

    if hot is None:
        return status(ranked)
    cut = slim.join(F.broadcast(large), hot, "left_semi")
    blocks = add_rank(cut, ["__digest", key], hash_block(F.col("__digest")), by=[batch], total="rows")
    return status(ranked).unionByName(status(blocks))


def training_rewards(calls: DataFrame, batch: str, key: str, apply_severity: bool = False, **checks) -> DataFrame:
    """Rows with their scores, the reward of every mode and the status of their batch.

    Rows of a batch that fails a check have reward 0 in all modes. Needs the
    typed judge answers (see `scoring.score_all`).
    """
    status = batch_status(calls, batch, key, **checks)
    scored = scoring.rewards(scoring.score_all(calls), apply_severity)
    # One row per batch, so it is hashed and the calls need no sort.
    out = scored.join(status.hint("shuffle_hash"), batch, "left").withColumn("status", F.coalesce("status", F.lit("length")))
    return out.withColumns({
        f"{m}_reward": F.when(F.col("status") == "ok", F.col(f"{m}_reward")).otherwise(F.lit(0.0)) for m in MODES})


def training_averages(rewarded: DataFrame, run: str, step: str, apply_severity: bool = False,
                      mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """Audit rows of the batches that passed, and the moving averages of their step means and deviations."""
    audit = scoring.audit_rows(rewarded.where("status = 'ok'"), apply_severity, mode)
    return audit, ema_mean_std(audit, run, step)
