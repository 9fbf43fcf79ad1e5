"""Joins of items with their per-axis judge results, metadata and policy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import config as C
from plumbline.functions import scores as S


def _axis(result: DataFrame, axis: str, key: str) -> DataFrame:
    """Result columns of one axis under names that cannot collide."""
    fields = [c for c in result.columns if c != key]
    return result.select(key, F.struct(*fields).alias(f"__{axis}"))


def join_axes(items: DataFrame, results: dict[str, DataFrame], key: str = "item_id") -> DataFrame:
    """Attach the three axis results; an absent result counts as the error default.

    All joins use the same key, so the items are exchanged once and every
    result table once.
    """
    out = items
    for axis, table in results.items():
        out = out.join(_axis(table, axis, key), key, "left")
    columns = {}
    for axis, table in results.items():
        defaults = C.ERROR_DEFAULTS[axis]
        for f in table.columns:
            if f == key:
                continue
            name = f"{axis}_severity" if f == "severity" else f
            value = F.col(f"__{axis}")[f]
            columns[name] = F.when(F.col(f"__{axis}").isNotNull(), value).otherwise(
                F.lit(defaults.get(f))
            ) if f in defaults else value
        columns[f"{axis}_ok"] = F.col(f"__{axis}").isNotNull()
    out = out.withColumns(columns).drop(*[f"__{a}" for a in results])
    return out.withColumn(
        "combined_score",
        S.combined_score(F.col("ahimsa_score"), F.col("dharma_score"), F.col("helpfulness_score")),
    )


def join_axes_strict(items: DataFrame, results: dict[str, DataFrame], key: str = "item_id") -> DataFrame:
    """As join_axes, but one failed axis turns the whole row into error defaults."""
    joined = join_axes(items, results, key)
    ok = F.col("ahimsa_ok") & F.col("dharma_ok") & F.col("helpfulness_ok")
    columns = {"all_ok": ok}
    for axis, table in results.items():
        for f in table.columns:
            if f in C.ERROR_DEFAULTS[axis]:
                name = f"{axis}_severity" if f == "severity" else f
                columns[name] = F.when(ok, F.col(name)).otherwise(F.lit(C.ERROR_DEFAULTS[axis][f]))
    columns["combined_score"] = F.when(ok, F.col("combined_score"))
    return joined.withColumns(columns)


def join_response_meta(prompts: DataFrame, responses: DataFrame, meta: DataFrame, key: str = "item_id") -> DataFrame:
    return prompts.join(responses, key).join(meta, key)


def scope_table(spark: SparkSession, table: dict | None = None) -> DataFrame:
    rows = [(p, r, float(f)) for (p, r), f in (C.SCOPE_FACTORS if table is None else table).items()]
    return spark.createDataFrame(rows, "scope STRING, response_scope STRING, factor DOUBLE")


def tier_table(spark: SparkSession) -> DataFrame:
    rows = [(t, *p) for t, p in C.TIER_POLICY.items()]
    return spark.createDataFrame(
        rows, "tier STRING, min_level INT, max_level INT, missed DOUBLE, over DOUBLE"
    )


def join_policy(df: DataFrame) -> DataFrame:
    """Rows with their tier policy and scope factor looked up from tables.

    The tables hold three rows and nine rows, one per tier and scope pair.
    """
    spark = df.sparkSession
    looked = df.join(F.broadcast(scope_table(spark)), ["scope", "response_scope"], "left").join(
        F.broadcast(tier_table(spark)), "tier", "left"
    )
    free = (F.col("response_scope") == "S0") | ((F.col("response_scope") == "S1") & (F.col("scope") != "S0"))
    return looked.withColumn("factor", F.when(free, 1.0).otherwise(F.coalesce("factor", F.lit(1.0))))


def join_runs(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The same items of two runs side by side."""
    a = left.select(key, *[F.col(f).alias(f"{f}_left") for f in fields])
    b = right.select(key, *[F.col(f).alias(f"{f}_right") for f in fields])
    return a.join(b, key)


def join_label_counts(original: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Row counts per label before and after relabelling, absent ones zero."""
    a = original.groupBy(label).agg(F.count(F.lit(1)).alias("original_count"))
    b = new.groupBy(label).agg(F.count(F.lit(1)).alias("new_count"))
    return a.join(b, label, "full").select(
        label,
        F.coalesce("original_count", F.lit(0)).alias("original_count"),
        F.coalesce("new_count", F.lit(0)).alias("new_count"),
    )
