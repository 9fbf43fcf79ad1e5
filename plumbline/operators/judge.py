"""Judge answers: parsing whole tables, batched answers, user-supplied scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline import config as C
from plumbline.functions import answers as A, text as T


def parse_answers(raw: DataFrame, axis: str, column: str = "raw") -> DataFrame:
    """Typed columns of one axis, with the parse strategy and the reject reason.

    Keys are fixed before typing; an unusable answer gets the neutral defaults.
    """
    found = raw.withColumn("__found", A.extract_object(F.col(column)))
    named = found.withColumn("strategy", F.col("__found.strategy")).withColumn(
        "fields", A.fix_keys(F.col("__found.fields"), axis)
    )
    typed = named.withColumns({
        "missing_before": F.size(A.missing_keys(F.col("__found.fields"), axis)),
        "missing": A.missing_keys(F.col("fields"), axis),
        "__typed": A.typed_answer(F.col("fields"), axis),
        "reasoning": A.ensure_reasoning(F.col("fields")["reasoning"]),
    })
    reason = (
        F.when(F.col("strategy").isNull(), "no_json")
        .when(F.size("missing") > 0, "missing_keys")
        .when(~F.col("__typed.usable"), "bad_value")
    )
    keys = list(C.PARSE_DEFAULTS[axis])
    return typed.withColumns({
        "reject_reason": reason, "used_default": ~F.col("__typed.usable"),
        **{k: F.col(f"__typed.{k}") for k in keys},
    }).drop("__found", "__typed", "fields")


def strategy_yield(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("used_default").alias("defaulted")
    )


def error_defaults(items: DataFrame, results: DataFrame, axis: str, key: str = "item_id") -> DataFrame:
    """Items with their axis results; failed items get zeros and a violation."""
    fields = [c for c in results.columns if c != key]
    wrapped = results.select(key, F.struct(*fields).alias("__r"))
    defaults = C.ERROR_DEFAULTS[axis]
    joined = items.join(wrapped, key, "left")
    failed = F.col("__r").isNull()
    return joined.select(
        *items.columns,
        *[F.when(failed, F.lit(defaults.get(f))).otherwise(F.col("__r")[f]).alias(f) for f in fields],
        failed.alias("failed"),
    )


def batch_answer_expand(items: DataFrame, answers: DataFrame, key: str = "item_id") -> DataFrame:
    """One answer holding a list for the items of a chunk: place j belongs to item j.

    Items have chunk_id and pos; a list of the wrong length gives every item of
    the chunk a null answer.
    """
    sizes = items.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("__items"))
    parsed = answers.select("chunk_id", A.extract_array(F.col("raw")).alias("__list")).join(sizes, "chunk_id")
    whole = parsed.where(F.size("__list") == F.col("__items"))
    elements = whole.select("chunk_id", F.posexplode("__list").alias("pos", "__v")).select(
        "chunk_id", "pos", F.col("__v").try_cast("map<string,string>").alias("fields")
    )
    return items.join(elements, ["chunk_id", "pos"], "left")


def judge_batch(items: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                defaults: dict, size: int = 10) -> DataFrame:
    """Call a scorer on batches of `size` rows inside each task.

    The scorer returns one row per item in order. A batch that raises, and
    items missing at the end of a short result, get `defaults`.
    """
    fields = list(defaults)
    columns = items.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at:at + size].reset_index(drop=True)
                try:
                    got = score(part)[fields].reset_index(drop=True).iloc[:len(part)]
                    error = None
                except Exception as e:  # a failed call must not fail the job
                    got, error = pd.DataFrame(columns=fields), type(e).__name__
                short = len(part) - len(got)
                if short:
                    fill = pd.DataFrame([defaults] * short, columns=fields)
                    failed = [None] * len(got) + [error or "missing"] * short
                    got = fill if got.empty else pd.concat([got, fill], ignore_index=True)
                else:
                    failed = [None] * len(part)
                yield pd.concat([part, got], axis=1).assign(scorer_error=failed)

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.select(*columns).mapInPandas(run, f"{base}, {schema}, scorer_error string")


def policy_column(rule: dict, text: Column) -> Column:
    """Score column of one named policy: keyword, regex or lookup, from its config row."""
    kind = rule["kind"]
    if kind == "keyword":
        hits = T.keyword_hits(text, rule["terms"])
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(rule["base"]) + rule["per_hit"] * hits))
    if kind == "regex":
        return F.when(T.matches_any(text, rule["terms"]), F.lit(rule["hit"])).otherwise(F.lit(rule["miss"]))
    if kind == "lookup":
        expr = F
        for value, score in rule["table"].items():
            expr = expr.when(text == value, F.lit(score))
        return expr.otherwise(F.lit(rule["miss"]))
    raise ValueError(f"unknown policy kind {kind}")


def register_policy(df: DataFrame, policies: dict[str, dict]) -> DataFrame:
    """One score column per configured policy; `on` names the text column."""
    return df.withColumns({f"policy_{n}": policy_column(r, F.col(r["on"])) for n, r in policies.items()})
