"""Query over the language model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import kneser_ney
from plumbline.llm.q_language import remainder
from plumbline.llm.registry import query, table


@query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = kneser_ney.score(docs, remainder("doc_id", 10) != 0)
    return found.selectExpr("doc_id", "NOT train AS held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
