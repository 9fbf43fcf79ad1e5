"""Query over the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import scorer
from plumbline.llm.q_language import remainder
from plumbline.llm.registry import query, table


@query("op11_scorer")
def op11_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    forest = scorer.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scorer.score(docs, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")
