"""Query over the Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard
from plumbline.llm.registry import query, table


@query("op7_jaccard")
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
