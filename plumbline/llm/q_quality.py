"""Query over the quality trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import quality
from plumbline.llm.registry import query, table


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, trees)
