"""Query over the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import secrets
from plumbline.llm.registry import query, table


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find(docs, secrets.train(docs))
