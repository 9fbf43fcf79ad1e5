"""Query over the spelling variants. SQL has no crc32 in the engine that states results, so there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import spelling
from plumbline.llm.registry import query, table


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs))
