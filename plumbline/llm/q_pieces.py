"""Query over the SentencePiece operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.pieces import encode_texts
from plumbline.llm.registry import query, table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model_path())
