"""Lexicon matching beyond the size of one regular expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import WORD


def lexicon_match_table(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """Flag rows with a word that starts with a term of the `terms` table.

    Each distinct word is cut to the distinct term lengths and looked up; the
    join side is chosen by size. Rows without a match keep false.
    """
    lex = terms.select(F.lower(term).alias("__term")).where(~F.col("__term").rlike(f"[^{WORD}]")).distinct()
    lengths = [r[0] for r in lex.select(F.length("__term")).distinct().collect()]  # a few dozen word lengths
    words = F.array_distinct(F.split(F.lower(text), f"[^{WORD}]+"))
    cuts = F.array(*[F.lit(n) for n in lengths])
    heads = (
        df.select(key, F.explode(words).alias("__word"))
        .select(key, F.explode(F.transform(
            F.filter(cuts, lambda n: n <= F.length("__word")), lambda n: F.substring("__word", F.lit(1), n)
        )).alias("__term"))
    )
    found = heads.join(lex, "__term", "left_semi").select(key).distinct().withColumn("__hit", F.lit(True))
    return (
        df.join(found, key, "left")
        .withColumn("lexicon_match", F.coalesce("__hit", F.lit(False))).drop("__hit")
    )
