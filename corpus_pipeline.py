"""A corpus pipeline: language, near duplicates, secrets, mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All
but the last return the columns of `documents`; other columns of `docs`, whatever
their names, travel along. Stages are written to the shared folder and read
again, so a lost executor costs at most one stage.

Nulls: a null text has no letter and goes in the first stage. Rows that repeat an
id or have none are rows of their own everywhere. A null source is a source of
its own. Texts of any length are read whole. Of near duplicates the row of the
smallest id stays (a null id comes last), then that of the smallest digest of its
text; rows that are equal in all are one near-duplicate group too. An empty table
stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import jaccard, language, mixing, secrets
from plumbline.llm.pieces import encode_texts
from plumbline.llm.q_language import remainder
from plumbline.llm.q_pieces import model_path
from plumbline.llm.registry import table
from plumbline.session import written

#: Texts whose language scores lower are rejected.
LEAST_SCORE = 0.3
#: Words a shingle and least overlap of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with letters whose language the output codes tell.

    Texts that are null or have no letter go, and so do rows whose best language
    scores below LEAST_SCORE; without any labelled row all rows go.
    """
    model = language.fit(docs, remainder("doc_id", 3) != 1)
    # The other columns as one, so that no name of the input meets a name of the model.
    carried = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = language.predict(carried, model, keep=["row", "text"])
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select("row.*", "text").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates; texts without words are near nothing and stay.

    Rows are told apart by id and text. Rows that repeat both become one, that of
    the least language and source.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                     F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    found = written(jaccard.join(docs.select(place.alias("place"), "text"), NEAR_WORDS, NEAR_PERCENT, "place"))
    dropped = found.where("component_id <> place").select("place").distinct()
    again = found.where("component_id = place AND n_shingles > 0").groupBy("place").count().where("count > 1").select("place")
    left = docs.select(F.struct(*docs.columns).alias("row"), place.alias("place")).join(dropped, "place", "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    least = F.min_by("row", F.struct("row.lang", "row.source")).alias("row")
    single = left.join(again, "place", "left_semi").groupBy("place").agg(least)
    return left.join(again, "place", "left_anti").select("row.*").unionByName(single.select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with secrets masked in their texts; null texts stay null, all rows stay."""
    hidden = secrets.redact(docs, secrets.train(docs))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources reach their targets; a text without words is taken once or not at all."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, with their number and digests; an empty or null text has the end id only."""
    return encode_texts(docs, model_path(), with_ids=True, keep=["lang", "source"])


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Trained classifiers and merge vocabularies are not expressible in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
