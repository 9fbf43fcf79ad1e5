"""Near-duplicate removal by cosine, and TF-IDF closeness to a core set. Both exact."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from plumbline import config as C
from plumbline.functions.text import WORD
from plumbline.operators import pivot_tree
from plumbline.session import written

def _has_direction(vec: str):
    """Whether a vector can be near another one: no nulls, finite, not zero."""
    length = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.coalesce((length > 0) & (length < F.lit(float("inf"))), F.lit(False))


def _distinct_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Equal vectors once (`rep` key, number of `copies`), those without a direction left out."""
    return df.where(_has_direction(vec)).groupBy(F.col(vec).alias("v")).agg(
        F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies")
    )


def has_partner(queries: DataFrame, partners: DataFrame, threshold: float, same_table: bool,
                pivots: int = 32, block: int = 4096, earlier: bool = False) -> DataFrame:
    """`rep` of every query vector with a partner at cosine >= threshold.

    Queries are first compared with a few partners. What is left goes over all
    partners in chunks, or, where that is much and a query visits few leaves, down
    a tree that splits cells of more than `block` partners around `pivots` of their
    vectors; see `pivot_tree`. Only query keys leave a task, never pairs. With
    `earlier` only partners of a smaller `rep` count.
    """
    reach = math.acos(min(1.0, max(-1.0, threshold)))
    search = pivot_tree.Search(reach, same_table, earlier)
    own = queries is partners
    partners = pivot_tree.spread(partners)
    queries = partners if own else pivot_tree.spread(queries)
    found, rest, left = pivot_tree.scouted(queries, partners, search, threshold, block)
    tree = pivot_tree.build(partners, pivots, block) if left > pivot_tree.FLAT_BLOCKS * block else None
    if tree and pivot_tree.visits_each(tree, rest, left, search, block) <= pivot_tree.MOST_VISITS:
        last = pivot_tree.partnered(tree, rest, search, threshold, block)
    else:
        last = pivot_tree.flat(rest, partners, search, threshold, left)
    for more in found:
        last = last.unionByName(more)
    return last.distinct()


def _expand(flagged: DataFrame, reps: DataFrame) -> DataFrame:
    return reps.join(flagged.hint("merge"), "rep", "left_semi").select("v")


def _drop_vectors(df: DataFrame, vectors: DataFrame, vec: str) -> DataFrame:
    # Vectors are far larger than the files Spark sizes them by, so they are not broadcast; sorted by a hash first, few are compared.
    gone = vectors.select(F.xxhash64("v").alias("__hash"), F.col("v").alias(vec)).hint("merge")
    return df.withColumn("__hash", F.xxhash64(vec)).join(gone, ["__hash", vec], "left_anti").select(df.columns)


def near_dup_existing(new: DataFrame, existing: DataFrame, threshold: float, key: str = "vec_id",
                      vec: str = "embedding", **options) -> DataFrame:
    """New rows whose highest cosine to the existing set is below the threshold."""
    queries = written(_distinct_vectors(new, key, vec))
    partners = written(_distinct_vectors(existing, key, vec))
    flagged = has_partner(queries, partners, threshold, same_table=False, **options)
    return _drop_vectors(new, _expand(flagged, queries), vec)


def near_dup_within(df: DataFrame, threshold: float, key: str = "vec_id", vec: str = "embedding",
                    mode: str = "drop_both", **options) -> DataFrame:
    """Rows without a near copy in the same table.

    `drop_both`: both members of a pair go. `keep_first`: a row goes if a row of
    a smaller key is near, so the first of each group stays. Vectors that are
    null, zero or not finite, or hold a null, are near nothing and stay.
    """
    reps = written(_distinct_vectors(df, key, vec))
    if mode == "keep_first":
        flagged = has_partner(reps, reps, threshold, same_table=True, earlier=True, **options)
        later = df.join(reps.select(F.col("rep").alias(key)), key, "left_semi")
        return later.join(flagged.select(F.col("rep").alias(key)), key, "left_anti").unionByName(
            df.where(~_has_direction(vec)))
    if mode != "drop_both":
        raise ValueError(f"unknown mode {mode}")
    flagged = has_partner(reps, reps, threshold, same_table=True, **options)
    copies = reps.where("copies > 1").select("v")
    return _drop_vectors(df, _expand(flagged, reps).union(copies), vec)


def near_dup(new: DataFrame, existing: DataFrame | None, threshold: float, key: str = "vec_id",
             vec: str = "embedding", **options) -> DataFrame:
    """Against the existing set first, then among the survivors."""
    left = new if existing is None else near_dup_existing(new, existing, threshold, key, vec, **options)
    return near_dup_within(left, threshold, key, vec, **options)


# --- TF-IDF closeness to a core set -------------------------------------------------


def words(text: str):
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def core_weights(core: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(core_id, term, idf, weight): smooth idf fitted on the core, rows of unit length."""
    stop = C.STOP_WORDS if stop_words is None else stop_words
    tf = core.select(F.col(key).alias("core_id"), F.explode(words(text)).alias("term")).where(
        ~F.col("term").isin(stop)
    ).groupBy("core_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + F.lit(core.count())) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("core_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "core_id").select("core_id", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


#: What one task of `core_similarity` takes: bytes of text, and pairs of a document and a core row.
TASK_BYTES, TASK_PAIRS = 8_000_000, 500_000
#: More tasks than this one shuffle does not deal to; their maps grow and spill instead.
MOST_TASKS = 10_000


def deal_documents(docs: DataFrame, key: str, text: str, core_rows: int) -> DataFrame:
    """(doc, text) dealt by key to tasks that grow in number, not in size, with the documents and the core."""
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    tasks = max((size["bytes"] or 0) / TASK_BYTES, size["rows"] * core_rows / TASK_PAIRS)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).repartition(
        max(least, min(MOST_TASKS, math.ceil(tasks))), "doc")


def core_similarity(docs: DataFrame, key: str, text: str, weights: DataFrame, core_rows: int) -> DataFrame:
    """Highest cosine of each document to any core row; documents sharing no term are absent.

    The documents are dealt by key once. Where the weights are broadcast, all
    that follows stays in that task: a task holds the counts and dot products
    of its own documents only, and nothing else is shuffled.
    """
    vocabulary = weights.select("term", "idf").distinct()
    dealt = deal_documents(docs, key, text, core_rows)
    terms = dealt.select("doc", F.explode(words("text")).alias("term"))
    tf = terms.join(vocabulary, "term").groupBy("doc", "term").agg(
        (F.count(F.lit(1)) * F.first("idf")).alias("w")
    )
    vectors = tf.groupBy("doc").agg(
        F.collect_list(F.struct("term", "w")).alias("terms"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )  # at most one entry per core term
    unit = vectors.select("doc", F.explode("terms").alias("t"), "norm").select(
        "doc", F.col("t.term").alias("term"), (F.col("t.w") / F.col("norm")).alias("w")
    )
    dots = unit.join(weights.select("core_id", "term", "weight"), "term").groupBy("doc", "core_id").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    return dots.groupBy("doc").agg(F.max("dot").alias("similarity")).withColumnRenamed("doc", key)


def tfidf_near_core(docs: DataFrame, core: DataFrame, threshold: float, key: str, text: str,
                    core_key: str, core_text: str, stop_words: list[str] | None = None,
                    broadcast_rows: int = 200_000) -> DataFrame:
    """Documents with `similarity` to the core; `near_core` where it reaches the threshold.

    The core's weights are a written table; up to `broadcast_rows` of them are
    broadcast, more go through shuffled joins. The plan is the same otherwise.
    """
    weights = written(core_weights(core, core_key, core_text, stop_words))
    size = weights.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("core_id").alias("core_rows")).first()
    if size["rows"] <= broadcast_rows:
        weights = F.broadcast(weights)
    close = core_similarity(docs, key, text, weights, size["core_rows"])
    scored = docs.join(close, key, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return scored.withColumn("near_core", F.col("similarity") >= threshold)


def scan_core_set(core: DataFrame, minimum: int = 40) -> DataFrame:
    """The reference set, or nothing at all if it has fewer than `minimum` rows."""
    return core if core.limit(minimum).count() >= minimum else core.limit(0)
