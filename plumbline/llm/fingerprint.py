"""I-Match document fingerprints, with built-in functions only.

Terms are the distinct words of a text with A-Z lowered. The lexicon keeps the
terms found in more than `LOW` and at most `HIGH` of all documents: a band of
inverse document frequency, whose lower end bounds the lexicon by the mean
number of terms of a document over LOW, however many documents there are. A
term stands as a number: 39 bits of its digest, then one bit for each
sub-lexicon. A document's lexicon terms are sorted by it and hashed: once all of them, and once for
each of `SUBSETS` randomised sub-lexicons, which hold 1/2 to 1/256 of the
lexicon. Two fingerprints are as alike as the share of hashes they have in
common among those that either has. Small subsets often survive an edit, the
whole list tells exact copies of the term set.

A text without a lexicon term has the digest of its lowered text as its first
hash and no others. Null is empty. Equal texts have equal fingerprints. Rows of
one id are ordered by text; a null id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.operators.ordering import key_blocks
from plumbline.session import written

LOW, HIGH = 0.001, 0.02
SUBSETS = 24
RATES = 8
BROADCAST_TERMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def terms(text: Column) -> Column:
    """Distinct words of a text, A-Z lowered."""
    return F.array_distinct(F.array_remove(F.split(folded(text), BLANKS), ""))


def term_number(term: Column) -> Column:
    """The term's number. Bit k: it is in sub-lexicon k, which holds 2 ** -(k % RATES + 1) of all terms."""
    code = F.conv(F.substring(F.md5(term.cast("binary")), 1, 12), 16, 10).cast("bigint") % (1 << 39)
    mask = code * (1 << SUBSETS)
    for k in range(SUBSETS):
        digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), term).cast("binary")), 1, 8), 16, 10).cast("bigint")
        mask = mask + F.when(digits % (2 ** (k % RATES + 1)) == 0, F.lit(1 << k).cast("bigint")).otherwise(
            F.lit(0).cast("bigint"))
    return mask


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> tuple[DataFrame, int]:
    """Written table (term, number) of the terms in the band, and its number of rows."""
    total = docs.count()
    counted = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))
    kept = written(counted.where((F.col("n") > low * total) & (F.col("n") <= F.greatest(F.lit(high * total), F.lit(2.0)))).select(
        "term", term_number(F.col("term")).alias("number")))
    return kept, kept.count()


def _digest(found: Column) -> Column:
    """Short hash of sorted terms; empty if there are none."""
    return F.when(F.size(found) > 0, F.substring(F.md5(F.array_join(
        F.transform(found, lambda t: F.shiftright(t, SUBSETS).cast("string")), " ").cast("binary")), 1, 8)).otherwise("")


def _subset(found: Column, k: int) -> Column:
    return F.filter(found, lambda t: t.bitwiseAND(F.lit(1 << k).cast("bigint")) != 0)


def signatures(found: Column, whole: Column) -> Column:
    """Hashes of sorted term numbers: of all, then of each subset; `whole` where there are none."""
    first = F.when(F.size(found) > 0, _digest(found)).otherwise(F.concat(F.lit("t"), F.substring(whole, 1, 16)))
    return F.array(first, *[_digest(_subset(found, k)) for k in range(SUBSETS)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that either fingerprint has."""
    both = F.zip_with(a, b, lambda x, y: F.struct(
        ((x == y) & (x != "")).cast("int").alias("same"), ((x != "") | (y != "")).cast("int").alias("any")))
    sums = F.aggregate(both, F.struct(F.lit(0).alias("same"), F.lit(0).alias("any")), lambda s, p: F.struct(
        (s["same"] + p["same"]).alias("same"), (s["any"] + p["any"]).alias("any")))
    return F.when(sums["any"] > 0, sums["same"] / sums["any"]).otherwise(1.0)


def with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, text, place, next_text, next_place): the next by falling id; the first follows the last.

    A place is a number: that of an id range, then the row's in it.

    The table is cut into id ranges; the first row of each is copied to the end
    of the one before it, so one exchange and a window inside the ranges do.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.count()
    # Blocks rise as ids fall; null ids are the last block.
    block = F.coalesce(F.lit(2**30) - key_blocks(rows, "id", rows=max(4_000, total // 65_536)), F.lit(2**30 + 1)).cast("bigint")
    blocked = rows.withColumn("block", block)
    heads = blocked.groupBy("block").agg(F.max("id").alias("head"))
    order, every = W.orderBy("block"), W.partitionBy(F.lit(1))
    heads = heads.select("block", "head", F.coalesce(F.lag("block").over(order), F.max("block").over(every)).alias("earlier"),
                         F.coalesce(F.lead("block").over(order), F.min("block").over(every)).alias("later"))
    marked = blocked.join(F.broadcast(heads), "block")
    is_head = F.col("id").eqNullSafe(F.col("head"))
    own = F.struct(F.col("block").alias("at"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("earlier").alias("at"), F.lit(1).alias("copy"))
    dealt = marked.withColumn("to", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own)))).select(
        "id", "text", "later", F.col("to.at").alias("at"), F.col("to.copy").alias("copy"))
    inside = W.partitionBy("at").orderBy("copy", F.col("id").desc_nulls_last(), "text")
    seen = dealt.withColumns({"rn": F.row_number().over(inside), "next_text": F.lead("text").over(inside),
                              "next_copy": F.lead("copy").over(inside)})
    return seen.where("copy = 0").select(
        "id", "text", (F.shiftleft("at", 32) + F.col("rn")).alias("place"), "next_text",
        F.when(F.col("next_copy") == 1, F.shiftleft("later", 32) + 1).otherwise(
            F.shiftleft("at", 32) + F.col("rn") + 1).alias("next_place"))


def edited(text: Column, following: Column) -> Column:
    """The last third of a text's characters replaced by as many, or all, from the start of the next text."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and their likeness."""
    band, size = lexicon(docs, text)
    # The empty term is in no text; its row carries what is known of the document.
    band = band.unionByName(docs.sparkSession.createDataFrame([("", None)], "term string, number bigint"))
    band = F.broadcast(band) if size <= BROADCAST_TERMS else band
    paired = with_next(docs, id_column, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    facts = F.struct(
        "id", "next_place", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.md5(folded(F.col("text")).cast("binary")).alias("whole"),
        F.md5(folded(F.col("edited")).cast("binary")).alias("edited_whole"))
    none = F.lit(None).cast(paired.select(facts.alias("f")).schema["f"].dataType)
    sides = paired.select("place", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), facts.alias("facts"), F.array(F.lit("")).alias("terms")),
        F.struct(F.lit(1).alias("v"), none.alias("facts"), terms(F.col("text")).alias("terms")),
        F.struct(F.lit(2).alias("v"), none.alias("facts"), terms(F.col("edited")).alias("terms")))).alias("side"))
    single = sides.select("place", "side.v", "side.facts", F.explode("side.terms").alias("term"))
    known = single.join(band, "term")
    # Rows of one document lie together, so the partial sums leave one row each.
    grouped = known.groupBy("place").agg(
        F.max("facts").alias("facts"), F.collect_list(F.when(F.col("v") == 1, F.col("number"))).alias("a"),
        F.collect_list(F.when(F.col("v") == 2, F.col("number"))).alias("b"))
    ordered = grouped.select("place", "facts.*", F.array_sort("a").alias("a"), F.array_sort("b").alias("b"))
    marked = written(ordered.select(
        "id", "place", "next_place", "n_chars", "edited_sha256",
        signatures(F.col("a"), F.col("whole")).alias("own"),
        signatures(F.col("b"), F.col("edited_whole")).alias("changed")))
    following = marked.select(F.col("place").alias("next_place"), F.col("own").alias("next_own"))
    return marked.join(following, "next_place").select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256",
        F.array_join("own", "-").alias("fingerprint"), F.array_join("changed", "-").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"))
