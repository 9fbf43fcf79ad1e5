"""Spelling variants: words one letter apart, found by PartEnum signatures.

A word is the multiset of its letters, a binary vector with one dimension per
letter and occurrence. One inserted, deleted or replaced letter changes at most
two dimensions. The dimensions are dealt to `parts` partitions by a hash; two
vectors within distance two agree exactly on some choice of `parts` - 2 of them.
Every word has one signature per such choice, and words meet in an equi-join of
exact signatures. A single edit also leaves the first or the last half of the
shorter word as it was, so a signature holds one of these halves too: without it
words of the same common letters would all meet. Pairs are verified by their
edit distance inside the join. A pair that meets under several signatures leaves
the join under the first one only, so no pair is sorted out afterwards. Tables of
words are joined by sorting and never broadcast, as they grow with the input.

Words are counted inside tasks first (a bounded table, flushed), then summed. A
word has a bounded number of words one edit away, so no group grows with the
table. Chains of forms are followed by doubling steps: counts at least double at
each link, so chains are short.

Nulls: a null text has no word, a null id counts as empty text in the hash.
Empty texts have no word; texts of any length are read in pieces cut between
words. Ties: a word's form is the near word of the largest count, then the first
in code-point order. Repeated rows count each time. Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.packed import mix
from plumbline.session import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Code points looked at at once, and distinct words a task holds before it hands them on.
PIECE, HELD = 1 << 20, 200_000
#: Bits of one partition's value in a signature.
BITS = 16
MOST_ROUNDS = 40


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut between runs, at about `size` code points."""
    at = 0
    while len(text) - at > size:
        stop = at + size
        inside = RUN.match(text, stop)
        stop = inside.end() if inside else stop
        yield text[at:stop]
        at = stop
    yield text[at:]


def altered(run: str, prefix: int, modulus: int) -> str:
    """The run, without one letter if the modulus divides its hash."""
    h = zlib.crc32(run.encode(), prefix)
    if h % modulus:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1:]


def count_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", modulus: int = 97, shortest: int = 5,
                least: int = 3) -> DataFrame:
    """(word, n): lower-cased runs of letters after the seeded deletions."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, body in zip(batch.column("key"), batch.column("body")):
                prefix = zlib.crc32(f"{key.as_py()}:".encode())
                for piece in pieces(body.as_py()):
                    low = piece.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
                    for run, n in Counter(RUN.findall(low)).items():
                        word = altered(run, prefix, modulus)
                        if len(word) >= shortest:
                            held[word] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    key = F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key")
    runs = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("body"))
    total = runs.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= least)


def partition_values(words: list[str], parts: int) -> np.ndarray:
    """One number per word: `parts` values of BITS bits, each a hash of the letters dealt to a partition."""
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    length = np.array([len(p) for p in points], np.int64)
    letter, row = np.concatenate(points).astype(np.uint64), np.repeat(np.arange(len(words)), length)
    order = np.lexsort((letter, row))
    letter, row = letter[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])
    starts = np.flatnonzero(first)
    occurrence = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    dimension = mix(mix(letter + np.uint64(1)) + occurrence.astype(np.uint64))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (row, (dimension % np.uint64(parts)).astype(np.int64)), mix(dimension))
    values = np.zeros(len(words), np.uint64)
    for p in range(parts):
        values |= (mix(sums[:, p]) >> np.uint64(64 - BITS)) << np.uint64(BITS * p)
    return values.view(np.int64)


def signatures(vocabulary: DataFrame, parts: int = 4) -> DataFrame:
    """Signature rows of every word: partition choice, half of the word, length of the shorter word.

    A word of length k meets words of its own length and one longer as itself
    (`own`), and words one shorter with the halves that those have.
    """
    if not 3 <= parts <= 64 // BITS:
        raise ValueError(f"use 3 to {64 // BITS} partitions")

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                values = partition_values(part.column("word").to_pylist(), parts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=["word", "n", "parts"])

    whole = vocabulary.select("word", "n").mapInArrow(valued, "word string, n bigint, parts bigint")
    choices = [sum(1 << p for p in c) for c in combinations(range(parts), parts - 2)]
    masks = [sum(((1 << BITS) - 1) << BITS * p for p in range(parts) if c >> p & 1) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    size = F.length("word")

    def role(own: bool, last: bool) -> Column:
        shorter = size if own else size - 1
        return F.struct(F.lit(own).alias("own"), F.lit(last).alias("last"), shorter.alias("size"))

    roles = F.array(*[role(own, last) for own in (True, False) for last in (False, True)])
    dealt = whole.select("word", "n", "parts", F.explode(roles).alias("r")).select("word", "n", "parts", "r.*")
    half = F.floor(F.col("size") / 2).cast("int")
    text = F.when(F.col("last"), F.expr("right(word, int(size div 2))")).otherwise(F.expr("left(word, int(size div 2))"))
    chosen = F.explode(F.array(*[
        F.struct(F.lit(c).alias("choice"), F.col("parts").bitwiseAND(F.lit(m)).alias("values"))
        for c, m in zip(choices, signed)]))
    out = dealt.withColumns({"half": half, "text": text}).select(
        "word", "n", "parts", "own", "last", "size", "half", "text", chosen.alias("c"))
    return out.select(
        "word", "n", "parts", "own", "last", "size", "half", F.col("c.choice").alias("choice"),
        F.xxhash64("text", "last", "size", "c.choice", "c.values").alias("key"))


def _first_meeting(parts: int) -> Column:
    """Whether the choice is the first one on which both words agree: no earlier partition outside it agrees."""
    def agrees(p: int) -> Column:
        mask = ((1 << BITS) - 1) << BITS * p
        return F.col("a.parts").bitwiseXOR(F.col("b.parts")).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0

    good = F.lit(False)
    for chosen in combinations(range(parts), parts - 2):
        outside = [p for p in range(max(chosen)) if p not in chosen]
        rule = F.col("a.choice") == sum(1 << p for p in chosen)
        for p in chosen:
            rule = rule & agrees(p)
        for p in outside:
            rule = rule & ~agrees(p)
        good = good | rule
    return good


def near_pairs(vocabulary: DataFrame, parts: int = 4) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once, a no longer than b."""
    rows = signatures(vocabulary, parts)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "last", "size", "choice")]
    heads_equal = F.expr("left(a.word, a.half) = left(b.word, a.half)")
    order = F.when(F.col("b.own"), F.col("a.word") < F.col("b.word")).otherwise(F.lit(True))
    rule = F.col("a.own") & order & (F.col("a.last") != heads_equal) & _first_meeting(parts)
    for s in same:
        rule = rule & s
    rule = rule & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    # Spark sizes the rows as if each word had one signature, so it would broadcast too large a table.
    return rows.alias("a").join(rows.alias("b").hint("merge"), rule).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain of forms, by doubling steps."""
    now = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("__next")).hint("merge")
        stepped = written(now.join(onward, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now
    raise RuntimeError(f"chains of forms did not end in {MOST_ROUNDS} rounds")


def variants(vocabulary: DataFrame, parts: int = 4, factor: int = 2) -> DataFrame:
    """Every word with its number of near words, its form and the root of its chain of forms.

    The form is the near word of the largest count if that is at least `factor`
    (two or more, so that chains end) times the word's own.
    """
    if factor < 2:
        raise ValueError("counts must at least double along a chain")
    words = written(vocabulary.select("word", "n"))
    pair = near_pairs(words, parts)
    ways = pair.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near")),
    )).alias("w")).select("w.*")
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    has_form = -F.col("near.less") >= factor * F.col("n")
    found = written(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("near.word")).alias("form"), F.when(has_form, -F.col("near.less")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
