"""Quality rules as gradient-boosted trees over document statistics.

Statistics of every whole text are computed in Arrow batches; trees are grown by
histograms on at most `sample_rows` labelled rows, with logistic loss. Features
named in `falling` may only lower the score as they rise: a split that would
break this is not made, and children are kept on their side of the midpoint.
The trees are flattened into complete binary arrays (feature, threshold, leaf
value), so scoring a batch takes `depth` gathers per tree.

Text null or empty: all statistics are 0, the base rule fails. Without labelled
rows of both classes the verdict is `kept` for what passes the base rule.
Repeated rows each get their row. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.packed import gram_hashes, hashes, mix, owner, runs, slices, unpack, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits",
            "signs", "ends", "line_words", "short_words", "long_words", "marks_per_word", "top_word"]
FALLING = ["symbols", "dup_lines", "repeats"]


def _mask(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars.encode())] = True
    return mask


_SYMBOL = _mask(SYMBOLS)
_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _mask("0123456789")
_SIGN = _mask("".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()))
_END = _mask(".!?")


def _repeats(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks of keys that occur twice or more within their row."""
    if not len(keys):
        return np.zeros(0, bool)
    both = mix(keys ^ mix(rows.astype(np.uint64)))
    _, back, count = np.unique(both, return_inverse=True, return_counts=True)
    return count[back] > 1


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (COUNTS) and features (FEATURES) of each text."""
    data, offsets = unpack(texts)
    n = len(offsets) - 1
    starts, ends = words(data, offsets)
    row = owner(starts, offsets)

    def per_row(marks_at: np.ndarray) -> np.ndarray:
        return np.bincount(marks_at, minlength=n).astype(np.float64)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = lead[ends] - lead[starts]
    n_words = per_row(row)
    word_chars = np.bincount(row, weights=length, minlength=n)
    h = hashes(data, starts, ends)

    grams, first = gram_hashes(h, row, WINDOW)
    repeated = first[_repeats(grams, row[first])]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    n_repeat = per_row(row[covered])

    line_starts, line_ends = runs(data != 0x0A, offsets)
    line_row = owner(line_starts, offsets)
    word_line = np.searchsorted(line_starts, starts, "right") - 1
    full = np.zeros(len(line_starts), bool)
    full[word_line] = True
    keys = mix(hashes(data, line_starts[full], line_ends[full]) ^ mix(line_row[full].astype(np.uint64)))
    n_lines = per_row(line_row[full])
    _, at = np.unique(keys, return_index=True)
    n_dup = n_lines - per_row(line_row[full][at])

    word_keys = mix(h ^ mix(row.astype(np.uint64)))
    _, at, count = np.unique(word_keys, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, row[at], count)
    symbols = of_bytes(_SYMBOL[data])
    chars = np.maximum(word_chars, 1)
    total = np.maximum(n_words, 1)
    last = np.zeros(n)
    np.add.at(last, row[_END[data[ends - 1]]], 1)
    marks = np.add.reduceat(_SIGN[data].astype(np.int64), starts) if len(starts) else np.zeros(0)
    features = np.column_stack([
        np.log1p(n_words), word_chars / total, symbols / chars, n_dup / np.maximum(n_lines, 1), n_repeat / total,
        per_row(row[at]) / total, of_bytes(_UPPER[data]) / chars, of_bytes(_DIGIT[data]) / chars,
        of_bytes(_SIGN[data]) / chars, last / total, n_words / np.maximum(n_lines, 1),
        per_row(row[length <= 3]) / total, per_row(row[length >= 12]) / total,
        per_row(row[marks >= 2]) / total, top / total,
    ])
    counts = np.column_stack([n_words, word_chars, symbols, n_dup, n_repeat]).astype(np.int64)
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, repeat = counts[:, 0], counts[:, 4]
    return (n_words < 10) | (100 * repeat > 20 * n_words)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[tree][node]] > self.threshold[tree][node])
            total += self.value[tree][node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, falling: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2,
         bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosted trees on a bounded sample; features in `falling` never raise the score."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]) if len(x) else x.astype(int)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(inner):
            low, high = bounds[k]
            rows = np.flatnonzero(node == k)
            split = _best_split(binned[rows], grad[rows], hess[rows], cuts, falling, low, high, ridge, least)
            right = np.zeros(len(rows), bool)
            bounds[2 * k + 1] = bounds[2 * k + 2] = (low, high)
            if split is not None:
                f, b, left_value, right_value = split
                feature[t, k], threshold[t, k] = f, cuts[f][b]
                right = binned[rows, f] > b
                if f in falling:
                    middle = (left_value + right_value) / 2
                    bounds[2 * k + 1], bounds[2 * k + 2] = (middle, high), (low, middle)
            node[rows] = 2 * k + 1 + right
        for leaf in range(leaves):
            rows = node == inner + leaf
            low, high = bounds[inner + leaf]
            if rows.any():
                value[t, leaf] = rate * np.clip(-grad[rows].sum() / (hess[rows].sum() + ridge), low, high)
            elif low > 0 or high < 0:
                value[t, leaf] = rate * np.clip(0, low, high)
        total += value[t][node - inner]
    return Trees(feature, threshold, value, depth, base)


def _best_split(binned, grad, hess, cuts, falling, low, high, ridge, least):
    """Feature, bin and side values of the best allowed split, or None."""
    if len(grad) < 2 * least:
        return None
    g, h = grad.sum(), hess.sum()
    best, found = 1e-6, None
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        size = len(cut) + 1
        gl = np.cumsum(np.bincount(binned[:, f], grad, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], hess, size))[:-1]
        nl = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        left = np.clip(-gl / (hl + ridge), low, high)
        right = np.clip(-(g - gl) / (h - hl + ridge), low, high)
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        allowed = (nl >= least) & (len(grad) - nl >= least)
        if f in falling:
            allowed &= left >= right
        gain = np.where(allowed, gain, -np.inf)
        b = int(gain.argmax())
        if gain[b] > best:
            best, found = gain[b], (f, b, float(left[b]), float(right[b]))
    return found


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = 12_000, falling: list[str] | None = None) -> Trees | None:
    """Grow trees on about `sample_rows` labelled documents, chosen by a hash of the id.

    None if the sample does not hold both classes. Only ids and statistics of
    the sample reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label).cast("double").alias("label"))
    total = known.count()
    bucket = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000))
    wanted = int(min(1.0, sample_rows / max(total, 1)) * 1_000_000) + 1
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(bucket < wanted)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = texts.mapInArrow(measured, f"id {kind}, x array<double>").join(known.where(bucket < wanted), "id")
    found = rows.select("x", "label").toPandas()
    y = found["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    names = FALLING if falling is None else falling
    return grow(np.vstack(found["x"]), y, [FEATURES.index(f) for f in names])


def assess(docs: DataFrame, trees: Trees | None, id_column: str = "doc_id", text: str = "text",
           threshold: float = 0.4) -> DataFrame:
    """Counts, base rule, score and verdict of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    schema += ", base_failed boolean, kept boolean, score double"

    def assessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                counts, x = statistics(part.column("__text"))
                failed = base_failed(counts)
                score = trees.score(x) if trees is not None else np.ones(len(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), *(pa.array(c) for c in counts.T), pa.array(failed),
                     pa.array(~failed & (score >= threshold)), pa.array(score)],
                    names=[id_column, *COUNTS, "base_failed", "kept", "score"],
                )

    return docs.select(id_column, F.col(text).alias("__text")).mapInArrow(assessed, schema)
