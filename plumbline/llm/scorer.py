"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches. Training bins every
statistic once into at most 255 quantile bins; a tree grows best split first, a
split is chosen from histograms of gradients and their curvature, and the larger
child's histogram is its parent's minus the smaller one's. The trees leave
training as flat node arrays (statistic, threshold, left, right, value), and
scoring walks all rows of a batch down one tree at once with array gathers.

The fit uses at most about `sample_rows` labelled ids, chosen by a hash of the
id; labels are the only thing learned from, and statistics the only inputs.

Nulls: a null text is an empty one, and its statistics are 0; a null id has no
label; null labels and labels other than 0 and 1 are left out. An id with
several labels counts with their mean, an id with several texts with its least
row of statistics. Without labelled rows of both classes every score is the
share of label 1, or 0.5 if there is none. Ties between splits go to the first
statistic and the lowest threshold. Texts of any length are read whole, repeated
rows each get their row, an empty table gives no rows and extra columns are not
read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.packed import FOLD, SPACE, hashes, mix, owner, runs, slices, unpack, words

BINS = 255


def _of(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars.encode())] = True
    return mask


_UPPER, _DIGIT = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("0123456789")
_STOP, _COMMA, _LOUD, _BAR = _of(".?"), _of(",;:"), _of("!"), _of("|")
_SIGN = _of("#$%&*+/<=>@[\\]^_`{|}~")
_LETTER = _of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 0x80)

STATISTICS = [
    "words", "lines", "word_length", "word_length_spread", "longest_word", "line_words", "longest_line", "upper", "digits",
    "signs", "bars", "loud", "stops", "commas", "letters", "blanks", "shouted_words", "signed_words", "ended_words",
    "joined_words", "distinct_words", "top_word", "repeated_words", "repeated_pairs", "repeated_lines", "worst_line_signs",
    "worst_line_upper", "worst_line_loud", "short_words", "long_words",
]


def _shares_of_line(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Largest share of marked bytes in any line of each text."""
    sums = np.concatenate([[0], np.cumsum(marks)])
    out = np.zeros(rows)
    np.maximum.at(out, row, (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1))
    return out


def measure(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = unpack(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    chars = np.maximum(size, 1)
    starts, ends = words(data, offsets)
    row = owner(starts, offsets)
    line_starts, line_ends = runs(data != 0x0A, offsets)
    line_row = owner(line_starts, offsets)

    def count(at: np.ndarray) -> np.ndarray:
        return np.bincount(at, minlength=n).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / chars

    def inside(mask: np.ndarray) -> np.ndarray:
        """Marked bytes of each word."""
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return sums[ends] - sums[starts]

    def repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Share of keys that occur more than once in their text, and distinct and largest shares."""
        out = np.zeros((3, n))
        if len(keys):
            _, at, back, times = np.unique(
                mix(keys ^ mix(of.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True, return_counts=True)
            np.maximum.at(out[2], of[at], times)
            out[0] = np.bincount(of, weights=times[back] > 1, minlength=n)
            out[1] = count(of[at])
        return out / np.maximum(count(of), 1)

    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = (lead[ends] - lead[starts]).astype(np.float64)
    n_words, n_lines = count(row), count(line_row)
    total = np.maximum(n_words, 1)
    mean = np.bincount(row, weights=length, minlength=n) / total
    square = np.bincount(row, weights=length**2, minlength=n) / total
    longest, longest_line = np.zeros(n), np.zeros(n)
    np.maximum.at(longest, row, length)
    np.maximum.at(longest_line, line_row, lead[line_ends] - lead[line_starts])
    h = hashes(FOLD[data], starts, ends)
    word_repeats = repeated(h, row)
    follows = np.flatnonzero(row[1:] == row[:-1])
    pair_repeats = repeated(mix(h[follows] * np.uint64(3) + h[follows + 1]), row[follows])
    line_repeats = repeated(hashes(data, line_starts, line_ends), line_row)
    upper, letters = inside(_UPPER), inside(_LETTER)
    signs, stops = inside(_SIGN), inside(_STOP)

    def of_words(marked: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=marked, minlength=n) / total

    lines = (line_starts, line_ends, line_row, n)
    return np.column_stack([
        np.log1p(n_words), np.log1p(n_lines), mean, np.sqrt(np.maximum(square - mean**2, 0)), longest,
        n_words / np.maximum(n_lines, 1), np.log1p(longest_line), share(_UPPER), share(_DIGIT), share(_SIGN), share(_BAR),
        share(_LOUD), share(_STOP), share(_COMMA), share(_LETTER), share(SPACE),
        of_words((upper == letters) & (letters > 1)), of_words(signs > 0), of_words(stops > 0),
        of_words((signs > 0) & (letters > 0)), word_repeats[1], word_repeats[2], word_repeats[0], pair_repeats[0],
        line_repeats[0], _shares_of_line(_SIGN[data], *lines), _shares_of_line(_UPPER[data], *lines),
        _shares_of_line(_LOUD[data], *lines), of_words(length <= 3), of_words(length >= 12),
    ])


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees in one set of arrays; a leaf has statistic -1. `roots` are the first nodes."""

    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                of = self.statistic[node]
                low = x[rows, np.maximum(of, 0)] <= self.threshold[node]
                node = np.where(of < 0, node, np.where(low, self.left[node], self.right[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def constant(share: float = 0.5) -> Forest:
    """A forest without trees."""
    none, no = np.zeros(0, np.int64), np.zeros(0)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Forest(none, no, none, none, no, none, 0, float(np.log(share / (1 - share))))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Rising thresholds of each statistic; a value equal to a threshold lies below it."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > bins - 1:
            middle = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        out.append(middle)
    return out


class _Grower:
    """Grows one tree after another on binned rows."""

    def __init__(self, binned: np.ndarray, cuts: list[np.ndarray], leaves: int, ridge: float, least: float, depth: int):
        self.binned, self.cuts, self.leaves, self.ridge, self.least, self.depth = binned, cuts, leaves, ridge, least, depth
        self.statistics = binned.shape[1]
        self.slots = binned.astype(np.int64) + np.arange(self.statistics) * BINS
        # A split behind a bin needs a threshold there.
        self.allowed = np.zeros((self.statistics, BINS), bool)
        for f, c in enumerate(cuts):
            self.allowed[f, :len(c)] = True

    def histogram(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """Sums of gradients, curvatures and rows per statistic and bin."""
        slots = self.slots[rows].ravel()
        weights = (grad[rows], hess[rows], np.ones(len(rows)))
        sums = [np.bincount(slots, np.repeat(w, self.statistics), self.statistics * BINS) for w in weights]
        return np.stack(sums).reshape(3, self.statistics, BINS)

    def split(self, held: np.ndarray) -> tuple[float, int, int]:
        """Gain, statistic and last bin of the left side of the best split."""
        g, h, n = held[:, 0].sum(1)
        low = held.cumsum(2)
        gl, hl, nl = low
        gain = gl**2 / (hl + self.ridge) + (g - gl)**2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
        gain = np.where(self.allowed & (nl >= self.least) & (n - nl >= self.least), gain, -np.inf)
        best = int(gain.argmax())
        return float(gain.flat[best]), best // BINS, best % BINS

    def tree(self, grad: np.ndarray, hess: np.ndarray, rate: float) -> tuple[list[list], np.ndarray]:
        """Nodes [statistic, threshold, left, right, value] and the value of every row."""
        everything = np.arange(len(grad))
        nodes, members, level = [[-1, 0.0, -1, -1, 0.0]], {0: everything}, {0: 0}
        held = {0: self.histogram(everything, grad, hess)}
        queue: list[tuple] = []

        def offer(node: int) -> None:
            if level[node] < self.depth:
                gain, f, b = self.split(held[node])
                if gain > 1e-6:
                    heapq.heappush(queue, (-gain, node, f, b))

        offer(0)
        while queue and len(members) < self.leaves:
            _, node, f, b = heapq.heappop(queue)
            rows = members.pop(node)
            low = self.binned[rows, f] <= b
            sides = rows[low], rows[~low]
            first = len(nodes)
            nodes[node][:4] = [f, float(self.cuts[f][b]), first, first + 1]
            small = int(len(sides[1]) < len(sides[0]))
            whole = held.pop(node)
            part = self.histogram(sides[small], grad, hess)
            for k in (0, 1):
                nodes.append([-1, 0.0, -1, -1, 0.0])
                members[first + k], level[first + k] = sides[k], level[node] + 1
                held[first + k] = part if k == small else whole - part
            offer(first)
            offer(first + 1)
        value = np.zeros(len(grad))
        for node, rows in members.items():
            nodes[node][4] = float(-rate * grad[rows].sum() / (hess[rows].sum() + self.ridge))
            value[rows] = nodes[node][4]
        return nodes, value


def grow(x: np.ndarray, y: np.ndarray, trees: int = 150, leaves: int = 12, depth: int = 8, rate: float = 0.08,
         ridge: float = 2.0, least: int = 10, bins: int = BINS) -> Forest:
    """Boost trees with logistic loss; targets may lie between 0 and 1."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    cuts = _cuts(x, min(bins, BINS))
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]).astype(np.uint8)
    grower = _Grower(binned, cuts, leaves, ridge, least, depth)
    base = constant(float(y.mean())).base
    total = np.full(len(y), base)
    flat: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        nodes, value = grower.tree(p - y, np.maximum(p * (1 - p), 1e-6), rate)
        total += value
        at = len(flat)
        roots.append(at)
        flat += [[f, t, a + at if a >= 0 else at, b + at if b >= 0 else at, v] for f, t, a, b, v in nodes]
    statistic, threshold, left, right, values = zip(*flat)
    return Forest(np.array(statistic), np.array(threshold), np.array(left), np.array(right), np.array(values),
                  np.array(roots), depth, base)


def fit(docs: DataFrame, labels: DataFrame, chosen: Column, id_column: str = "doc_id", text: str = "text",
        label: str = "quality", sample_rows: int = 20_000, **shape) -> Forest:
    """A forest from the labelled ids that `chosen`, a condition on the label rows, allows."""
    known = labels.where(chosen & F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    total = known.count()
    bucket = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000))
    sample = known.where(bucket < int(min(1.0, sample_rows / max(total, 1)) * 1_000_000) + 1)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(sample, "id", "left_semi")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(list(measure(part.column("text"))), pa.list_(pa.float64()))], names=["id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = texts.mapInArrow(measured, f"id {kind}, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    found = rows.join(sample, "id").orderBy("id").select("x", "y").toPandas()
    if found.empty:
        return constant()
    return grow(np.vstack(found["x"].to_numpy()), found["y"].to_numpy(float), **shape)


def score(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score and prediction of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = forest.score(measure(part.column("__text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    names=[id_column, "score", "predicted"])

    return docs.select(id_column, F.col(text).alias("__text")).mapInArrow(
        scored, f"`{id_column}` {kind}, score double, predicted int")
