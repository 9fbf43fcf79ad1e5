"""Secret scans: base patterns, and a linear-chain conditional random field.

The field tags tokens (runs of letters, digits and `_+/-.`) as outside, begin or
inside a secret. Features: the token's shape (length, character kinds, changes
between letters and digits), what stands between it and its neighbours, hashed
neighbouring words, and properties of the whole file. It adds spans that the
patterns do not cover.

Training. Windows of about `sample_rows` texts are labelled by the base patterns.
As these know a few key words and alphabets only, every secret is also shown
rewritten: under another word of its text, with other quotes and signs, and as a
random string of another alphabet; ordinary words and numbers in the same places
are shown as no secrets. Whole groups of features are left out at random, so that
shape and context each suffice. Tokens with digits or of unusual length that are
no secret are shown too. A part of the windows is held back, and the outside tag
is raised until (nearly) none of its tokens outside is taken for a secret.

Decoding is Viterbi. A token whose outside score leads by more than any change
of its two transitions can win is outside on every best path, so only the runs
between such tokens are decoded; the result is that of the whole chain. A long
text is read in pieces that end at such a token; the file's properties are
counted over the whole text first, and neighbours are seen across the cut, so
tags do not depend on where a text is cut.

Text null or empty: no spans. Without a text that holds a base span there is no
field (None) and `find` returns the base spans; an empty table gives no rows.
Repeated rows each get their row; ties in the score go to the lower tag. Very
long texts are read whole, piece by piece. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.packed import FOLD, SPACE, hashes, owner, runs, slices, unpack

#: Code points of a text that are looked at together; it bounds memory and changes no result.
PIECE = 1 << 20
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")

WORDS = 1 << 12
FIELDS = {"shape": 4096, "gap": 4096, "previous": WORDS, "before": WORDS, "next": WORDS, "file": 64, "file_shape": 4096,
          "random": 64}
_START = dict(zip(FIELDS, np.cumsum([0, *FIELDS.values()]).tolist()))
DIMENSIONS = sum(FIELDS.values())
REACH = 12


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret part) of the base patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, ...]]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def _of(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars.encode())] = True
    return mask


_LOWER = _of("".join(chr(c) for c in range(97, 123)))
_UPPER = _of("".join(chr(c) for c in range(65, 91)))
_DIGIT = _of("0123456789")
_MARK = _of("_+/-.")
_WIDE = np.arange(256) >= 0x80
_TOKEN = _LOWER | _UPPER | _DIGIT | _MARK | _WIDE
_HEXED = _DIGIT | _of("abcdefABCDEF")
_EQUAL, _QUOTE = _of("=:"), _of("\"'")


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    #: index of each feature, one column per field
    features: np.ndarray
    #: per text: tokens, tokens of letters and digits, tokens behind an equals sign or colon
    counts: np.ndarray


def file_index(counts: np.ndarray) -> np.ndarray:
    """Class of a file by the counts of its tokens, below 64."""
    total = np.maximum(counts[:, 0], 1)
    steps = [0.001, 0.01, 0.05]
    file = np.searchsorted(steps, counts[:, 1] / total, "right") * 4 + np.searchsorted(steps, counts[:, 2] / total, "right")
    return file * 4 + np.searchsorted([30, 300, 3000], total, "right")


def tokens(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None) -> Tokens:
    """Tokens of all texts with their feature indices; `counts` are the files' own where texts are pieces of them."""
    starts, ends = runs(_TOKEN[data], offsets)
    row = owner(starts, offsets)
    n, texts = len(starts), len(offsets) - 1

    def within(mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[high] - sums[low]

    length = ends - starts
    kinds = sum(((within(m[data], starts, ends) > 0).astype(np.int64) << k)
                for k, m in enumerate((_LOWER, _UPPER, _DIGIT, _MARK, _WIDE)))
    digit = _DIGIT[data]
    flips = np.zeros(len(data), bool)
    flips[1:] = digit[1:] != digit[:-1]
    changes = np.minimum(np.searchsorted([1, 2, 4, 8], within(flips, np.minimum(starts + 1, ends), ends), "right"), 3)
    size = np.searchsorted([4, 8, 12, 16, 20, 32, 64], length, "right")
    hexed = (within(_HEXED[data], starts, ends) == length).astype(np.int64)
    shape = ((kinds * 8 + size) * 4 + changes) * 2 + hexed  # below 2048

    begin = offsets[row]
    previous_end = np.maximum(np.concatenate([[0], ends[:-1]]), begin) if n else ends
    gap = ((within(_EQUAL[data], previous_end, starts) > 0) * 2 + (within(_QUOTE[data], previous_end, starts) > 0))
    coarse = (kinds * 8 + size) * 4 + gap  # below 1024

    h = (hashes(FOLD[data], starts, ends) % np.uint64(WORDS - 1) + np.uint64(1)).astype(np.int64)

    def neighbour(step: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if n > abs(step):
            a, b = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
            out[b] = np.where(row[a] == row[b], h[a], 0)
        return out

    own = np.column_stack([
        np.bincount(row, minlength=texts), np.bincount(row, weights=(kinds & 4 > 0) & (kinds & 3 > 0), minlength=texts),
        np.bincount(row, weights=gap >= 2, minlength=texts)]).astype(np.int64)
    own_file = file_index(own if counts is None else counts)[row]
    both = ((kinds & 3 > 0) & (kinds & 4 > 0)).astype(np.int64)
    random = (both * 4 + changes) * 8 + np.minimum(size, 4)  # whatever the alphabet
    columns = [shape, coarse, neighbour(-1), neighbour(-2), neighbour(1), own_file, (size * 32 + kinds) * 4 + own_file // 16,
               random]
    return Tokens(starts, ends, row, np.column_stack([c + s for c, s in zip(columns, _START.values())]), own)


@dataclass(frozen=True)
class Field:
    """Emission weights (feature by tag) and transition weights (tag by tag)."""

    emission: np.ndarray
    transition: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        for column in features.T:
            out += self.emission[column]
        return out

    def open_tokens(self, score: np.ndarray) -> np.ndarray:
        """Tokens that may be part of a secret whatever stands around them."""
        swing = float(2 * (self.transition.max() - self.transition.min()))
        return score[:, OUTSIDE] - score[:, 1:].max(1) <= swing

    def decode(self, found: Tokens) -> np.ndarray:
        """Viterbi tags of all tokens, text by text."""
        tags = np.zeros(len(found.row), np.int8)
        if not len(tags):
            return tags
        score = self.scores(found.features)
        open_ = self.open_tokens(score)
        if not open_.any():
            return tags
        at = np.flatnonzero(open_)
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(found.row[at]) != 0)) + 1
        for run in np.split(at, cut):
            first, last = run[0], run[-1]
            left = first > 0 and found.row[first - 1] == found.row[first]
            right = last + 1 < len(tags) and found.row[last + 1] == found.row[last]
            tags[run] = self._path(score[run], left, right)
        return tags

    def _path(self, score: np.ndarray, left: bool, right: bool) -> list[int]:
        """Best tags of one run; `left` and `right` tell of an outside token next to it."""
        best = score[0] + (self.transition[OUTSIDE] if left else 0)
        back = []
        for emission in score[1:]:
            ways = best[:, None] + self.transition
            back.append(ways.argmax(0))
            best = ways.max(0) + emission
        if right:
            best = best + self.transition[:, OUTSIDE]
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def crf_spans(found: Tokens, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first byte, end byte) of each tagged secret; an inside tag with no begin opens one."""
    out: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero(tags):
        row, start, end = int(found.row[i]), int(found.starts[i]), int(found.ends[i])
        if out and tags[i] == INSIDE and i == last + 1 and out[-1][0] == row:
            out[-1] = (row, out[-1][1], end)
        else:
            out.append((row, start, end))
        last = i
    return out


def _bytes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return unpack(pa.array([text], pa.large_string()))


_BLANK = re.compile("[\x20\x09-\x0d]")


def _blank_cut(text: str, at: int) -> int:
    """The first white space from a place on, or the end: no token is cut there."""
    found = _BLANK.search(text, at)
    return found.start() if found else len(text)


def file_counts(text: str) -> np.ndarray:
    """Token counts of a whole text, summed over pieces."""
    total, at = np.zeros((1, 3), np.int64), 0
    while at < len(text):
        stop = _blank_cut(text, min(at + PIECE, len(text)))
        data, offsets = _bytes_of(text[at:stop])
        found = tokens(data, offsets)
        total += found.counts
        # The sign in front of a piece's first token may lie in the piece before.
        if at and len(found.starts):
            before = _LAST_TOKEN_GAP.search(text, max(0, at - PIECE), at)
            own = bytes(data[: found.starts[0]])
            if before and set(before.group(1)) & set("=:") and not set(own) & set(b"=:"):
                total[0, 2] += 1
        at = stop
    return total


#: What stands behind the last token.
_LAST_TOKEN_GAP = re.compile(r"([^A-Za-z0-9_+/.\x80-\U0010ffff-]*)\Z")


def long_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Tagged spans of a text read in pieces, in code points; the same as read at once."""
    counts, out, at, size = file_counts(text), [], 0, PIECE
    while at < len(text):
        stop = _blank_cut(text, min(at + size, len(text)))
        # Tokens on either side are seen as neighbours.
        low = _back(text, at)
        high = _blank_cut(text, min(stop + REACH * 64, len(text))) if stop < len(text) else stop
        data, offsets = _bytes_of(text[low:high])
        found = tokens(data, offsets, counts)
        place = np.cumsum((data & 0xC0) != 0x80)
        starts, ends = low + place[found.starts] - 1, low + place[found.ends - 1]
        inside = np.flatnonzero((starts >= at) & (starts < stop))
        open_ = field.open_tokens(field.scores(found.features)) if len(starts) else np.zeros(0, bool)
        if stop < len(text):
            # Go on from the last token that is surely outside; what follows is decoded with the next piece.
            sure = inside[~open_[inside]]
            if not len(sure) or starts[sure[-1]] <= at:
                if len(inside):
                    size *= 2
                    continue
                at = stop
                continue
            inside = inside[inside < sure[-1]]
            stop = int(starts[sure[-1]])
        tags = field.decode(found)
        keep = np.zeros(len(tags), bool)
        keep[inside] = True
        tags[~keep] = OUTSIDE
        for _, a, b in crf_spans(found, tags):
            out.append((int(low + place[a] - 1), int(low + place[b - 1])))
        at, size = stop, PIECE
    return out


def _back(text: str, at: int) -> int:
    """A place at white space with a few tokens between it and `at`."""
    low = at
    for _ in range(4):
        if not low:
            return 0
        low = max(text.rfind(c, 0, max(low - 1, 0)) for c in " \n\t")
        low = max(low, 0)
    return low


def scan(texts: list[str | None], field: Field | None) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    more: list[list] = [[] for _ in texts]

    def add(k: int, start: int, stop: int) -> None:
        if not any(s[0] < stop and start < s[2] for s in base[k]):
            more[k].append((start, 3, stop, start))

    if field is not None:
        data, offsets = unpack(pa.array([t if t and len(t) <= PIECE else "" for t in texts], pa.large_string()))
        found = tokens(data, offsets)
        for row, start, end in crf_spans(found, field.decode(found)):
            lead = int(((data[offsets[row]:start] & 0xC0) != 0x80).sum())
            add(row, lead, lead + int(((data[start:end] & 0xC0) != 0x80).sum()))
        for k, text in enumerate(texts):
            if text and len(text) > PIECE:
                for start, stop in long_spans(text, field):
                    add(k, start, stop)
    for b, m in zip(base, more):
        yield b, sorted(b + m)


_HEX, _LOW, _BIG = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NUM = "0123456789"


def _random_secret(rng: random.Random) -> str:
    """A string of a random alphabet, as keys and tokens have them."""
    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choices(alphabet, k=rng.randint(low, high)))

    kind = rng.randrange(8)
    if kind == 0:
        body = list(some(_HEX, 24, 64))
        for _ in range(rng.randint(1, 3)):
            body[rng.randrange(len(body))] = rng.choice("ghjkmnpqrstuvwxyz")
        return "".join(body)
    if kind == 1:
        return some(_LOW + _NUM, 20, 48)
    if kind == 2:
        return some(_LOW + _BIG + _NUM, 16, 44)
    if kind == 3:
        return some(_LOW + _BIG + _NUM + "+/", 24, 60)
    if kind == 4:
        return some(_BIG + _NUM, 16, 40)
    if kind == 5:
        return some(_LOW, 2, 5) + rng.choice("_-") + some(_LOW + _BIG + _NUM, 20, 40)
    if kind == 6:
        return ".".join(some(_LOW + _BIG + _NUM + "_-", 18, 40) for _ in range(3))
    return some(_LOW + _BIG + _NUM, 4, 8) + rng.choice("_-/+") + some(_LOW + _BIG + _NUM, 8, 24)


def _no_secret(rng: random.Random, words: list[str]) -> str:
    """What stands in the same places without being a secret."""
    kind = rng.randrange(6)
    if kind == 0:
        return "".join(rng.choices(_NUM, k=rng.randint(1, 16)))
    if kind == 1:
        return ".".join(str(rng.randrange(1000)) for _ in range(rng.randint(2, 4)))
    if kind == 2:
        return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    if kind == 3:
        return rng.choice(words) + str(rng.randrange(100))
    if kind == 4:
        return rng.choice(words) + rng.choice("_-./") + rng.choice(words)
    return rng.choice(words)


def rewritten(text: str, span: tuple[int, int, int, int], rng: random.Random) -> tuple[str, int, int]:
    """A passage around a span with another name and value; where its secret lies (nowhere: equal ends)."""
    before, after = text[max(0, span[0] - 160):span[0]], text[span[2]:span[2] + 160]
    words = re.findall("[^\\W\\d_]+", before + " " + after) or ["a"]
    name = rng.choice(words).lower()
    if rng.random() < 0.3:
        name += rng.choice("_-") + rng.choice(words).lower()
    quote = rng.choice(["\"", "'", ""])
    sign = rng.choice([" = ", "=", ": ", ":", " "])
    secret = rng.random() < 0.6
    value = _random_secret(rng) if secret else _no_secret(rng, words)
    head = f"{before.rstrip(_QUOTES)} {name}{sign}{quote}"
    return f"{head}{value}{quote} {after.lstrip(_QUOTES)}", len(head), len(head) + len(value) * secret


_QUOTES = " \"'"


def _windows(text: str, hits: int, variants: int, odd: int, rng: random.Random) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training windows (features, tags) of one text: around secrets, rewritten ones, odd tokens and one regular place."""
    counts = file_counts(text)
    spans = base_spans(text)
    places = [s[3] for s in spans[:hits]] + [rng.randrange(len(text))]
    numbers = [m.start() for m in _ODD.finditer(text)]
    places += rng.sample(numbers, min(odd, len(numbers)))
    for at in places:
        # A passage that holds the window's tokens whole.
        low, high = _back(text, max(0, at - 40 * REACH)), _blank_cut(text, min(len(text), at + 40 * REACH))
        yield from _window(text[low:high], at - low, [], counts)
    for span in spans[:hits]:
        for _ in range(variants):
            passage, a, b = rewritten(text, span, rng)
            yield from _window(passage, a, [(a, b)] if a < b else [], counts)


#: Long runs and runs with a digit: most are no secrets.
_ODD = re.compile("[\\w+/.-]{16,}|[\\w+/.-]*[0-9][\\w+/.-]*")


def _window(passage: str, at: int, secrets: list[tuple[int, int]], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and tags around a place; what the base patterns find is a secret as well."""
    data, offsets = _bytes_of(passage)
    found = tokens(data, offsets, counts)
    if not len(found.starts):
        return
    gold = np.zeros(len(found.starts), np.int32)
    for a, b in [*secrets, *((s[3], s[2]) for s in base_spans(passage))]:
        low, high = len(passage[:a].encode()), len(passage[:b].encode())
        first, stop = np.searchsorted(found.ends, low, "right"), np.searchsorted(found.starts, high, "left")
        gold[first:stop] = INSIDE
        gold[first:first + 1] = BEGIN if stop > first else gold[first:first + 1]
    centre = int(np.searchsorted(found.ends, len(passage[:at].encode()), "right"))
    low, high = max(0, centre - REACH), min(len(gold), centre + REACH + 1)
    if high <= low:
        return
    x, y = np.full((2 * REACH + 1, len(FIELDS)), -1, np.int32), np.zeros(2 * REACH + 1, np.int32)
    x[: high - low], y[: high - low] = found.features[low:high], gold[low:high]
    yield x.ravel(), y


def train(docs: DataFrame, text: str = "text", id_column: str = "doc_id", sample_rows: int = 3000, hits: int = 4,
          variants: int = 16, odd: int = 3, epochs: int = 60) -> Field | None:
    """A field from windows of about `sample_rows` texts, chosen by a hash of id and text.

    Windows of 2 * REACH + 1 tokens: of each text up to `hits` around secrets that
    the base patterns find, `variants` rewritten passages for each of these, up to
    `odd` tokens that look unusual, and one at any place. None if no secret is found.
    """
    total = docs.count()
    bucket = F.pmod(F.xxhash64(F.col(id_column), F.col(text), F.lit(1)), F.lit(1_000_000))
    part = int(min(1.0, sample_rows / max(total, 1)) * 1_000_000) + 1
    rows = docs.where((bucket < part) & (F.length(text) > 0)).select(F.col(text).alias("text"))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out = []
                for value in piece.column("text").to_pylist():
                    # The same windows of the same text wherever it is read.
                    seed = zlib.crc32(value.encode())
                    held = seed % 5 == 0
                    out += [(x, y, held) for x, y in _windows(value, hits, variants, odd, random.Random(seed))]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.list_(pa.int32())),
                         pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out])],
                        names=["x", "y", "held"])

    sample = rows.mapInArrow(windowed, "x array<int>, y array<int>, held boolean").toPandas()
    if sample.empty:
        return None
    x, y, held = np.vstack(sample["x"]), np.vstack(sample["y"]), sample["held"].to_numpy()
    if not y[~held].any():
        held = np.zeros(len(y), bool)
    if not y.any():
        return None
    order = np.lexsort(np.hstack([y, x]).T[:90])  # the same sums however rows arrive
    x, y, held = x[order].reshape(len(y), 2 * REACH + 1, -1), y[order], held[order]
    field = fit(x[~held], y[~held], epochs)
    return calibrated(field, x[held], y[held]) if held.any() else field


def calibrated(field: Field, x: np.ndarray, y: np.ndarray, share: float = 1e-3, step: float = 0.25) -> Field:
    """The field with its outside tag raised until at most `share` of the given windows without a secret get a tag."""
    clean = x[~y.any(1)]
    if not len(clean):
        return field
    real = clean[:, :, 0] >= 0
    flat = clean[real]
    row = np.repeat(np.arange(len(clean)), real.sum(1))
    none = np.zeros(0, np.int64)
    for k in range(40):
        emission = field.emission.copy()
        # Every token has one shape.
        emission[_START["shape"]:_START["gap"], OUTSIDE] += k * step
        raised = Field(emission, field.transition)
        tags = raised.decode(Tokens(none, none, row, flat, none))
        if len(np.unique(row[tags > 0])) <= share * len(clean):
            break
    return raised


def fit(x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Adagrad on the conditional log likelihood of padded windows (feature -1 is padding).

    In each pass a seeded part of the fields of each window is left out: a third of
    them one by one, or all that tell the context, or all that tell the shape.
    """
    rng = np.random.default_rng(3)
    n, width, fields = x.shape
    real = x[:, :, 0] >= 0
    whole = np.where(x < 0, DIMENSIONS, x)
    emission, transition = np.zeros((DIMENSIONS + 1, 3)), np.zeros((3, 3))
    grown_e, grown_t = np.full(emission.shape, 1e-6), np.full((3, 3), 1e-6)
    gold = np.eye(3)[y] * real[:, :, None]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for _ in range(epochs):
        out = rng.random((n, 1, fields)) < 1 / 3
        group = rng.random((n, 1, 1))
        out = np.where(group < 1 / 4, _CONTEXT, np.where(group < 3 / 8, _SHAPE, out))
        x = np.where(out, DIMENSIONS, whole)
        flat = x.reshape(-1)
        score = emission[x].sum(2)
        score[~real] = 0
        forward, backward = np.zeros((width, n, 3)), np.zeros((width, n, 3))
        forward[0] = score[:, 0]
        for t in range(1, width):
            new = _log_sum(forward[t - 1][:, :, None] + transition, 1) + score[:, t]
            forward[t] = np.where(real[:, t, None], new, forward[t - 1])
        for t in range(width - 2, -1, -1):
            new = _log_sum(transition + (score[:, t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(real[:, t + 1, None], new, backward[t + 1])
        norm = _log_sum(forward[-1], 1)
        node = np.exp(forward + backward - norm[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
        pairs = np.zeros((3, 3))
        for t in range(1, width):
            both = np.exp(forward[t - 1][:, :, None] + transition + (score[:, t] + backward[t])[:, None, :]
                          - norm[:, None, None])
            pairs += (both * real[:, t, None, None]).sum(0)
        off = np.repeat((gold - node).reshape(-1, 3), fields, axis=0)
        grad = np.column_stack([np.bincount(flat, off[:, k], DIMENSIONS + 1) for k in range(3)]) / n - ridge * emission
        grad[-1] = 0
        grown_e += grad**2
        emission += rate * grad / np.sqrt(grown_e)
        grad_t = (gold_pairs - pairs) / n - ridge * transition
        grown_t += grad_t**2
        transition += 0.2 * rate * grad_t / np.sqrt(grown_t)
    return Field(emission[:-1].astype(np.float32), transition.astype(np.float32))


_CONTEXT = np.array([name in ("gap", "previous", "before", "next") for name in FIELDS])
_SHAPE = np.array([name in ("shape", "gap", "file_shape", "random") for name in FIELDS])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def find(docs: DataFrame, field: Field | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of base spans and all spans of every row, in code points."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                rows = list(scan(part.column("__text").to_pylist(), field))
                counts = [pa.array([sum(s[1] == k for s in b) for b, _ in rows], pa.int64()) for k in range(3)]
                digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), *counts, pa.array(digest, pa.string()),
                     pa.array([joined(a) for _, a in rows], pa.string())],
                    names=[id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(id_column, F.col(text).alias("__text")).mapInArrow(found, schema)


def redact(docs: DataFrame, field: Field | None, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with the secret part of every span replaced; null texts stay null."""
    names = docs.columns
    hidden = docs.withColumnRenamed(text, "__text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hidden.schema.fields)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").to_pylist()
                out = [None if t is None else _masked(t, spans, mask) for t, (_, spans) in zip(texts, scan(texts, field))]
                place = part.schema.get_field_index("__text")
                yield part.set_column(place, part.schema.field(place), pa.array(out, part.schema.field(place).type))

    done = hidden.mapInArrow(masked, schema).withColumnRenamed("__text", text)
    return done.select(*names)


def _masked(text: str, spans: list[tuple[int, int, int, int]], mask: str) -> str:
    out, at = [], 0
    for _, _, end, secret in sorted(spans, key=lambda s: s[3]):
        if secret >= at:
            out += [text[at:secret], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
