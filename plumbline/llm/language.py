"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary n-gram classifier per bit tells
the languages with that bit set from the others. A text's margins are compared
with every codeword, each bit's loss weighted by how well that bit's classifier
does on that language; the codeword of least loss wins, and a small lead over
the next one flags the text as ambiguous.

The classifiers are log ratios of hashed byte n-gram frequencies, counted over
all labelled rows in one pass (a few thousand counters per language leave a
task). Bit weights come from a sample of about `sample_rows` labelled rows.
`DIMENSIONS` counters per language reach the driver; more than `MAX_LANGUAGES`
labels stop the fit, none is left out.

Text null or without a letter: `und`, score 0, not ambiguous. No labelled rows:
`und` for all. An empty table gives no rows. Rows with a null label teach nothing. Repeated rows each get
their row. Ties go to the first language in code point order. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.packed import slices, unpack

DIMENSIONS = 8192
MAX_LANGUAGES = 1000
UNKNOWN = "und"
SMOOTHING = 0.5
SCORE_SHARPNESS = 6.0


def _letters_only() -> np.ndarray:
    """Bytes as they are in letters; other ASCII becomes a space."""
    fold = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalpha():
            fold[b] = 0x20
    return fold


_FOLD = _letters_only()


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte pairs and triples of lower-cased texts, one row per text."""
    data, offsets = unpack(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    rows = len(offsets) - 1
    out = np.zeros(rows * DIMENSIONS, np.float32)
    if len(data) < 2:
        return out.reshape(rows, DIMENSIONS)
    b = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(b))
    for n in (2, 3):
        code = np.zeros(len(b) - n + 1, np.uint32)
        for k in range(n):
            code = code * np.uint32(251) + b[k:len(b) - n + 1 + k] + np.uint32(n)
        code = (code * np.uint32(2654435761)) >> np.uint32(19)
        inside = (at[: len(code)] + n <= last[: len(code)]) & ~((b[: len(code)] == 0x20) & (b[1:len(code) + 1] == 0x20))
        key = row[: len(code)][inside] * DIMENSIONS + code[inside]
        out += np.bincount(key, minlength=len(out)).astype(np.float32)
    return out.reshape(rows, DIMENSIONS)


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """Rows of -1 and 1: every two-way split of a few languages, else random splits with far rows."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = range(1, 2 ** (languages - 1))
        return np.array([[1 if k == 0 or not (s >> (k - 1)) & 1 else -1 for s in splits] for k in range(languages)])
    bits = int(np.ceil(15 * np.log2(languages)))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (languages, bits))
        code[0, np.abs(code.sum(0)) == languages] *= -1
        gap = ((bits - code @ code.T) / 2 + np.eye(languages) * bits).min()
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        return counts @ self.weights / np.sqrt(total)

    def decode(self, margins: np.ndarray, lead: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and ambiguity of each row of margins."""
        loss = np.empty((len(margins), len(self.languages)))
        for k in range(len(self.languages)):
            loss[:, k] = np.logaddexp(0, -margins * self.codes[k]) @ self.trust[k]
        best = loss.argmin(1)
        share = np.exp(-SCORE_SHARPNESS * (loss - loss.min(1, keepdims=True)))
        score = share.max(1) / share.sum(1)
        ordered = np.sort(loss, 1)
        close = ordered[:, 1] - ordered[:, 0] < lead if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, score, close


def fit(docs: DataFrame, train: Column, text: str = "text", label: str = "lang",
        id_column: str = "doc_id", sample_rows: int = 2000) -> LanguageModel:
    """Count n-grams per language over all rows where `train` holds, and weigh the bits."""
    rows = docs.where(train & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.col(id_column).alias("id")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                counts, labels = gram_counts(part.column("text")), np.array(part.column("label").to_pylist(), object)
                for lang in set(labels):
                    add = counts[labels == lang].sum(0, dtype=np.float64)
                    sums[lang] = sums[lang] + add if lang in sums else add
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([lang] * DIMENSIONS), "gram": pa.array(range(DIMENSIONS), pa.int32()),
                "n": pa.array(total),
            })

    summed = rows.select("label", "text").mapInArrow(counted, "label string, gram int, n double")
    found = summed.groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["label"].unique(), key=lambda v: v.encode())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; the model holds at most {MAX_LANGUAGES} languages")
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((DIMENSIONS, 1), np.float32), np.ones((0, 1)))
    counts = np.zeros((len(languages), DIMENSIONS))
    place = {lang: i for i, lang in enumerate(languages)}
    known = found[found["label"].isin(place)]
    counts[known["label"].map(place), known["gram"]] = known["n"]
    share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * DIMENSIONS)
    codes = codewords(len(languages))
    weights = np.zeros((DIMENSIONS, codes.shape[1]))
    for bit in range(codes.shape[1]):
        up, down = share[codes[:, bit] > 0], share[codes[:, bit] < 0]
        if len(up) and len(down):
            weights[:, bit] = np.log(up.mean(0)) - np.log(down.mean(0))
    model = LanguageModel(languages, codes, weights.astype(np.float32), np.ones(codes.shape))
    return _trusted(model, rows, sample_rows)


def _trusted(model: LanguageModel, rows: DataFrame, sample_rows: int) -> LanguageModel:
    """Weights of bits per language from the share of sampled rows each classifier gets right."""
    total = rows.count()
    part = min(1.0, sample_rows / max(total, 1))
    bucket = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    sample = rows.where(bucket < int(part * 1_000_000) + 1).select("label", "text")
    bits = model.codes.shape[1]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(model.languages)}
        right, seen = np.zeros(model.codes.shape), np.zeros(len(place))
        for batch in batches:
            for piece in slices(batch):
                margins = model.margins(gram_counts(piece.column("text")))
                for lang, row in zip(piece.column("label").to_pylist(), margins):
                    if lang in place:
                        right[place[lang]] += row * model.codes[place[lang]] > 0
                        seen[place[lang]] += 1
        yield pa.RecordBatch.from_pydict({
            "label": np.repeat(np.arange(len(place)), bits), "bit": np.tile(np.arange(bits), len(place)),
            "right": right.ravel(), "seen": np.repeat(seen, bits),
        })

    found = sample.mapInArrow(checked, "label bigint, bit bigint, right double, seen double").groupBy(
        "label", "bit").agg(F.sum("right").alias("right"), F.sum("seen").alias("seen")).toPandas()
    trust = np.ones(model.codes.shape)
    trust[found["label"].astype(int), found["bit"].astype(int)] = (found["right"] + 1) / (found["seen"] + 2)
    return LanguageModel(model.languages, model.codes, model.weights, trust / trust.sum(1, keepdims=True))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None,
            lead: float = 0.02) -> DataFrame:
    """`keep` columns with lang_pred, score (0 to 1) and ambiguous for every row."""
    kept = keep or ["doc_id"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    read = text if text in kept else "__text"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                texts = part.column(read)
                lettered = np.array([t is not None and next(filter(str.isalpha, t), None) is not None
                                     for t in texts.to_pylist()], bool)
                if model.languages:
                    best, score, close = model.decode(model.margins(gram_counts(texts)), lead)
                else:
                    lettered[:] = False
                    best, score, close = (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool))
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(names, pa.string()),
                     pa.array(np.where(lettered, score, 0.0)), pa.array(close & lettered)],
                    names=[*kept, "lang_pred", "score", "ambiguous"],
                )

    schema = f"{fields}, lang_pred string, score double, ambiguous boolean"
    rows = docs.select(*kept) if read == text else docs.select(*kept, F.col(text).alias(read))
    return rows.mapInArrow(predicted, schema)
