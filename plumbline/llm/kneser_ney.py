"""Interpolated modified Kneser-Ney bigram model, counted and looked up in Spark.

Tokens are words with A-Z lowered and one end token per text; a text's first
token has the start of text as its context. The model has as many entries as the
corpus has bigrams, so neither the driver nor any one worker holds it: bigrams
are dealt to shards by a hash of the predicted word, and by both words where the
predicted word is hot, so one frequent word is many shards.

1. Hot words: tokens with at least 1 / HOT of a task's tokens are reported; the
   few that also have that share of all tokens (below 2 * HOT) are known to all.
2. Counts: tasks pack distinct bigrams with their training counts into sorted
   arrays, one row per shard. A shard sums them; it sends counts of counts to the
   driver (a few numbers), and for each context its totals to the context's
   owner shard, which answers with the context's discounted mass and count.
3. Scores: tasks pack (bigram, document, count) for all texts. A shard stores its
   part of the model as sorted hash arrays in a file, maps it into memory,
   looks the bigrams up, and sums per document. The sums of a pack's documents
   meet by pack, one short row per shard, and are added there.

Bigram discounts follow from the counts of counts (modified Kneser-Ney); the
lower order uses continuation counts with discounts of its own and gives what
is left to a uniform word. Words have 48-bit and contexts 40-bit hashes, besides
the shard.

Text null or empty: one token, the end. Without training texts every token has
the uniform probability. Repeated rows each get their row. Texts are read whole;
one long text is one pack. A null id counts as empty text in the split.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.packed import FOLD, SLICE_ROWS, hashes, mix, slices, unpack, words
from plumbline.session import written

PACK_TOKENS = 1_000_000
PACK_DOCS = 60_000
HOT = 4096
WORD_BITS, CONTEXT_BITS = 48, 40
END = np.uint64(0x5DEECE66D123)
START = np.uint64(0x2545F4914F6C)


def _pack(values: np.ndarray, size: int) -> bytes:
    """Lowest `size` bytes of each 64-bit value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and row of every token, an end token behind each text."""
    data, offsets = unpack(texts)
    starts, ends = words(data, offsets)
    h = hashes(FOLD[data], starts, ends) >> np.uint64(64 - WORD_BITS)
    rows = len(offsets) - 1
    count = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=rows)
    last = np.cumsum(count + 1) - 1
    word = np.empty(len(h) + rows, np.uint64)
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[inner], word[last] = h, END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.concatenate([[0], last[:-1] + 1])] = START
    return word, context & np.uint64(2**CONTEXT_BITS - 1), np.repeat(np.arange(rows), count + 1)


@dataclass(frozen=True)
class Layout:
    """Shards and the words whose bigrams are dealt by both words."""

    shards: int
    hot: np.ndarray

    def of(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        place = mix(word)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
            hot = self.hot[at] == word
            place[hot] = mix(place[hot] ^ mix(context[hot]))
        return (place % np.uint64(self.shards)).astype(np.int32)

    def owner(self, context: np.ndarray) -> np.ndarray:
        return (mix(context) % np.uint64(self.shards)).astype(np.int32)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(word, context, row, ids, train) of bounded groups of texts."""
    held, tokens, docs = [], 0, 0
    for batch in batches:
        for part in slices(batch):
            word, context, row = token_pairs(part.column("text"))
            held.append((word, context, (row + docs).astype(np.int32), part.column("id"), part.column("train")))
            tokens += len(word)
            docs += part.num_rows
            if tokens >= PACK_TOKENS or docs + SLICE_ROWS > PACK_DOCS:
                merged = _merged(held)
                held, tokens, docs = [], 0, 0
                yield merged
    if held:
        yield _merged(held)


def _merged(held: list[tuple]) -> tuple:
    word, context, row, ids, train = zip(*held)
    return (np.concatenate(word), np.concatenate(context), np.concatenate(row), pa.chunked_array(list(ids)),
            np.concatenate([t.to_numpy(zero_copy_only=False) for t in train]).astype(bool))


def _edges(sorted_: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    for column in more:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def hot_words(texts: DataFrame, train: str = "train") -> tuple[np.ndarray, int]:
    """Sorted hashes of the hot words, and the number of training tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, _, row, _, train_ in _packs(batches):
            found, count = np.unique(word, return_counts=True)
            many = count * HOT >= len(word)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(np.append(found[many].astype(np.int64), -1)),
                "n": pa.array(np.append(count[many], len(word)).astype(np.int64)),
                "train": pa.array(np.append(np.zeros(many.sum(), np.int64), train_[row].sum()))})

    found = texts.mapInArrow(counted, "word bigint, n bigint, train bigint").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("train").alias("train")).toPandas()
    total = int(found["n"][found["word"] == -1].sum())
    hot = found[(found["word"] >= 0) & (found["n"] * 2 * HOT >= total)]["word"].to_numpy().astype(np.uint64)
    return np.sort(hot), int(found["train"][found["word"] == -1].sum())


def count_packs(texts: DataFrame, layout: Layout) -> DataFrame:
    """Rows (shard, words, contexts_each, contexts, n): distinct bigrams with training counts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, context, row, _, train in _packs(batches):
            shard = layout.of(word, context)
            order = np.lexsort((context, word, shard))
            word, context, shard = word[order], context[order], shard[order]
            first = _edges(shard, word, context)
            n = np.add.reduceat(train[row[order]].astype(np.uint32), first, dtype=np.uint32)
            yield _pair_rows(layout.shards, shard[first], word[first], context[first], {"n": (n, None)})

    return texts.mapInArrow(packed, "shard int, words binary, each binary, contexts binary, n binary")


def _pair_rows(shards: int, shard: np.ndarray, word: np.ndarray, context: np.ndarray, more: dict) -> pa.RecordBatch:
    """One row per shard: words, contexts per word, contexts, and further arrays by pair (or by their own bounds)."""
    edges = np.searchsorted(shard, np.arange(shards + 1))
    columns: dict[str, list] = {"shard": [], "words": [], "each": [], "contexts": [], **{k: [] for k in more}}
    for s in np.flatnonzero(np.diff(edges)):
        a, b = edges[s], edges[s + 1]
        first = _edges(word[a:b])
        columns["shard"].append(int(s))
        columns["words"].append(_pack(word[a:b][first], WORD_BITS // 8))
        columns["each"].append(np.diff(np.append(first, b - a)).astype(np.uint32).tobytes())
        columns["contexts"].append(_pack(context[a:b], CONTEXT_BITS // 8))
        for name, (values, bounds) in more.items():
            low, high = (a, b) if bounds is None else (bounds[a], bounds[b])
            columns[name].append(values[low:high].tobytes())
    kinds = [pa.int32(), *[pa.binary()] * (len(columns) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds)], names=list(columns))


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    word = np.repeat(_unpack(row["words"], WORD_BITS // 8), _counts(row["each"]))
    return word, _unpack(row["contexts"], CONTEXT_BITS // 8)


def _by_shard(batches: Iterator[pa.RecordBatch], key: str = "shard") -> Iterator[tuple[int, list[dict]]]:
    """Rows of each shard; the input is sorted by shard."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams of count packs: sorted keys, words, contexts and counts."""
    word, context = (np.concatenate(c) for c in zip(*[_pairs(r) for r in rows]))
    keys = _key(word, context)
    order = np.argsort(keys)
    keys = keys[order]
    first = _edges(keys)
    n = np.add.reduceat(np.concatenate([_counts(r["n"]) for r in rows])[order], first, dtype=np.int64)
    one = order[first]
    return keys[first], word[one], context[one], n


def _levels(values: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5].tolist()


def shard_facts(packs: DataFrame, layout: Layout) -> DataFrame:
    """Per shard: counts of counts, hot words' sums, and its contexts' totals for their owners."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            _, word, context, n = _summed(rows)
            seen = n > 0
            types, back = np.unique(word, return_inverse=True)
            followed = np.bincount(back, seen).astype(np.int64)
            count = np.bincount(back, n).astype(np.int64)
            hot = np.isin(types, layout.hot)
            own = followed[~hot]
            out = [(0, shard, -1, [*_levels(n), *_levels(own), int((own > 0).sum()), int(seen.sum())], b"", b"")]
            out += [(2, shard, int(w), [int(a), int(c)], b"", b"")
                    for w, a, c in zip(types[hot], followed[hot], count[hot])]
            order = np.argsort(context, kind="stable")
            context, n = context[order], n[order]
            first = _edges(context)
            totals = [np.add.reduceat(x, first) for x in ((n == 1).astype(np.int64), n == 2, n > 2, n)]
            context = context[first]
            owner = layout.owner(context)
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(layout.shards + 1))
            for o in np.flatnonzero(np.diff(edges)):
                mine = order[edges[o]:edges[o + 1]]
                body = b"".join(t[mine].astype(np.uint32).tobytes() for t in totals)
                out.append((1, shard, int(o), [], _pack(context[mine], CONTEXT_BITS // 8), body))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["kind", "shard", "at", "sums", "contexts", "totals"])

    dealt = _dealt(packs, "shard", layout.shards)
    return dealt.mapInArrow(facts, "kind int, shard int, at bigint, sums array<bigint>, contexts binary, totals binary")


def _dealt(rows: DataFrame, key: str, shards: int, *more: str) -> DataFrame:
    parts = min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(parts, (F.col(key) % parts).cast("int")).sortWithinPartitions(key, *more)


@dataclass(frozen=True)
class Constants:
    """Discounts of both orders and the sizes they belong to."""

    tokens: int
    types: int
    bigrams: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    spare: float
    hot: np.ndarray
    hot_followed: np.ndarray
    hot_count: np.ndarray

    def word_probability(self, followed: np.ndarray) -> np.ndarray:
        """Lower order by the number of contexts a word has."""
        uniform = 1 / (self.types + 1)
        if not self.bigrams:
            return np.full(len(followed), uniform)
        less = np.maximum(followed - self.word_discount[np.minimum(followed, 3)], 0)
        return less / self.bigrams + self.spare * uniform


def discounts(levels: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the numbers of counts 1 to 4."""
    n = [max(x, 0) for x in levels]
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([0, *[min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d)]])


def constants(facts: DataFrame, tokens: int) -> Constants:
    """Sums over shards: a few numbers, and one row per hot word."""
    sums = facts.where("kind = 0").select(*[F.col("sums")[i].alias(f"s{i}") for i in range(10)]).agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(10)]).first()
    totals = [int(x or 0) for x in sums]
    hot = facts.where("kind = 2").groupBy("at").agg(
        F.sum(F.col("sums")[0]).alias("a"), F.sum(F.col("sums")[1]).alias("c")).orderBy("at").toPandas()
    followed = hot["a"].to_numpy(np.int64)
    levels = [x + y for x, y in zip(totals[4:8], _levels(followed))]
    types, bigrams = totals[8] + int((followed > 0).sum()), totals[9]
    word_discount = discounts(levels)
    lost = sum(d * k for d, k in zip(word_discount[1:3], levels[:2])) + word_discount[3] * (types - sum(levels[:2]))
    return Constants(tokens, types, bigrams, discounts(totals[:4]), word_discount, lost / max(bigrams, 1),
                     hot["at"].to_numpy(np.int64).astype(np.uint64), followed, hot["c"].to_numpy(np.int64))


def answers(facts: DataFrame, layout: Layout, known: Constants) -> DataFrame:
    """Rows (shard, owner, mass, count): the asked contexts' discounted mass and count, in the asked order."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _by_shard(batches, "at"):
            asked = [_unpack(r["contexts"], CONTEXT_BITS // 8) for r in rows]
            totals = np.hstack([_counts(r["totals"]).reshape(4, -1) for r in rows])
            every, back = np.unique(np.concatenate(asked), return_inverse=True)
            ones, twos, more, count = (np.bincount(back, t, len(every)) for t in totals)
            _, d1, d2, d3 = known.pair_discount
            mass = (d1 * ones + d2 * twos + d3 * more).astype(np.float32)[back]
            count = count.astype(np.float32)[back]
            at = np.cumsum([0, *map(len, asked)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"] for r in rows], pa.int32()), pa.array([owner] * len(rows), pa.int32()),
                 pa.array([mass[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]),
                 pa.array([count[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])],
                names=["shard", "owner", "mass", "count"])

    asked = _dealt(facts.where("kind = 1"), "at", layout.shards)
    return asked.mapInArrow(answered, "shard int, owner int, mass binary, count binary")


def score_packs(texts: DataFrame, layout: Layout) -> DataFrame:
    """Count packs of all texts by document: each bigram's documents and counts.

    One row of each pack also carries the ids and numbers of tokens of its documents.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (word, context, row, ids, train) in enumerate(_packs(batches)):
            shard = layout.of(word, context)
            order = np.lexsort(((context << np.uint64(24)) | row.astype(np.uint64), word, shard))
            word, context, shard, row = word[order], context[order], shard[order], row[order]
            entry = _edges(shard, word, context, row)
            n = np.diff(np.append(entry, len(word))).astype(np.uint32)
            word, context, shard, row = word[entry], context[entry], shard[entry], row[entry]
            pair = _edges(shard, word, context)
            bounds = np.append(pair, len(word))
            tokens = np.bincount(row, n, len(train)).astype(np.int64)
            rows = _pair_rows(layout.shards, shard[pair], word[pair], context[pair], {
                "docs": (np.diff(bounds).astype(np.uint32), None), "doc": (row.astype(np.uint16), bounds),
                "n": (n, bounds)})
            pack = pa.array([(part << 24) | number] * rows.num_rows, pa.int64())
            marks = pa.array([np.packbits(train).tobytes()] * rows.num_rows)
            others = [None] * (rows.num_rows - 1)
            carried = [pa.array([ids.to_pylist(), *others], pa.list_(ids.type)),
                       pa.array([tokens, *others], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pack, pa.array([len(train)] * rows.num_rows, pa.int32()), marks, *carried, *rows.columns],
                names=["pack", "rows", "train", "ids", "tokens", *rows.schema.names])

    return texts.mapInArrow(packed, f"pack bigint, rows int, train binary, ids array<{id_type}>, tokens array<bigint>, "
                                    "shard int, words binary, each binary, contexts binary, docs binary, doc binary, n binary")


class ModelShard:
    """One shard of the model: sorted hash arrays in a mapped file."""

    def __init__(self, rows: list[dict], replies: list[dict], layout: Layout, known: Constants):
        keys, word, context, n = _summed([{**r, "n": self._trained(r)} for r in rows])
        types, back = np.unique(word, return_inverse=True)
        followed = np.bincount(back, n > 0).astype(np.int64)
        count = np.bincount(back, n).astype(np.int64)
        if len(known.hot):
            at = np.minimum(np.searchsorted(known.hot, types), len(known.hot) - 1)
            hot = known.hot[at] == types
            followed[hot], count[hot] = known.hot_followed[at[hot]], known.hot_count[at[hot]]
        lower = known.word_probability(followed)[back]
        base = np.log10((count + 0.1) / (known.tokens + 0.1 * (known.types + 1)))[back]
        known_word = (count > 0)[back]
        del word, back

        every, back = np.unique(context, return_inverse=True)
        mass, total = np.zeros(len(every), np.float32), np.zeros(len(every), np.float32)
        owner = layout.owner(every)
        for r in replies:
            mine = owner == r["owner"]
            mass[mine], total[mine] = np.frombuffer(r["mass"], np.float32), np.frombuffer(r["count"], np.float32)
        mass, total = mass[back], total[back]
        less = np.maximum(n - known.pair_discount[np.minimum(n, 3)], 0)
        p = np.where(total > 0, (less + mass * lower) / np.maximum(total, 1), lower)
        arrays = {"key": keys, "score": np.log10(p), "base": base, "known": known_word.astype(np.uint8)}
        # The file is gone when the map is, also if the task is lost.
        with tempfile.TemporaryFile() as file:
            for values in arrays.values():
                file.write(values.data)
            file.flush()
            self.parts, offset = {}, 0
            for name, values in arrays.items():
                self.parts[name] = np.memmap(file, values.dtype, "r", offset, values.shape)
                offset += values.nbytes

    @staticmethod
    def _trained(row: dict) -> bytes:
        train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: row["rows"]].astype(bool)
        n = np.where(train[np.frombuffer(row["doc"], np.uint16)], _counts(row["n"]), 0)
        docs = _counts(row["docs"])
        return np.add.reduceat(n, np.cumsum(docs, dtype=np.int64) - docs, dtype=np.uint32).tobytes()

    def sums(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a pack with their known tokens, base score and score in this shard."""
        at = np.searchsorted(self.parts["key"], _key(*_pairs(row)))
        doc, n = np.frombuffer(row["doc"], np.uint16), _counts(row["n"])
        at = np.repeat(at, _counts(row["docs"]))
        found = [np.bincount(doc, n * self.parts[c][at], row["rows"]) for c in ("known", "base", "score")]
        some = np.flatnonzero(np.bincount(doc, minlength=row["rows"]))
        return some, *(f[some] for f in found)


def _key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(mix(word) ^ (context * np.uint64(0x9E3779B97F4A7C15)))


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    base_score is the add-0.1 unigram score, score the model's; both are log10.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                        F.col(text).alias("text"))
    hot, tokens = hot_words(texts)
    layout = Layout(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), hot)
    facts = written(shard_facts(count_packs(texts, layout), layout))
    known = constants(facts, tokens)
    replies = written(answers(facts, layout, known))

    packs = score_packs(texts, layout).withColumn("kind", F.lit(1))
    every = packs.unionByName(replies.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    id_type = to_arrow_type(docs.schema[id_column].dataType)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            packs_of, told = [r for r in rows if r["kind"]], [r for r in rows if not r["kind"]]
            if not packs_of:
                continue
            model = ModelShard(packs_of, told, layout, known)
            for row in packs_of:
                doc, *sums = model.sums(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["pack"]], pa.int64()), pa.array([row["rows"]], pa.int32()), pa.array([row["train"]]),
                     pa.array([row["ids"]], pa.list_(id_type)), pa.array([row["tokens"]], pa.list_(pa.int64())),
                     pa.array([doc.astype(np.uint16).tobytes()]), *[pa.array([x.tobytes()]) for x in sums]],
                    names=["pack", "rows", "train", "ids", "tokens", "doc", "n_known", "base_score", "score"])

    parts = _dealt(every, "shard", layout.shards, "kind").mapInArrow(
        summed, f"pack bigint, rows int, train binary, ids array<{kind}>, tokens array<bigint>, doc binary, "
                "n_known binary, base_score binary, score binary")

    def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_known", "base_score", "score")
        for _, rows in _by_shard(batches, "pack"):
            totals = np.zeros((len(names), rows[0]["rows"]))
            carrier = next(r for r in rows if r["ids"] is not None)
            for r in rows:
                doc = np.frombuffer(r["doc"], np.uint16)
                for total, name in zip(totals, names):
                    total[doc] += np.frombuffer(r[name], np.float64)
            marks = np.unpackbits(np.frombuffer(carrier["train"], np.uint8))[: carrier["rows"]].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(carrier["ids"], id_type), pa.array(marks), pa.array(carrier["tokens"], pa.int64()),
                 pa.array(totals[0].astype(np.int64)), pa.array([tokens] * len(marks), pa.int64()), pa.array(totals[1]),
                 pa.array(totals[2])],
                names=[id_column, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return parts.repartition("pack").sortWithinPartitions("pack").mapInArrow(
        totalled, f"`{id_column}` {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                  "base_score double, score double")
