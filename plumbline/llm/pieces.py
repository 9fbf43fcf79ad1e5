"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Encoding keeps an agenda of adjacent symbol pairs ordered by piece score, then
by place, and merges the best pair until none is left. A merge never crosses a
place where no piece of the vocabulary has the two characters side by side, so
a text is cut there first: before each run of spaces, around line feeds, and
between Latin letters and ASCII signs. Each rule is checked against the pieces
and left out where a piece breaks it. Cut parts repeat, so a worker keeps a bounded table of parts it has encoded.
Every part is compared with the sentencepiece library when it enters the table,
one call per Arrow batch; a difference stops the job. The decoded text is built
from the ids of the whole text, whatever its parts.

Text null or empty: the end id alone, decoded as "". Repeated rows each give
their row. Very long texts are encoded whole; a very long part costs
n log n steps. An empty table gives an empty result. Other columns of the input
are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE_MARK = "▁"
#: Parts in each of the two halves of a worker's table.
TABLE_PARTS = 200_000
SHORT = 48
INFINITE = float("inf")
NEVER = repeat(INFINITE)
LETTERS = "A-Za-z\u00C0-\u024F"
SIGNS = "!-@\\[-`{-~"


class Vocabulary:
    """Pieces of one model file, with the agenda encoder and the decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(size)]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.library.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.control = {i for i in range(size) if self.library.is_control(i)}
        self.known = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.bytes}
        self.cost = {p: -self.library.get_score(i) for p, i in self.known.items()}
        self.end = self.library.eos_id()
        self.unknown = self.library.unk_id()
        #: No piece goes on after a space mark inside it, joins a line feed to anything, or a letter to a sign.
        cut_at_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.known)
        cut_at_line = not any("\n" in p and len(p) > 1 for p in self.known)
        border = re.compile(f"[{LETTERS}][{SIGNS}]|[{SIGNS}][{LETTERS}]")
        self.cut = None
        if cut_at_space and cut_at_line:
            signs = not any(border.search(p) for p in self.known)
            self.cut = _FINE if signs else _PARTS
        self.text = [None if i in self.bytes else "" if i in self.control else p.replace(SPACE_MARK, " ")
                     for i, p in enumerate(self.pieces)]
        #: bytes and decimal form of each id, to be taken for all ids of a batch at once
        coded = [bytes([self.bytes[i]]) if t is None else t.encode() for i, t in enumerate(self.text)]
        self.coded = pa.array(coded, pa.binary())
        self.decimal = pa.array([str(i) for i in range(size)])

    def merge(self, symbols: str) -> list[int]:
        """Ids of marked text by the score-ordered agenda."""
        text = self._short(symbols) if len(symbols) <= SHORT else self._long(symbols)
        ids: list[int] = []
        for piece in text:
            found = self.known.get(piece)
            if found is not None:
                ids.append(found)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _short(self, symbols: str) -> list[str]:
        """The agenda of a few pairs is a list by place: the first of the best is next."""
        text, cost = list(symbols), self.cost.get
        agenda = list(map(cost, map(add, text, text[1:]), NEVER))
        while agenda:
            best = min(agenda)
            if best == INFINITE:
                break
            i = agenda.index(best)
            text[i] += text.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(text[i] + text[i + 1], INFINITE)
            if i:
                agenda[i - 1] = cost(text[i - 1] + text[i], INFINITE)
        return text

    def _long(self, symbols: str) -> list[str]:
        """The agenda is a heap by score and place; pairs that a merge has undone are passed over."""
        text: list[str | None] = list(symbols)
        n, cost = len(text), self.cost
        agenda = [(cost[p], i, p) for i, p in enumerate(map(add, text, text[1:])) if p in cost]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if text[i] is None or j >= n or text[i] + text[j] != piece:
                continue
            text[i], text[j], after[i] = piece, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((i, after[i]), (before[i], i)):
                if left >= 0 and right < n and (pair := text[left] + text[right]) in cost:
                    heappush(agenda, (cost[pair], left, pair))
        return [p for p in text if p is not None]

    def parts(self, text: str) -> list[str]:
        """Marked text cut where no merge can cross; joined it is the marked text."""
        if not text:
            return []
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        return self.cut.findall(marked) if self.cut else [marked]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.merge(part)]

    def decode_all(self, ids: pa.ListArray) -> list[str]:
        """Texts of lists of ids, all pieces of a batch taken together."""
        pieces = pa.ListArray.from_arrays(ids.offsets, self.coded.take(ids.values))
        return [b.as_py().decode(errors="replace").removeprefix(" ") for b in pc.binary_join(pieces, b"")]

    def written(self, ids: pa.ListArray) -> list[str]:
        """Decimal ids of each list, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.decimal.take(ids.values)), " ").to_pylist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: space marks become spaces, byte pieces characters, the dummy space goes."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            out.append(self.text[i])
        out.append(pending.decode(errors="replace"))
        return "".join(out).removeprefix(" ")


_PARTS = re.compile("\n|▁*[^▁\n]+|▁+")
#: A run of letters or of signs is a part of its own unless another kind of character follows it.
_OTHER = f"[^{LETTERS}{SIGNS}▁\n]"
_FINE = re.compile(f"\n|▁*(?:[{LETTERS}]++(?!{_OTHER})|[{SIGNS}]++(?!{_OTHER})|[^▁\n]+)|▁+")


class Parts(dict):
    """Ids of known parts, four bytes each; what has not been used for long is forgotten.

    A full table becomes the older half, whose parts come back as they are met.
    """

    def __init__(self, size: int):
        self.size, self.older = size, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.pop(part)
        self.put(part, ids)
        return ids

    def put(self, part: str, ids: bytes) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[part] = ids

    def unknown(self, parts: list[str]) -> set[str]:
        return {p for p in set(parts) if p not in self and p not in self.older}


class Encoder:
    """A vocabulary with the bounded table of parts of one worker."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.mark = self.vocabulary.merge(SPACE_MARK)
        self.table = Parts(TABLE_PARTS)

    def learn(self, parts: set[str]) -> None:
        """Encode new parts and compare them with the library."""
        v = self.vocabulary
        # The library puts a space mark in front; what has none is compared behind a line feed.
        asked = list(parts)
        marked = [p[0] == SPACE_MARK and p != SPACE_MARK for p in asked]
        given = [p[1:] if m else "\n" + p for p, m in zip(asked, marked)]
        lead = len(self.mark) + len(v.merge("\n"))
        for part, m, theirs in zip(asked, marked, v.library.encode(given, num_threads=1)):
            ids = v.merge(part)
            expected = theirs if m else theirs[lead:]
            if v.cut and ids != expected:
                raise ValueError(f"agenda and library differ on {part!r}: {ids} and {expected}")
            self.table.put(part, _packed(ids))

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text with the end id."""
        v, end = self.vocabulary, _packed([self.vocabulary.end])
        cut = [v.parts(t or "") for t in texts]
        packed = [self._known(parts) for parts in cut]
        new: set[str] = set()
        for parts, ids in zip(cut, packed):
            if ids is None:
                new |= self.table.unknown(parts)
        if new:
            self.learn(new)
        for i, ids in enumerate(packed):
            if ids is None:
                ids = self._known(cut[i])
            if ids is None:  # forgotten since
                again = {p: _packed(v.merge(p)) for p in set(cut[i])}
                ids = b"".join(map(again.__getitem__, cut[i]))
            packed[i] = ids + end
        ends = np.cumsum([0, *map(len, packed)]) // 4
        return pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    def _known(self, parts: list[str]) -> bytes | None:
        """Ids of a text whose parts are all in the table."""
        try:
            return b"".join(map(self.table.__getitem__, parts))
        except KeyError:
            return None


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text",
                 with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per document: its id, number of ids, digests of ids and of the decoded text.

    `with_ids` adds the ids; `keep` names further columns to pass on.
    """
    kept = [id_column, *(keep or [])]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    schema = f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.packed import slices

        tool = encoder(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids = tool.encode_batch(part.column("__text").to_pylist())
                columns = [part.column(c) for c in kept]
                columns += [pc.list_value_length(ids).cast(pa.int64()),
                            pa.array(map(_sha, tool.vocabulary.written(ids)), pa.string()),
                            pa.array(map(_sha, tool.vocabulary.decode_all(ids)), pa.string())]
                names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(ids)
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(encoded, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
