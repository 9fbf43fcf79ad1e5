"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows of equal text are one group that no cut may split; groups are ordered by a
digest of their text. The smallest capacity with which a greedy walk needs no
more than the wanted number of shards is found by binary search, and the walk at
that capacity makes the cuts.

The search runs on sums per digest prefix, at most `BLOCKS` of them. A prefix in
which a cut may fall for a capacity still in question is refined by longer
prefixes, until those hold single groups; so the capacity and the cuts are those
of all groups, while only sums reach the driver. Rows then compare their digest
with the cuts; slots count rows per (shard, block of a hash of the id), so no
task holds a shard or a group of copies.

Text null: size 1, as empty. Repeated rows are rows like others. Ties in the
slot order go by id, then digest; rows alike in both are interchangeable. A
table with fewer groups than shards leaves shards empty; an empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.session import written

PREFIX = 4
STEP = 2
BLOCKS = 16**PREFIX
SLOT_BLOCK = 3


@dataclass(frozen=True)
class Unit:
    """Groups whose digests share a prefix; atomic if it is one group."""

    prefix: str
    size: int
    atomic: bool


def _walk(units: list[Unit], ends: list[int], capacity: int, shards: int, split: bool) -> list[int] | None:
    """Greedy cut places (bytes before each cut), or None if the shards do not suffice.

    With `split` a unit that is not atomic may be cut at any byte; else none may.
    """
    cuts, start, total = [], 0, ends[-1]
    for _ in range(shards):
        reach = start + capacity
        if reach >= total:
            return cuts
        k = bisect.bisect_right(ends, reach)
        low = ends[k - 1] if k else 0
        stop = reach if split and not units[k].atomic else low
        if stop <= start:
            return None
        cuts.append(stop)
        start = stop
    return None


def _capacity(units: list[Unit], ends: list[int], shards: int, split: bool) -> int:
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _walk(units, ends, middle, shards, split) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(groups: DataFrame, shards: int, key: str = "key", size: str = "size") -> tuple[int, list[str]]:
    """Smallest feasible capacity, and the first prefix of each shard but the first.

    `groups` has a row per group: a hexadecimal digest and a size.
    """
    def sums(where: DataFrame, digits: int) -> list[Unit]:
        found = where.groupBy(F.substring(F.col(key), 1, digits).alias("p")).agg(
            F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return [Unit(r["p"], int(r["s"]), r["n"] == 1) for r in found]

    units = sorted(sums(groups, PREFIX), key=lambda u: u.prefix)
    while units:
        ends, total = [], 0
        for u in units:
            total += u.size
            ends.append(total)
        least, most = _capacity(units, ends, shards, True), _capacity(units, ends, shards, False)
        open_ = _in_question(units, ends, least, most, shards)
        if not open_:
            cuts = _walk(units, ends, most, shards, False) or []
            return most, [units[bisect.bisect_right(ends, c)].prefix for c in cuts]
        by_length: dict[int, list[str]] = {}
        for i in open_:
            by_length.setdefault(len(units[i].prefix), []).append(units[i].prefix)
        finer: list[Unit] = []
        for length, prefixes in by_length.items():
            few = groups.where(F.substring(F.col(key), 1, length).isin(prefixes))
            finer += sums(few, min(length + STEP, 32))
        units = sorted([u for i, u in enumerate(units) if i not in open_] + finer, key=lambda u: u.prefix)
    return 0, []


def _in_question(units: list[Unit], ends: list[int], least: int, most: int, shards: int) -> set[int]:
    """Units of several groups in which a cut of some capacity in [least, most] may fall."""
    coarse = max((u.size for u in units if not u.atomic), default=0)
    if not coarse:
        return set()
    found: set[int] = set()
    low = high = 0
    for _ in range(shards - 1):
        # A greedy cut lies at most one unit before start + capacity.
        low = max(low, _last_end(ends, low + least))
        high = min(high + most, ends[-1])
        a, b = bisect.bisect_right(ends, low), bisect.bisect_left(ends, high)
        found.update(i for i in range(a, min(b, len(units) - 1) + 1) if not units[i].atomic)
    return found


def _last_end(ends: list[int], at: int) -> int:
    """End of the last unit that ends at or before `at`."""
    k = bisect.bisect_right(ends, at)
    return ends[k - 1] if k else 0


def _shard(key: Column, cuts: list[str]) -> Column:
    """Number of cuts at or before a digest."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(F.substring(key, 1, len(c)) >= F.lit(c), 1).otherwise(0)
    return out.cast("int")


def assign(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: size, digest, shard, and a gapless slot from 0 in its shard."""
    filled = F.coalesce(F.col(text), F.lit(""))
    sized = written(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(filled) + 1).cast("bigint").alias("size"),
        F.crc32(filled.cast("binary")).alias("text_crc32"), F.md5(filled.cast("binary")).alias("key"),
    ))
    groups = written(sized.groupBy("key").agg(F.sum("size").alias("size")))
    _, cuts = minimax_cuts(groups, shards)
    block = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), 1, SLOT_BLOCK)
    placed = sized.withColumn("shard", _shard(F.col("key"), cuts)).withColumn("__block", block)
    counts = placed.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = W.partitionBy("shard", "__block").orderBy("id", "key")
    return placed.join(starts, ["shard", "__block"]).select(
        F.col("id").alias(id_column), "size", "text_crc32", "key", "shard",
        (F.row_number().over(inside) - 1 + F.col("__first")).cast("bigint").alias("slot"))
