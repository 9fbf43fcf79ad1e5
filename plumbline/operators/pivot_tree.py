"""Exact search for a vector within an angle, over a tree of pivots kept as tables.

All vectors start in one cell. A cell of more than `block` rows is split: a few
of its vectors become pivots, every vector goes to the nearest one, and the new
cells are split in turn. Rows of a cell are dealt to tasks by a hash, so a cell
that holds all rows is many tasks, and the tree is a table of nodes per level,
never a driver's object.

A query goes down level by level. Three bounds tell which children can hold a
partner: its angle to the pivot may differ from the members' least and greatest
angle by the reach at most; and a member is no nearer to another pivot than to
its own, so it lies beyond the plane between the two. A query stops at the first
partner: at a pivot within reach, or in a cell that lies wholly within reach.
The nearest leaf is searched first, and only queries without a partner there
look further. On data without clusters nothing can be pruned, and every leaf is
searched: a query would be copied once a leaf, which fills the disks. The tree is
therefore asked only where few leaves are visited. Before it, all queries are
compared with a few partners (`scouted`); where it is not asked, chunks of queries
go to all partners, one after the other (`flat`). In both the chunk is broadcast and
the other side stays where it lies, so nothing is copied and nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from plumbline.operators.ordering import hash_order
from plumbline.session import written

SLACK = 1e-6
#: Cells of vectors that are all (nearly) one direction are not split any further.
ONE_DIRECTION = 1e-6
#: A cell's number holds its way from the root in this many bits.
PATH_BITS = 60
#: Rounds of scouts at most; a round that leaves more than this share is the last one.
SCOUT_ROUNDS, SCOUTS_USEFUL = 4, 0.9
#: So few blocks of queries need no scouts, and so few go to all partners without a tree being built.
SCOUT_BLOCKS, FLAT_BLOCKS = 8, 128
#: Leaves that a query may visit in the mean, and queries that tell it.
MOST_VISITS, PROBES = 8, 256
#: Bytes of the unit vectors of a chunk, rows of a side that are compared at once, vectors of a task.
CHUNK_BYTES, TILE, SHARE = 16_000_000, 1024, 50_000



def units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length from a column of equally long lists."""
    if not len(column):
        return np.zeros((0, 0))
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(lists), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass(frozen=True)
class Tree:
    """`leaves`: rep, v, cell, angle (to the cell's pivot), pivot_rep. `levels`: a table of split cells each.

    A row of a level has `cell` and the array `nodes`: its children with their
    pivot, least and greatest angle, number and smallest rep of members. `ends`:
    cell, n, high and first of every leaf.
    """

    leaves: DataFrame
    ends: DataFrame
    levels: list[DataFrame]


def _dealt(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows with `salt`: the rows of a cell lie in about n / block groups."""
    salts = sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    return rows.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))


def _copied(cells: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """One row per cell for each of its groups of rows."""
    salts = sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    return cells.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _chosen(rows: DataFrame, sizes: DataFrame, fan: int, seed: int) -> DataFrame:
    """(cell, pivots): up to `fan` vectors of each cell in hash order, from a thin hash sample of it."""
    digest = hash_order(F.col("rep"), seed)
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    thin = rows.join(sizes, "cell").where(place * F.col("n") <= 4 * fan + 16).select("cell", "rep", "v", digest.alias("digest"))
    order = W.partitionBy("cell").orderBy("digest", "rep")
    best = thin.withColumn("k", F.row_number().over(order)).where(F.col("k") <= fan)
    return best.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "rep", "v"))).alias("pivots"))


def build(vectors: DataFrame, fan: int, block: int) -> Tree:
    """The tree of (rep, v); vectors have a direction."""
    rep, vec = (vectors.schema[c].dataType.simpleString() for c in ("rep", "v"))
    row = f"rep {rep}, v {vec}, cell bigint, angle double, pivot_rep {rep}"
    none = F.lit(None).cast(rep)
    now = vectors.select("rep", "v", F.lit(0).cast("bigint").alias("cell"), F.lit(math.pi).alias("angle"), none.alias("pivot_rep"))
    ends = now.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.lit(math.pi).alias("high"), F.min("rep").alias("first"))
    leaves, all_ends, levels = [], [], []

    def assigned(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({c: [] for c in ("rep", "v", "cell", "angle", "pivot_rep")})
        if not len(right):
            return left.select(["rep", "v", "cell", "angle", "pivot_rep"])
        points = right.column("pivots")[0].as_py()
        at = units(left.column("v")) @ units(pa.chunked_array([pa.array([p["v"] for p in points])])).T
        near = at.argmax(1)
        return pa.table({
            "rep": left.column("rep"), "v": left.column("v"),
            "cell": pa.array(int(key[0].as_py()) * fan + 1 + near, pa.int64()),
            "angle": pa.array(angles(at[np.arange(len(near)), near])),
            "pivot_rep": pa.array([points[k]["rep"] for k in near], left.column("rep").type)})

    most = int(PATH_BITS / math.log2(fan)) if fan > 1 else 0
    for depth in range(most + 1):
        open_ = (F.col("n") > block) & (F.col("high") > ONE_DIRECTION) & F.lit(depth < most)
        ends = ends.withColumn("split", open_)
        big = ends.where("split").select("cell", "n")
        last = big.isEmpty()
        if last and depth == 0:
            return Tree(now, ends.drop("split"), [])
        done = ends.where("NOT split")
        leaves.append(now if last else now.join(done.select("cell"), "cell", "left_semi").select(now.columns))
        all_ends.append(done.drop("split"))
        if last:
            break
        inner = now.join(big.select("cell"), "cell", "left_semi")
        pivots = written(_chosen(inner, big, fan, depth))
        left = _dealt(inner, big, block).groupBy("cell", "salt")
        right = _copied(pivots, big, block).groupBy("cell", "salt")
        now = written(left.cogroup(right).applyInArrow(assigned, row))
        ends = written(now.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("angle").alias("high"), F.min("rep").alias("first"), F.min("angle").alias("low")))
        # The pivots of a cell with what is known of the children they made.
        made = pivots.select("cell", F.explode("pivots").alias("p")).select(
            "cell", (F.col("cell") * fan + F.col("p.k")).alias("child"), F.col("p.rep").alias("pivot_rep"), F.col("p.v").alias("pivot"))
        facts = ends.select(F.col("cell").alias("child"), "n", "low", "high", "first")
        levels.append(made.join(facts, "child").groupBy("cell").agg(
            F.sort_array(F.collect_list(F.struct("child", "pivot_rep", "pivot", "n", "low", "high", "first"))).alias("nodes")))
        ends = ends.drop("low")
    out, facts = leaves[0], all_ends[0]
    for more, end in zip(leaves[1:], all_ends[1:]):
        out, facts = out.unionByName(more), facts.unionByName(end)
    return Tree(out, facts, levels)


@dataclass(frozen=True)
class Search:
    """What counts as a partner: within `reach`, not the row itself, and with `earlier` of a smaller rep."""

    reach: float
    same_table: bool
    earlier: bool

    def may(self, query: np.ndarray, partner: np.ndarray) -> np.ndarray:
        if self.earlier:
            return partner < query
        return partner != query if self.same_table else np.ones(np.broadcast(query, partner).shape, bool)

    def column(self, query: Column, partner: Column) -> Column:
        if self.earlier:
            return partner < query
        return partner != query if self.same_table else F.lit(True)


def _down(search: Search, nearest: bool):
    """One level: queries of a cell against its children."""

    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        columns = ["rep", "v", "cell", "found"]
        if not len(left) or not len(right):
            return pa.table({"rep": left.column("rep").slice(0, 0), "v": left.column("v").slice(0, 0),
                             "cell": pa.array([], pa.int64()), "found": pa.array([], pa.bool_())}) if len(left) else \
                pa.table({c: [] for c in columns})
        nodes = right.column("nodes")[0].as_py()
        pivots = units(pa.chunked_array([pa.array([n["pivot"] for n in nodes])]))
        low, high, count = (np.array([n[c] for n in nodes]) for c in ("low", "high", "n"))
        child = np.array([n["child"] for n in nodes], np.int64)
        first, own = (np.array([n[c] for n in nodes]) for c in ("first", "pivot_rep"))
        rep = np.array(left.column("rep").to_pylist())
        cosine = units(left.column("v")) @ pivots.T
        at = angles(cosine)
        near = at.argmin(1)
        rows = np.arange(len(rep))
        found = ((at <= search.reach - SLACK) & search.may(rep[:, None], own[None, :])).any(1)
        # A cell wholly within reach has a partner if its first member may be one, or if it has another member.
        other = search.may(rep[:, None], first[None, :]) | (~np.bool_(search.earlier) & (count > 1)[None, :])
        found |= ((at + high <= search.reach - SLACK) & other).any(1)
        if nearest:
            goes = np.zeros(at.shape, bool)
            goes[rows, near] = True
        else:
            goes = (at <= high + search.reach + SLACK) & (at >= low - search.reach - SLACK)
            apart = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)[near]
            lead = cosine[rows, near][:, None] - cosine
            goes &= lead <= math.sin(min(search.reach + SLACK, math.pi / 2)) * apart + SLACK
        goes[found] = False
        q, c = np.nonzero(goes)
        take = pa.array(np.concatenate([np.flatnonzero(found), q]))
        return pa.table({
            "rep": left.column("rep").take(take), "v": left.column("v").take(take),
            "cell": pa.array(np.concatenate([np.full(int(found.sum()), -1, np.int64), child[c]])),
            "found": pa.array(np.concatenate([np.ones(int(found.sum()), bool), np.zeros(len(q), bool)]))})

    return step


def descend(tree: Tree, queries: DataFrame, search: Search, block: int, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """(rep) of queries that met a partner on the way, and (rep, v, cell) of leaves to search."""
    rep, vec = (queries.schema[c].dataType.simpleString() for c in ("rep", "v"))
    now = queries.select("rep", "v", F.lit(0).cast("bigint").alias("cell"))
    found = now.select("rep").limit(0)
    visits: list[DataFrame] = []
    for level in tree.levels:
        inner = now.join(level.select("cell"), "cell", "left_semi")
        visits.append(now.join(level.select("cell"), "cell", "left_anti").select("rep", "v", "cell"))
        sizes = _counted(inner)
        left = _dealt(inner, sizes, block).groupBy("cell", "salt")
        right = _copied(level, sizes, block).groupBy("cell", "salt")
        out = written(left.cogroup(right).applyInArrow(_down(search, nearest), f"rep {rep}, v {vec}, cell bigint, found boolean"))
        found = found.unionByName(out.where("found").select("rep"))
        now = out.where("NOT found").select("rep", "v", "cell")
    for more in visits:
        now = now.unionByName(more)
    done = written(found.distinct())
    # A query that met a partner in one branch need not look in the others.
    return done, now.join(done, "rep", "left_anti").select("rep", "v", "cell")


def compare(tree: Tree, visits: DataFrame, search: Search, threshold: float, block: int) -> DataFrame:
    """(rep) of the queries with a partner in a leaf they visit; only keys leave a task."""
    rep = visits.schema["rep"].dataType.simpleString()
    asked, held = _counted(visits), tree.ends.select("cell", "n")
    plan = asked.select("cell", F.ceil(F.col("n") / block).cast("int").alias("qs")).join(
        held.select("cell", F.ceil(F.col("n") / block).cast("int").alias("ps")), "cell")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        cut = rows.select("cell", "rep", "v").join(F.broadcast(plan), "cell").withColumn(
            own[0], F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        return cut.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("cell", "q", "p", "rep", "v")

    def match(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"rep": left.column("rep").slice(0, 0) if len(left) else []})
        cosine = units(left.column("v")) @ units(right.column("v")).T
        a, b = (np.array(t.column("rep").to_pylist()) for t in (left, right))
        cosine[~search.may(a[:, None], b[None, :])] = -2.0
        return pa.table({"rep": left.column("rep").filter(pa.array(cosine.max(axis=1) >= threshold))})

    left = dealt(visits, "qs", "ps").groupBy("cell", "q", "p")
    right = dealt(tree.leaves, "ps", "qs").groupBy("cell", "q", "p")
    return left.cogroup(right).applyInArrow(match, f"rep {rep}").distinct()


def spread(rows: DataFrame) -> DataFrame:
    """(rep, v) written in files that grow in number with the rows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.select("rep", "v").repartition(max(least, math.ceil(rows.count() / SHARE)), "rep"))


def met(search: Search, threshold: float, reps: np.ndarray, at: np.ndarray, partner_reps: np.ndarray,
        partners: np.ndarray) -> np.ndarray:
    """Which of the unit vectors `at` have a partner; those that met one are left out of the next tile."""
    found = np.zeros(len(at), bool)
    for start in range(0, len(at), TILE):
        left = np.arange(start, min(start + TILE, len(at)))
        rows = at[left]
        for k in range(0, len(partners), TILE):
            cosine = rows @ partners[k:k + TILE].T
            near = np.flatnonzero(cosine.max(axis=1) >= threshold)
            if not len(near):
                continue
            may = search.may(reps[left[near]][:, None], partner_reps[None, k:k + TILE])
            gone = near[((cosine[near] >= threshold) & may).any(1)]
            found[left[gone]] = True
            left = np.delete(left, gone)
            if not len(left):
                break
            rows = at[left]
    return found


def _chunk(rows: DataFrame):
    """Reps and unit vectors of few rows (rep, v) as a broadcast value."""
    table = rows.select("rep", "v").toArrow()
    return rows.sparkSession.sparkContext.broadcast((table.column("rep").combine_chunks(), units(table.column("v"))))


def _reps(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist())


def _chunk_rows(rows: DataFrame) -> int:
    first = rows.select(F.size("v")).head()
    return max(1, CHUNK_BYTES // (8 * max(1, first[0]))) if first else 1


def _against(queries: DataFrame, partners: DataFrame, search: Search, threshold: float) -> DataFrame:
    """(rep, v, found) of queries, compared where they lie with a chunk of partners."""
    few = _chunk(partners)
    rep, vec = (queries.schema[c].dataType.simpleString() for c in ("rep", "v"))

    def asked(batches):
        partner_reps, at = few.value
        partner_reps = _reps(partner_reps)
        for batch in batches:
            own = pa.Table.from_batches([batch])
            found = met(search, threshold, _reps(own.column("rep")), units(own.column("v")), partner_reps, at)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("v"), pa.array(found)], names=["rep", "v", "found"])

    out = written(queries.select("rep", "v").mapInArrow(asked, f"rep {rep}, v {vec}, found boolean"))
    few.destroy()
    return out


def _among(queries: DataFrame, partners: DataFrame, search: Search, threshold: float) -> DataFrame:
    """(rep) of a chunk of queries with a partner, compared where the partners lie; once a task at most."""
    few = _chunk(queries)

    def looked(batches):
        reps, at = few.value
        own, left = _reps(reps), np.arange(len(reps))
        for batch in batches:
            other = pa.Table.from_batches([batch])
            found = met(search, threshold, own[left], at[left], _reps(other.column("rep")), units(other.column("v")))
            if found.any():
                yield pa.RecordBatch.from_arrays([reps.take(pa.array(left[found]))], names=["rep"])
                left = left[~found]

    out = written(partners.select("rep", "v").mapInArrow(looked, f"rep {queries.schema['rep'].dataType.simpleString()}"))
    few.destroy()
    return out


def flat(queries: DataFrame, partners: DataFrame, search: Search, threshold: float, left: int) -> DataFrame:
    """(rep) of the `left` queries (rep, v) with a partner among all, a chunk of queries after the other."""
    out = queries.select("rep").limit(0)
    chunks = math.ceil(left / _chunk_rows(queries)) if left else 0
    for k in range(chunks):
        chunk = queries.where(F.pmod(F.xxhash64("rep", F.lit("chunks")), F.lit(chunks)) == k)
        out = out.unionByName(_among(chunk, partners, search, threshold))
    return out


def _scouts(partners: DataFrame, search: Search, start: int, stop: int) -> DataFrame:
    """Partners number `start` to `stop`: the smallest reps if only those count, else in hash order."""
    placed = partners.withColumn("place", F.col("rep") if search.earlier else hash_order(F.col("rep"), "scouts"))

    def cut(n: int):
        return placed.select("place").orderBy("place").limit(n).agg(F.max("place")).first()[0]

    upto = placed.where(F.col("place") <= F.lit(cut(stop)))
    return (upto.where(F.col("place") > F.lit(cut(start))) if start else upto).select("rep", "v")


def scouted(queries: DataFrame, partners: DataFrame, search: Search, threshold: float, block: int) -> tuple[list[DataFrame], DataFrame, int]:
    """(found, rest, number of the rest): queries (rep, v) that a few partners settle, and the others.

    Where near copies are common, most queries have one among any few partners, and
    no tree need be asked for them. The partners of a round are four times those of
    the one before; a round that settles little is the last.
    """
    found: list[DataFrame] = []
    rest, left, all_partners = queries.select("rep", "v"), queries.count(), partners.count()
    start, size, most = 0, block, _chunk_rows(partners)
    for _ in range(SCOUT_ROUNDS):
        if left <= SCOUT_BLOCKS * block or start >= all_partners:
            break
        size = min(size, most)
        asked = _against(rest, _scouts(partners, search, start, start + size), search, threshold)
        found.append(asked.where("found").select("rep"))
        rest = asked.where("NOT found").select("rep", "v")
        before, left = left, rest.count()
        start, size = start + size, size * 4
        if left > before * SCOUTS_USEFUL:
            break
    return found, rest, left


def visits_each(tree: Tree, queries: DataFrame, left: int, search: Search, block: int) -> float:
    """Leaves that a query visits in the mean, by a hash sample of the `left` queries."""
    probes = queries.where(F.pmod(F.xxhash64("rep", F.lit("probes")), F.lit(left // PROBES + 1)) == 0)
    return descend(tree, probes, search, block, nearest=False)[1].count() / max(1, probes.count())


def partnered(tree: Tree, queries: DataFrame, search: Search, threshold: float, block: int) -> DataFrame:
    """(rep) of every query (rep, v) with a partner in the tree."""
    if search.same_table:
        # Every row lies in its nearest leaf already, and its angle to the pivot is known.
        own = tree.leaves.join(queries.select("rep"), "rep", "left_semi")
        placed = own.join(tree.ends.select("cell", "high", "n", "first"), "cell")
        may = search.column(F.col("rep"), F.col("first")) | (F.lit(not search.earlier) & (F.col("n") > 1))
        sure = (F.col("angle") + F.col("high") <= search.reach - SLACK) & may
        by_pivot = (F.col("angle") <= search.reach - SLACK) & search.column(F.col("rep"), F.col("pivot_rep"))
        marked = placed.withColumn("sure", F.coalesce(sure | by_pivot, F.lit(False)))
        met, home = marked.where("sure").select("rep"), marked.where("NOT sure").select("rep", "v", "cell")
    else:
        met, home = descend(tree, queries, search, block, nearest=True)
    home = written(home)
    found = written(met.unionByName(compare(tree, home, search, threshold, block)))
    if not tree.levels:
        return found
    rest = written(queries.join(found, "rep", "left_anti").select("rep", "v"))
    if rest.isEmpty():
        return found
    met, visits = descend(tree, rest, search, block, nearest=False)
    others = visits.join(home.select("rep", "cell"), ["rep", "cell"], "left_anti").select("rep", "v", "cell")
    return found.unionByName(met).unionByName(compare(tree, written(others), search, threshold, block))
