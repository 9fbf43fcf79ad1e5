"""N-gram Jaccard join with vertical partitioning, and its components.

Two documents link if their sets of n-word shingles overlap by at least
`percent` of their union. Documents of equal sets are one vertex. The join is
exact; no pair of a class of copies is formed, and no bucket is capped.

1. Filter. Of a set of n shingles a partner misses at most (100 - percent) % n.
   The shingles whose hash is below one bound, the same for all sets and about
   `PREFIX_PERCENT` of all, are dealt to fragments by hash, so a shared shingle
   is dealt by each set that has it or by none; a fragment counts, for every
   set, the shingles that no other set has, and the counts are summed per set. A
   set with too many is linked to nothing and goes. What a task can tell alone is
   settled before the exchange.
2. Order. For the remaining sets all shingles are ordered by how many of these
   sets have them, then by hash, and cut into fragments at quantiles; a set
   becomes one sorted segment per fragment.
3. Candidates. A linked pair shares one of the first n - ceil(percent % n) + 1
   shingles of either set. Per shingle, the set with the most common shingles is
   the centre, and each set is first compared with its best centre only. Sets of
   one centre that are not yet in one component are compared by what they have
   beyond their centre and lack of it, in pairs of blocks; sets of different
   centres by the shingles they share, if their sizes can reach the threshold.
4. Verification. Per fragment and pair the segments' overlap is counted; the
   partial overlaps are summed per pair and compared with the union.

Texts with fewer words than n are one shingle; texts without words (null, empty
or blank) are linked with nothing. The result has one row per input row: rows
that repeat an id each have their own set, and rows of a null id link with
nothing. Inside, a class of equal sets has a number of its own, so ids may be of
any type and repeat. Ties between centres change the order of the work only.
Texts of any length are read whole, an empty table gives no rows, and columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.components import components
from plumbline.llm.groups import attach
from plumbline.llm.packed import FOLD, gram_hashes, hashes, mix, owner, slices, unpack, words
from plumbline.session import written

PREFIX_PERCENT = 30
#: Hashes below it are dealt by the filter.
DEALT_BELOW = np.uint64(2**64 * PREFIX_PERCENT // 100)
SEGMENTS = 8
FLUSH_SHINGLES = 1_000_000
FLUSH_TEXTS = 60_000
#: Bytes of a hash in the filter; equal cut hashes only let a set pass.
CUT_BYTES = 5
#: Sets per block when the members of one centre are compared.
BLOCK_SETS = 512
BROADCAST_SETS = 500_000


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row, then hash."""
    data, offsets = unpack(texts)
    starts, ends = words(data, offsets)
    row = owner(starts, offsets)
    h = hashes(FOLD[data], starts, ends)
    grams, first = gram_hashes(h, row, n)
    rows = row[first]
    count = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        at = np.concatenate([[0], np.cumsum(count)])
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = count[few] > k
            place = at[few[has]] + k
            short[has] = mix(short[has] * np.uint64(0x9E3779B97F4A7C15) + h[place] + np.uint64(k + 1))
        grams, rows = np.concatenate([grams, short]), np.concatenate([rows, few])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], grams[new]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _signatures(rows: np.ndarray, grams: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set, and two order-free 64-bit digests of it."""
    size = np.bincount(rows, minlength=texts)
    at = np.concatenate([[0], np.cumsum(size)])

    def folded(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        return mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))

    return size, folded(mix(grams)), folded(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def describe(docs: DataFrame, id_column: str, text: str, n: int) -> DataFrame:
    """(id, tie, size, s1, s2): digest of the text, set size and digest of the set of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, grams = shingle_sets(part.column("text"), n)
                size, one, two = _signatures(rows, grams, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tie"), pa.array(size.astype(np.int64)), pa.array(_signed(one)),
                     pa.array(_signed(two))], names=["id", "tie", "size", "s1", "s2"])

    return docs.select(F.col(id_column).alias("id"), _tie(text).alias("tie"), F.col(text).alias("text")).mapInArrow(
        described, f"id {kind}, tie string, size bigint, s1 bigint, s2 bigint")


def _tie(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _unshared(docs: DataFrame, text: str, n: int, fragments: int) -> DataFrame:
    """(s1, unshared): shingles of each set with a hash below the bound that no other set has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = texts_held = 0
        for batch in batches:
            for part in slices(batch):
                rows, grams = shingle_sets(part.column("text"), n)
                if not len(rows):
                    continue
                _, one, _ = _signatures(rows, grams, part.num_rows)
                taken = grams < DEALT_BELOW
                if not taken.any():
                    continue
                held.append((one[rows[taken]], grams[taken]))
                total += int(taken.sum())
                texts_held += part.num_rows
                if total >= FLUSH_SHINGLES or texts_held > FLUSH_TEXTS:
                    yield from _fragment_rows(held, fragments)
                    held, total, texts_held = [], 0, 0
        if held:
            yield from _fragment_rows(held, fragments)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                fragment = batch.column("fragment")[k].as_py()
                if fragment != now and held:
                    yield _lonely(held)
                    held = []
                now = fragment
                held.append((_wide(batch.column("grams")[k].as_py()),
                             np.frombuffer(batch.column("owner")[k].as_buffer(), np.uint16),
                             np.frombuffer(batch.column("sets")[k].as_buffer(), np.uint64)))
        if held:
            yield _lonely(held)

    texts = docs.select(F.col(text).alias("text"))
    pieces = texts.mapInArrow(cut, "fragment int, grams binary, owner binary, sets binary")
    dealt = pieces.repartition(fragments, "fragment").sortWithinPartitions("fragment")
    return dealt.mapInArrow(counted, "s1 bigint, unshared bigint").groupBy("s1").agg(F.sum("unshared").alias("unshared"))


def _narrow(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CUT_BYTES].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // CUT_BYTES, 8), np.uint8)
    out[:, :CUT_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, CUT_BYTES)
    return out.reshape(-1).view("<u8")


#: Owner of a shingle that several sets of one task have.
_MANY = np.uint16(0xFFFF)


def _fragment_rows(held: list[tuple[np.ndarray, np.ndarray]], fragments: int) -> Iterator[pa.RecordBatch]:
    """One row per fragment: sorted shingles, and for those of one set only, that set."""
    sets, grams = (np.concatenate(c) for c in zip(*held))
    known, owner_ = np.unique(sets, return_inverse=True)
    fragment = grams % np.uint64(fragments)
    grams = grams >> np.uint64(64 - 8 * CUT_BYTES)
    order = np.lexsort((owner_, grams, fragment))
    grams, owner_, fragment = grams[order], owner_[order].astype(np.uint16), fragment[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (fragment[1:] != fragment[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(grams)]]) - 1
    one = owner_[first].copy()
    one[owner_[first] != owner_[last]] = _MANY
    grams = grams[first]
    edges = np.searchsorted(fragment[first], np.arange(fragments + 1, dtype=np.uint64))
    out: list[tuple[int, bytes, bytes, bytes]] = []
    for f in range(fragments):
        a, b = edges[f], edges[f + 1]
        if a < b:
            mine = one[a:b]
            single = mine != _MANY
            used, place = np.unique(mine[single], return_inverse=True)
            packed = np.full(b - a, _MANY, np.uint16)
            packed[single] = place
            out.append((f, _narrow(grams[a:b]), packed.tobytes(), known[used].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                     names=["fragment", "grams", "owner", "sets"])


def _lonely(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Shingles of one fragment that a single set has, counted per set."""
    grams = np.concatenate([h[0] for h in held])
    # 0 stands for several sets.
    sets = np.concatenate([np.concatenate([h[2], [np.uint64(0)]])[np.where(h[1] == _MANY, len(h[2]), h[1])] for h in held])
    order = np.argsort(grams, kind="stable")
    grams, sets = grams[order], sets[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    low, high = np.minimum.reduceat(sets, first), np.maximum.reduceat(sets, first)
    found, count = np.unique(low[(low == high) & (low != 0)], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(count.astype(np.int64))], names=["s1", "unshared"])


def _grams_of(docs: DataFrame, n: int) -> DataFrame:
    """(v, size, h) of texts (v, text)."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, grams = shingle_sets(part.column("text"), n)
                size = np.bincount(rows, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("v").take(pa.array(rows)), pa.array(size[rows].astype(np.int64)), pa.array(_signed(grams))],
                    names=["v", "size", "h"])

    kind = docs.schema["v"].dataType.simpleString()
    return docs.mapInArrow(exploded, f"v {kind}, size bigint, h bigint")


def _reach(size: Column, percent: int) -> Column:
    """ceil(percent % of size)."""
    return F.floor((size * percent + 99) / 100)


def _can_link(a: str, b: str, percent: int) -> Column:
    """Sizes and numbers of shared shingles allow the threshold."""
    most = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return most * (100 + percent) >= (F.col(f"{a}.size") + F.col(f"{b}.size")) * percent


def _ordered(docs: DataFrame, sets: DataFrame, n: int, percent: int, id_column: str, text: str) -> DataFrame:
    """Sets that may have a partner: (v, size, shared, weight, grams by the global order, rarest first)."""
    fragments = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lonely = _unshared(docs, text, n, fragments)
    alive = sets.join(lonely, "s1", "left").where(
        F.coalesce("unshared", F.lit(0)) * 100 <= F.col("size") * (100 - percent)).select("v", "id", "tie")
    texts = docs.select(F.col(id_column).alias("id"), _tie(text).alias("tie"), F.col(text).alias("text"))
    alive = written(alive)
    # Few sets remain; texts move only if they are many.
    alive = F.broadcast(alive) if alive.count() <= BROADCAST_SETS else alive
    chosen = texts.join(alive, ["id", "tie"]).groupBy("v").agg(F.min("text").alias("text"))
    grams = written(_grams_of(chosen, n))
    common = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # The global order: how many sets have a shingle, then its hash.
    return written(grams.join(common, "h").groupBy("v", "size").agg(
        F.count(F.lit(1)).alias("shared"), F.sum("df").alias("weight"),
        F.sort_array(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "h"))).alias("grams")).where(
            F.col("shared") >= _reach(F.col("size"), percent)))


def _place(g: Column) -> Column:
    """Place in the global order as one number."""
    return g["df"] + (g["h"] / F.lit(2.0**64) + 0.5)


def _segments(ordered: DataFrame) -> DataFrame:
    """(v, fragment, grams): each set cut where quantiles cut the global order."""
    places = ordered.select(F.explode("grams").alias("g")).select(_place(F.col("g")).alias("o"))
    cuts = places.select(F.percentile_approx("o", [i / SEGMENTS for i in range(1, SEGMENTS)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]

    def within(low: float | None, high: float | None) -> Column:
        def inside(g: Column) -> Column:
            above = F.lit(True) if low is None else _place(g) >= low
            return above if high is None else above & (_place(g) < high)

        return F.transform(F.filter("grams", inside), lambda g: g["h"])

    cut = F.array(*[within(low, high) for low, high in zip(bounds[:-1], bounds[1:])])
    return ordered.select("v", F.posexplode(cut).alias("fragment", "grams"))


def _overlaps(pairs: DataFrame, segments: DataFrame, differences: bool) -> DataFrame:
    """The pairs' columns with their overlap: counted per fragment, summed per pair.

    With `differences` also the shingles only a has (more) and only b has (less).
    """
    left = segments.select(F.col("v").alias("a"), "fragment", F.col("grams").alias("x"))
    right = segments.select(F.col("v").alias("b"), "fragment", F.col("grams").alias("y"))
    joined = pairs.join(left, "a").join(right, ["b", "fragment"])
    sums = [F.sum(F.size(F.array_intersect("x", "y"))).alias("overlap")]
    if differences:
        sums += [F.flatten(F.collect_list(F.array_except("x", "y"))).alias("more"),
                 F.flatten(F.collect_list(F.array_except("y", "x"))).alias("less")]
    return joined.groupBy(*pairs.columns).agg(*sums)


def _linked(overlap: str, a: str, b: str, percent: int) -> Column:
    return F.col(overlap) * 100 >= (F.col(a) + F.col(b) - F.col(overlap)) * percent


def _within_centres(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join components among the sets of each centre.

    `members` has (c, size_c, v, size, component, more, less): what a set has
    beyond its centre and what it lacks of it. The overlap of two sets follows
    from these: size_c - |less_a or less_b| + |more_a and more_b|. Sets that are
    not in the centre's main component are open; blocks of them meet blocks of
    all sets of the centre. A task holds one pair of blocks and returns only
    links that join components. Each side is cut by its own size, so N sets with
    one open set among them are copied once.
    """
    count = F.count(F.lit(1)).alias("n")
    sizes = members.groupBy("c", "component").agg(count)
    rows = _dealt_members(members)
    kind = members.schema["v"].dataType.simpleString()
    meet = rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["c"], row["i"], row["j"])
                if held and at != key:
                    yield _block_links(held, percent)
                    held = []
                key = at
                held.append(row)
        if held:
            yield _block_links(held, percent)

    return meet.mapInArrow(compared, f"a {kind}, b {kind}")


def _dealt_members(members: DataFrame) -> DataFrame:
    """Rows of each pair (i, j) of a block of open sets and a block of all sets, per centre."""
    sizes = members.groupBy("c", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("c").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"),
                                   F.count(F.lit(1)).alias("k")).where("k > 1")
    plan = mains.select(
        "c", F.col("m.component").alias("main"),
        F.ceil((F.col("n") - F.col("m.n")) / BLOCK_SETS).cast("int").alias("opens"),
        F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("blocks"))
    dealt = members.join(plan, "c")
    columns = ["c", "size_c", "v", "size", "component", "more", "less", "side", "i", "j"]

    def place(blocks: str) -> Column:
        return F.pmod(F.xxhash64("v"), F.col(blocks)).cast("int")

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    asks = dealt.where("component <> main").select(
        "*", F.lit(0).alias("side"), place("opens").alias("i"), each("blocks").alias("j"))
    gives = dealt.select("*", F.lit(1).alias("side"), each("opens").alias("i"), place("blocks").alias("j"))
    return asks.select(*columns).unionByName(gives.select(*columns))


def _block_links(rows: list[dict], percent: int) -> pa.RecordBatch:
    """Links of one pair of blocks that join components."""
    x, y = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    out: list[tuple] = []
    if x and y:
        both = _shared_counts([r["more"] for r in x], [r["more"] for r in y])
        both += _shared_counts([r["less"] for r in x], [r["less"] for r in y])
        lack_x, lack_y = (np.array([len(r["less"]) for r in side]) for side in (x, y))
        overlap = x[0]["size_c"] - lack_x[:, None] - lack_y[None, :] + both
        size_x, size_y = (np.array([r["size"] for r in side]) for side in (x, y))
        link = overlap * 100 >= (size_x[:, None] + size_y[None, :] - overlap) * percent
        parent: dict = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for i, j in zip(*np.nonzero(link)):
            a, b = root(x[i]["component"]), root(y[j]["component"])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x[i]["v"], y[j]["v"]))
    return pa.RecordBatch.from_pydict({"a": [o[0] for o in out], "b": [o[1] for o in out]}) if out else \
        pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _shared_counts(x: list[list[int]], y: list[list[int]]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    out = np.zeros((len(x), len(y)), np.int64)
    xs, ys = np.concatenate([np.array(v, np.int64) for v in x]), np.concatenate([np.array(v, np.int64) for v in y])
    xi, yi = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.repeat(np.arange(len(y)), [len(v) for v in y])
    order = np.argsort(ys, kind="stable")
    ys, yi = ys[order], yi[order]
    low, high = np.searchsorted(ys, xs, "left"), np.searchsorted(ys, xs, "right")
    for i in range(len(x)):
        mine = xi == i
        spans = [yi[a:b] for a, b in zip(low[mine], high[mine]) if a < b]
        if spans:
            out[i] = np.bincount(np.concatenate(spans), minlength=len(y))
    return out


def links(docs: DataFrame, sets: DataFrame, n: int, percent: int, id_column: str, text: str) -> DataFrame:
    """(a, b) links between representatives that join the components of different sets."""
    ordered = _ordered(docs, sets, n, percent, id_column, text)
    segments = _segments(ordered)
    # Shingles that no other set has come before all others and cannot be shared.
    first = F.col("size") - _reach(F.col("size"), percent) + 1 - (F.col("size") - F.col("shared"))
    prefix = written(ordered.select("v", "size", "shared", "weight", F.explode(
        F.slice("grams.h", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("h")))

    score = F.struct((F.col("weight") / F.col("size")).alias("w"), F.col("v").alias("v"))
    # Written, so that both sides of the join are plain exchanges and a hot shingle can be split.
    centres = written(prefix.groupBy("h").agg(F.max(F.struct(score.alias("score"), "size", "shared")).alias("c")))
    best = prefix.join(centres, "h").groupBy("v", "size", "shared").agg(F.max("c").alias("c"))
    stars = best.where("c.score.v <> v").select(
        F.col("v").alias("a"), F.col("c.score.v").alias("b"), F.col("size").alias("size_a"),
        F.col("c.size").alias("size_b"), F.col("c.shared").alias("shared_b"))
    compared = written(_overlaps(stars, segments, differences=True))
    star_links = compared.where(_linked("overlap", "size_a", "size_b", percent)).select("a", "b")

    near = written(components(star_links).withColumnRenamed("vertex", "v"))
    # What only shows up in shingles that a set shares with no other set is in neither list.
    members = compared.select(
        F.col("b").alias("c"), F.col("shared_b").alias("size_c"), F.col("a").alias("v"), F.col("size_a").alias("size"),
        "more", "less").join(near, "v", "left").withColumn("component", F.coalesce("component", "v"))
    inner = _within_centres(members, percent)

    # Pairs of different centres: per shingle the sets outside its main component meet all sets.
    centre = compared.select(F.col("a").alias("v"), F.col("b").alias("centre"))
    placed = written(prefix.join(near, "v", "left").join(centre, "v", "left").withColumns({
        "component": F.coalesce("component", "v"), "centre": F.coalesce("centre", "v")}))
    sizes = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = written(sizes.groupBy("h").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where(
        "k > 1").select("h", F.col("m.component").alias("main")))
    open_ = placed.join(mains, "h")
    x, y = open_.where("component <> main").alias("x"), open_.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & (F.col("x.centre") != F.col("y.centre")) & (
        (F.col("y.component") == F.col("y.main")) | (F.col("x.v") < F.col("y.v")))
    more = x.join(y, (F.col("x.h") == F.col("y.h")) & differ & _can_link("x", "y", percent)).select(
        F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.size").alias("size_a"),
        F.col("y.size").alias("size_b")).distinct()
    outer = _overlaps(more, segments, differences=False).where(_linked("overlap", "size_a", "size_b", percent)).select("a", "b")
    return star_links.unionByName(inner).unionByName(outer)


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    described = written(describe(docs, id_column, text, n))
    classes = written(described.where("size > 0 AND id IS NOT NULL").groupBy("s1", "s2", "size").agg(
        F.min(F.struct("id", "tie")).alias("m"), F.count(F.lit(1)).alias("n")).select(
            "s1", "s2", "size", F.col("m.id").alias("id"), F.col("m.tie").alias("tie"), "n",
            F.monotonically_increasing_id().alias("v")))
    joined = written(components(links(docs, classes, n, percent, id_column, text)).withColumnRenamed("vertex", "v"))
    total = described.count()
    linked = classes.join(joined, "v", "left")
    least = linked.where("component IS NOT NULL").groupBy("component").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    key = F.concat_ws(":", "s1", "s2", "size")
    # Only classes of several rows or with links need a look-up.
    roots = attach(linked, least, "component", F.col("v"), total).where("n > 1 OR component IS NOT NULL").select(
        key.alias("key"), "n", F.coalesce("least", "id").alias("root"))
    keyed = described.select(
        "id", "tie", "size", F.when((F.col("size") > 0) & F.col("id").isNotNull(), key).alias("key"))
    found = attach(keyed, roots, "key", F.xxhash64("id", "tie"), total)
    return found.select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"),
                        F.coalesce("root", "id").alias("component_id"))
