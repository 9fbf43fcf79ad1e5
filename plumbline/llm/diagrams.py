"""Filter interaction audit over count-weighted decision diagrams.

Every row carries a mask: bit k is set if it fails filter k. Spark counts the
masks per part; a part then is at most 2**k counts, whatever its number of rows.
From them a task builds the part's diagram: a node of level l branches on the
l-th filter of the order (pass or fail), equal sub-diagrams are one node, rows
that do not exist are one empty node, and a node's weight is the counts of all
rows below it. Plain changes visit all orders of the filters, each from the one
before by exchanging two adjacent levels, so only nodes of these two levels are
made anew. The path on which all filters pass gives an order's steps: the weight
of its k-th node is what the first k filters keep, the weight beside it what the
next one removes.

Nulls: a null condition counts as passed, a null part as the empty string, a
null fact as false. A null id is no copy of another row and has no labels. Empty
or null texts are texts of no word. Repeated rows each count; several labels of
an id hold if any of them does; ties in the id are no earlier copies. Texts of
any length are read whole. An empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.groups import attach
from plumbline.session import written

#: More filters have more orders than anyone reads (9! is 362,880 a part).
MOST_FILTERS = 8
STEP = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint"

Weight = tuple[int, ...]


class Diagram:
    """Shared sub-diagrams by level. Node 0 is empty; leaves are weights."""

    def __init__(self, counts: dict[int, Weight], filters: int):
        self.order = list(range(filters))
        self.zero: Weight = tuple(0 for _ in next(iter(counts.values())))
        self.weight: dict[int, Weight] = {0: self.zero}
        self.sides: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.known: list[dict] = [{} for _ in range(filters + 1)]
        self.root = self._build(counts, 0, 0)

    def _leaf(self, weight: Weight) -> int:
        if weight == self.zero:
            return 0
        return self._named(len(self.order), weight, weight, (0, 0))

    def _node(self, level: int, passed: int, failed: int) -> int:
        """The one node of a level with these two sides."""
        if not passed and not failed:
            return 0
        weight = tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed]))
        return self._named(level, (passed, failed), weight, (passed, failed))

    def _named(self, level: int, key: tuple, weight: Weight, sides: tuple[int, int]) -> int:
        found = self.known[level].get(key)
        if found is None:
            found = self.known[level][key] = len(self.weight)
            self.weight[found], self.sides[found] = weight, sides
        return found

    def _build(self, counts: dict[int, Weight], level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self.zero))
        return self._node(level, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def exchange(self, level: int) -> None:
        """Exchange the filters of a level and the next one; all other levels stay."""
        upper = list(self.known[level].values())
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.known[level + 1], self.known[level] = {}, {}
        for node in upper:
            passed, failed = (self.sides[s] for s in self.sides[node])
            sides = self._node(level + 1, passed[0], failed[0]), self._node(level + 1, passed[1], failed[1])
            self.sides[node] = sides
            self.known[level][sides] = node

    def steps(self) -> list[tuple[Weight, Weight]]:
        """Weights kept and removed by each filter of the order, along the all-pass path."""
        out, node = [], self.root
        for _ in self.order:
            passed, failed = self.sides[node]
            out.append((self.weight[passed], self.weight[failed]))
            node = passed
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Positions to exchange with their right neighbour, so that all orders of n things are visited once."""
    if n < 2:
        return
    down = True
    for inner in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            # The largest thing stands in front after a way down, at the end after a way up.
            yield inner + 1 if down else inner
        down = not down


def orders(counts: dict[int, Weight], names: list[str]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique fails, facts lost ..., removed over all orders)."""
    diagram = Diagram(counts, len(names))
    found = []
    for change in [None, *plain_changes(len(names))]:
        if change is not None:
            diagram.exchange(change)
        found.append((list(diagram.order), diagram.steps()))
    fails, alone, shares = {}, {}, dict.fromkeys(range(len(names)), 0)
    for order, steps in found:
        fails[order[0]], alone[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for filter_, (_, removed) in zip(order, steps):
            shares[filter_] += removed[0]
    out = []
    for order, steps in found:
        name = "".join(names[f] for f in order)
        for k, (f, (kept, removed)) in enumerate(zip(order, steps), 1):
            out.append((name, k, kept[0], removed[0], fails[f] - removed[0], alone[f], *removed[1:], shares[f]))
    return out


def mask(conditions: dict[str, Column]) -> Column:
    """Bit k is set where the k-th condition holds; null does not hold."""
    bits = [F.coalesce(c.cast("int"), F.lit(0)) * F.lit(1 << k) for k, c in enumerate(conditions.values())]
    return sum(bits[1:], bits[0])


def audit(counts: DataFrame, names: list[str], facts: list[str]) -> DataFrame:
    """Steps of all orders of the named filters for every part.

    `counts` has part, mask, n and one count per fact, any number of rows each;
    `{fact}_lost` are the facts' rows removed at a step.
    """
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"name 1 to {MOST_FILTERS} filters")
    held = ["n", *facts]
    part = F.coalesce(F.col("part"), F.lit("")).alias("part")
    per_mask = counts.groupBy(part, "mask").agg(*[F.sum(c).alias(c) for c in held])
    # At most 2**len(names) rows a part.
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", *held)).alias("masks"))
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{f}_lost" for f in facts], "shapley"]

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, masks in zip(batch["part"], batch["masks"]):
                rows = orders({int(m["mask"]): tuple(int(m[c]) for c in held) for m in masks}, names)
                out = pd.DataFrame(rows, columns=columns)
                out.insert(0, "part", name)
                yield out

    schema = ", ".join([STEP, *[f"{f}_lost bigint" for f in facts], "shapley bigint"])
    return parts.mapInPandas(walked, schema)


def earlier_copy(rows: DataFrame, id_column: str, digest: str, out: str) -> DataFrame:
    """Adds whether a row of a smaller id has the same digest; no digest's rows meet in one task."""
    copies = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("__first")).where("n > 1")
    marked = attach(rows, copies, digest, F.col(digest), rows.count())
    return marked.withColumn(out, F.coalesce(F.col(id_column) > F.col("__first"), F.lit(False))).drop("__first")


WORD = r"[^\x20\x09-\x0D]+"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of the rules on one text: short, repetitive, shouting, marked."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n_words,
        "C": 100 * upper > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
                    source: str = "source", facts: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """The audit of the text rules and of repeated texts, per source.

    `facts` maps a name to the label column and value that make it hold.
    """
    facts = facts or {"good": ("quality", 1), "toxic": ("toxic", 1)}
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
        mask(text_conditions(body)).alias("own"), F.sha2(body.cast("binary"), 256).alias("digest")))
    names = [*text_conditions(body), "E"]
    copied = earlier_copy(rows, "id", "digest", "copied")
    counts = copied.groupBy("id", "part", (F.col("own") + F.col("copied").cast("int") * (1 << len(names) - 1)).alias("mask")).agg(
        F.count(F.lit(1)).alias("rows"))
    held = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(
        *[F.max((F.col(c) == v).cast("int")).alias(f) for f, (c, v) in facts.items()])
    known = counts.join(held, counts["id"] == held["__id"], "left")
    return audit(
        known.select("part", "mask", F.col("rows").alias("n"), *[
            (F.col("rows") * F.coalesce(F.col(f), F.lit(0))).alias(f) for f in facts]),
        names, list(facts))
