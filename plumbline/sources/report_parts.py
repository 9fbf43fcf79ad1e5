"""Evaluation reports of any size, read and written in parts.

A report is a JSON document with a configuration, a summary and a long list of
results. It is read as lines, so a document is as many tasks as it has file
splits, and a result is a row of its own; only what is not a result is put
together per document. Any line breaks will do as long as every result begins on
a line of its own (as indented JSON and our own writer have it); a document on
one line is read whole.

The depth of brackets before a line tells where it stands. A task that reads a
block of lines has them in order and counts along; what a block starts from
(depth, list and numbers) is carried from one row per block. So no line is
exchanged to be placed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from plumbline.schemas import EVAL_REPORT, REPORT_RESULT
from plumbline.session import written

_OPENS = r'"individual_results"\s*:\s*\[\s*$'
#: A line without brackets, or one whole object without others: it opens what it closes.
_FLAT = r"^(?:[\s,]*+\{[^{}\[\]\\]*+\}[\s,]*+|[^{}\[\]\\]*+)$"
#: Blocks, and documents that are no reports, up to which they are broadcast.
BROADCAST_BLOCKS = 100_000
_CARRIED = ["depth0", "within0", "item0", "number0"]


def _net(line: Column) -> Column:
    """Brackets that a line of JSON opens, less those it closes; escapes and string contents do not count."""
    plain = F.when(F.contains(line, F.lit("\\")), F.regexp_replace(line, r"\\.", "")).otherwise(line)
    brackets = F.regexp_replace(plain, r'"[^"]*"|[^{}\[\]"]+', "")
    opened, closed = (F.length(F.translate(brackets, other, "")) for other in (']}"', '[{"'))
    return F.when(line.rlike(_FLAT), F.lit(0)).otherwise(opened - closed).cast("bigint")


def document_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None,
                   document: str = "file") -> DataFrame:
    """Lines (file, start, document, place, seq, line); `place` names the block of a file, seq rises in it.

    A document is a `file`, or a `folder` of part files in the order of their
    numbers; a folder of `many` holds one document after the other.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return reader.text(path).select(
        file.alias("file"), start.alias("start"), F.lit(document).alias("document"), F.xxhash64(file, start).alias("place"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def _document() -> tuple[Column, Column]:
    """The document of a file, and what its blocks are ordered by."""
    file, name = F.col("file"), F.substring_index("file", "/", -1)
    doc = F.when(F.col("document") == "file", file).otherwise(F.substring(file, F.lit(1), F.length(file) - F.length(name) - 1))
    number = F.coalesce(F.regexp_extract(name, "part-([0-9]+)[^/]*$", 1).try_cast("int"), F.lit(0))
    return doc, F.struct(number.alias("number"), file.alias("file"), F.col("start").alias("start"))


def _facts(lines: DataFrame) -> DataFrame:
    """Lines with what they say by themselves."""
    return lines.withColumn("net", _net(F.col("line"))).withColumns({
        "opens": (F.col("net") > 0) & F.regexp_replace("line", r"\\.", "").rlike(_OPENS),
        "starts": (F.col("net") > 0) & F.col("line").rlike(r"^\s*,?\s*\{"), "begins": F.col("line").rlike(r"^\s*[{\[]")})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, in order, with the running values of their block."""
    last = None  # place, depth, within, item and number after the rows so far
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        place, net, opens, starts, begins, depth0, within0, item0, number0 = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "net", "opens", "starts", "begins", *_CARRIED))
        rows = np.arange(n)
        new = np.r_[True, place[1:] != place[:-1]]
        first = rows[new]
        of = np.cumsum(new) - 1
        froms = [x[first] for x in (depth0, within0, item0, number0)]
        if last is not None and last[0] == place[0]:
            froms = [x.copy() for x in froms]
            for x, value in zip(froms, last[1:], strict=True):
                x[0] = value

        def along(step, at, first=first, of=of):
            """Running sum from the value `at` the start of each block."""
            total = np.cumsum(step)
            return total + (at - (total[first] - step[first]))[of]

        after = along(net, froms[0])
        depth = after - net
        outer = np.maximum.accumulate(np.where(depth <= 1, rows, -1))
        within = np.where(outer >= first[of], (opens & (after == 2))[outer], froms[1][of])
        item = along((starts & (depth == 2)).astype(np.int64), froms[2])
        number = along((begins & (depth == 0)).astype(np.int64), froms[3])
        last = (place[-1], after[-1], within[-1], item[-1], number[-1])
        kept = [c for c in batch.schema.names if c not in _HELPERS]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, kept), *map(pa.array, (depth, after, within, item, number))],
            [*kept, "depth", "after", "within", "item", "number"])


_HELPERS = {"net", "opens", "starts", "begins", *_CARRIED}
_RUNS = "depth bigint, after bigint, within boolean, item bigint, number bigint"


def _counted(facts: DataFrame) -> DataFrame:
    """Facts with running values; without carried columns from zero in every block."""
    start = {"depth0": F.lit(0).cast("bigint"), "within0": F.lit(False), "item0": F.lit(0).cast("bigint"), "number0": F.lit(0).cast("bigint")}
    full = facts.withColumns({c: F.coalesce(F.col(c), v) if c in facts.columns else v for c, v in start.items()})
    kept = facts.select(*[c for c in facts.columns if c not in _HELPERS]).schema
    for f in StructType.fromDDL(_RUNS):
        kept = kept.add(f)
    return full.mapInArrow(_runs, kept)


def _blocks(lines: DataFrame) -> DataFrame:
    """A written row per block: what it starts from, and whether it may hold results of several lines."""
    # Lines that open what they close tell of no other line, but may be documents of their own.
    facts = _facts(lines).where("net <> 0 OR begins")
    told = [F.col(c).alias(f"is_{c}") for c in ("opens", "starts", "begins")]
    seen = _counted(facts.select("place", "seq", "net", "opens", "starts", "begins", *told))
    # Depths are relative to the block here; few kinds of lines differ in depth and in what they open.
    kinds = seen.groupBy("place", "depth", (F.col("after") - F.col("depth")).alias("net")).agg(
        F.max("seq").alias("last"), F.max(F.when(F.col("is_opens"), F.col("seq"))).alias("opened"),
        F.count_if("is_starts").alias("starts"), F.count_if("is_begins").alias("begins"), F.count(F.lit(1)).alias("n"))
    doc, block = _document()
    told = kinds.groupBy("place").agg(
        F.sum(F.col("net") * F.col("n")).alias("net"),
        F.collect_list(F.struct("depth", "net", "last", "opened", "starts", "begins")).alias("kinds"))
    # A block in the midst of a list may have no such line.
    places = lines.groupBy("place", "file", "start", "document").agg(F.count(F.lit(1)).alias("n_lines"))
    blocks = places.join(told, "place", "left").withColumns({
        "doc": doc, "block": block, "kinds": F.coalesce("kinds", F.array())})
    earlier = W.partitionBy("doc").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    deep = blocks.withColumn("depth0", F.coalesce(F.sum("net").over(earlier), F.lit(0)))

    def of(name, kept, fold):
        return fold(F.transform(F.filter("kinds", lambda k: kept(F.col("depth0") + k["depth"], k["net"])), lambda k: k[name]))

    def total(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    outer = of("last", lambda depth, net: depth <= 1, F.array_max)
    opened = of("opened", lambda depth, net: (depth <= 1) & (depth + net == 2), F.array_max)
    known = deep.withColumns({
        "within": F.when(outer.isNotNull(), F.coalesce(outer == opened, F.lit(False))),
        "items": of("starts", lambda depth, net: depth == 2, total),
        "begun": of("begins", lambda depth, net: depth == 0, total),
        "long": F.exists("kinds", lambda k: (F.col("depth0") + k["depth"] >= 2) & (F.col("depth0") + k["depth"] + k["net"] >= 2)
                         & ((F.col("depth0") + k["depth"] > 2) | (k["net"] != 0)))})
    return written(known.select(
        "place", "doc", "block", "n_lines", "long", "depth0", F.coalesce(F.last("within", ignorenulls=True).over(earlier), F.lit(False)).alias("within0"),
        F.coalesce(F.sum("items").over(earlier), F.lit(0)).alias("item0"),
        F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("number0")))


def _placed(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines (place, seq, line) with depth, after, inside, item and number."""
    facts = _facts(lines.select("place", "seq", "line"))
    # Most blocks begin a document and start from zero.
    carried = blocks.where("depth0 <> 0 OR within0 OR item0 <> 0 OR number0 <> 0").select("place", *_CARRIED)
    n = carried.count()
    if 0 < n <= BROADCAST_BLOCKS:
        facts = facts.join(F.broadcast(carried), "place", "left")
    elif n:
        facts = facts.join(carried, "place", "left").repartition("place").sortWithinPartitions("place", "seq")
    inside = F.col("within") & (F.col("depth") >= 2) & (F.col("after") >= 2)
    return _counted(facts).select("place", "seq", "line", "depth", "after", inside.alias("inside"), "item", "number")


def _named(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Placed lines with their document and block."""
    known = blocks.select("place", "doc", "block")
    return placed.join(F.broadcast(known) if known.count() <= BROADCAST_BLOCKS else known, "place")


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines with `depth` (brackets open before), `after`, `inside` (of the results), `item`, the number of a result
    of several lines, and `number`, that of the document among many."""
    blocks = _blocks(lines)
    return _named(_placed(lines, blocks), blocks)


def _together() -> Column:
    """The lines of a group in order; a group is one result, or a document without its results."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "seq", "line")))
    return F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")


def _result(text: Column) -> Column:
    """A result from its text, with the commas around it."""
    return F.from_json(F.btrim(text, F.lit(" \t\n\x0b\f\r,")), REPORT_RESULT)


def scan_report_parts(spark: SparkSession, path: str | list[str], pattern: str | None = None,
                      document: str = "file") -> tuple[DataFrame, DataFrame]:
    """(reports, results): a row per document with configuration and summary, and a row per result.

    Reports have the columns of the report schema and `file_path`, with those
    results only that stand on one line with the rest. Results have `file_path`
    and the result's fields. Documents that are no reports are in neither.
    """
    lines = document_lines(spark, path, pattern, document)
    blocks = _blocks(lines)
    placed = _named(_placed(lines, blocks), blocks)
    if document == "many":
        placed = placed.withColumn("doc", F.concat("doc", F.lit("#"), "number"))
    heads = placed.where("NOT inside").groupBy("doc").agg(_together().alias("text"))
    found = written(heads.select(F.col("doc").alias("file_path"), F.from_json("text", EVAL_REPORT).alias("r")).select("r.*", "file_path"))
    is_report = F.col("evaluation_config").isNotNull() & F.col("summary_metrics").isNotNull()
    reports = found.where(is_report)
    held = placed.where("inside")
    # Most results are one line and are read where they stand.
    one = (F.col("depth") == 2) & (F.col("after") == 2)
    results = held.where(one & F.col("line").rlike(r"\{")).select("doc", F.col("line").alias("text"))
    if blocks.where("long").limit(1).count():
        long = held.where(~one).groupBy("doc", "item").agg(_together().alias("text")).select("doc", "text")
        results = results.unionByName(long)
    # Few documents are no reports; the results of the others stay where they are.
    others = found.where(~is_report).select(F.col("file_path").alias("doc"))
    n = others.count()
    if n:
        results = results.join(F.broadcast(others) if n <= BROADCAST_BLOCKS else others, "doc", "left_anti")
    # A generator, as fields taken from a parsed column are each parsed anew.
    return reports, results.select(F.col("doc").alias("file_path"), F.inline(F.array(_result(F.col("text")))))


def explode_result_parts(reports: DataFrame, results: DataFrame) -> DataFrame:
    """Prompt, response and scenario id of every result; tier C and scope S0 by default.

    A report without results fails the job, with the place of the document.
    """
    columns = ["scenario_id", "prompt", "response"]
    results = written(results.select("file_path", *columns))  # counted and handed on
    counts = results.groupBy("file_path").agg(F.count(F.lit(1)).alias("__n"))
    inline = F.coalesce("individual_results", F.array())
    held = F.when((F.size(inline) > 0) | F.col("__n").isNotNull(), inline).otherwise(
        F.raise_error(F.concat(F.lit("No 'individual_results' found in "), F.col("file_path"))))
    alone = reports.join(counts, "file_path", "left").select(F.explode(held).alias("r"))
    rows = alone.select(*[f"r.{c}" for c in columns]).unionByName(results.select(*columns))
    return rows.where("prompt <> '' AND response <> ''").withColumns({"tier": F.lit("C"), "scope": F.lit("S0")})


def sink_report_parts(lines: DataFrame, path: str, run: str, key: str) -> None:
    """One folder per run whose part files, in the order of their numbers, are its document.

    Rows are cut by ranges of run, part and key, so a run that is a third of all
    rows is written by a third of the tasks, and a task's numbers follow the order.
    """
    ordered = written(lines).repartitionByRange(run, "part", key).sortWithinPartitions(run, "part", key)
    ordered.select(F.col(run).alias("name"), "line").write.partitionBy("name").text(path)


def sink_many_reports(lines: DataFrame, path: str, run: str, key: str, parts: int) -> None:
    """The documents of all runs one after the other, in one folder of `parts` packed files.

    The files do not grow in number with the runs, and a run that is a large
    part of all rows is cut as the others are. The lines are read twice, once to
    find the cuts.
    """
    ordered = lines.repartitionByRange(parts, run, "part", key).sortWithinPartitions(run, "part", key)
    ordered.select("line").write.option("compression", "gzip").text(path)
