"""Writers: JSON lines, report tables and documents, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import names as N
from plumbline.session import written

#: Runs up to which their first results are broadcast.
BROADCAST_RUNS = 1_000_000


def sink_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def sink_eval_report(summary: DataFrame, items: DataFrame, path: str, run: str = "run") -> None:
    """Summary and item tables; items lie in evenly sized files, sorted so that a run is found by file statistics."""
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    # A row's number beside the run cuts a run that is a large part of all rows into many files.
    placed = items.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(run, "__place")
    placed.sortWithinPartitions(run).drop("__place").write.mode("overwrite").parquet(f"{path}/items")


def report_lines(summary: DataFrame, items: DataFrame, run: str, key: str, fields: list[str]) -> DataFrame:
    """Lines (run, part, key, line) of one JSON document per run: head, a line per result, end.

    Sorted by part and key the lines of a run are its document, so it is never
    held in one row. The first result of a run (least key) opens the list.
    """
    facts = items.groupBy(run).agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__first"))
    heads = written(summary.join(facts, run))
    metrics = [c for c in summary.columns if c != run]
    head = F.concat(
        F.lit('{"evaluation_config": '),
        F.to_json(F.struct(F.col(run).alias("model_name"), F.col("__n").alias("num_scenarios"))),
        F.lit(', "summary_metrics": '), F.to_json(F.struct(*metrics)), F.lit(', "individual_results": ['))
    none = F.lit(None).cast(items.schema[key].dataType)
    tops = heads.select(run, F.lit(0).alias("part"), none.alias(key), head.alias("line"))
    ends = heads.select(run, F.lit(2).alias("part"), none.alias(key), F.lit("]}").alias("line"))
    firsts = heads.select(run, F.col("__first").alias(key), F.lit(True).alias("__opens"))
    if firsts.count() <= BROADCAST_RUNS:
        firsts = F.broadcast(firsts)
    body = items.select(run, key, F.to_json(F.struct(*fields)).alias("line")).join(firsts, [run, key], "left")
    rows = body.select(run, F.lit(1).alias("part"), key, F.concat(F.when(F.col("__opens"), "").otherwise(","), "line").alias("line"))
    return tops.unionByName(rows).unionByName(ends)


def sink_report_documents(lines: DataFrame, path: str, run: str, key: str) -> None:
    """One JSON document per run, written line by line; a document is one file."""
    ordered = lines.repartition(run).sortWithinPartitions(run, "part", key)
    ordered.select(F.col(run).alias("name"), "line").write.partitionBy("name").text(path)


def markdown_table(df: DataFrame, formats: dict | None = None) -> str:
    """A finished, already small result as a markdown table."""
    formats = formats or {}
    columns = df.columns
    rows = df.select(*[formats.get(c, lambda x: x.cast("string"))(F.col(c)).alias(c) for c in columns]).collect()
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    lines += ["| " + " | ".join("N/A" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines)


def comparison_report(pivoted: DataFrame, detail: DataFrame, rates: set[str]) -> str:
    """Key metrics per evaluator and the detailed table, as markdown."""
    shown = F.when(F.col("metric").isin(list(rates)), N.percent(F.col("baseline"))).otherwise(N.score3(F.col("baseline")))
    other = F.when(F.col("metric").isin(list(rates)), N.percent(F.col("candidate"))).otherwise(N.score3(F.col("candidate")))
    table = pivoted.orderBy("metric", "evaluator_name").select(
        "metric", "evaluator_name", shown.alias("baseline"),
        F.when(F.col("has_candidate"), other).otherwise("N/A").alias("candidate"), "improvement",
    )
    parts = ["# Model Evaluation Results Comparison", "", "## Key Metrics Comparison", "", markdown_table(table),
             "", "## Detailed Metrics by Model and Evaluator", "", markdown_table(detail)]
    return "\n".join(parts)


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Markdown rows as a table, for results that are written rather than shown."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_report(sections: list[tuple[str, DataFrame, list[str]]], title: str) -> DataFrame:
    """Lines (section, part, line) of a report: title, then a heading and a table per section.

    Ordered by these columns they are the report; rows of a table are in order of their text.
    """
    spark = sections[0][1].sparkSession
    heads = [(0, 0, f"# {title}")]
    for k, (heading, _, columns) in enumerate(sections, 1):
        heads += [(k, 0, f"## {heading}"), (k, 1, "| " + " | ".join(columns) + " |"),
                  (k, 2, "| " + " | ".join("---" for _ in columns) + " |")]
    out = spark.createDataFrame(heads, "section int, part int, line string")
    for k, (_, df, columns) in enumerate(sections, 1):
        out = out.unionByName(markdown_lines(df, columns).select(F.lit(k).alias("section"), F.lit(3).alias("part"), "line"))
    return out


def sink_markdown(report: DataFrame, path: str) -> None:
    """Write the lines of a report in order; a sorted write keeps any size readable in file order."""
    report.orderBy("section", "part", "line").select("line").write.mode("overwrite").text(path)


def sink_records_json(records: DataFrame, path: str, names: tuple[str, ...] = ("model_name", "evaluator_name")) -> None:
    """Records as JSON lines, with their number and the distinct names beside them."""
    records.write.mode("overwrite").json(f"{path}/records")
    records.agg(F.count(F.lit(1)).alias("total_evaluations")).write.mode("overwrite").json(f"{path}/metadata")
    for name in names:
        records.select(name).distinct().write.mode("overwrite").json(f"{path}/{name}")
