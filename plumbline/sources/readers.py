"""Readers: JSON lines, evaluation reports, lexicons and logs, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from plumbline import config as C
from plumbline.functions.text import strip
from plumbline.operators.ordering import add_rank
from plumbline.schemas import EVAL_REPORT, SCENARIO


def scan_jsonl(spark: SparkSession, path: str | list[str], schema: str = SCENARIO,
               pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows and, apart from them, the lines that could not be read. Blank lines vanish."""
    wide = schema + ", _bad STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    glob = {"pathGlobFilter": pattern} if pattern else {}
    rows = spark.read.schema(wide).options(**options, **glob).json(path)
    lines = spark.read.options(**glob).text(path).where(strip(F.col("value")) != "")
    bad = lines.where(F.from_json("value", wide, options)["_bad"].isNotNull()).select(F.col("value").alias("_bad"))
    return rows.where("_bad IS NULL").drop("_bad"), bad


def scan_jsonl_counted(spark: SparkSession, path: str | list[str], schema: str = SCENARIO,
                       pattern: str | None = None) -> tuple[DataFrame, Observation]:
    """Good rows, and the numbers of `lines` and `rejected` lines, from one pass over the files.

    The numbers are there once a first job has read all rows; let that job write the
    rows as they are, as tasks before a shuffle may run again and count twice when
    executors are lost. Blank lines do not count.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.options(**({"pathGlobFilter": pattern} if pattern else {})).text(path)
    parsed = lines.where(strip(F.col("value")) != "").select(
        F.from_json("value", schema + ", _bad STRING", options).alias("row")).select("row.*")
    counts = Observation()
    seen = parsed.observe(counts, F.count(F.lit(1)).alias("lines"), F.count("_bad").alias("rejected"))
    return seen.where("_bad IS NULL").drop("_bad"), counts


def scan_jsonl_strict(spark: SparkSession, path: str | list[str], schema: str = SCENARIO) -> DataFrame:
    """A malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_prompt_column(df: DataFrame, column: str = "prompt") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull())


def scan_eval_reports(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """One row per report document that has a configuration and a summary."""
    reader = spark.read.schema(EVAL_REPORT).option("multiLine", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    reports = reader.json(path).withColumn("file_path", F.col("_metadata.file_path"))
    return reports.where("evaluation_config IS NOT NULL AND summary_metrics IS NOT NULL")


def report_rows(reports: DataFrame) -> DataFrame:
    """Flat report rows: names, number of scenarios and metrics, missing ones zero."""
    config, summary = "evaluation_config", "summary_metrics"
    metrics = [f.name for f in reports.schema[summary].dataType if f.name != "scope_response_counts"]
    zero = {m: F.lit(0).cast(reports.schema[summary].dataType[m].dataType) for m in metrics}
    return reports.select(
        "file_path",
        F.coalesce(f"{config}.model_name", F.lit("Unknown")).alias("raw_model_name"),
        F.coalesce(f"{config}.evaluator", F.lit("Unknown")).alias("raw_evaluator"),
        F.coalesce(f"{config}.timestamp", F.lit("")).alias("timestamp"),
        F.coalesce(f"{config}.num_scenarios", F.lit(0)).alias("num_scenarios"),
        *[F.coalesce(f"{summary}.{m}", zero[m]).alias(m) for m in metrics],
    )


def explode_results(reports: DataFrame) -> DataFrame:
    """Prompt, response and scenario id of every result; tier C and scope S0 by default.

    A report without results fails the job, with the place of the document.
    """
    where = F.col("file_path") if "file_path" in reports.columns else F.lit("a report")
    results = F.when(F.size(F.coalesce("individual_results", F.array())) > 0, F.col("individual_results")).otherwise(
        F.raise_error(F.concat(F.lit("No 'individual_results' found in "), where)))
    rows = reports.select(F.explode(results).alias("r")).select("r.scenario_id", "r.prompt", "r.response")
    return rows.where("prompt <> '' AND response <> ''").withColumns(
        {"tier": F.lit("C"), "scope": F.lit("S0")}
    )


def scan_terms(lines: DataFrame, column: str = "value", seed: list[str] | None = None) -> DataFrame:
    """Lower-cased, trimmed, non-empty terms of a text file together with the seed terms."""
    found = lines.select(F.lower(strip(F.col(column))).alias("term")).where("term <> ''")
    return union_terms(found, C.SEED_TERMS if seed is None else seed)


def union_terms(terms: DataFrame, seed: list[str]) -> DataFrame:
    start = terms.sparkSession.createDataFrame([(t.lower(),) for t in seed], "term STRING")
    return terms.select("term").union(start).distinct()


def scan_log(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Numbered lines (run, idx, line) of text logs.

    The run is taken from the file path; the files of a run follow each other
    by name. Lines keep their order inside a file split, and splits are ordered
    by file and offset, so a log of any size is numbered in parallel.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
        ).alias("split_at"),
        F.monotonically_increasing_id().alias("seq"),
    )
    named = lines.withColumn("run", F.regexp_extract("split_at.file", run_pattern, 1))
    ranked = add_rank(named, ["seq"], F.col("split_at"), by=["run"])
    return ranked.select("run", (F.col("rn") - 1).alias("idx"), "line")
