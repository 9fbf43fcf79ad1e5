"""Shape of the physical plans."""

import re

import pytest

from __spark_entry__ import queries

Q = queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "summary_metrics", "cross_mode", "component_ablation", "parse_answers_ahimsa", "filter_prompt_artifacts",
    "clean_annotations", "lexicon_match", "add_prompt_hash", "parse_log", "extract_metrics",
])
def test_expressions_need_no_python(spark, sf, name):
    text = plan(Q[name](spark, sf))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas", text)


@pytest.mark.parametrize("name", ["cross_mode", "filter_prompt_artifacts", "scope_penalty", "token_estimate"])
def test_row_jobs_do_not_shuffle(spark, sf, name):
    assert "Exchange" not in plan(Q[name](spark, sf))


def test_core_set_is_broadcast_without_python(spark, sf):
    text = plan(Q["tfidf_near_core"](spark, sf))
    assert "BroadcastHashJoin" in text and not re.search(r"ArrowEvalPython|MapInPandas", text)


def test_log_sampling_needs_no_python(spark, sf):
    assert not re.search(r"Python|Pandas|Arrow", plan(Q["condense_log"](spark, sf)))


def test_parsing_does_not_shuffle_split_tables(spark):
    from plumbline.operators.judge import parse_answers

    assert "Exchange" not in plan(parse_answers(spark.createDataFrame([("{}",)], "raw string"), "dharma"))


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(Q["summary_two_axis"](spark, sf))
    assert "l_extendedprice" not in text and "l_shipdate" not in text
    assert "PushedFilters: [IsNotNull(lang)" in plan(spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'"))


def test_items_are_exchanged_once_for_three_axes(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Q["join_axes"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 4  # the items and three result tables


def test_rank_exchanges_the_table_once(spark, sf):
    from plumbline.operators.ordering import add_rank
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.read.parquet(f"{sf}/events.parquet")
        text = plan(add_rank(df, ["event_id"], F.floor(F.col("event_id") / 100), by=["user_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    window = text.index("row_number()")
    assert text[window:].count("Exchange hashpartitioning(__key") == 3  # the rows once, the block counts twice


@pytest.mark.parametrize("name", ["split_dataset", "oversample_pool"])
def test_hash_takes_broadcast_the_block_table(spark, sf, name):
    assert "BroadcastHashJoin" in plan(Q[name](spark, sf))


@pytest.mark.parametrize("name", sorted(Q))
def test_no_cartesian_product(spark, sf, name):
    if name.startswith(("stream_", "near_dup", "scan_", "sink_", "exclude", "log_", "condense", "curate", "pipeline") + tuple(
            f"op{k}_" for k in range(1, 11))):
        pytest.skip("runs jobs to build its plan; covered by the result tests")
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(Q[name](spark, sf)))
