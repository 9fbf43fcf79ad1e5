"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare
from plumbline.sources import readers, report_parts, writers


def test_jsonl_tolerant_and_strict(spark, tmp_path):
    good = [{"id": 1, "prompt": "a’b", "tier": "A"}, {"id": 2, "prompt": "c"}]
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(good[0], ensure_ascii=False), "", "{broken", "   ", json.dumps(good[1])]))
    rows, bad = readers.scan_jsonl(spark, str(tmp_path))
    assert [(r.id, r.prompt) for r in rows.orderBy("id").collect()] == [(1, "a’b"), (2, "c")]
    assert [r._bad for r in bad.collect()] == ["{broken"]
    with pytest.raises(Exception):
        readers.scan_jsonl_strict(spark, str(tmp_path)).collect()


def test_jsonl_counts_leave_with_the_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "prompt": "a", "more": 2}\n\n{broken\n  \n{"id": 2, "prompt": null}\n[1\n')
    rows, counts = readers.scan_jsonl_counted(spark, str(tmp_path))
    both, bad = readers.scan_jsonl(spark, str(tmp_path))
    found = sorted(rows.collect(), key=lambda r: r.id)
    assert found == sorted(both.collect(), key=lambda r: r.id) and rows.schema == both.schema
    assert counts.get == {"lines": 4, "rejected": 2} and bad.count() == 2
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    (tmp_path / "x.jsonl").write_text("")
    rows, counts = readers.scan_jsonl_counted(spark, str(tmp_path))
    assert rows.collect() == [] and counts.get == {"lines": 0, "rejected": 0}


def test_reports(spark, tmp_path):
    report = {
        "evaluation_config": {"model_name": "meta/Llama-3.2-1B", "evaluator": "gemini (gemini-2.0-flash)", "num_scenarios": 2},
        "summary_metrics": {"average_combined_score": 0.5, "ahimsa_violations": 1, "scope_response_counts": {"S0": 2}},
        "individual_results": [{"scenario_id": "1", "prompt": "p", "response": "r"}, {"scenario_id": "2", "prompt": "", "response": "r"}, {"scenario_id": "3", "prompt": "q"}],
    }
    (tmp_path / "a_eval_1.json").write_text(json.dumps(report, indent=2))
    (tmp_path / "b_eval_2.json").write_text(json.dumps({"summary_metrics": {}}))
    (tmp_path / "other.json").write_text(json.dumps(report))
    reports = readers.scan_eval_reports(spark, str(tmp_path), "*eval*.json")
    rows = readers.report_rows(reports)
    first = compare.consolidate([rows]).first()
    assert (first.model_name, first.evaluator_name, first.evaluator_type) == ("Llama-3.2-1B", "Gemini 2.0 Flash", "gemini")
    assert (first.average_combined_score, first.ahimsa_violations, first.dharma_violations) == (0.5, 1, 0)
    assert [tuple(r) for r in readers.explode_results(reports).collect()] == [("1", "p", "r", "C", "S0")]


def test_log_numbers_follow_files_and_splits(spark, tmp_path):
    for run, names in (("a", ["p0", "p1"]), ("b", ["p0"])):
        (tmp_path / run).mkdir()
        for k, name in enumerate(names):
            (tmp_path / run / f"{name}.log").write_text("".join(f"{run} {k * 1000 + i}\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.scan_log(spark, str(tmp_path / "*")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000
    assert all(r.line == f"{r.run} {r.idx}" for r in rows)


def test_report_documents_and_their_rows(spark, tmp_path):
    items = spark.range(100).select(F.when(F.col("id") < 90, "m").otherwise("k").alias("run"), F.col("id"), F.lit("p").alias("prompt"), F.lit("r").alias("response"))
    summary = spark.createDataFrame([("m", 0.5), ("k", 0.25)], "run string, average_combined_score double")
    lines = writers.report_lines(summary, items, "run", "id", ["id", "prompt", "response"])
    writers.sink_report_documents(lines, str(tmp_path / "out"), "run", "id")
    docs = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").glob("*/*.txt")}
    assert [r["id"] for r in docs["name=m"]["individual_results"]] == list(range(90))
    assert docs["name=k"]["evaluation_config"]["num_scenarios"] == 10
    reports = readers.scan_eval_reports(spark, str(tmp_path / "out"))
    assert readers.report_rows(reports).count() == 2 and readers.explode_results(reports).count() == 100
    (tmp_path / "empty.json").write_text('{"evaluation_config": {"model_name": "x"}, "summary_metrics": {}, "individual_results": []}')
    with pytest.raises(Exception, match="individual_results"):
        readers.explode_results(readers.scan_eval_reports(spark, str(tmp_path / "empty.json"))).collect()


def test_markdown(spark):
    df = spark.createDataFrame([("m", 0.5), ("n", None)], "model string, score double")
    text = writers.markdown_table(df.orderBy("model"))
    assert text.splitlines() == ["| model | score |", "| --- | --- |", "| m | 0.5 |", "| n | N/A |"]
    rows = spark.createDataFrame([("Llama", "e", 0.5, 0.25, 1), ("Tuned", "e", 0.75, 0.5, 2)],
                                 "model_name string, evaluator_name string, average_combined_score double, dharma_violation_rate double, k int")
    pivot = compare.pivot_baseline_candidate(rows, F.col("model_name") == "Llama", F.col("model_name") == "Tuned", "k",
                                             {"average_combined_score": False, "dharma_violation_rate": True})
    report = writers.comparison_report(pivot, rows.select("model_name", "evaluator_name"), {"dharma_violation_rate"})
    assert "| average_combined_score | e | 0.500 | 0.750 | ↑ 50.0% |" in report
    assert "| dharma_violation_rate | e | 25.0% | 50.0% | ↑ 100.0% |" in report


def test_terms(spark):
    lines = spark.createDataFrame([(" Heart ",), ("",), ("bp",), (None,)], "value string")
    assert {r.term for r in readers.scan_terms(lines, seed=["BP", "x"]).collect()} == {"heart", "bp", "x"}


def pretty(name, results, **more):
    return {"evaluation_config": {"model_name": name, "num_scenarios": len(results), **more}, "summary_metrics": {"average_combined_score": 0.5},
            "notes": [{"a": [1, {"b": 2}]}, "x"], "individual_results": results, "trailer": [{"scenario_id": "no result"}]}


def result(k):
    odd = ['{"individual_results": [', "}],[{", 'a "quoted" \\ word', "é\nline two\n  },", "", "\\"][k % 6]
    return {"scenario_id": str(k), "prompt": f"p{k} {odd}", "response": f"r{k} {odd}", "combined_score": k / 7}


@pytest.mark.parametrize("split", [700, 100_000])
def test_report_parts_of_any_layout(spark, tmp_path, split):
    """Indented, one-line and empty documents, with brackets and quotes in their strings, cut at any place."""
    many, few = [result(k) for k in range(200)], [result(k) for k in range(500, 503)]
    (tmp_path / "a.json").write_text(json.dumps(pretty("many", many), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(pretty("wide", few), indent=4, ensure_ascii=False))
    (tmp_path / "c.json").write_text(json.dumps(pretty("line", few)))
    (tmp_path / "stray.json").write_text('{"unrelated": [\n{"scenario_id": "9"}\n]}')
    (tmp_path / "broken.json").write_text('{"evaluation_config": {\n"individual_results": [\n{"scenario_id": "8"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        reports, results = report_parts.scan_report_parts(spark, str(tmp_path))
        rows = report_parts.explode_result_parts(reports, results).collect()
        assert {(r.evaluation_config.model_name, r.evaluation_config.num_scenarios) for r in reports.collect()} == {
            ("many", 200), ("wide", 3), ("line", 3)}
        assert results.count() == 203
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((r["scenario_id"], r["prompt"], r["response"]) for r in [*many, *few, *few])
    assert sorted((r.scenario_id, r.prompt, r.response) for r in rows) == want
    assert {r.combined_score for r in results.where("scenario_id = '14'").collect()} == {2.0}


def test_report_without_results_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(pretty("none", []), indent=2))
    reports, results = report_parts.scan_report_parts(spark, str(tmp_path))
    assert reports.count() == 1 and results.count() == 0
    with pytest.raises(Exception, match="No 'individual_results' found"):
        report_parts.explode_result_parts(reports, results).collect()


def test_a_run_of_a_third_of_all_results_is_many_parts(spark, tmp_path):
    items = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 40)).alias("run"), F.col("id"),
                                     F.col("id").cast("string").alias("scenario_id"), F.lit("p").alias("prompt"), F.lit("r").alias("response"))
    summary = items.select("run").distinct().withColumn("average_combined_score", F.lit(0.5))
    lines = writers.report_lines(summary, items, "run", "id", ["scenario_id", "prompt", "response"])
    path = str(tmp_path / "out")
    # So small a table would be one part otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report_parts.sink_report_parts(lines, path, "run", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out" / "name=hot").glob("part-*"))
    assert len(files) >= 3
    whole = json.loads("".join(f.read_text() for f in files))
    assert [int(r["scenario_id"]) for r in whole["individual_results"]] == list(range(0, 3000, 3))
    placed = report_parts.placed_lines(report_parts.document_lines(spark, path, document="folder"))
    assert placed.where("inside AND doc LIKE '%name=hot'").select("block").distinct().count() >= 3
    reports, results = report_parts.scan_report_parts(spark, path, document="folder")
    assert reports.count() == 41 and results.groupBy("file_path").count().agg(F.max("count")).first()[0] == 1000


def test_report_items_of_few_runs_are_many_files(spark, tmp_path):
    """Two runs hold all rows: their items are cut into more files than runs, none of which holds most of them."""
    items = spark.range(0, 40_000, 1, 4).selectExpr("if(id % 4 = 0, 'a', 'b') AS run", "id AS item_id", "sha2(string(id), 512) AS text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.sink_eval_report(items.groupBy("run").count(), items, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(str(tmp_path / "items"))
    assert back.columns == items.columns and back.exceptAll(items).count() == 0 and back.count() == 40_000
    sizes = [r["count"] for r in back.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 10_000


def test_many_reports_of_a_folder_are_told_apart(spark, tmp_path):
    """Documents follow each other in packed files that cut them; the files do not grow in number with the runs."""
    items = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 80)).alias("run"), F.col("id"),
                                     F.col("id").cast("string").alias("scenario_id"), F.lit("p {[").alias("prompt"), F.lit('r "}').alias("response"))
    summary = items.select("run").distinct().withColumn("average_combined_score", F.lit(0.5))
    lines = writers.report_lines(summary, items, "run", "id", ["scenario_id", "prompt", "response"])
    path = str(tmp_path / "out")
    report_parts.sink_many_reports(lines, path, "run", "id", 7)
    assert len(list((tmp_path / "out").glob("part-*"))) == 7
    placed = report_parts.placed_lines(report_parts.document_lines(spark, path, document="many"))
    assert placed.count() == 4082 and placed.where("inside").groupBy("number").count().agg(F.max("count")).first()[0] == 2000
    assert placed.groupBy("number").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] >= 3
    reports, results = report_parts.scan_report_parts(spark, path, document="many")
    assert {(r.evaluation_config.model_name, r.evaluation_config.num_scenarios) for r in reports.collect()} == {
        ("hot", 2000), *((f"m{k}", 50) for k in range(1, 80, 2))}
    assert results.groupBy("file_path").count().count() == 41
    rows = report_parts.explode_result_parts(reports, results).collect()
    assert sorted(int(r.scenario_id) for r in rows) == list(range(4000)) and {(r.prompt, r.response) for r in rows} == {("p {[", 'r "}')}


@pytest.mark.parametrize("blocks", [0, 100_000])
def test_many_reports_of_any_layout(spark, tmp_path, monkeypatch, blocks):
    """Indented and one-line documents of one folder, cut at any place, beside one that is no report."""
    monkeypatch.setattr(report_parts, "BROADCAST_BLOCKS", blocks)
    docs = [pretty("many", [result(k) for k in range(60)]), {"unrelated": [{"scenario_id": "9"}]}, pretty("few", [result(k) for k in range(500, 503)])]
    whole = [json.dumps(docs[0], indent=2), json.dumps(docs[1], indent=1), json.dumps(docs[2]), json.dumps(docs[2], indent=4)]
    text = "\n".join(whole).split("\n")
    for k in range(5):
        (tmp_path / f"part-{k:05d}.txt").write_text("".join(f"{line}\n" for line in text[len(text) * k // 5:len(text) * (k + 1) // 5]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        reports, results = report_parts.scan_report_parts(spark, str(tmp_path), document="many")
        rows = report_parts.explode_result_parts(reports, results).collect()
        assert sorted(r.evaluation_config.model_name for r in reports.collect()) == ["few", "few", "many"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((r["scenario_id"], r["prompt"], r["response"]) for d in (docs[0], docs[2], docs[2]) for r in d["individual_results"])
    assert sorted((r.scenario_id, r.prompt, r.response) for r in rows) == want


def test_report_lines_are_not_exchanged_to_be_read(spark, tmp_path):
    """What is shuffled to read reports is a few numbers per block and the lines that are no results."""
    items = spark.range(100).select(F.lit("m").alias("run"), F.col("id"), F.col("id").cast("string").alias("scenario_id"), F.lit("p").alias("prompt"), F.lit("r").alias("response"))
    lines = writers.report_lines(items.groupBy("run").agg(F.lit(0.5).alias("average_combined_score")), items, "run", "id", ["scenario_id", "prompt", "response"])
    report_parts.sink_many_reports(lines, str(tmp_path / "out"), "run", "id", 2)
    _, results = report_parts.scan_report_parts(spark, str(tmp_path / "out"), document="many")
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "MapInArrow" in plan
