"""Queries over joins, comparisons and report tables."""

from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.operators import compare, joins, metrics
from plumbline.plans import tables as D
from plumbline.plans.registry import query, rounded
from plumbline.session import shared_dir

_S = "WITH " + D.SCORED

_AHIMSA = ["ahimsa_score", "ahimsa_violation", "harm_avoidance_score", "referral_strength"]
_DHARMA = ["dharma_score", "dharma_violation", "response_scope", "scope_penalty_factor"]
_HELP = ["helpfulness_score", "helpfulness_violation", "clarity_score"]


def axis_tables(spark, d):
    """Per-axis results as separate tables; some items lack one of them."""
    s = D.scored(spark, d)
    return {
        "ahimsa": s.where("l_linenumber <> 7").select("item_id", *_AHIMSA, F.col("ahimsa_severity").alias("severity")),
        "dharma": s.where("l_partkey % 10 <> 3").select("item_id", *_DHARMA),
        "helpfulness": s.where("l_suppkey % 9 <> 1").select("item_id", *_HELP),
    }


_OK = "l_linenumber <> 7 AS a_ok, l_partkey % 10 <> 3 AS d_ok, l_suppkey % 9 <> 1 AS h_ok"


@query("join_axes", f"""{_S}, j AS (SELECT *, {_OK} FROM scored), k AS (SELECT item_id, CASE WHEN a_ok THEN ahimsa_score ELSE 0 END AS a, CASE WHEN d_ok THEN dharma_score ELSE 0 END AS d,
 CASE WHEN h_ok THEN helpfulness_score ELSE 0 END AS h, NOT a_ok OR ahimsa_violation AS ahimsa_violation, NOT d_ok OR dharma_violation AS dharma_violation,
 CASE WHEN d_ok THEN response_scope ELSE 'S3' END AS response_scope, CASE WHEN a_ok THEN ahimsa_severity ELSE 'major' END AS ahimsa_severity FROM j)
 SELECT item_id, round(a, 9) AS ahimsa_score, round(d, 9) AS dharma_score, round(h, 9) AS helpfulness_score, ahimsa_violation, dharma_violation, response_scope, ahimsa_severity,
 round(a * 0.3::DOUBLE + d * 0.4::DOUBLE + h * 0.3::DOUBLE, 9) AS combined_score FROM k""")
def join_axes(spark, d):
    items = D.judged(spark, d).select("item_id", "run")
    out = joins.join_axes(items, axis_tables(spark, d))
    return out.select("item_id", *[rounded(f"{a}_score") for a in ("ahimsa", "dharma", "helpfulness", "combined")],
                      "ahimsa_violation", "dharma_violation", "response_scope", "ahimsa_severity")


@query("join_axes_strict", f"""{_S}, j AS (SELECT *, l_linenumber <> 7 AND l_partkey % 10 <> 3 AND l_suppkey % 9 <> 1 AS ok FROM scored)
 SELECT item_id, ok AS all_ok, round(CASE WHEN ok THEN ahimsa_score ELSE 0 END, 9) AS ahimsa_score, CASE WHEN ok THEN response_scope ELSE 'S3' END AS response_scope,
 round(CASE WHEN ok THEN combined_score END, 9) AS combined_score FROM j""")
def join_axes_strict(spark, d):
    items = D.judged(spark, d).select("item_id", "run")
    out = joins.join_axes_strict(items, axis_tables(spark, d))
    return out.select("item_id", "all_ok", rounded("ahimsa_score"), "response_scope", rounded("combined_score"))


@query("join_response_meta", "WITH " + D.JUDGED + " SELECT item_id, run, tier, scope, response_scope FROM judged")
def join_response_meta(spark, d):
    j = D.judged(spark, d)
    out = joins.join_response_meta(j.select("item_id", "run"), j.select("item_id", "response_scope"), j.select("item_id", "tier", "scope"))
    return out.select("item_id", "run", "tier", "scope", "response_scope")


@query("join_policy", f"{_S} SELECT item_id, scope_penalty_factor AS factor, CASE tier WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END AS min_level, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.5 ELSE 0.0 END::DOUBLE AS missed FROM scored")
def join_policy(spark, d):
    return joins.join_policy(D.judged(spark, d)).select("item_id", "factor", "min_level", "missed")


# two runs over the same items: order keys that have rows of both models
_RUNS = _S + """, runs AS (SELECT l_orderkey, run, avg(ahimsa_score) AS ahimsa_score, avg(dharma_score) AS dharma_score, avg(helpfulness_score) AS helpfulness_score, avg(combined_score) AS combined_score FROM scored GROUP BY ALL),
 pairs AS (SELECT a.l_orderkey, a.ahimsa_score AS a1, b.ahimsa_score AS a2, a.dharma_score AS d1, b.dharma_score AS d2, a.helpfulness_score AS h1, b.helpfulness_score AS h2, a.combined_score AS c1, b.combined_score AS c2
 FROM runs a JOIN runs b USING (l_orderkey) WHERE a.run = 'baseline' AND b.run = 'candidate')"""


def run_pairs(spark, d):
    s = D.scored(spark, d)
    runs = s.groupBy("l_orderkey", "run").agg(*[F.avg(c).alias(c) for c in compare.SCORES])
    return joins.join_runs(runs.where("run = 'baseline'"), runs.where("run = 'candidate'"), "l_orderkey", compare.SCORES)


@query("join_runs", _RUNS + " SELECT l_orderkey, round(a1, 9) AS ahimsa_left, round(a2, 9) AS ahimsa_right, round(c1, 9) AS combined_left, round(c2, 9) AS combined_right FROM pairs")
def join_runs(spark, d):
    return run_pairs(spark, d).select("l_orderkey", rounded("ahimsa_score_left", "ahimsa_left"), rounded("ahimsa_score_right", "ahimsa_right"), rounded("combined_score_left", "combined_left"), rounded("combined_score_right", "combined_right"))


_CONSISTENCY = _RUNS + """, long AS (SELECT 'ahimsa_score' AS score, a1 AS a, a2 AS b FROM pairs UNION ALL SELECT 'dharma_score', d1, d2 FROM pairs UNION ALL SELECT 'helpfulness_score', h1, h2 FROM pairs UNION ALL SELECT 'combined_score', c1, c2 FROM pairs
 UNION ALL SELECT 'same_score', 0.5::DOUBLE, 0.5::DOUBLE FROM pairs UNION ALL SELECT 'flat_score', 0.25::DOUBLE, c2 FROM pairs),
 cons AS (SELECT score, count(*) AS n, avg(abs(a - b)) AS mad, max(abs(a - b)) AS mx, CASE score WHEN 'same_score' THEN 1.0 WHEN 'flat_score' THEN 0.0 ELSE corr(a, b) END::DOUBLE AS r FROM long GROUP BY 1),
 rated AS (SELECT *, CASE WHEN r > 0.95 AND mad < 0.05 THEN 'excellent' WHEN r > 0.9 AND mad < 0.1 THEN 'good' WHEN r > 0.8 AND mad < 0.15 THEN 'fair' ELSE 'poor' END AS rating FROM cons)"""


def consistency(spark, d):
    pairs = run_pairs(spark, d).withColumns({
        "same_score_left": F.lit(0.5), "same_score_right": F.lit(0.5),
        "flat_score_left": F.lit(0.25), "flat_score_right": F.col("combined_score_right"),
    })
    return compare.score_consistency(pairs, [*compare.SCORES, "same_score", "flat_score"])


@query("score_consistency", _CONSISTENCY + " SELECT score, n, round(mad, 9) AS mean_absolute_difference, round(mx, 9) AS max_difference, round(r, 9) AS correlation FROM rated")
def score_consistency(spark, d):
    return consistency(spark, d).select("score", "n", rounded("mean_absolute_difference"), rounded("max_difference"), rounded("correlation"))


@query("run_consistency", _RUNS + """, base AS (SELECT l_orderkey % 4 AS part, l_orderkey, run, combined_score FROM runs),
 both_ AS (SELECT l_orderkey, combined_score FROM base WHERE run = 'baseline' AND l_orderkey IN (SELECT l_orderkey FROM base WHERE run = 'candidate')),
 n AS (SELECT (SELECT count(*) FROM base WHERE run = 'baseline') AS l, (SELECT count(*) FROM base WHERE run = 'candidate') AS r)
 SELECT 'unequal' AS compared, 'error' AS rating, NULL::BIGINT AS n, CASE WHEN l <> r THEN 'Mismatched result counts: left=' || l || ', right=' || r ELSE 'Mismatched items' END AS error FROM n
 UNION ALL SELECT 'same', 'excellent', count(*), NULL FROM both_""")
def run_consistency(spark, d):
    """The two models as they are (unequal runs), and one run against itself."""
    s = D.scored(spark, d)
    runs = s.groupBy("l_orderkey", "run").agg(F.avg("combined_score").alias("combined_score"))
    left, right = runs.where("run = 'baseline'"), runs.where("run = 'candidate'")
    common = left.join(right.select("l_orderkey"), "l_orderkey", "left_semi")
    unequal = compare.run_consistency(left, right, "l_orderkey", ["combined_score"])
    same = compare.run_consistency(common, common.withColumn("combined_score", F.col("combined_score") + 0), "l_orderkey", ["combined_score"])
    return unequal.select(F.lit("unequal").alias("compared"), "rating", "n", "error").unionByName(
        same.select(F.lit("same").alias("compared"), "rating", "n", "error"))


@query("consistency_rating", _CONSISTENCY + """ SELECT score, rating FROM rated UNION ALL SELECT 'overall', CASE WHEN r > 0.95 AND mad < 0.05 THEN 'excellent' WHEN r > 0.9 AND mad < 0.1 THEN 'good' WHEN r > 0.8 AND mad < 0.15 THEN 'fair' ELSE 'poor' END FROM (SELECT avg(r) AS r, avg(mad) AS mad FROM rated)""")
def consistency_rating(spark, d):
    c = consistency(spark, d)
    return c.select("score", "rating").unionByName(compare.overall_consistency(c).select(F.lit("overall").alias("score"), F.col("overall").alias("rating")))


@query("mode_performance", """WITH r AS (SELECT n_nationkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / 1e6 / (1 + n_nationkey % 3) AS b, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) / 1e6 AS i,
 CAST(ceil(count_if(o_orderstatus = 'F') / (1 + n_nationkey % 3)) AS BIGINT) AS bc, count_if(o_orderstatus = 'O')::BIGINT AS ic, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
 SELECT n_nationkey, round(CASE WHEN b > 0 THEN i / b ELSE 0 END, 6) AS speedup_factor, ic - bc AS calls_saved, round(CASE WHEN bc > 0 THEN ic / bc ELSE 0 END, 6) AS reduction_factor,
 CASE WHEN b < i THEN 'batch' ELSE 'individual' END AS performance_winner, CASE WHEN bc < ic THEN 'batch' ELSE 'individual' END AS api_efficiency_winner,
 CASE WHEN k IN (0, 1) AND CASE WHEN b > 0 THEN i / b ELSE 0 END > 1.5 AND CASE WHEN bc > 0 THEN ic / bc ELSE 0 END > 2 THEN 'strongly_batch' WHEN k IN (0, 1) AND CASE WHEN b > 0 THEN i / b ELSE 0 END > 1.2 THEN 'batch'
 WHEN k = 2 AND CASE WHEN b > 0 THEN i / b ELSE 0 END > 2 THEN 'consider_batch' WHEN k = 3 THEN 'individual' ELSE 'depends' END AS recommendation FROM (SELECT *, n_nationkey % 4 AS k FROM r)""")
def mode_performance(spark, d):
    orders = D.load(spark, d, "orders")
    customers = D.load(spark, d, "customer")
    batch, single = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    runs = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        (F.sum(F.when(batch, F.col("o_totalprice")).otherwise(0)) / 1e6 / (1 + F.first("c_nationkey") % 3)).alias("batch_seconds"),
        (F.sum(F.when(single, F.col("o_totalprice")).otherwise(0)) / 1e6).alias("individual_seconds"),
        F.ceil(F.count_if(batch) / (1 + F.first("c_nationkey") % 3)).alias("batch_calls"), F.count_if(single).alias("individual_calls"), F.count(F.lit(1)).alias("num_scenarios"))
    # Costs that differ by up to four times and every rating, so that each recommendation occurs.
    rating = F.element_at(F.array(*map(F.lit, ("excellent", "good", "fair", "poor"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    out = compare.mode_performance(runs, rating)
    return out.select("n_nationkey", F.round("speedup_factor", 6).alias("speedup_factor"), "calls_saved", F.round("reduction_factor", 6).alias("reduction_factor"), "performance_winner", "api_efficiency_winner", "recommendation")


_SUMS = _S + """, m AS (SELECT run, avg(helpfulness_score) AS average_helpfulness_score, avg(ahimsa_score) AS average_ahimsa_score, avg(dharma_score) AS average_dharma_score, avg(combined_score) AS average_combined_score,
 count_if(ahimsa_violation)::DOUBLE AS ahimsa_violations, count_if(dharma_violation)::DOUBLE AS dharma_violations, count_if(helpfulness_violation)::DOUBLE AS helpfulness_violations FROM scored GROUP BY run),
 u AS (UNPIVOT m ON COLUMNS(* EXCLUDE (run)) INTO NAME metric VALUE v), j AS (SELECT metric, max(v) FILTER (run = 'baseline') AS baseline, max(v) FILTER (run = 'candidate') AS trained FROM u GROUP BY 1)"""


def _joined(spark, d):
    sums = metrics.summary_metrics(D.scored(spark, d), ["run"])
    return compare.join_baseline_trained(sums.where("run = 'baseline'"), sums.where("run = 'candidate'"))


@query("join_baseline_trained", _SUMS + " SELECT metric, round(baseline, 9) AS baseline, round(trained, 9) AS trained FROM j")
def join_baseline_trained(spark, d):
    return _joined(spark, d).select("metric", rounded("baseline"), rounded("trained"))


@query("compare_metrics", _SUMS + """ SELECT metric, round(CASE WHEN metric <> 'average_helpfulness_score' THEN CASE WHEN metric LIKE '%violations' THEN baseline - trained ELSE trained - baseline END END, 9) AS improvement,
 round(CASE WHEN metric LIKE '%violations' THEN baseline - trained ELSE trained - baseline END / greatest(baseline, 0.001) * 100, 9) AS relative_improvement FROM j""")
def compare_metrics(spark, d):
    return compare.compare_metrics(_joined(spark, d)).select("metric", rounded("improvement"), rounded("relative_improvement"))


@query("join_label_counts", "WITH " + D.TIERS + """, a AS (SELECT coalesce(tier, 'none') AS tier, count(*) AS c FROM tiers GROUP BY 1), b AS (SELECT CASE WHEN source < 'src2' THEN 'D' ELSE coalesce(tier, 'C') END AS tier, count(*) AS c FROM tiers GROUP BY 1)
 SELECT tier, coalesce(a.c, 0) AS original_count, coalesce(b.c, 0) AS new_count FROM a FULL JOIN b USING (tier)""")
def join_label_counts(spark, d):
    t = D.tiers(spark, d)
    original = t.select(F.coalesce("tier", F.lit("none")).alias("tier"))
    new = t.select(F.when(F.col("source") < "src2", "D").otherwise(F.coalesce("tier", F.lit("C"))).alias("tier"))
    return joins.join_label_counts(original, new, "tier")


# report rows: model by nation, evaluator by order priority
_REPORTS = """reports AS (SELECT (['meta/Llama-3.2-1B', 'out/checkpoint-7', 'other/base'])[CAST(c_nationkey % 3 + 1 AS INT)] AS raw_model_name, o_orderpriority AS evaluator_name, c_nationkey,
 avg(o_totalprice) / 5e5 AS average_combined_score, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS dharma_violation_rate, count(*) AS num_scenarios
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 named AS (SELECT *, CASE raw_model_name WHEN 'meta/Llama-3.2-1B' THEN 'Llama-3.2-1B' WHEN 'out/checkpoint-7' THEN 'Tuned-checkpoint-7' ELSE 'base' END AS model_name FROM reports)"""


def reports(spark, d):
    orders = D.load(spark, d, "orders")
    customers = D.load(spark, d, "customer")
    model = F.element_at(F.array(F.lit("meta/Llama-3.2-1B"), F.lit("out/checkpoint-7"), F.lit("other/base")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(
        model.alias("raw_model_name"), F.col("o_orderpriority").alias("raw_evaluator"), "c_nationkey").agg(
        (F.avg("o_totalprice") / 5e5).alias("average_combined_score"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("dharma_violation_rate"), F.count(F.lit(1)).alias("num_scenarios"))
    low = rows.where("c_nationkey < 12")
    return compare.consolidate([low, rows.where("c_nationkey >= 12")])


@query("consolidate", f"WITH {_REPORTS} SELECT model_name, evaluator_name, 'unknown' AS evaluator_type, c_nationkey, num_scenarios, round(average_combined_score, 9) AS average_combined_score FROM named")
def consolidate(spark, d):
    return reports(spark, d).select("model_name", "evaluator_name", "evaluator_type", "c_nationkey", "num_scenarios", rounded("average_combined_score"))


@query("sort_models", f"WITH {_REPORTS} SELECT model_name, evaluator_name, count(*) AS n FROM named GROUP BY ALL ORDER BY 1, 2")
def sort_models(spark, d):
    counted = reports(spark, d).groupBy("model_name", "evaluator_name").agg(F.count(F.lit(1)).alias("n"))
    return compare.sort_models(counted)


@query("sink_records_json", f"""WITH {_REPORTS} SELECT 'record' AS kind, model_name, evaluator_name, num_scenarios, round(average_combined_score, 9) AS average_combined_score FROM named
 UNION ALL SELECT 'total', NULL, NULL, count(*), NULL FROM named UNION ALL SELECT DISTINCT 'model', model_name, NULL, NULL::BIGINT, NULL::DOUBLE FROM named UNION ALL SELECT DISTINCT 'evaluator', NULL, evaluator_name, NULL::BIGINT, NULL::DOUBLE FROM named""")
def sink_records_json(spark, d):
    """The written records, their number and the names, read back from JSON."""
    from plumbline.sources.writers import sink_records_json as sink

    path = shared_dir(spark)
    sink(reports(spark, d).select("model_name", "evaluator_name", "num_scenarios", "average_combined_score"), path)
    schema = "model_name STRING, evaluator_name STRING, num_scenarios BIGINT, average_combined_score DOUBLE"
    out = spark.read.schema(schema).json(f"{path}/records").withColumn("kind", F.lit("record"))
    total = spark.read.schema("total_evaluations BIGINT").json(f"{path}/metadata").select(
        F.lit("total").alias("kind"), F.col("total_evaluations").alias("num_scenarios"))
    for rows in (total, spark.read.schema("model_name STRING").json(f"{path}/model_name").withColumn("kind", F.lit("model")),
                 spark.read.schema("evaluator_name STRING").json(f"{path}/evaluator_name").withColumn("kind", F.lit("evaluator"))):
        out = out.unionByName(rows, allowMissingColumns=True)
    return out.select("kind", "model_name", "evaluator_name", "num_scenarios", rounded("average_combined_score"))


_PIVOT = _REPORTS + """, e AS (SELECT evaluator_name, coalesce(arg_min(average_combined_score, c_nationkey) FILTER (model_name LIKE 'Llama%'), 0) AS b1, coalesce(arg_min(average_combined_score, c_nationkey) FILTER (model_name LIKE 'Tuned%'), 0) AS c1,
 coalesce(arg_min(dharma_violation_rate, c_nationkey) FILTER (model_name LIKE 'Llama%'), 0) AS b2, coalesce(arg_min(dharma_violation_rate, c_nationkey) FILTER (model_name LIKE 'Tuned%'), 0) AS c2 FROM named GROUP BY 1),
 p AS (SELECT evaluator_name, 'average_combined_score' AS metric, b1 AS baseline, c1 AS candidate FROM e UNION ALL SELECT evaluator_name, 'dharma_violation_rate', b2, c2 FROM e)"""


def _pivoted(spark, d):
    r = reports(spark, d)
    return compare.pivot_baseline_candidate(
        r, F.col("model_name").startswith("Llama"), F.col("model_name").startswith("Tuned"), "c_nationkey",
        {"average_combined_score": False, "dharma_violation_rate": True})


@query("pivot_baseline_candidate", f"WITH {_PIVOT} SELECT evaluator_name, metric, round(baseline, 9) AS baseline, round(candidate, 9) AS candidate FROM p")
def pivot_baseline_candidate(spark, d):
    return _pivoted(spark, d).select("evaluator_name", "metric", rounded("baseline"), rounded("candidate"))


@query("improvement_pct", f"""WITH {_PIVOT} SELECT evaluator_name, metric, CASE WHEN baseline = 0 THEN 'N/A' WHEN (metric LIKE 'dharma%' AND candidate >= baseline) OR (metric NOT LIKE 'dharma%' AND candidate > baseline)
 THEN '↑ ' || printf('%.1f', abs((candidate - baseline) / baseline * 100)) || '%' ELSE '↓ ' || printf('%.1f', abs((candidate - baseline) / baseline * 100)) || '%' END AS improvement FROM p""")
def improvement_pct(spark, d):
    return _pivoted(spark, d).select("evaluator_name", "metric", "improvement")


_METRIC_TABLE = _REPORTS + """, t AS (SELECT model_name AS model, max(average_combined_score) AS best, sum(num_scenarios)::BIGINT AS scenarios, CASE WHEN model_name <> 'base' THEN max(dharma_violation_rate) END AS worst FROM named GROUP BY 1)"""


@query("model_metric_table", f"WITH {_METRIC_TABLE} SELECT model, printf('%.4f', best) AS best, scenarios::VARCHAR AS scenarios, coalesce(printf('%.4f', worst), 'N/A') AS worst FROM t")
def model_metric_table(spark, d):
    return compare.model_metric_table(_metric_rows(spark, d), ["best", "scenarios", "worst"])


def _metric_rows(spark, d):
    t = reports(spark, d).groupBy(F.col("model_name").alias("model")).agg(
        F.max("average_combined_score").alias("best"), F.sum("num_scenarios").alias("scenarios"), F.max("dharma_violation_rate").alias("worst"))
    long = compare.unpivot(t, ["model"], ["best", "scenarios", "worst"])
    return long.where("NOT (model = 'base' AND metric = 'worst')").withColumn("is_int", F.col("metric") == "scenarios")


@query("metric_key_union", "SELECT unnest(['best', 'scenarios', 'worst', 'event_click', 'event_error', 'event_purchase', 'event_signup', 'event_view']) AS metric")
def metric_key_union(spark, d):
    kinds = D.events(spark, d).select(F.concat(F.lit("event_"), "event_type").alias("metric"))
    return compare.metric_key_union([_metric_rows(spark, d), kinds])


@query("sink_markdown", f"""WITH {_PIVOT}, t AS (SELECT model_name, evaluator_name, sum(num_scenarios) AS n FROM named GROUP BY ALL), x AS (SELECT evaluator_name, metric, CASE WHEN baseline > candidate THEN 'baseline' WHEN candidate > baseline THEN 'candidate' ELSE 'equal' END AS higher FROM p)
 SELECT unnest(['# Model Evaluation Results Comparison', '## Key Metrics Comparison', '| metric | evaluator_name | higher |', '| --- | --- | --- |', '## Detailed Metrics by Model and Evaluator', '| model_name | evaluator_name | n |', '| --- | --- | --- |']) AS line
 UNION ALL SELECT '| ' || metric || ' | ' || evaluator_name || ' | ' || higher || ' |' FROM x UNION ALL SELECT '| ' || model_name || ' | ' || evaluator_name || ' | ' || n || ' |' FROM t""")
def sink_markdown(spark, d):
    """The whole report, written as text and read back."""
    from plumbline.sources import writers

    pivot = _pivoted(spark, d)
    higher = F.when(F.col("baseline") > F.col("candidate"), "baseline").when(
        F.col("candidate") > F.col("baseline"), "candidate").otherwise("equal")
    detail = reports(spark, d).groupBy("model_name", "evaluator_name").agg(F.sum("num_scenarios").alias("n"))
    path = shared_dir(spark)
    writers.sink_markdown(writers.markdown_report([
        ("Key Metrics Comparison", pivot.withColumn("higher", higher), ["metric", "evaluator_name", "higher"]),
        ("Detailed Metrics by Model and Evaluator", detail, ["model_name", "evaluator_name", "n"]),
    ], "Model Evaluation Results Comparison"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
