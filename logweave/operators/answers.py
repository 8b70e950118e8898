"""Per-trace answers, their contract, token usage, run payloads, costs and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import ANOMALY_TYPES, VERDICTS, fixed
from logweave.operators import metrics as M

ANSWER_SCHEMA = ("flow string, step_check string, explanation string, verdict string, "
                 "anomaly_type string, first_deviation_line bigint")
ANSWER_KEYS = ["flow", "step_check", "explanation", "verdict", "anomaly_type",
               "first_deviation_line"]
TYPES = ["visible_error", "silent_skip", "wrong_order", "truncated", "retry_storm"]


def answers_json(answers: DataFrame) -> DataFrame:
    """One JSON answer per trace (what a plug-in classifier returns)."""
    return answers.select("trace_id", "n_lines", F.to_json(F.struct(*[
        F.col(k) for k in ANSWER_KEYS]), {"ignoreNullFields": "false"}).alias("answer"))


def answer_parse(raw: DataFrame) -> DataFrame:
    """Decode the JSON answer: flagged = verdict anomalous, pred_index = first deviation line,
    text = explanation."""
    a = F.from_json("answer", ANSWER_SCHEMA)
    return raw.select("trace_id", a.alias("a")).select(
        "trace_id", "a.*", (F.col("a.verdict") == "anomalous").alias("flagged"),
        F.col("a.first_deviation_line").alias("pred_index"),
        F.col("a.explanation").alias("worst_line_text"))


def answer_contract(raw: DataFrame, flow_names: list[str]) -> DataFrame:
    """Rows that break the answer contract, with the reason (empty = every answer valid):
    required keys exactly, verdict in 2 values, type in 6, line in 0..n_lines or null, flow
    in the flow names plus ``unknown``."""
    a = F.from_json("answer", ANSWER_SCHEMA)
    keys = F.array_sort(F.json_object_keys("answer"))
    want = F.array(*[F.lit(k) for k in sorted(ANSWER_KEYS)])
    p = raw.select("trace_id", "n_lines", keys.alias("keys"), a.alias("a"))
    line = F.col("a.first_deviation_line")
    checks = [
        ("keys", ~(F.col("keys") == want)),
        ("verdict", ~F.col("a.verdict").isin(VERDICTS) | F.col("a.verdict").isNull()),
        ("anomaly_type", ~F.col("a.anomaly_type").isin(ANOMALY_TYPES + ["other"])
         | F.col("a.anomaly_type").isNull()),
        ("first_deviation_line", line.isNotNull() & ~line.between(0, F.col("n_lines"))),
        ("flow", ~F.col("a.flow").isin([*flow_names, "unknown"]) | F.col("a.flow").isNull()),
        ("step_check", F.col("a.step_check").isNull()),
        ("explanation", F.col("a.explanation").isNull()),
    ]
    bad = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return p.select("trace_id", F.array_join(bad, ",").alias("violations")).where(
        F.col("violations") != "")


def usage_table(prompts: DataFrame, answers: DataFrame, prefix_chars: int) -> DataFrame:
    """Token counts per trace, estimated at 4 characters per token: one prompt of the system text
    and the trace's lines (joined by line breaks), the completion and the cached prefix.
    ``prompts``: one row per line (trace_id, user)."""
    per = prompts.groupBy("trace_id").agg(
        (F.sum(F.length("user") + 1) - 1 + prefix_chars).alias("_chars"))
    j = per.join(answers.select("trace_id", "answer"), "trace_id")
    return j.select(
        "trace_id",
        F.ceil(F.col("_chars") / 4).cast("long").alias("prompt_tokens"),
        F.ceil(F.length("answer") / 4).cast("long").alias("completion_tokens"),
        F.lit(-(-prefix_chars // 4)).cast("long").alias("cached_tokens"))


def token_usage(usage: DataFrame) -> DataFrame:
    return usage.agg(F.sum("prompt_tokens").cast("long").alias("input_tokens"),
                     F.sum("completion_tokens").cast("long").alias("output_tokens"),
                     F.sum("cached_tokens").cast("long").alias("cached_input_tokens"),
                     F.count("*").alias("n_calls"))


def run_payloads(dets: DataFrame, runs: DataFrame) -> DataFrame:
    """Evaluation payloads (what each ``metrics.json`` holds), all runs in one pass: ``dets``
    are detection records tagged with ``run_id``; ``runs`` has one row per run with method,
    variant, split, threshold and the usage columns."""
    by = ["run_id"]
    m = M.classification_metrics(dets, by)
    auc = M.auroc(dets, by=by)
    rpt = M.recall_per_type(dets, by).groupBy("run_id").agg(F.map_from_entries(F.collect_list(
        F.struct("anomaly_type", F.struct("n", "flagged", "recall")))).alias("recall_per_type"))
    one = m.join(auc, "run_id", "left").join(rpt, "run_id", "left")
    metric_cols = [c for c in m.columns if c != "run_id"] + ["auroc", "recall_per_type"]
    j = runs.join(one.select("run_id", F.struct(*metric_cols).alias("metrics")), "run_id", "left")
    return j.select("method", "run_id", "variant", "split", "threshold", "metrics",
                    *[c for c in runs.columns if c not in ("method", "run_id", "variant", "split",
                                                             "threshold")])


def run_costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per 1,000 traces and one-off training cost, by method: the LLM rule for answer
    runs, the GPU rule for model runs, else the stored cost and 0.0 training."""
    j = runs.join(F.broadcast(prices), how="inner", on=F.lit(True))  # prices: one row
    n = F.col("metrics.n_traces")
    llm = M.llm_cost_per_1000(F.coalesce("input_tokens", F.lit(0)),
                              F.coalesce("output_tokens", F.lit(0)), n,
                              F.col("llm_input_per_1m_tokens"), F.col("llm_output_per_1m_tokens"))
    gpu = M.gpu_cost_per_1000(F.coalesce("scoring_seconds", F.lit(0.0)), n, F.col("gpu_per_hour"))
    train = M.training_cost(F.coalesce("training_seconds", F.lit(0.0)), F.col("gpu_per_hour"))
    method = F.col("method")
    per_1000 = (F.when(method == "answers", llm).when(method == "surprise", gpu)
                .otherwise(F.col("cost_per_1000")))
    training = F.when(method == "surprise", train).otherwise(F.lit(0.0))
    return j.select("*", F.round(per_1000, 9).alias("cost_per_1000_traces"),
                    F.round(training, 9).alias("training_cost"))


def compare_runs(costed: DataFrame) -> DataFrame:
    """One row per run: method, variant, traces, P, R, F1, FPR and both costs (3 / 4 decimals
    or ``n/a``), ordered by run id."""
    from logweave.functions.text import null_format

    m = F.col
    return costed.select(
        "run_id", "method", "variant", m("metrics.n_traces").alias("traces"),
        null_format(m("metrics.precision")).alias("precision"),
        null_format(m("metrics.recall")).alias("recall"),
        null_format(m("metrics.f1")).alias("f1"),
        null_format(m("metrics.false_positive_rate")).alias("fpr"),
        null_format(m("cost_per_1000_traces"), 4).alias("cost_per_1000"),
        null_format(m("training_cost"), 4).alias("training_cost")).orderBy("run_id")


def recall_pivot(runs: DataFrame) -> DataFrame:
    """Run x the five fixed anomaly types; a type the run did not see shows ``-``."""
    e = runs.select("run_id", F.explode("metrics.recall_per_type").alias("type", "r"))
    p = (e.groupBy("run_id").pivot("type", TYPES)
         .agg(F.first(fixed(F.col("r.recall"), 3))))
    return runs.select("run_id").join(p, "run_id", "left").select(
        "run_id", *[F.coalesce(F.col(t), F.lit("-")).alias(t) for t in TYPES])
