"""Scale guards on physical plans: per-trace work never funnels rows through one partition."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL

# queries whose plans must hold no single-partition exchange (no global window or sort).
# Queries ending in a global aggregate (e.g. trace_interleaving) legitimately merge one
# partial row per task in a single partition, so they are not listed.
DISTRIBUTED = ["line_index", "keyword_match", "group_traces", "flow_conformance", "repeat_runs",
               "join_flow_steps", "asof_token_line", "line_surprise"]


@pytest.mark.parametrize("name", DISTRIBUTED)
def test_no_single_partition_exchange(spark, name):
    from __spark_entry__ import queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # inspect the static plan
    try:
        df = queries()[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SinglePartition" not in plan, plan


def test_hot_trace_is_split_before_the_step_windows(spark):
    """With broadcast off the steps are dealt by (trace, chunk) before any window over them."""
    from logweave.operators import flows as FL
    from logweave.plans import base as B

    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ix = B.indexed(spark, SF_SMALL)
        obs = FL.observed_steps(ix, FL.trace_heads(ix))
        plan = obs._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    depth = [i for i, line in enumerate(plan) if "Window " in line and "row_number()" in line and "_c#" in line]
    assert depth
    for i in depth:
        below = next(line for line in plan[i + 1:] if "Exchange hashpartitioning" in line)
        assert "trace_id" in below and "_c#" in below


def test_work_by_trace_reads_buckets_without_an_exchange(spark):
    """With broadcast off, nothing between the bucketed lines and the aggregate per trace is shuffled."""
    from logweave.operators import detect as D
    from logweave.operators import flows as FL
    from logweave.plans import base as B

    B.prepared(spark, SF_SMALL)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fn in (D.keyword_match, FL.trace_heads, lambda lines: FL.line_facts(lines, FL.trace_heads(lines))):
            plan = B.by_trace(spark, SF_SMALL, fn)._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "Exchange" not in plan, plan
        # the one exchange of the evaluation by keywords is that of the short list of test traces
        tests = B.splits(spark, SF_SMALL).where("split = 'test'").select("trace_id")
        plan = B.by_trace(spark, SF_SMALL, lambda lines: D.keyword_match(lines.join(tests, "trace_id")))
        plan = plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan.split("Exchange")[0], plan
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_hot_traces_stay_out_of_the_buckets(spark):
    from logweave.operators import detect as D
    from logweave.plans import base as B
    from logweave.session import scratch_path

    rows = [("hot", i, "api ERROR x" if i == 70 else "api INFO y") for i in range(500)] + [(f"t{i % 20}", i // 20, "api INFO z") for i in range(200)]
    lines = spark.createDataFrame(rows, "trace_id string, idx long, template string")
    forms = B.bucket_by_trace(lines, scratch_path(spark, "buckets"), hot_lines=100, rows=50)
    assert spark.table(forms[0]).where("trace_id = 'hot'").count() == 0 and forms[1] is not None
    got = sorted(map(tuple, B.per_trace(forms, spark, D.keyword_match).collect()))
    assert got == sorted(map(tuple, D.keyword_match(lines).collect())) and len(got) == 21


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_index_alone_builds_no_answers(spark):
    """A query that reads only the indexed lines has no other prepared table built."""
    import shutil
    import tempfile

    from logweave.plans import base as B
    from logweave.plans.catalog import QUERIES

    sf = tempfile.mkdtemp(prefix="logweave-lazy-")
    for t in ("events", "documents", "labels", "conversations", "orders"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", sf)
    rows = QUERIES["sort_lines"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert not [p for key, built in B._PREPARED.items() if key[1] == sf for p in built]
    QUERIES["answer_parse"](spark, sf)
    assert [list(built) for key, built in B._PREPARED.items() if key[1] == sf] == [["answers"]]


def test_index_by_trace_parts_hot_traces_by_one_exchange(spark):
    from logweave.operators.traces import line_index
    from logweave.plans import base as B
    from logweave.session import scratch_path

    rows = [("hot", 7 - i % 3, i) for i in range(300)] + [(None, 1, 400 + i) for i in range(150)] + [(f"t{i % 9}", i % 4, 900 + i) for i in range(90)]
    lines = spark.createDataFrame(rows, "trace_id string, sec long, line_no long").selectExpr("trace_id", "timestamp_seconds(sec) AS ts", "line_no")
    name, hot = B.index_by_trace(lines, scratch_path(spark, "ix"), hot_lines=100, rows=20)
    got = B.per_trace((name, hot), spark, lambda x: x).select("trace_id", "line_no", "idx").collect()
    want = line_index(lines).select("trace_id", "line_no", "idx").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 540
    assert spark.table(name).count() == 90
    assert sorted({str(r[0]) for r in spark.read.parquet(hot).collect()}) == ["None", "hot"]


def test_short_traces_conform_like_hot_ones(spark):
    """The answers of one window per trace are those of the chunked form, without a shuffle of the lines."""
    from logweave.operators import flows as FL
    from logweave.plans import base as B

    ix = B.indexed(spark, SF_SMALL)
    some = ix.where("idx < 1").selectExpr("cast(null as string) AS trace_id", "ts", "line_no", "level", "service", "template", "cast(line_no as long) AS idx").limit(3)
    lines = ix.select("trace_id", "ts", "line_no", "level", "service", "template", "idx").unionByName(some)
    whole = FL.conformance(lines, with_optional=True, short=True)
    chunked = FL.conformance(lines, with_optional=True)
    assert sorted(map(str, whole.collect())) == sorted(map(str, chunked.collect()))
    plan = _plan(B.by_trace(spark, SF_SMALL, lambda x: FL.conformance(x, with_optional=True, short=True)))
    assert plan.count("Join ") == 1, plan


def test_runs_and_splits_read_each_line_once(spark):
    """Runs are one aggregate over a running count; lines of the splits come from the index, not from the events."""
    from logweave.operators import flows as FL
    from logweave.plans.catalog import QUERIES

    obs = spark.createDataFrame([("t", 0, 5, 1, None, None), ("t", 1, 6, 1, 1, None)], "trace_id string, k long, idx long, pos int, prev_pos int, prev2_pos int")
    assert _plan(FL.repeat_runs(obs)).count("Join ") == 1  # the chunks' totals
    plan = QUERIES["repeat_runs"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "logweave_lines" in plan, plan
    for name in ("split_membership", "union_splits"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan and "logweave_lines" in plan, plan


def test_contexts_of_a_day_are_counted_before_they_are_unfolded(spark):
    from logweave.operators.surprise import histories
    from logweave.plans import delta as DL

    rows = spark.createDataFrame([(f"t{i // 5}", i % 5, f"x{i % 3}", f"d{i // 50}") for i in range(100)], "trace_id string, idx long, template string, day string")
    got = DL._day_contexts(rows)
    want = histories(rows, carry=("day",)).selectExpr("day", "next", "inline(levels)").groupBy("day", "k", "context", "next").count()
    assert sorted(map(tuple, got.select("day", "k", "context", "next", "n").collect())) == sorted(map(tuple, want.select("day", "k", "context", "next", "count").collect()))
    assert "Aggregate" in _plan(got).split("Generate")[1].split("Window")[0]


def test_raw_lines_meet_the_labelled_ones_without_a_shuffle(spark):
    """``scan_labelled_jsonl`` writes the few labelled lines before it looks up their raw text."""
    import glob

    from __spark_entry__ import queries
    from logweave.session import _scratch_root

    queries()["scan_labelled_jsonl"](spark, SF_SMALL)
    written = glob.glob(f"{_scratch_root(spark).removeprefix('file:')}/labelled-lines-*")
    assert written
    lines, labelled = spark.read.parquet(written[0]), queries()["scan_labelled_jsonl"](spark, SF_SMALL)
    assert {r.trace_id for r in lines.select("trace_id").distinct().collect()} == {r.trace_id for r in labelled.collect()}
