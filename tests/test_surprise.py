"""Back-off context model against its formula on plain lists."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from logweave.operators import flows as FL
from logweave.operators import surprise as SU


def plain_histories(lines: list[str], order: int) -> list[tuple[str, list[tuple]]]:
    """(next, [context of length 0, 1, ...]) of every line and the end."""
    full = [SU.START, *lines]
    out = []
    for i, following in enumerate([*lines, SU.END]):
        before = full[: i + 1]
        out.append((following, [tuple(before[len(before) - k:]) for k in range(min(order, len(before)) + 1)]))
    return out


def plain_scores(train: list[list[str]], traces: dict[str, list[str]], order: int = SU.ORDER) -> dict[tuple, float]:
    counts: dict[tuple, Counter] = defaultdict(Counter)
    for lines in train:
        for following, contexts in plain_histories(lines, order):
            for c in contexts:
                counts[c][following] += 1
    vocab = len({n for c in counts.values() for n in c} - {SU.END}) + 2
    out = {}
    for t, lines in traces.items():
        for i, (following, contexts) in enumerate(plain_histories(lines, order)):
            p = 1 / vocab
            for c in contexts:
                if c in counts:
                    n, kinds = sum(counts[c].values()), len(counts[c])
                    p = (counts[c][following] + kinds * p) / (n + kinds)
            out[t, i] = -math.log(p)
    return out


def frame(spark, traces: dict[str, list[str]]):
    rows = [(t, i, x) for t, lines in traces.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "trace_id string, idx long, template string").repartition(5)


def random_traces(seed: int, n: int, letters: str) -> dict[str, list[str]]:
    draw = random.Random(seed)
    return {f"t{seed}-{i}": draw.choices(letters, k=draw.choice([1, 2, 3, 5, 9, 40])) for i in range(n)}


@pytest.mark.parametrize("chunk", [5, 4096])
def test_scores_equal_the_formula(spark, chunk):
    train, test = random_traces(1, 60, "aab"), random_traces(2, 60, "abc")
    model = SU.context_model(SU.histories(frame(spark, train), chunk=chunk))
    rows = SU.histories(frame(spark, test), chunk=chunk)
    got = {(r.trace_id, r.idx): r.surprise for r in SU.score_histories(rows, model, SU.vocabulary_size(model)).collect()}
    want = plain_scores(list(train.values()), test)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_contexts_are_the_last_templates(spark):
    rows = SU.histories(frame(spark, {"t": list("abcdef")}), order=2, chunk=3).orderBy("idx").collect()
    digest = lambda *x: hashlib.md5("\u0001".join(x).encode()).hexdigest()
    assert [r.next for r in rows] == [*"abcdef", SU.END]
    assert [(x.k, x.context) for x in rows[0].levels] == [(0, digest()), (1, digest(SU.START))]
    assert [(x.k, x.context) for x in rows[4].levels] == [(0, digest()), (1, digest("d")), (2, digest("c", "d"))]


def test_nothing_learned_means_equal_surprise(spark):
    rows = SU.histories(frame(spark, {"t": ["a", "b"]}))
    model = SU.context_model(rows.limit(0))
    got = SU.score_histories(rows, model, SU.vocabulary_size(model)).collect()
    assert {round(r.surprise, 12) for r in got} == {round(math.log(2), 12)}


def test_hot_trace_is_dealt_by_chunk(spark):
    """30,000 lines of one trace: no task sees more than a chunk and the lines repeated before it."""
    ix = spark.range(30_000).selectExpr("'hot' AS trace_id", "id AS idx", "concat('x', id % 7) AS template")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = SU.histories(ix, chunk=1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    window = plan.index("Window ")
    below = next(line for line in plan[window:].splitlines() if "Exchange hashpartitioning" in line)
    assert "_c#" in below
    assert SU.histories(ix, chunk=1000).count() == 30_001


def test_flow_variants_hold_optional_lines_anywhere():
    flow = FL.EVENT_FLOWS[0]
    steps = [FL.step_template(s.service, s.level, s.message) for s in flow.steps]
    extra = FL.step_template(flow.optional[0].service, flow.optional[0].level, flow.optional[0].message)
    found = FL.flow_variants((flow,), optional=1)
    assert sorted(found) == sorted([steps, *[steps[:i] + [extra] + steps[i:] for i in range(4)]])


def test_skips_truncations_and_errors_score_above_normal_traces(spark):
    """Learned from the flow definitions alone, every broken trace has a worse line than every normal one."""
    model = SU.context_model(SU.histories(SU.variant_lines(spark)))
    t = lambda kind, level="INFO": FL.step_template(f"{kind}-service", level, f"{kind} handled user={{user}} key={{key}}")
    view, click, buy, fail = t("view"), t("click"), t("purchase"), t("error", "ERROR")
    normal = {"n1": [view, click, buy], "n2": [click, buy], "n3": [click, view, buy]}
    broken = {"b1": [view, click], "b2": [view, fail, click, buy], "b3": [buy, click, view], "b4": [view, view, view, view, click]}
    rows = SU.histories(frame(spark, normal | broken))
    scored = SU.trace_surprise(SU.score_histories(rows, model, SU.vocabulary_size(model))).collect()
    score = {r.trace_id: r.score for r in scored}
    assert max(score[n] for n in normal) < min(score[b] for b in broken)
    assert {r.trace_id: r.pred_index for r in scored}["b1"] == 2  # the missing purchase, where the trace ends
    assert {r.trace_id: r.pred_index for r in scored}["b2"] == 1
