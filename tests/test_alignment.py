"""Alignment of traces to flows against a plain dynamic program."""

from __future__ import annotations

import random

import pytest

from logweave.operators import alignment as AL
from logweave.operators import flows as FL


def template(kind: str) -> str:
    level = {"signup": "WARN", "error": "ERROR"}.get(kind, "INFO")
    return FL.step_template(f"{kind}-service", level, f"{kind} handled user={{user}} key={{key}}")


def plain_cost(lines: list[str], flow: FL.Flow) -> tuple[int, int]:
    """(least cost, cost without any match), by the table of the edit distance."""
    steps = [FL.step_template(s.service, s.level, s.message) for s in flow.steps]
    pos = {s.step: i for i, s in enumerate(flow.steps)}
    optional = {FL.step_template(o.service, o.level, o.message): [pos[c] for c in o.covers] for o in flow.optional}
    n, size = len(steps), len(lines)
    cost = [[10**9] * (n + 1) for _ in range(size + 1)]
    cost[0][0] = 0
    for i in range(size + 1):
        for p in range(n + 1):
            here = cost[i][p]
            if p < n:
                cost[i][p + 1] = min(cost[i][p + 1], here + 1)
            if i < size:
                drop = 0 if lines[i] in optional else 1
                cost[i + 1][p] = min(cost[i + 1][p], here + drop)
                if p < n and lines[i] == steps[p]:
                    cost[i + 1][p + 1] = min(cost[i + 1][p + 1], here)
                covered = optional.get(lines[i])
                if covered and covered[0] == p:
                    cost[i + 1][p + len(covered)] = min(cost[i + 1][p + len(covered)], here)
    return cost[size][n], n + sum(line not in optional for line in lines)


def plain_flow(lines: list[str], flows) -> tuple[str, int | None]:
    found = []
    for f in flows:
        cost, worst = plain_cost(lines, f)
        if cost < worst:
            found.append((cost, cost - worst, f.name))
    return (min(found)[2], min(found)[0]) if found else ("unknown", None)


def frame(spark, traces: dict[str, list[str]]):
    rows = [(t, i, line, line.split()[0], line.split()[1]) for t, lines in traces.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "trace_id string, idx long, template string, service string, level string").repartition(4)


@pytest.mark.parametrize("flows", [FL.EVENT_FLOWS, FL.COVER_FLOWS], ids=["plain", "cover"])
@pytest.mark.parametrize("chunk, fan", [(3, 2), (256, 16)])
def test_flows_equal_the_plain_dynamic_program(spark, flows, chunk, fan):
    draw = random.Random(6)
    kinds = [template(k) for k in ("signup", "view", "click", "purchase", "error")]
    traces = {f"t{i}": draw.choices(kinds, k=draw.choice([1, 2, 3, 4, 7, 20, 41])) for i in range(500)}
    got = AL.align_flows(frame(spark, traces), flows, chunk, fan).collect()
    assert {r.trace_id: (r.flow, r.cost) for r in got} == {t: plain_flow(x, flows) for t, x in traces.items()}


def test_trace_without_its_first_line_is_a_silent_skip(spark):
    traces = {"lost": [template(k) for k in ("click", "purchase")], "none": [template("error")],
              "whole": [template(k) for k in ("view", "click", "purchase")]}
    flows = (FL.EVENT_FLOWS[1],)  # only the longer flow is known
    ix = frame(spark, traces)
    got = {r.trace_id: r for r in FL.conformance(ix, flows, recognised=AL.align_flows(ix, flows)).collect()}
    assert (got["lost"].flow, got["lost"].anomaly_type, got["lost"].first_deviation_line) == ("browse_buy", "silent_skip", 0)
    assert got["lost"].step_check == "view: missing; click: 0; purchase: 1"
    assert (got["whole"].flow, got["whole"].verdict) == ("browse_buy", "normal")
    assert got["none"].flow == "unknown"
    by_first = {r.trace_id: r.flow for r in FL.conformance(ix, flows).collect()}
    assert by_first["lost"] == "unknown"


def test_covering_line_stands_for_its_steps(spark):
    traces = {"a": [template("signup"), template("purchase")]}
    ix = frame(spark, traces)
    got = FL.conformance(ix, FL.COVER_FLOWS, recognised=AL.align_flows(ix, FL.COVER_FLOWS)).first()
    assert (got.flow, got.verdict, got.step_check) == ("browse_buy", "normal", "view: 0; click: 0; purchase: 1")


def test_covers_must_be_neighbours():
    flow = FL.Flow("f", "", FL.EVENT_FLOWS[1].steps, (FL._opt("signup", "WARN", ("view", "purchase")),))
    with pytest.raises(ValueError, match="neighbours"):
        AL.flow_actions((flow,))


def test_hot_trace_is_folded_in_chunks(spark):
    """One trace of 30,000 lines: every row of the fold holds one chunk, and the cost is the plain one."""
    kinds = [template(k) for k in ("view", "click", "purchase", "signup")]
    draw = random.Random(1)
    lines = draw.choices(kinds, k=30_000)
    ix = spark.createDataFrame([("hot", i, t) for i, t in enumerate(lines)], "trace_id string, idx long, template string").repartition(8)
    got = AL.align_flows(ix).first()
    assert (got.flow, got.cost) == plain_flow(lines, FL.EVENT_FLOWS)
