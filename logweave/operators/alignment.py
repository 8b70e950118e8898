"""Alignment of whole traces to flows: the flow of least edit cost, whichever lines are missing.

A trace is aligned to a flow of ``L`` steps by skipping steps (cost 1 each), dropping lines (cost 1, or 0
if the line is optional in the flow) and matching lines to their steps in order (cost 0; an
optional line that covers neighbouring steps matches all of them at once). Cost and order of a
line act on a flow position ``p`` ("``p`` steps are done"), so a line is a (min,+) matrix over the
``L + 1`` positions, and a trace is the product of its lines' matrices.

The product is associative, which splits a hot trace: lines are folded in chunks of ``CHUNK`` indices, one
small matrix per chunk and flow, and the chunk matrices of a trace are multiplied in groups of ``FAN``
until one is left. A row holds ``CHUNK`` template numbers or ``FAN`` matrices at most, never a trace.
Templates that no flow knows act alike, so only numbers of known ones travel.

A trace is recognised as the flow of least cost among those that at least one line was worth matching to;
ties go to the flow that explains more, then by name; without any match it is ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.flows import EVENT_FLOWS, Flow, step_template
from logweave.session import cut_lineage

CHUNK = 256
FAN = 16
FAR = 1 << 40  # more than any cost


def flow_actions(flows: tuple[Flow, ...] = EVENT_FLOWS) -> tuple[dict[str, int], list[list[tuple[int, int, int]]]]:
    """Number of each known template, and per number and flow: position matched, steps covered, cost
    of dropping the line. Number 0 stands for every other template (position -1: matches nothing)."""
    names = sorted({step_template(x.service, x.level, x.message) for f in flows for x in (*f.steps, *f.optional)})
    number = {t: i + 1 for i, t in enumerate(names)}
    table = [[(-1, 0, 1)] * len(flows) for _ in range(len(names) + 1)]
    for at, f in enumerate(flows):
        pos = {s.step: i for i, s in enumerate(f.steps)}
        for o in f.optional:
            covered = [pos[c] for c in o.covers]
            if covered != list(range(covered[0], covered[0] + len(covered))) if covered else False:
                raise ValueError(f"flow {f.name!r}: {o.kind!r} covers steps that are no neighbours")
            table[number[step_template(o.service, o.level, o.message)]][at] = (covered[0] if covered else -1, len(covered), 0)
        for i, s in enumerate(f.steps):
            table[number[step_template(s.service, s.level, s.message)]][at] = (i, 1, 1)
    return number, table


def _literal(values: list) -> Column:
    return F.array(*[_literal(v) if isinstance(v, list) else F.lit(v) for v in values])


def _start(flows: tuple[Flow, ...], width: int) -> Column:
    """Skipping steps only: ``q - p`` steps lie between two positions."""
    one = [[F.lit(q - p if q >= p else FAR).cast("long") for q in range(width)] for p in range(width)]
    return F.array(*[F.array(*[F.array(*row) for row in one]) for _ in flows])


def _fold(numbers: Column, flows: tuple[Flow, ...], width: int) -> Column:
    """The product of the lines' matrices, line by line from the left."""
    _, table = flow_actions(flows)
    place, covers, drop = (_literal([[action[i] for action in row] for row in table]) for i in range(3))

    def line(state: Column, number: Column) -> Column:
        def of_flow(matrix: Column, f: Column) -> Column:
            p, c, e = (F.get(F.get(t, number), f) for t in (place, covers, drop))
            return F.transform(matrix, lambda row: F.transform(row, lambda x, q: F.least(
                x + e, F.when((p >= 0) & (q >= p + c), F.get(row, p) + q - p - c))))
        return F.transform(state, of_flow)

    return F.aggregate(numbers, _start(flows, width), line)


def _product(matrices: Column, width: int) -> Column:
    """(min,+) product of an array of per-flow matrices, in order."""
    def times(left: Column, right: Column) -> Column:
        return F.transform(left, lambda a, f: F.transform(a, lambda row: F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda q: F.array_min(F.transform(row, lambda x, r: x + F.get(F.get(F.get(right, f), r), q))))))

    return F.aggregate(F.slice(matrices, 2, F.size(matrices)), F.get(matrices, F.lit(0)), times)


def trace_matrices(indexed: DataFrame, flows: tuple[Flow, ...] = EVENT_FLOWS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(trace_id, m)``: per flow the matrix of the whole trace. ``indexed``: trace_id, idx, template."""
    number, _ = flow_actions(flows)
    width = max(len(f.steps) for f in flows) + 1
    known = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    lines = indexed.select("trace_id", "idx", F.floor(F.col("idx") / chunk).alias("part"),
                           F.coalesce(F.element_at(known, F.col("template")), F.lit(0)).alias("number"))
    # dealt by trace and part, not by trace: a hot trace is many tasks' work
    ordered = F.array_sort(F.collect_list(F.struct("idx", "number")))
    parts = lines.groupBy("trace_id", "part").agg(F.transform(ordered, lambda x: x["number"]).alias("numbers"))
    parts = parts.select("trace_id", "part", _fold(F.col("numbers"), flows, width).alias("m"))
    last = indexed.agg(F.max("idx")).first()[0] or 0
    left = last // chunk
    while left > 0:
        ordered = F.array_sort(F.collect_list(F.struct("part", "m")))
        groups = cut_lineage(parts, "matrices").groupBy("trace_id", F.floor(F.col("part") / fan).alias("part")).agg(ordered.alias("ms"))
        parts = groups.select("trace_id", "part", _product(F.transform("ms", lambda x: x["m"]), width).alias("m"))
        left //= fan
    return parts.select("trace_id", "m")


def align_flows(indexed: DataFrame, flows: tuple[Flow, ...] = EVENT_FLOWS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(trace_id, flow, cost)``: the flow of least cost and that cost; ``unknown`` and null without a match."""
    options = []
    for i, f in enumerate(flows):
        n = len(f.steps)
        cell = lambda p, q: F.get(F.get(F.get("m", F.lit(i)), F.lit(p)), F.lit(q))  # noqa: B023, E731
        worth = cell(0, n) - n - cell(n, n)  # against skipping every step and dropping every line
        options.append(F.struct(cell(0, n).alias("cost"), worth.alias("worth"), F.lit(f.name).alias("flow")))
    best = F.array_min(F.filter(F.array(*options), lambda o: o["worth"] < 0))
    found = trace_matrices(indexed, flows, chunk, fan).select("trace_id", best.alias("best"))
    return found.select("trace_id", F.coalesce("best.flow", F.lit("unknown")).alias("flow"), F.col("best.cost").alias("cost"))
