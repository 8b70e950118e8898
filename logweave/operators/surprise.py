"""Next-line surprise scoring and token-loss aggregation.

A countable stand-in for a language model trained on normal traces: a back-off model of a line given
the ``ORDER`` templates before it (with START and END markers). The probability of a template in
a context mixes the context's own counts with the next shorter context's probability by the
escape weight of Witten and Bell, ``(c(ctx, next) + t(ctx) * p(next | shorter)) / (n(ctx) + t(ctx))``,
where ``t`` counts the different templates seen after the context; unseen contexts fall through, and
below the empty context all templates are equally likely. A line's surprise is ``-ln p``; a
trace is scored by its worst line, and the threshold is a percentile over traces held out of learning.

It learns from conforming traces only, and from the line sequences that the flow definitions allow.

Scale: a line needs the ``ORDER`` lines before it, not its trace: lines are dealt by chunks of their index, and
the last ``ORDER`` lines of a chunk are repeated at the head of the next one, so a hot trace is many
tasks' work. Lines with the same history are one *pattern*: counts are summed and
probabilities computed per pattern, and only then joined to the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.functions.text import TRACE_END
from logweave.operators.flows import EVENT_FLOWS, Flow, flow_variants
from logweave.operators.ranking import running_total

START, END = "<START>", "<END>"
ORDER = 4
HISTORY_CHUNK = 4096
#: Share of the conforming traces that set the threshold: their hash begins below this hex digit (3/16).
CALIBRATE_BELOW = "3"


def learning_role(trace_id: Column, normal: Column) -> Column:
    """``learn`` or ``calibrate`` for a conforming trace, else null."""
    held_out = F.md5(F.concat(F.lit("surprise:"), trace_id)) < CALIBRATE_BELOW
    return F.when(normal, F.when(held_out, "calibrate").otherwise("learn"))


def _context(*templates: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", *templates)) if templates else F.md5(F.lit(""))


def histories(indexed: DataFrame, template: str = "template", carry: tuple[str, ...] = (), order: int = ORDER,
              chunk: int = HISTORY_CHUNK) -> DataFrame:
    """Per trace ``n_lines + 1`` rows ``(trace_id, idx, next, levels, deepest)``; idx = n_lines is END.

    ``levels``: ``(k, context)`` for the last ``k`` templates, as far as the trace has them (START is
    the one before line 0); ``deepest``: the longest of these contexts. ``carry``: per-trace columns."""
    lines = indexed.select("trace_id", "idx", F.col(template).alias("next"), *carry)
    ends = lines.groupBy("trace_id", *carry).agg((F.max("idx") + 1).alias("idx"), F.lit(END).alias("next"))
    own = F.floor(F.col("idx") / chunk)
    places = F.when(F.pmod("idx", F.lit(chunk)) >= chunk - order, F.array(own, own + 1)).otherwise(F.array(own))
    spread = lines.unionByName(ends).withColumn("_c", F.explode(places)).repartition("trace_id", "_c")
    w = W.partitionBy("trace_id", "_c").orderBy("idx")
    before = [F.when(F.col("idx") >= k, F.lag("next", k).over(w)).when(F.col("idx") == k - 1, START).alias(f"_p{k}")
              for k in range(1, order + 1)]
    rows = spread.select("*", *before).where(F.col("_c") == own)
    levels = [F.struct(F.lit(k).alias("k"), _context(*[F.col(f"_p{j}") for j in range(k, 0, -1)]).alias("context"))
              for k in range(order + 1)]
    there = F.array(levels[0], *[F.when(F.col(f"_p{k}").isNotNull(), levels[k]) for k in range(1, order + 1)])
    rows = rows.withColumn("levels", F.filter(there, lambda x: x.isNotNull()))
    return rows.select("trace_id", "idx", "next", *carry, "levels", F.element_at("levels", -1)["context"].alias("deepest"))


def variant_lines(spark: SparkSession, flows: tuple[Flow, ...] = EVENT_FLOWS) -> DataFrame:
    """The line sequences that the flow definitions allow, as ``(trace_id, idx, template)``."""
    rows = [(f"variant-{n}", i, t) for n, seq in enumerate(flow_variants(flows)) for i, t in enumerate(seq)]
    return spark.createDataFrame(rows, "trace_id string, idx long, template string")


def context_model(rows: DataFrame) -> DataFrame:
    """``(k, context, next, n)``: how often a template follows a context of ``k`` templates."""
    patterns = rows.groupBy("deepest", "next").agg(F.any_value("levels").alias("levels"), F.count("*").alias("n"))
    return patterns.select("next", "n", F.inline("levels")).groupBy("k", "context", "next").agg(F.sum("n").alias("n"))


def vocabulary_size(model: DataFrame) -> int:
    """Learned templates + END + one slot for unseen templates."""
    return model.where(F.col("next") != END).select("next").distinct().count() + 2


def score_histories(rows: DataFrame, model: DataFrame, vocab: int) -> DataFrame:
    """``(trace_id, idx, next, carried columns, surprise)`` of every row of ``histories``."""
    totals = model.groupBy("k", "context").agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    patterns = rows.groupBy("deepest", "next").agg(F.any_value("levels").alias("levels"))
    levels = patterns.select("deepest", "next", F.inline("levels")).join(totals, ["k", "context"])
    counts = model.select("k", "context", "next", F.col("n").alias("c"))
    levels = levels.join(counts, ["k", "context", "next"], "left")
    level = F.struct("k", F.coalesce("c", F.lit(0)).cast("double").alias("c"), F.col("n").cast("double").alias("n"),
                     F.col("t").cast("double").alias("t"))
    seen = levels.groupBy("deepest", "next").agg(F.array_sort(F.collect_list(level)).alias("seen"))  # at most ORDER + 1
    p = F.aggregate("seen", F.lit(1.0 / vocab), lambda p, x: (x["c"] + x["t"] * p) / (x["n"] + x["t"]))
    scored = seen.select("deepest", "next", (-F.log(p)).alias("_s"))
    keep = [c for c in rows.columns if c not in ("levels", "deepest")]
    unseen = F.lit(1.0 / vocab)
    return rows.join(scored, ["deepest", "next"], "left").select(*keep, F.coalesce("_s", -F.log(unseen)).alias("surprise"))


def trace_surprise(line_scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Score = max line surprise (END included), worst line = argmax (lowest index on ties),
    its text (``TRACE END`` past the last line), and the mean over all lines."""
    order = F.struct(F.col("surprise"), -F.col("idx"))
    return line_scores.groupBy("trace_id", *by).agg(
        F.max("surprise").alias("score"),
        F.max_by("idx", order).alias("pred_index"),
        F.max_by(F.when(F.col("next") == END, F.lit(TRACE_END)).otherwise(F.col("next")),
                 order).alias("worst_line_text"),
        F.avg("surprise").alias("mean_nll"))


# ---- token losses --------------------------------------------------------------------------

TOKEN_CHUNK = 8192


def token_lines(tokens: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of lookup of each token's line: the last line that begins at or before the token's first
    non-space character (a token of white space alone: its own start, i.e. the line it ends).

    ``tokens``: ``(trace_id, tok, s, e, span, nll)`` (span = the token's text); ``starts``:
    ``(trace_id, idx, offset)``, one row per line and one for the end marker. Starts and tokens
    are merged by position, and a token's line is the number of starts up to it less one: a
    running count in chunks of ``TOKEN_CHUNK`` characters, linear in tokens and lines."""
    t = tokens.where((F.col("tok") > 0) & (F.col("e") > F.col("s")))
    stripped = F.regexp_replace("span", r"^\s+", "")  # whitespace incl. newlines
    pos = F.when(F.length(stripped) > 0,
                 F.col("s") + F.length("span") - F.length(stripped)).otherwise(F.col("s"))
    t = t.select("trace_id", pos.cast("long").alias("_pos"), F.lit(1).alias("_kind"), "tok", "nll",
                 F.lit(0).cast("long").alias("_one"))
    lines = starts.select("trace_id", F.col("offset").cast("long").alias("_pos"), F.lit(0).alias("_kind"),
                          F.lit(None).cast("int").alias("tok"), F.lit(None).cast("double").alias("nll"),
                          F.lit(1).cast("long").alias("_one"))
    order = [F.col("_pos"), F.col("_kind"), F.col("tok")]
    merged = running_total(lines.unionByName(t), ["trace_id"], order,
                           F.floor(F.col("_pos") / TOKEN_CHUNK), {"_begun": F.col("_one")})
    return merged.where(F.col("_kind") == 1).select(
        "trace_id", "tok", "nll", (F.col("_begun") - 1).cast("long").alias("line"))


def token_to_line_loss(tokens: DataFrame, starts: DataFrame) -> DataFrame:
    """Map token losses to lines and average: the first token and zero-width tokens are
    skipped, header tokens (line < 0) ignored. Returns ``(trace_id, line, line_loss, n)``."""
    lines = token_lines(tokens, starts).where(F.col("line") >= 0)
    return lines.groupBy("trace_id", "line").agg(F.avg("nll").alias("line_loss"),
                                                 F.count("*").alias("n"))


def worst_line(line_losses: DataFrame, text: DataFrame) -> DataFrame:
    """Per trace: score = max line loss, worst index (first on ties), its text and the mean over
    all counted tokens. A trace without scored lines gets score 0.0, a null index and ``''``.
    ``text``: the rows of ``trace_text`` (the end marker is the line past the last)."""
    order = F.struct(F.col("line_loss"), -F.col("line"))
    g = line_losses.groupBy("trace_id").agg(
        F.max("line_loss").alias("score"), F.max_by("line", order).alias("worst_index"),
        (F.sum(F.col("line_loss") * F.col("n")) / F.sum("n")).alias("mean_nll"))
    traces = text.select("trace_id").distinct().join(g, "trace_id", "left")
    lines = text.select("trace_id", F.col("idx").alias("worst_index"), F.col("line").alias("worst_text"))
    return traces.join(lines, ["trace_id", "worst_index"], "left").select(
        "trace_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("mean_nll", F.lit(0.0)).alias("mean_nll"),
        F.col("worst_index").cast("long").alias("worst_index"),
        F.coalesce("worst_text", F.lit("")).alias("worst_text"))
