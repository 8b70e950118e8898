"""Trace assembly on the long form ``(trace_id, ts, line_no, ...)``.

The long form is the working format: one row per line, keyed by ``(trace_id, idx)``. Sequences,
texts, numbers and offsets per trace are rows too, so no row or task ever holds an
unbounded trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators.ranking import rank_ordered, rank_within, running_total

INDEX_CHUNK = 4096


def line_index(lines: DataFrame, key: str = "trace_id", ts: str = "ts",
               line_no: str = "line_no") -> DataFrame:
    """Add ``idx``: 0-based position of a line in its trace, ordered by (ts, line_no).

    A trace of more than ``CHUNK_ROWS`` lines is dealt by sampled split points of its order,
    so billions of lines within one second are spread over many tasks.
    """
    out = rank_ordered(lines, [key], [F.col(ts), F.col(line_no)], out="idx")
    return out.withColumn("idx", F.col("idx") - 1)


def line_index_of_short(lines: DataFrame, key: str = "trace_id", ts: str = "ts", line_no: str = "line_no") -> DataFrame:
    """``line_index`` of lines none of whose traces is hot: one window, on the lines as they are dealt by trace."""
    out = rank_within(lines, [key], [F.col(ts), F.col(line_no)], None, out="idx")
    return out.withColumn("idx", F.col("idx") - 1)


def line_index_by_number(lines: DataFrame, key: str = "trace_id",
                         order: str = "line_no") -> DataFrame:
    """``idx`` for traces ordered by an integer column (e.g. conversation turn)."""
    chunk = F.floor(F.col(order) / INDEX_CHUNK)
    out = rank_within(lines, [key], [F.col(order)], chunk, out="idx")
    return out.withColumn("idx", F.col("idx") - 1)


def trace_start(lines: DataFrame, key: str = "trace_id", ts: str = "ts") -> DataFrame:
    """Timestamp of the first line of each trace (partial + final aggregate)."""
    return lines.groupBy(key).agg(F.min(ts).alias("start"), F.count("*").alias("n_lines"))


def group_traces(indexed: DataFrame, value: str = "template", key: str = "trace_id") -> DataFrame:
    """Ordered sequences per trace in long form: ``(trace_id, idx, n_lines, line)``.

    The order is the column ``idx``; a trace of any length stays spread over rows and tasks."""
    sizes = indexed.groupBy(key).agg(F.count("*").alias("n_lines"))
    return (indexed.select(key, "idx", F.col(value).alias("line")).join(sizes, key)
            .select(key, "idx", "n_lines", "line"))


def trace_text(indexed: DataFrame, value: str = "template", key: str = "trace_id") -> DataFrame:
    """The trace's text, one row per line: the start marker at ``idx`` -1, the end marker one
    past the last line. Rows in order, joined by line breaks, are the whole text."""
    sizes = indexed.groupBy(key).agg(F.count("*").alias("_n"))
    marks = sizes.select(key, F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("idx"), F.lit(T.TRACE_START).alias("line")),
        F.struct(F.col("_n").cast("long").alias("idx"), F.lit(T.TRACE_END).alias("line")))))
    return indexed.select(key, F.col("idx").cast("long").alias("idx"),
                          F.col(value).alias("line")).unionByName(marks)


def line_offsets(text: DataFrame, key: str = "trace_id") -> DataFrame:
    """``(trace_id, idx, line, offset)``: the character at which each row of ``trace_text``
    begins. A running total in chunks of ``INDEX_CHUNK`` lines, so cost is linear and a hot
    trace is split."""
    chunk = F.floor(F.col("idx") / INDEX_CHUNK)
    size = (F.length("line") + 1).cast("long")
    return running_total(text, [key], [F.col("idx")], chunk, {"offset": size}, inclusive=False)


def adjacent_pairs(lines: DataFrame, file_col: str | None, line_no: str = "line_no",
                   cols: tuple[str, ...] = ("trace_id", "ts")) -> DataFrame:
    """Each line joined to the line right after it in the same file (equi-join on line_no+1,
    so no file or day is funnelled through one task)."""
    keys = [file_col] if file_col else []
    a = lines.select(*keys, F.col(line_no).alias("_n"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = lines.select(*keys, (F.col(line_no) - 1).alias("_n"),
                     *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, [*keys, "_n"])


def trace_interleaving(lines: DataFrame, file_col: str | None = None) -> DataFrame:
    """Adjacent line pairs in the file and how many of them switch trace."""
    p = adjacent_pairs(lines, file_col, cols=("trace_id",))
    return p.agg(F.count("*").alias("n_pairs"),
                 F.count_if(F.col("a_trace_id") != F.col("b_trace_id")).alias("n_switches"))


def order_violations(lines: DataFrame, file_col: str | None = None) -> DataFrame:
    """Lines whose timestamp is lower than the previous line's in the file."""
    p = adjacent_pairs(lines, file_col, cols=("ts", "line_no"))
    return p.where(F.col("b_ts") < F.col("a_ts")).select(
        F.col("b_line_no").alias("line_no"), F.col("b_ts").alias("ts"),
        F.col("a_ts").alias("prev_ts"))


def first_deviation(actual: DataFrame, expected: DataFrame, key: str = "trace_id") -> DataFrame:
    """First index where two step sequences of one trace differ; ``min(len)`` when one is a
    prefix of the other. Inputs are long form ``(trace_id, idx, step)``."""
    a = actual.select(key, "idx", F.col("step").alias("a"))
    e = expected.select(key, "idx", F.col("step").alias("e"))
    j = a.join(e, [key, "idx"], "full")
    return j.groupBy(key).agg(
        F.coalesce(
            F.min(F.when(~F.col("a").eqNullSafe(F.col("e")) & F.col("a").isNotNull()
                         & F.col("e").isNotNull(), F.col("idx"))),
            F.least(F.count("a"), F.count("e")).cast("long")).alias("first_deviation"),
        F.count("a").alias("n_actual"), F.count("e").alias("n_expected"))
