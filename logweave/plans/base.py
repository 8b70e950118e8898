"""Shared building blocks of the registered queries: each is a lazily built DataFrame over
the driver's tables. Multi-use intermediates that feed eager steps (the split selection)
are checkpointed into the shared folder instead of being recomputed."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators import flows as FL
from logweave.operators import splits as SP
from logweave.operators.traces import line_index, line_index_of_short, trace_start
from logweave.session import cut_lineage
from logweave.sources.tables import conv_lines, trace_lines


def indexed_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Long form with the 0-based line index per trace (computed, not reused)."""
    return line_index(trace_lines(spark, sf))


def incidents(spark: SparkSession) -> DataFrame:
    return SP.typed_incidents(SP.incidents_frame(spark))


def truth_from(answers_df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Answers (with start and optional-line count) -> truth with incident phase."""
    if "start" not in answers_df.columns:
        starts = trace_start(trace_lines(spark, sf)).select("trace_id", "start")
        answers_df = answers_df.join(starts, "trace_id")
    t = answers_df.select(
        "trace_id", "flow", "start", (F.col("verdict") == "anomalous").cast("int").alias("label"),
        "anomaly_type", F.col("first_deviation_line").alias("first_deviation_index"), "n_optional")
    return SP.incident_phase(t, incidents(spark))


def input_state(spark: SparkSession, sf: str) -> tuple:
    """Name, size and time of every file of the tables read here: a changed input is another key."""
    from logweave.sources.files import _hadoop_fs

    state = []
    for t in ("events", "documents", "labels", "conversations", "orders"):
        fs, p = _hadoop_fs(spark, f"{sf}/{t}.parquet")
        if fs.exists(p):
            state += sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    return tuple(state)


_PREPARED: dict[tuple, dict[str, str]] = {}  # input -> folder of each prepared table built so far
_BY_TRACE: dict[tuple, tuple[str, str | None]] = {}  # input -> bucketed table, folder of hot traces
_BUILD = threading.RLock()
PREPARED_TABLES = ("indexed", "answers", "truth", "splits")
#: A trace with more lines than this is not put into a bucket.
HOT_TRACE = 1 << 16
BUCKET_ROWS = 1 << 20


def bucket_by_trace(indexed: DataFrame, root: str, hot_lines: int = HOT_TRACE, rows: int = BUCKET_ROWS) -> tuple[str, str | None]:
    """A second form of the lines for work that goes trace by trace: a table bucketed and sorted by trace, which
    aggregates and joins on the trace read without an exchange, and apart from it the lines of hot
    traces (a bucket is one task's work). Returns the table's name and the hot traces' folder, if any."""
    spark = indexed.sparkSession
    hot = indexed.where(F.col("idx") >= hot_lines).select("trace_id").distinct()
    hot_path = None
    if not hot.isEmpty():
        hot_path = f"{root}/hot"
        indexed.join(hot, "trace_id", "left_semi").write.mode("overwrite").parquet(hot_path)
        indexed = indexed.join(hot, "trace_id", "left_anti")
    n = _n_buckets(spark, indexed.count(), rows)
    return _buckets(indexed.repartition(n, "trace_id"), root, n), hot_path


def _n_buckets(spark: SparkSession, lines: int, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-lines // rows))


def _buckets(dealt: DataFrame, root: str, n: int) -> str:
    """Write lines already dealt into ``n`` partitions by trace as a table of as many buckets."""
    name = f"logweave_lines_{uuid.uuid4().hex[:12]}"
    (dealt.write.mode("overwrite").option("path", f"{root}/buckets")
     .bucketBy(n, "trace_id").sortBy("trace_id", "idx").saveAsTable(name))
    return name


def index_by_trace(lines: DataFrame, root: str, hot_lines: int = HOT_TRACE, rows: int = BUCKET_ROWS) -> tuple[str, str | None]:
    """``bucket_by_trace`` of ``line_index``, by one exchange: the one that deals the lines into buckets also
    brings a trace's lines together for their index. Hot traces are indexed by sampled split points."""
    spark = lines.sparkSession
    sizes = lines.groupBy("trace_id").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot_path = None
    if most > hot_lines:
        hot = cut_lineage(sizes.where(F.col("n") > hot_lines).select(F.col("trace_id").alias("_hot")), "hot-traces")
        is_hot = lines["trace_id"].eqNullSafe(hot["_hot"])
        hot_path = f"{root}/hot"
        line_index(lines.join(hot, is_hot, "left_semi")).write.mode("overwrite").parquet(hot_path)
        lines = lines.join(hot, is_hot, "left_anti")
    n = _n_buckets(spark, total, rows)
    return _buckets(line_index_of_short(lines.repartition(n, "trace_id")), root, n), hot_path


def per_trace(forms: tuple[str, str | None], spark: SparkSession, fn: Callable[[DataFrame], DataFrame],
              hot_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``fn``, which treats every trace by itself, on the bucketed lines and on those of hot traces
    (these by ``hot_fn``, if given)."""
    name, hot_path = forms
    out = fn(spark.table(name))
    return out if hot_path is None else out.unionByName((hot_fn or fn)(spark.read.parquet(hot_path)))


def _key(spark: SparkSession, sf: str) -> tuple:
    return spark.sparkContext.applicationId, sf, input_state(spark, sf)


def _forms(spark: SparkSession, sf: str) -> tuple[str, str | None]:
    """The indexed lines in buckets by trace, and the folder of hot traces."""
    from logweave.session import scratch_path

    key = _key(spark, sf)
    with _BUILD:
        if key not in _BY_TRACE:
            lines = trace_lines(spark, sf).drop("content")  # no reader of the index wants it
            _BY_TRACE[key] = index_by_trace(lines, scratch_path(spark, "by-trace"))
        return _BY_TRACE[key]


def by_trace(spark: SparkSession, sf: str, fn: Callable[[DataFrame], DataFrame],
             hot_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``per_trace`` over the prepared lines."""
    return per_trace(_forms(spark, sf), spark, fn, hot_fn)


def _prepared_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One prepared table, built when it is first read, with those that it is made from."""
    from logweave.session import scratch_path

    if name == "indexed":
        return by_trace(spark, sf, lambda lines: lines)
    with _BUILD:
        paths = _PREPARED.setdefault(_key(spark, sf), {})
        if name not in paths:
            if name == "answers":
                check = partial(FL.conformance, with_optional=True, cut_input=False)
                df = by_trace(spark, sf, partial(check, short=True), check)
            elif name == "truth":
                df = truth_from(_prepared_table(spark, sf, "answers"), spark, sf)
            else:
                df = SP.trace_splits(_prepared_table(spark, sf, "truth"), incidents(spark))
            path = scratch_path(spark, name)
            df.write.mode("overwrite").parquet(path)
            paths[name] = path
        return spark.read.parquet(paths[name])


def prepared(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The prepared tables of one input, built once per Spark application and reused by the
    later queries (like the reference's prepare-once, evaluate-many flow): the indexed long
    form, the conformance answers, per-trace truth with incident phase, and the splits. Each
    is a parquet table in the shared folder, so every reader starts from a cut lineage. A query
    that reads only some of them has only these built."""
    return {name: _prepared_table(spark, sf, name) for name in PREPARED_TABLES}


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared_table(spark, sf, "indexed")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared_table(spark, sf, "answers").drop("n_optional", "start")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Per trace: flow, start, label, type, deviation index, incident phase, optional lines."""
    return _prepared_table(spark, sf, "truth")


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared_table(spark, sf, "splits")


def lines_with_split(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).join(splits(spark, sf), "trace_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Truth of the test split (the labelled set)."""
    test = splits(spark, sf).where(F.col("split") == "test").select("trace_id")
    return truth(spark, sf).join(test, "trace_id")


def conv_text(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as trace texts, one row per ``role: text`` line and per marker."""
    from logweave.operators.traces import line_index_by_number, trace_text

    return trace_text(line_index_by_number(conv_lines(spark, sf)), value="line")


def conv_tokens(text: DataFrame, width: int = 4) -> DataFrame:
    """Fixed-width character tokens of each trace's text with a loss derived from the token text
    (a deterministic stand-in for a model's per-token loss). ``text``: rows of the text with
    their ``offset``. Tokens inside a row are cut in one regex pass and never shuffled; only the
    pieces of tokens that span rows are put together by token."""
    last = F.col("line") == T.TRACE_END
    row = F.when(last, F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    head = F.pmod(-F.col("offset"), F.lit(width)).cast("int")  # characters up to the next border
    cut = text.select("trace_id", "offset", row.alias("_row"), head.alias("_head"))
    cut = cut.withColumn("_tail", F.greatest(F.pmod(F.length("_row") - F.col("_head"), F.lit(width)), F.lit(0)))
    # tokens inside a row need no other row
    middle = F.substr("_row", F.col("_head") + 1, F.greatest(F.length("_row") - F.col("_head") - F.col("_tail"), F.lit(0)))
    inside = cut.select("trace_id", (F.col("offset") + F.col("_head")).alias("_at"),
                        F.posexplode(F.regexp_extract_all(middle, F.lit(f"(?s).{{{width}}}"), 0)).alias("_i", "span"))
    inside = inside.select("trace_id", (F.floor(F.col("_at") / width) + F.col("_i")).alias("tok"), "span")
    # pieces before a row's first border and after its last one: put together by token
    begin = F.struct(F.col("offset").alias("at"), F.substr("_row", F.lit(1), F.col("_head")).alias("piece"))
    at_tail = F.length("_row") - F.col("_tail")
    end = F.struct((F.col("offset") + at_tail).alias("at"), F.substr("_row", at_tail + 1, F.col("_tail")).alias("piece"))
    short = F.length("_row") <= F.col("_head")
    pieces = F.when(short, F.array(begin)).otherwise(F.array(begin, end))
    p = cut.select("trace_id", F.inline(pieces)).where(F.length("piece") > 0)
    g = p.groupBy("trace_id", F.floor(F.col("at") / width).alias("tok")).agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_p"))  # at most ``width`` pieces
    span = F.array_join(F.transform("_p", lambda x: x["piece"]), "")
    s = F.col("tok") * width
    t = inside.unionByName(g.select("trace_id", "tok", span.alias("span")))
    nll = F.pmod(F.ascii("span"), F.lit(13)) / 4.0 + 0.25 * F.length("span")
    return t.select("trace_id", F.col("tok").cast("int").alias("tok"), s.cast("long").alias("s"),
                    (s + F.length("span")).cast("long").alias("e"), "span", nll.cast("double").alias("nll"))


def roles(spark: SparkSession, sf: str) -> DataFrame:
    """Per trace of a split: the split, and its part in learning what conforming traces look like."""
    from logweave.operators.surprise import learning_role

    t = splits(spark, sf).join(truth(spark, sf).select("trace_id", "label"), "trace_id")
    normal = (F.col("label") == 0) & F.col("split").isin("train", "val")
    return t.select("trace_id", "split", learning_role(F.col("trace_id"), normal).alias("role"))


_MEMO: dict[tuple, object] = {}


def memo_table(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A derived table written once per application into the shared folder and read back by
    every later query (same pattern as ``prepared``)."""
    from logweave.session import scratch_path

    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), name)
    path = _MEMO.get(key)
    if path is None:
        path = scratch_path(spark, f"memo-{name}")
        build().write.mode("overwrite").parquet(path)
        _MEMO[key] = path
    return spark.read.parquet(path)


def memo_value(spark: SparkSession, sf: str, name: str, compute):
    """A small driver-side result (a threshold, a folder name) computed once per application."""
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), name)
    if key not in _MEMO:
        _MEMO[key] = compute()
    return _MEMO[key]


def clear(spark: SparkSession) -> None:
    """Forget the prepared and derived tables and delete all scratch of this application."""
    from logweave.session import clear_scratch

    for name, _ in _BY_TRACE.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _BY_TRACE.clear()
    _PREPARED.clear()
    _MEMO.clear()
    clear_scratch(spark)
