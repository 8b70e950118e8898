"""Bindings of the driver's parquet tables to the library's data model.

The driver ships no log files, so log lines, flows, incidents and detection records are
derived from its tables with deterministic expressions. ``logweave.plans.oracle_sql`` holds
the same definitions in plain SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import NO_CORR, content, template_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _level(event_type: Column) -> Column:
    return (F.when(event_type == "error", "ERROR")
            .when(event_type == "signup", "WARN")
            .otherwise("INFO"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application log line per event; a trace is one user on one day.

    Columns: line_no, ts, ts_text, level, service, trace_id, host, message, raw (v1 line),
    raw_prod (production-shaped line with host and correlation id; background lines have
    corrId ``-``), content, template.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    level = _level(F.col("event_type"))
    service = F.concat(F.col("event_type"), F.lit("-service"))
    trace_id = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"),
                        F.date_format("ts", "yyyyMMdd"))
    message = F.concat(F.col("event_type"), F.lit(" handled user="),
                       F.col("user_id").cast("string"), F.lit(" key="),
                       F.col("event_id").cast("string"))
    ts_text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    local_text = F.concat(
        F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        F.lit("+01:00"))
    host = F.concat(F.lit("host-"), F.pmod(F.col("user_id"), F.lit(4)).cast("string"))
    df = ev.select(
        F.col("event_id").alias("line_no"), "ts", ts_text.alias("ts_text"),
        level.alias("level"), service.alias("service"), trace_id.alias("trace_id"),
        host.alias("host"), message.alias("message"),
        F.when(F.col("value") < 1.0, F.lit(NO_CORR)).otherwise(trace_id).alias("corr_id"),
        local_text.alias("ts_local"))
    df = df.select(
        "*",
        F.concat_ws(" ", "ts_text", "level", "service",
                    F.concat(F.lit("trace="), F.col("trace_id")), "message").alias("raw"),
        F.concat_ws(" ", "ts_local", "level", "service",
                    F.concat(F.lit("host="), F.col("host")),
                    F.concat(F.lit("corrId="), F.col("corr_id")), "message").alias("raw_prod"),
        content(F.col("service"), F.col("level"), F.col("message")).alias("content"))
    return df.withColumn("template", template_of(F.col("content")))


#: Planted faults of the day logs, as SQL that Spark and DuckDB share: some lines are cut short, some are
#: blank, some have an impossible date.
BROKEN_SQL = ("CASE WHEN line_no % 97 = 3 THEN substr(raw, 1, 20) WHEN line_no % 101 = 5 THEN '' "
              "WHEN line_no % 103 = 7 THEN '2024-13-45T00:00:00.000Z' || substr(raw, 25) ELSE raw END")


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day logs with planted faults: day, line_no, value."""
    return log_lines(spark, sf_dir).select(F.date_format("ts", "yyyyMMdd").alias("day"), "line_no",
                                           F.expr(BROKEN_SQL).alias("value"))


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long working form: one row per line with its trace, order keys and template."""
    return log_lines(spark, sf_dir).select(
        "trace_id", "ts", "line_no", "level", "service", "content", "template")


#: Long statements of the order log: condition on an order (SQL that Spark and DuckDB share), level
#: and words. The first that holds is logged; ``{...}`` is an expression whose value is one token.
ORDER_STATEMENTS: list[tuple[str, str, str]] = [
    ("o_orderkey % 100 = 7", "INFO", "audit order x{o_orderkey} was opened by hand for a second check"),
    ("o_orderkey % 97 = 5 AND year(o_orderdate) >= 2000", "WARN",
     "refund of this order is kept back until desk k{o_custkey % 3} has signed"),
    ("o_orderkey % 4 = 0", "INFO", "accepted order for branch b{o_custkey % 40} and queued it for packing"),
    ("o_orderkey % 4 = 1", "INFO",
     "reserved goods of group g{o_custkey % 13} in hall h{o_orderkey % 17} for the next truck that leaves the main yard before noon"),
    ("o_orderkey % 4 = 2", "WARN",
     "open order with priority {replace(o_orderpriority, ' ', '_')} and status {o_orderstatus} was handed to clerk c{o_custkey % 9} "
     "who will call the customer again on the next working day before the bill is sent out"),
    ("o_custkey % 50 = 0", "WARN", "parcel lost"),
    ("true", "INFO", "parcel from depot d{o_custkey % 7} leaves via line l{o_orderkey % 11}"),
]
_ORDER_SERVICES = ["audit", "refund", "order", "stock", "bill", "ship", "ship"]


def order_text_sql(cast: str) -> str:
    """``service LEVEL message`` of an order as a SQL expression (``cast``: the string type's name)."""
    cases = []
    for (condition, level, message), service in zip(ORDER_STATEMENTS, _ORDER_SERVICES, strict=True):
        parts = re.split(r"{(.*?)}", f"{service}-service {level} {message}")
        shown = [f"CAST({p} AS {cast})" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p]
        cases.append(f"WHEN {condition} THEN {' || '.join(shown)}")
    return f"CASE {' '.join(cases)} END"


ORDER_SPLIT_SQL = "CASE WHEN year(o_orderdate) < 1999 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'val' ELSE 'test' END"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line of 4 to 31 tokens per order: line_no, ts, trace_id (the customer), split (by year), text."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").cast("long").alias("line_no"), F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("trace_id"),
        F.expr(ORDER_SPLIT_SQL).alias("split"), F.expr(order_text_sql("STRING")).alias("text"))


def conv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: trace = conversation, order = turn, line = ``role: text``."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("trace_id"),
                    F.col("turn").alias("line_no"), "role",
                    F.concat_ws(": ", "role", "text").alias("line"))


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection records over labelled documents.

    label = 1 - quality; anomaly_type = lang for label 1 else ``none``; score = n_chars;
    first_deviation_index = doc_id % 5. ``flagged``/``pred_index`` come from the keyword
    detector run over every line of the whole text.
    """
    from logweave.operators.detect import with_document_keywords

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    labs = table(spark, sf_dir, "labels").select("doc_id", "quality")
    base = with_document_keywords(docs.join(labs, "doc_id"))
    label = (F.lit(1) - F.col("quality")).cast("int")
    return base.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("trace_id"),
        "doc_id", label.alias("label"),
        F.when(label == 1, F.col("lang")).otherwise(F.lit("none")).alias("anomaly_type"),
        F.col("pred_index").isNotNull().alias("flagged"),
        F.col("n_chars").cast("double").alias("score"), "pred_index",
        F.pmod(F.col("doc_id"), F.lit(5)).cast("int").alias("first_deviation_index"),
        F.coalesce("worst_line_text", F.lit("")).alias("worst_line_text"))
