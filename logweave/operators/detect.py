"""Line-rule detectors: keyword search and the ERROR-level rule.

On the long form both are one partial + final aggregate per trace (map-side combine), so a
hot trace is reduced in every task before the shuffle. For documents the lines live inside
one row, so the search is a row-local array expression with no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import KEYWORDS, keyword_hit

DOC_KEYWORDS = "license|token|@"


def keyword_match(indexed: DataFrame, line: str = "template", key: str = "trace_id",
                  pattern: str = KEYWORDS) -> DataFrame:
    """Per trace: first 0-based line matching the keywords (case-insensitive), flagged, text."""
    hit = keyword_hit(F.col(line), pattern)
    g = indexed.groupBy(key).agg(
        F.min(F.when(hit, F.col("idx"))).alias("pred_index"),
        F.min_by(F.col(line), F.when(hit, F.col("idx"))).alias("_txt"))
    return g.select(key, "pred_index", F.col("pred_index").isNotNull().alias("flagged"),
                    F.coalesce("_txt", F.lit("")).alias("worst_line_text"))


def error_level_match(indexed: DataFrame, line: str = "template",
                      key: str = "trace_id") -> DataFrame:
    """First line whose numbered form ``i: line`` contains `` ERROR `` -> anomalous,
    visible_error and that line; else normal, none, null."""
    numbered = F.concat(F.col("idx").cast("string"), F.lit(": "), F.col(line))
    g = indexed.groupBy(key).agg(
        F.min(F.when(numbered.contains(" ERROR "), F.col("idx"))).alias("first_deviation_line"))
    bad = F.col("first_deviation_line").isNotNull()
    return g.select(
        key,
        F.when(bad, "anomalous").otherwise("normal").alias("verdict"),
        F.when(bad, "visible_error").otherwise("none").alias("anomaly_type"),
        "first_deviation_line")


def with_document_keywords(docs: DataFrame, text: str = "text",
                           pattern: str = DOC_KEYWORDS) -> DataFrame:
    """Add ``pred_index`` / ``worst_line_text``: the first line of the whole text matching the
    keywords. Row-local (no shuffle); the line array and the match position are computed once
    per row in their own projection, then reused."""
    d = docs.withColumn("_lines", F.split(F.col(text), "\n"))
    d = d.withColumn("_pos", F.array_position(
        F.transform("_lines", lambda x: keyword_hit(x, pattern)), F.lit(True)))
    p = F.col("_pos")
    return d.select(*docs.columns, F.when(p > 0, (p - 1).cast("int")).alias("pred_index"),
                    F.when(p > 0, F.element_at("_lines", p.cast("int"))).alias("worst_line_text"))


def document_keywords(docs: DataFrame, text: str = "text", key: str = "trace_id",
                      pattern: str = DOC_KEYWORDS) -> DataFrame:
    """Keyword search over every line of whole documents (row-local, no shuffle)."""
    return with_document_keywords(docs, text, pattern).select(key, "pred_index", "worst_line_text")
