"""Data-quality checks. Each returns the violating rows: an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import KEYWORDS, MASKED_KEYS, V1_LINE_PATTERN, keyword_hit

#: A masked key with a value that is not the mask token.
UNMASKED = r"\b(" + "|".join(MASKED_KEYS) + r")=([^<\s]|<[^*])"


def dq_unparsed_lines(raw: DataFrame, pattern: str = V1_LINE_PATTERN) -> DataFrame:
    return raw.where(~F.col("value").rlike(pattern))


def dq_split_overlap(splits: DataFrame) -> DataFrame:
    return (splits.groupBy("trace_id").agg(F.count_distinct("split").alias("n_splits"))
            .where(F.col("n_splits") > 1))


def dq_label_counts(labels_with_split: DataFrame, expected: DataFrame) -> DataFrame:
    """Per split and type, actual vs declared counts; rows that differ."""
    actual = labels_with_split.groupBy("split", "anomaly_type").agg(F.count("*").alias("actual"))
    j = actual.join(expected, ["split", "anomaly_type"], "full")
    return j.where(~F.coalesce(F.col("actual"), F.lit(0)).eqNullSafe(
        F.coalesce(F.col("expected"), F.lit(0))))


def dq_dirty_train(lines_with_split: DataFrame, line: str = "template") -> DataFrame:
    """Lines of train or val that hold an error word."""
    return lines_with_split.where(F.col("split").isin("train", "val")
                                  & keyword_hit(F.col(line), KEYWORDS))


def dq_label_leak(raw: DataFrame, word: str = "anomal") -> DataFrame:
    return raw.where(F.lower(F.col("value")).contains(word))


def dq_mask_leak(lines: DataFrame, line: str = "template") -> DataFrame:
    """Lines in which a value of a masked key is still readable."""
    return lines.where(F.col(line).rlike(UNMASKED))


def dq_template_refs(refs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Referenced template ids missing from the dictionary."""
    return refs.join(dictionary.select(F.col("id").alias("template_id")), "template_id", "left_anti")


def dq_label_consistency(answers: DataFrame, heads: DataFrame) -> DataFrame:
    """An ERROR line iff visible_error; normal has a null index."""
    j = answers.join(heads.select("trace_id", "err_line"), "trace_id")
    bad = ((F.col("err_line").isNotNull() & (F.col("flow") != "unknown"))
           != (F.col("anomaly_type") == "visible_error"))
    bad = bad | ((F.col("anomaly_type") == "none") & F.col("first_deviation_line").isNotNull())
    return j.where(bad)


def dq_deviation_index(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """Labelled index differs from the index the conformance rule of its type gives."""
    j = labels.join(answers.select("trace_id", F.col("anomaly_type").alias("rule_type"),
                                   "first_deviation_line"), "trace_id")
    return j.where(~F.col("first_deviation_index").eqNullSafe(F.col("first_deviation_line"))
                   | (F.col("anomaly_type") != F.col("rule_type")))


def dq_storm_length(runs: DataFrame, answers: DataFrame, lo: int = 4, hi: int = 6) -> DataFrame:
    """Storm traces whose longest run of one step is outside [lo, hi]."""
    longest = runs.groupBy("trace_id").agg(F.max("length").alias("longest"))
    s = answers.where(F.col("anomaly_type") == "retry_storm").join(longest, "trace_id", "left")
    return s.where(~F.coalesce(F.col("longest"), F.lit(0)).between(lo, hi))


def dq_flow_scope(answers: DataFrame, allowed_flows: list[str]) -> DataFrame:
    return answers.where((F.col("verdict") == "anomalous") & ~F.col("flow").isin(allowed_flows))


def dq_known_services(lines: DataFrame, services: DataFrame) -> DataFrame:
    return lines.join(services, "service", "left_anti")


def dq_line_counts(sequences: DataFrame, lines: DataFrame) -> DataFrame:
    """Sequence length differs from the raw line count of the trace."""
    s = sequences.groupBy("trace_id").agg(F.count("*").alias("seq_lines"))
    r = lines.groupBy("trace_id").agg(F.count("*").alias("raw_lines"))
    j = s.join(r, "trace_id", "full")
    return j.where(~F.col("seq_lines").eqNullSafe(F.col("raw_lines")))


def dq_manifest(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose checksum differs from the manifest (or that only one side lists)."""
    j = actual.select("file", F.col("sha256").alias("actual")).join(
        manifest.select("file", F.col("sha256").alias("expected")), "file", "full")
    return j.where(~F.col("actual").eqNullSafe(F.col("expected")))
