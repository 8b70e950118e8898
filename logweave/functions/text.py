"""Column functions over log text. All of them are built-in Spark expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Line shapes: v1 "ts level service trace=id message", production "ts level service host=h corrId=id message".
V1_LINE_PATTERN = r"^(\S+) (\w+) (\S+) trace=(\S+) (.*)$"
PROD_LINE_PATTERN = r"^(\S+) (\w+) (\S+) host=(\S+) corrId=(\S+) (.*)$"
# Correlation id of background lines (no business flow).
NO_CORR = "-"
# Keys whose values are masked (first policy): 8 keys of the first dataset, then 23 of the
# production-shaped dataset.
MASKED_KEYS = [
    "order_id", "refund_id", "user", "client", "items", "amount", "currency", "key",
    "application_id", "customer_segment", "customer_id", "risk_class", "property_id", "provider",
    "value_dkk", "latency_ms", "score", "loan_type", "principal_dkk", "doc_id", "loan_id",
    "due_date", "mandate_id", "amount_dkk", "posting_id", "channel", "target_product", "series",
    "price", "cost_dkk", "quote_id",
]
MASK_TOKEN = "<*>"
# Keyword rule of the baseline detector, case-insensitive, anywhere in the line.
KEYWORDS = "ERROR|FATAL|exception|timeout"
TRACE_START = "TRACE START"
TRACE_END = "TRACE END"
# Anomaly types of the answer contract, in contract order.
ANOMALY_TYPES = ["none", "visible_error", "silent_skip", "wrong_order", "truncated", "retry_storm"]
VERDICTS = ["normal", "anomalous"]
# ---------------------------------------------------------------------------------------------


def keyed_mask_pattern(keys: list[str] = MASKED_KEYS) -> str:
    """One regex for all keys: ``\\b(k1|k2|...)=\\S+``; replacement keeps the key."""
    return r"\b(" + "|".join(keys) + r")=\S+"


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def mask_keys(c: Column, keys: list[str] = MASKED_KEYS) -> Column:
    """Replace the value of each listed ``key=value`` pair with ``<*>`` (one pass)."""
    return F.regexp_replace(c, keyed_mask_pattern(keys), "$1=" + MASK_TOKEN)


def mask_all_values(c: Column) -> Column:
    """Second masking policy: every ``=value`` becomes ``=<*>``."""
    return F.regexp_replace(c, r"=\S+", "=" + MASK_TOKEN)


def content(service: Column, level: Column, message: Column) -> Column:
    """``service LEVEL message``: drops timestamp, host and trace id."""
    return F.concat_ws(" ", service, level, message)


def template_of(content_col: Column, policy: str = "keys") -> Column:
    masked = mask_keys(content_col) if policy == "keys" else mask_all_values(content_col)
    return collapse_ws(masked)


def _parsed(value: Column, pattern: str, names: list[str]) -> Column:
    """The groups of one match as a struct (``parsed`` and the names): the pattern runs once,
    rewriting a matching line to its groups with a separator that no line can hold."""
    mark = "\u0000"
    joined = F.regexp_replace(value, pattern, mark + mark.join(f"${i + 1}" for i in range(len(names))))
    parts = F.split(joined, mark)
    hit = F.size(parts) == len(names) + 1
    return F.struct(hit.alias("parsed"), *[
        F.when(hit, parts[i + 1]).otherwise("").alias(n) for i, n in enumerate(names)])


def parse_v1(value: Column) -> Column:
    """Struct of a v1 line: parsed, ts_text, level, service, trace_id, message."""
    return _parsed(value, V1_LINE_PATTERN, ["ts_text", "level", "service", "trace_id", "message"])


def parse_prod(value: Column) -> Column:
    """Struct of a production line: the v1 fields and host."""
    return _parsed(value, PROD_LINE_PATTERN,
                   ["ts_text", "level", "service", "host", "trace_id", "message"])


def keyword_hit(c: Column, pattern: str = KEYWORDS) -> Column:
    return c.rlike("(?i)(" + pattern + ")")


def numbered_line(idx: Column, line: Column) -> Column:
    """``idx: line``."""
    return F.concat(idx.cast("string"), F.lit(": "), line)


def ts_format(ts: Column, zone_suffix: str = "Z") -> Column:
    """ISO text with truncated milliseconds; ``Z`` or a fixed ``+hh:mm`` suffix."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(zone_suffix))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 (plain ``/`` raises under ANSI mode)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same double in every engine, never a printing tie."""
    scale = 10 ** digits
    return F.floor(x * scale + 0.5) / scale


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_half_up(x, digits))


def null_format(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull(), F.lit("n/a")).otherwise(fixed(x, digits))

