"""Incident windows, leak-free splits and the labelled (test) selection.

Random shuffles of the reference are replaced by a hash order (md5 of seed and trace id):
the same sizes and strata, other members, and reproducible on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.session import cut_lineage

SEED = "0"

# Incident windows over the event log (our own fixed values; event time runs through January
# 2024). Text has a +01:00 offset like production extracts.
INCIDENTS = [
    ("inc-1", "sign-up service degraded", "onboarding",
     "2024-01-08T01:00:00+01:00", "2024-01-09T01:00:00+01:00", "2024-01-10T13:00:00+01:00"),
    ("inc-2", "checkout slowdown", "browse_buy",
     "2024-01-20T07:00:00+01:00", "2024-01-21T01:00:00+01:00", "2024-01-21T19:00:00+01:00"),
]
# Labelled-set selection (sizes of the production-like extract: 30 anomalous, 50 normal, of
# which up to 4 hard negatives).
SELECTION = {"anomalous": 30, "anomalous_quota": {"inc-1": 8, "inc-2": 8, "background": 6},
             "normal": 50, "hard_negatives": 4}
VAL_SHARE = 0.1
SALTS = 64
PREFIX_CHARS = 3  # of the hash: at most 4,096 counts


def parse_offset_ts(c: Column) -> Column:
    """ISO text with ``Z`` or ``+hh:mm`` -> TIMESTAMP_NTZ in UTC (zone-free arithmetic)."""
    pat = r"^(.*?)(Z|[+-]\d\d:\d\d)$"
    local = F.to_timestamp_ntz(F.regexp_extract(c, pat, 1))
    off = F.regexp_extract(c, pat, 2)
    mins = F.when(off == "Z", F.lit(0)).otherwise(
        (F.substring(off, 2, 2).cast("int") * 60 + F.substring(off, 5, 2).cast("int"))
        * F.when(F.substring(off, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1)))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), mins, F.lit(0))


def hash_key(trace_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), trace_id))


def incidents_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, t, f, a, s, e, n) for n, (i, t, f, a, s, e) in enumerate(INCIDENTS)],
        "id string, title string, flow string, precursor_start string, start string, "
        "end string, list_pos int")


def typed_incidents(raw: DataFrame) -> DataFrame:
    """Offset timestamp text -> TIMESTAMP_NTZ (UTC)."""
    return raw.select("id", "title", "flow",
                      *[parse_offset_ts(F.col(c)).alias(c) for c in ("precursor_start", "start", "end")],
                      *(["list_pos"] if "list_pos" in raw.columns else []))


def window_days(incidents: DataFrame) -> DataFrame:
    """One row per incident and day that its window touches (column ``_day``)."""
    return incidents.withColumn("_day", F.explode(F.sequence(
        F.to_date("precursor_start"), F.to_date("end"))))


def range_anti_incident(traces: DataFrame, incidents: DataFrame) -> DataFrame:
    """Traces whose start is outside every incident's [precursor_start, end] (both inclusive),
    whatever the incident's flow. An equi-join on the day with the range as a further condition,
    so an incident list of any length needs neither a nested loop nor a forced broadcast."""
    inc = window_days(incidents).select("_day", F.col("precursor_start").alias("_ps"), F.col("end").alias("_e"))
    start = F.col("start")
    cond = (F.to_date(start) == F.col("_day")) & (start >= F.col("_ps")) & (start <= F.col("_e"))
    return traces.join(inc, cond, "left_anti")


def incident_phase(traces: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per trace (flow equal): ``incident`` if start <= t <= end, else ``precursor`` if
    precursor_start <= t < start, else ``background``; first matching incident in list order.
    Only traces inside a window are grouped; they join back by trace id."""
    inc = window_days(incidents).select(
        F.col("id").alias("_id"), F.col("flow").alias("_f"), "list_pos", "_day",
        F.col("precursor_start").alias("_ps"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    t = F.col("start")
    cond = (F.col("flow") == F.col("_f")) & (F.to_date(t) == F.col("_day")) & (t >= F.col("_ps")) & (t <= F.col("_e"))
    phase = F.when(t >= F.col("_s"), "incident").otherwise("precursor")
    hit = traces.select("trace_id", "flow", "start").join(inc, cond).groupBy("trace_id").agg(
        F.min_by(F.struct(F.col("_id").alias("incident_id"), phase.alias("phase")), "list_pos").alias("_b"))
    return traces.join(hit, "trace_id", "left").select(
        *traces.columns, F.col("_b.incident_id").alias("incident_id"),
        F.coalesce("_b.phase", F.lit("background")).alias("phase"))


def incident_summary(phased: DataFrame) -> DataFrame:
    """Anomalous traces per incident and phase."""
    return phased.groupBy("incident_id", "phase").agg(
        F.count("*").alias("n_traces"), F.sum("label").cast("long").alias("n_anomalous"))


def _top_per_group(df: DataFrame, group: str, k_col: str, limit: int, out: str = "rn") -> DataFrame:
    """Rows with the ``limit`` smallest ``k_col`` per group, exact and skew-safe: top-k inside
    (group, salt) first, then among the survivors (at most SALTS * limit rows per group)."""
    salt = F.pmod(F.xxhash64(k_col), F.lit(SALTS))
    w1 = W.partitionBy(group, "_salt").orderBy(k_col)
    pre = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
           .where(F.col("_r1") <= limit).drop("_salt", "_r1"))
    w2 = W.partitionBy(group).orderBy(k_col)
    return pre.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= limit)


def stratified_quota(anomalous: DataFrame, quotas: dict[str, int], total: int) -> DataFrame:
    """Per stratum (incident id in phase incident, else ``background``) take its quota in hash
    order, then fill to ``total`` from the rest in hash order."""
    stratum = F.when(F.col("phase") == "incident", F.col("incident_id")).otherwise("background")
    a = anomalous.withColumn("stratum", stratum).withColumn("_h", hash_key(F.col("trace_id")))
    quota = F.coalesce(F.element_at(F.create_map(*[x for k, v in quotas.items()
                                                   for x in (F.lit(k), F.lit(v))]),
                                    F.col("stratum")), F.lit(0))
    first = _top_per_group(a, "stratum", "_h", max(quotas.values(), default=0))
    first = cut_lineage(first.where(F.col("rn") <= quota).drop("rn"), "quota")  # a few rows, read three times
    rest = a.join(first.select("trace_id"), "trace_id", "left_anti")
    n_fill = max(total - first.count(), 0)  # a short stratum leaves more to fill
    fill = rest.orderBy("_h").limit(n_fill)  # distributed top-k (TakeOrderedAndProject)
    return first.unionByName(fill).drop("_h")


def hard_negatives(normal: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` normal traces in phase precursor holding an optional (harmless) line."""
    c = normal.where((F.col("phase") == "precursor") & (F.col("n_optional") > 0))
    return c.withColumn("_h", hash_key(F.col("trace_id"))).orderBy("_h").limit(n).drop("_h")


def round_robin_fill(normal: DataFrame, n: int) -> DataFrame:
    """Take one trace per flow in turn (flows sorted, empty flows skipped) until ``n``."""
    h = normal.withColumn("_h", hash_key(F.col("trace_id")))
    top = _top_per_group(h, "flow", "_h", n, out="turn")
    return top.orderBy("turn", "flow").limit(n).drop("_h")


def select_labelled(truth: DataFrame, spec: dict = SELECTION) -> DataFrame:
    """The labelled test set: stratified anomalous quota, hard negatives, round-robin normals.
    ``truth`` holds trace_id, flow, start, label, phase, incident_id, n_optional."""
    known = truth.where(F.col("flow") != "unknown")
    anomalous = stratified_quota(known.where(F.col("label") == 1), spec["anomalous_quota"],
                                 spec["anomalous"])
    normal = known.where(F.col("label") == 0)
    hard = cut_lineage(hard_negatives(normal, spec["hard_negatives"]), "hard-negatives")
    rest = normal.join(hard.select("trace_id"), "trace_id", "left_anti")
    fill = round_robin_fill(rest, max(spec["normal"] - hard.count(), 0))
    cols = truth.columns
    return (anomalous.select(*cols).unionByName(hard.select(*cols))
            .unionByName(fill.select(*cols)))


def split_train_val(pool: DataFrame, val_share: float = VAL_SHARE, seed: str = SEED) -> DataFrame:
    """Pool in hash order; the first ``bround(n * share)`` go to val, the rest to train.
    Traces are counted by hash prefix, and only those of the prefix at the border are sorted. A trace
    without an id counts (first), but is in no split."""
    h = pool.select("trace_id", hash_key(F.col("trace_id"), seed).alias("_h"))
    prefix = F.substring("_h", 1, PREFIX_CHARS)
    sizes = {r["p"]: r["n"] for r in h.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
    left = round(sum(sizes.values()) * val_share)  # half to even, like Python's round in the reference
    left -= sizes.pop(None, 0)
    border = ""  # the largest hash of val
    for p in sorted(sizes):
        if 0 < left <= sizes[p]:
            border = h.where(prefix == p).orderBy("_h").offset(left - 1).first()["_h"]
        left -= sizes[p]
    return h.where(F.col("_h").isNotNull()).select(
        "trace_id", F.when(F.col("_h") <= border, "val").otherwise("train").alias("split"))


def trace_splits(truth: DataFrame, incidents: DataFrame, spec: dict = SELECTION) -> DataFrame:
    """trace_id -> split: test = labelled selection; train/val from the pool of traces that
    are neither labelled nor started inside an incident window."""
    test = cut_lineage(select_labelled(truth, spec).select("trace_id", F.lit("test").alias("split")), "test-split")
    pool = truth.select("trace_id", "start").join(test, "trace_id", "left_anti")
    pool = range_anti_incident(pool, incidents)
    return test.unionByName(split_train_val(pool))


def split_membership(lines: DataFrame, splits: DataFrame) -> DataFrame:
    return lines.join(splits, "trace_id")


def split_overlap(splits: DataFrame) -> DataFrame:
    """Trace ids found in more than one split (empty = disjoint)."""
    return (splits.groupBy("trace_id").agg(F.count_distinct("split").alias("n_splits"))
            .where(F.col("n_splits") > 1))


def split_summary(lines_with_split: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per split: traces, normal, anomalous, lines."""
    per_trace = lines_with_split.groupBy("split", "trace_id").agg(F.count("*").alias("n"))
    if labels is not None:
        per_trace = per_trace.join(labels.select("trace_id", "label"), "trace_id", "left")
    else:
        per_trace = per_trace.withColumn("label", F.lit(None).cast("int"))
    return per_trace.groupBy("split").agg(
        F.count("*").alias("traces"), F.count_if(F.col("label") == 0).alias("normal"),
        F.count_if(F.col("label") == 1).alias("anomalous"), F.sum("n").alias("lines"))

