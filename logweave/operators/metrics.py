"""Detection metrics over a detection DataFrame.

Input columns: ``label`` (0/1), ``anomaly_type``, ``flagged`` (bool), ``score`` (double, null
when the method has none), ``pred_index`` and ``first_deviation_index`` (nullable ints).

Every metric is one distributed aggregate. AUROC and the exact percentile need an ordered
pass; both first reduce to distinct scores, then use the chunked running total of
``logweave.operators.ranking`` so no single task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import round_half_up, null_format, safe_ratio
from logweave.operators.ranking import dealt, running_total
from logweave.session import cut_lineage

LOCALISATION_TOLERANCE = 1
HIST_BINS = 40
DIGITS = 9


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


def join_labels(detections: DataFrame, labels: DataFrame, key: str = "trace_id") -> DataFrame:
    """Attach label, anomaly_type and first_deviation_index to each detection by trace id; a
    detection without a label fails the job (naming the trace), like a missing dict key."""
    lab = labels.select(key, "label", "anomaly_type", "first_deviation_index",
                        F.lit(True).alias("_labelled"))
    j = detections.join(lab, key, "left")
    missing = F.concat(F.lit("no label for trace "), F.col(key))
    return j.withColumn("label", F.when(F.col("_labelled").isNull(), F.raise_error(missing))
                        .otherwise(F.col("label")).cast("int")).drop("_labelled")


def localisation_hit(pred: Column, truth: Column) -> Column:
    """abs(pred - truth) <= 1; a null on either side never hits."""
    return F.coalesce(F.abs(pred - truth) <= LOCALISATION_TOLERANCE, F.lit(False))


def confusion_matrix(det: DataFrame) -> DataFrame:
    pos, flg = F.col("label") == 1, F.col("flagged")
    return det.agg(F.count_if(pos & flg).alias("tp"), F.count_if(pos & ~flg).alias("fn"),
                   F.count_if(~pos & flg).alias("fp"), F.count_if(~pos & ~flg).alias("tn"))


def classification_metrics(det: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, F1 (null if P or R is null, 0.0 if both are 0), FPR, and
    the localisation rate among true positives; per group of ``by`` (e.g. run id) if given."""
    by = list(by or [])
    pos, flg = F.col("label") == 1, F.col("flagged")
    hit = localisation_hit(F.col("pred_index"), F.col("first_deviation_index"))
    c = det.groupBy(*by).agg(
        F.count("*").alias("n_traces"),
        F.count_if(pos & flg).alias("tp"), F.count_if(pos & ~flg).alias("fn"),
        F.count_if(~pos & flg).alias("fp"), F.count_if(~pos & ~flg).alias("tn"),
        F.count_if(pos & flg & hit).alias("localisation_hits"))
    p = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.select("*", p.alias("precision"), r.alias("recall"))
    f1 = (F.when(F.col("precision").isNull() | F.col("recall").isNull(), F.lit(None))
          .when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
          .otherwise(F.lit(0.0)))
    return c.select(
        *by, "n_traces", (F.col("fp") + F.col("tn")).alias("n_normal"),
        (F.col("tp") + F.col("fn")).alias("n_anomalous"), "tp", "fp", "fn", "tn",
        _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"),
        _r(f1.cast("double")).alias("f1"),
        _r(safe_ratio(F.col("fp"), F.col("fp") + F.col("tn"))).alias("false_positive_rate"),
        _r(safe_ratio(F.col("localisation_hits"), F.col("tp"))).alias("localisation_hit_rate"),
        "localisation_hits", F.col("tp").alias("localisation_n"))


def recall_per_type(det: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per anomaly type that occurs with label 1: n over all records of the type, flagged,
    recall. Ordered by type."""
    by = list(by or [])
    g = det.groupBy(*by, "anomaly_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("flagged")).alias("flagged"),
        F.max("label").alias("_maxl"))
    return (g.where(F.col("_maxl") == 1)
            .select(*by, "anomaly_type", "n", "flagged",
                    _r(F.col("flagged") / F.col("n")).alias("recall"))
            .orderBy(*by, "anomaly_type"))


def recall_per_type_map(det: DataFrame) -> DataFrame:
    """The same as one ``MAP<type, STRUCT<n, flagged, recall>>`` value."""
    r = recall_per_type(det)
    return r.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "anomaly_type", F.struct("n", "flagged", "recall"))))).alias("recall_per_type"))


def auroc(det: DataFrame, score: str = "score", label: str = "label",
          by: list[str] | None = None) -> DataFrame:
    """Rank AUROC with average ranks for ties (Mann-Whitney U / (P*N)).

    Null when a class is missing or when any record has no score. Records are reduced to
    distinct scores first (the null score is one group); the count of negatives below each
    score is a chunked running total; one final aggregate gives U, P, N and the null count.
    """
    by = list(by or [])
    d = det.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"),
        F.count("*").alias("n_all"))
    d, chunk = dealt(cut_lineage(d, "scores"), by, [F.col(score)])
    d = running_total(d, by, [F.col(score)], chunk,
                      {"neg_below": F.when(F.col(score).isNotNull(), F.col("n_neg")).otherwise(0)},
                      inclusive=False)
    scored = F.col(score).isNotNull()
    a = d.groupBy(*by).agg(
        F.sum(F.when(scored, F.col("n_pos") * (F.col("neg_below") + F.col("n_neg") * 0.5)))
        .alias("U"),
        F.sum("n_pos").alias("n_p"), F.sum("n_neg").alias("n_n"), F.sum("n_all").alias("n_total"),
        F.sum(F.when(~scored, F.col("n_all")).otherwise(0)).alias("n_unscored"))
    ok = ((F.col("n_total") > 0) & (F.col("n_unscored") == 0) & (F.col("n_p") > 0)
          & (F.col("n_n") > 0))
    return a.select(*by, _r(F.when(ok, F.col("U") / (F.col("n_p") * F.col("n_n")))).alias("auroc"))


def exact_percentile(df: DataFrame, value: str, pct: float) -> float | None:
    """p-th percentile with linear interpolation (numpy's default), computed distributed:
    distinct values, chunked cumulative counts, then only the (at most two) rows around
    the interpolation position come back to the driver."""
    vals = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("cnt")), "values")
    n = vals.agg(F.sum("cnt")).first()[0]
    if not n:
        return None
    h = (n - 1) * pct / 100.0
    lo, hi = int(h // 1), int(-(-h // 1))
    vals, chunk = dealt(vals, [], [F.col(value)])
    cum = running_total(vals, [], [F.col(value)], chunk, {"cum": F.col("cnt")})
    start = F.col("cum") - F.col("cnt")
    rows = cum.where((start <= F.lit(hi)) & (F.col("cum") > F.lit(lo))).select(
        F.col(value).alias("_v"), start.alias("_start"), F.col("cum").alias("_cum")).collect()

    def at(p: int) -> float:
        return next(float(r["_v"]) for r in rows if r["_start"] <= p < r["_cum"])

    vlo, vhi = at(lo), at(hi)
    return vlo + (h - lo) * (vhi - vlo)


def percentile_threshold(spark: SparkSession, df: DataFrame, value: str,
                         pct: float = 99.0) -> DataFrame:
    t = exact_percentile(df, value, pct)
    return spark.range(1).select(F.round(F.lit(t).cast("double"), DIGITS).alias("threshold"))


def threshold_flag(det: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """flagged = score strictly greater than the threshold."""
    t = F.lit(threshold).cast("double")
    return det.withColumn("flagged", F.coalesce(F.col(score) > t, F.lit(False)))


def score_histogram(det: DataFrame, score: str = "score", bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins per class over that class's own min..max; the max lands in the last bin."""
    s = det.where(F.col(score).isNotNull())
    rng = s.groupBy("label").agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    # at most two rows (one per class): a fixed size
    j = s.join(F.broadcast(rng), "label")
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(score) - F.col("lo")) / width * bins) + 1, F.lit(bins)))
    return (j.groupBy("label", b.cast("long").alias("bucket"))
            .agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")))


def report_table(det: DataFrame) -> DataFrame:
    """Tall metric/value rows (values formatted like the report: 3 decimals or n/a), then one
    row per anomaly type."""
    m = classification_metrics(det).join(auroc(det), how="inner", on=F.lit(True))
    traces = F.format_string("%d (%d normal, %d anomalous)", "n_traces", "n_normal", "n_anomalous")
    loc = F.concat(null_format(F.col("localisation_hit_rate")), F.lit(" ("),
                   F.col("localisation_hits").cast("string"), F.lit(" of "),
                   F.col("localisation_n").cast("string"), F.lit(")"))
    rows = [(1, "traces", traces), (2, "precision", null_format(F.col("precision"))),
            (3, "recall", null_format(F.col("recall"))), (4, "F1", null_format(F.col("f1"))),
            (5, "false positive rate", null_format(F.col("false_positive_rate"))),
            (6, "AUROC", null_format(F.col("auroc"))), (7, "localisation hit rate", loc)]
    head = m.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("pos"), F.lit(k).alias("metric"), v.alias("value"))
        for p, k, v in rows])))
    types = recall_per_type(det).select(
        F.lit(100).alias("pos"), F.concat(F.lit("recall "), F.col("anomaly_type")).alias("metric"),
        F.format_string("%d of %d (%.3f)", "flagged", "n", round_half_up(F.col("recall"), 3)).alias("value"))
    return head.unionByName(types)


# ---- costs ---------------------------------------------------------------------------------

def llm_cost_per_1000(tokens_in: Column, tokens_out: Column, n: Column,
                      price_in: Column, price_out: Column) -> Column:
    """(in/1e6*pin + out/1e6*pout)/n*1000; null if a price is null or n <= 0."""
    total = tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
    return F.when(price_in.isNull() | price_out.isNull() | (n <= 0), F.lit(None)).otherwise(
        total / n * 1000).cast("double")


def gpu_cost_per_1000(seconds: Column, n: Column, rate: Column) -> Column:
    return F.when(rate.isNull() | (n <= 0), F.lit(None)).otherwise(
        seconds / 3600.0 * rate / n * 1000).cast("double")


def training_cost(seconds: Column, rate: Column) -> Column:
    return F.when(rate.isNull(), F.lit(None)).otherwise(seconds / 3600.0 * rate).cast("double")
