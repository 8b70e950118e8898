"""Incremental prepare: after new, changed or lost log files, only what they touch is prepared again.

A prepared store holds, partitioned by the day on which a trace starts,

* ``lines``: the indexed long form (trace_id, idx, ts, file, line_no, level, service, template),
* ``templates``: per day the count of each template,
* ``contexts``: per day the context counts of the surprise model,

and ``manifest``: the digest of every file it was made from. ``update`` compares the files with the
manifest. Traces with a line in a file that differs are *touched*; the days on which they start,
before and after, are read back, their traces indexed again, and exactly these partitions
overwritten (dynamic partition overwrite). Dictionary and model are sums over the days, so untouched
days are neither read nor written.

The manifest is swapped in last: an update that dies on the way leaves the old one, and the next run
does the same work again; rows of a differing file are always dropped before its lines are added, so
nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import template_of
from logweave.operators.surprise import context_model, histories
from logweave.operators.traces import line_index
from logweave.session import cut_lineage
from logweave.sinks.writers import atomic_write
from logweave.sources import files as FS
from logweave.sources.digests import file_digests

LINES = "trace_id string, idx long, ts timestamp, file string, line_no long, level string, service string, template string, day string"
TEMPLATES = "template string, count long, day string"
CONTEXTS = "k int, context string, next string, n long, day string"
MANIFEST = "file string, sha256 string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not FS.path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _overwrite_days(spark: SparkSession, rows: DataFrame, path: str, days: list[str]) -> None:
    """Replace the partitions ``days`` by ``rows``; a day without rows is removed."""
    written = {r["day"] for r in rows.select("day").distinct().collect()}  # at most the touched days
    rows.repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in set(days) - written:
        fs, folder = FS._hadoop_fs(spark, f"{path}/day={day}")
        fs.delete(folder, True)


def changed_files(spark: SparkSession, root: str, glob: str) -> tuple[DataFrame, DataFrame]:
    """Digests of the files there are, and ``(file, there)`` of those that are new, changed or lost."""
    now = cut_lineage(file_digests(spark, glob).select("file", "sha256"), "digests")
    before = _read(spark, f"{root}/manifest", MANIFEST).withColumnRenamed("sha256", "before")
    differs = now.join(before, "file", "full").where(~F.col("sha256").eqNullSafe(F.col("before")))
    return now, cut_lineage(differs.select("file", F.col("sha256").isNotNull().alias("there")), "changed")


def _parsed(spark: SparkSession, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], LINES).drop("idx", "day")
    lines = FS.scan_log_v1(spark, files, strict=True)
    return lines.select("trace_id", F.to_timestamp("ts_text").alias("ts"), "file", "line_no", "level", "service",
                        template_of(F.col("content")).alias("template"))


def update(spark: SparkSession, root: str, glob: str) -> dict[str, object]:
    """Bring the store at ``root`` up to the files of ``glob``; tells the files and days it worked on."""
    now, differs = changed_files(spark, root, glob)
    listed = sorted((r["file"], r["there"]) for r in differs.collect())  # names of the files to read
    if not listed:
        return {"files": 0, "days": [], "traces": 0}
    store = _read(spark, f"{root}/lines", LINES)
    fresh = cut_lineage(_parsed(spark, [f for f, there in listed if there]), "fresh")
    of_changed = store.join(differs.select("file"), "file", "left_semi")
    touched = cut_lineage(fresh.select("trace_id").unionByName(of_changed.select("trace_id")).distinct(), "touched")

    stays = store.join(differs.select("file"), "file", "left_anti")
    all_of = stays.join(touched, "trace_id", "left_semi").select("trace_id", "ts").unionByName(fresh.select("trace_id", "ts"))
    starts = all_of.groupBy("trace_id").agg(F.date_format(F.min("ts"), "yyyyMMdd").alias("day"))
    left = store.join(touched, "trace_id", "left_semi").select("day")
    days = sorted(r["day"] for r in starts.select("day").unionByName(left).distinct().collect())

    # of the touched days: traces that stay as they are, and touched ones from all their lines
    kept = stays.where(F.col("day").isin(days))
    untouched = kept.join(touched, "trace_id", "left_anti")
    columns = [c for c in fresh.columns]
    again = line_index(kept.join(touched, "trace_id", "left_semi").select(columns).unionByName(fresh))
    again = again.join(starts, "trace_id")
    rows = cut_lineage(untouched.select(store.columns).unionByName(again.select(store.columns)), "rows")

    _overwrite_days(spark, rows, f"{root}/lines", days)
    counts = rows.groupBy("day", "template").agg(F.count("*").alias("count"))
    _overwrite_days(spark, cut_lineage(counts, "counts"), f"{root}/templates", days)
    _overwrite_days(spark, cut_lineage(_day_contexts(rows), "day-contexts"), f"{root}/contexts", days)
    atomic_write(spark, f"{root}/manifest", lambda p: now.write.parquet(p))
    return {"files": len(listed), "days": days, "traces": touched.count()}


def _day_contexts(rows: DataFrame) -> DataFrame:
    """Context counts of each day's traces: lines with the same history are counted before their levels are unfolded."""
    seen = histories(rows, carry=("day",))
    patterns = seen.groupBy("day", "levels", "next").agg(F.count("*").alias("n"))
    levels = patterns.select("day", "next", "n", F.inline("levels"))
    return levels.groupBy("day", "k", "context", "next").agg(F.sum("n").alias("n"))


def lines(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/lines", LINES)


def dictionary(spark: SparkSession, root: str) -> DataFrame:
    """``(template, count)`` over all days."""
    return _read(spark, f"{root}/templates", TEMPLATES).groupBy("template").agg(F.sum("count").alias("count"))


def model(spark: SparkSession, root: str) -> DataFrame:
    """``(k, context, next, n)`` over all days: the counts a full build would give."""
    return _read(spark, f"{root}/contexts", CONTEXTS).groupBy("k", "context", "next").agg(F.sum("n").alias("n"))


def rebuilt_model(spark: SparkSession, root: str) -> DataFrame:
    """The same counts from the lines themselves."""
    return context_model(histories(lines(spark, root)))
