"""File sources: raw logs, labels, labelled traces, incidents, flows, sequences, run
metrics, prices, console results and file checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import content, parse_prod, parse_v1
from logweave.operators.ranking import rank_within

LABEL_SCHEMA = "trace_id string, label int, anomaly_type string, first_deviation_index int"
LABELLED_SCHEMA = ("trace_id string, idx long, flow string, start string, template_id string, "
                   "expected_verdict string, anomaly_type string, first_deviation_index string, "
                   "explanation string, raw_line string")
INCIDENT_SCHEMA = ("id string, title string, flow string, precursor_start string, start string, "
                   "end string")
PRICE_KEYS = ["llm_input_per_1m_tokens", "llm_output_per_1m_tokens", "gpu_per_hour"]


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return fs.exists(p)


def read_small_text(spark: SparkSession, path: str) -> str | None:
    """A small config document (flow definitions, price list) read on the driver."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _numbered(raw: DataFrame) -> DataFrame:
    """Each line with its file and 1-based line number. Read order inside a file is
    (block start, position in the split); the rank is chunked by block, so one big file is
    numbered by many tasks."""
    r = raw.select("value", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_pos"))
    r = rank_within(r, ["file"], [F.col("_block"), F.col("_pos")], F.col("_block"), out="line_no")
    return r.drop("_block", "_pos")


def _scan(raw: DataFrame, parse, strict: bool) -> DataFrame:
    """Parse numbered lines. Strict: a row whose line does not match raises in a filter over the
    whole row, so it fails whatever columns the caller reads."""
    df = raw.select("file", "line_no", "value", parse(F.col("value")).alias("_p"))
    if strict:
        where = F.concat(F.lit("unparseable line "), F.col("file"), F.lit(":"),
                         F.col("line_no").cast("string"), F.lit(": "), F.col("value"))
        df = df.where(F.when(F.col("_p.parsed"), F.lit(True)).otherwise(
            F.raise_error(where).cast("boolean")))
    df = df.select("file", "line_no", "value", "_p.*")
    return df.withColumn("content", content(F.col("service"), F.col("level"), F.col("message")))


def scan_log_v1(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """``ts level service trace=id message`` lines. Strict mode fails on the first line that
    does not match, naming file and line; otherwise ``parsed`` routes rejects."""
    return _scan(_numbered(spark.read.text(path)), parse_v1, strict)


def scan_log_prod(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Production-shaped lines with host and correlation id, read from many daily files;
    files are taken in name order."""
    return _scan(_numbered(spark.read.text(path)), parse_prod, strict)


REJECT_REASONS = ["blank", "shape", "timestamp"]


def reject_reason(value: Column, parsed: Column, ts_text: Column) -> Column:
    """Why a line is no log line (one of ``REJECT_REASONS``), or null."""
    return (F.when(F.trim(value) == "", "blank").when(~parsed, "shape")
            .when(F.try_to_timestamp(ts_text).isNull(), "timestamp"))


def reject_counts() -> list[Column]:
    """Aggregates over ``reason``: all lines, good ones, and rejects by reason."""
    return [F.count("*").alias("n_lines"), F.count_if(F.col("reason").isNull()).alias("n_good"),
            *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REJECT_REASONS]]


def quarantine(lines: DataFrame, out: str, parse=parse_v1) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Part numbered lines ``(file, line_no, value)`` into good lines and rejects, in one pass.

    Both are written to ``out``, partitioned by ``reason``; the counts are observed while writing,
    so nothing is read twice. Returns the good lines (parsed fields and content), the rejects
    ``(file, line_no, reason, value)`` and the counts."""
    seen = Observation()
    p = lines.select("file", "line_no", "value", parse(F.col("value")).alias("_p"))
    p = p.withColumn("reason", reject_reason(F.col("value"), F.col("_p.parsed"), F.col("_p.ts_text")))
    fields = [f.name for f in p.schema["_p"].dataType if f.name != "parsed"]
    good = F.col("reason").isNull()
    rows = p.observe(seen, *reject_counts()).select(
        "file", "line_no", *[F.when(good, F.col(f"_p.{f}")).alias(f) for f in fields],
        F.when(good, content(F.col("_p.service"), F.col("_p.level"), F.col("_p.message"))).alias("content"),
        F.when(~good, F.col("value")).alias("value"), F.coalesce("reason", F.lit("none")).alias("reason"))
    rows.write.mode("overwrite").partitionBy("reason").parquet(out)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    table = lines.sparkSession.read.schema(schema).parquet(out)
    return (table.where(F.col("reason") == "none").drop("value", "reason"),
            table.where(F.col("reason") != "none").select("file", "line_no", "reason", "value"), dict(seen.get))


def scan_labels(spark: SparkSession, folder: str, split: str) -> DataFrame:
    path = f"{folder}/labels_{split}.csv"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no labels for split {split!r}: {path}")
    return spark.read.csv(path, header=True, schema=LABEL_SCHEMA)


def scan_labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Labelled traces, one record per line (its place is ``idx``); the deviation index is an int or ``""`` in the file."""
    df = spark.read.schema(LABELLED_SCHEMA).json(path)
    return df.withColumn("first_deviation_index",
                         F.expr("try_cast(first_deviation_index AS INT)"))


def scan_incidents(spark: SparkSession, path: str) -> DataFrame:
    from logweave.operators.splits import typed_incidents

    raw = spark.read.csv(path, header=True, schema=INCIDENT_SCHEMA)
    return typed_incidents(raw.withColumn("list_pos", F.monotonically_increasing_id()))


def scan_flows(spark: SparkSession, path: str):
    """Flow definitions from a YAML (or JSON) document, read once on the driver."""
    import yaml

    from logweave.operators.flows import flows_from_document

    text = read_small_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return flows_from_document(yaml.safe_load(text) or {})


def scan_sequences(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Prepared sequences of one split (partition pruning on ``split``)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def scan_run_metrics(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """Every run's metrics document, ordered by path."""
    r = spark.read.option("multiLine", True)
    if schema:
        r = r.schema(schema)
    return (r.json(glob)
            .withColumn("path", F.col("_metadata.file_path")).orderBy("path"))


def scan_prices(spark: SparkSession, path: str) -> DataFrame:
    """One row of nullable prices; a missing file or key gives null, never a made-up price."""
    import yaml

    text = read_small_text(spark, path)
    data = (yaml.safe_load(text) or {}) if text else {}
    row = [tuple(None if data.get(k) is None else float(data[k]) for k in PRICE_KEYS)]
    return spark.createDataFrame(row, ", ".join(f"{k} double" for k in PRICE_KEYS))


def extract_embedded_json(console: DataFrame, prefix: str = "RESULT ",
                          first_only: bool = False) -> DataFrame:
    """Lines starting with the prefix carry a JSON object of file name -> content; one output
    record per entry. ``first_only`` keeps only the first such line (by file, then line
    number when the console has a ``line_no`` column), as a single job's output is read."""
    lines = console.where(F.col("value").startswith(prefix))
    if first_only:
        order = [c for c in ("file", "line_no") if c in console.columns]
        key = F.struct(*order) if order else F.monotonically_increasing_id()
        lines = lines.agg(F.min_by("value", key).alias("value")).where(F.col("value").isNotNull())
    obj = F.from_json(F.substring(F.col("value"), len(prefix) + 1, 1 << 30), "map<string,string>")
    return lines.select(F.explode(obj).alias("name", "content"))


def file_checksums(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 per file, streamed (see ``digests``)."""
    from logweave.sources.digests import file_digests

    return file_digests(spark, glob)
