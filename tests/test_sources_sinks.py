"""File sources and sinks: strict parsing, labels, prices, console results, swap and reuse."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweave.session import scratch_path
from logweave.sinks import writers as WR
from logweave.sources import files as FS

GOOD = "2024-01-01T00:00:00.000Z INFO api trace=t1 order placed order_id=5"


def test_strict_scan_names_file_and_line(spark):
    root = scratch_path(spark, "strict")
    FS.write_small_text(spark, f"{root}/raw_dev.log", GOOD + "\nthis is not a log line\n")
    lax = FS.scan_log_v1(spark, f"{root}/raw_dev.log").orderBy("line_no").collect()
    assert [(r.line_no, r.parsed) for r in lax] == [(1, True), (2, False)]
    assert lax[0].content == "api INFO order placed order_id=5"
    with pytest.raises(Exception, match=r"raw_dev\.log:2"):
        FS.scan_log_v1(spark, f"{root}/raw_dev.log", strict=True).collect()


@pytest.mark.parametrize("column", ["content", "line_no", "file"])
def test_strict_scan_fails_whatever_is_read(spark, column):
    root = scratch_path(spark, "strict-one")
    FS.write_small_text(spark, f"{root}/bad.log", GOOD + "\ngarbage\n" + GOOD + "\n")
    with pytest.raises(Exception, match=r"bad\.log:2"):
        FS.scan_log_v1(spark, f"{root}/bad.log", strict=True).select(column).collect()
    with pytest.raises(Exception, match="unparseable line"):
        FS.scan_log_prod(spark, f"{root}/bad.log", strict=True).select(column).collect()


def test_failed_swap_keeps_the_old_copy(spark):
    path = scratch_path(spark, "swap-fails")
    WR.atomic_write(spark, path, lambda p: spark.range(3).write.parquet(p))
    calls = []

    def second_fails(fs, src, dst):
        calls.append(str(dst))
        if len(calls) == 2:
            raise OSError("no rename today")
        assert fs.rename(src, dst)

    with pytest.raises(OSError, match="no rename today"):
        WR.atomic_write(spark, path, lambda p: spark.range(5).write.parquet(p), rename=second_fails)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(OSError, match="nothing was written"):
        WR.atomic_write(spark, path, lambda p: None)
    assert spark.read.parquet(path).count() == 3


def test_prod_lines_and_offsets(spark):
    root = scratch_path(spark, "prod")
    FS.write_small_text(spark, f"{root}/prod_1.log",
                        "2026-03-02T09:00:00.123+01:00 INFO gw host=h1 corrId=c-1 start x=1\n"
                        "2026-03-02T09:00:01.000+01:00 INFO gw host=h1 corrId=- heartbeat\n")
    rows = FS.scan_log_prod(spark, f"{root}/prod_1.log", strict=True).orderBy("line_no").collect()
    assert [(r.trace_id, r.host, r.content) for r in rows] == [
        ("c-1", "h1", "gw INFO start x=1"), ("-", "h1", "gw INFO heartbeat")]


def test_labels_missing_split_and_empty_index(spark):
    root = scratch_path(spark, "labels")
    FS.write_small_text(spark, f"{root}/labels_dev.csv",
                        "trace_id,label,anomaly_type,first_deviation_index\nt1,0,none,\nt2,1,truncated,4\n")
    got = {r.trace_id: r.first_deviation_index for r in FS.scan_labels(spark, root, "dev").collect()}
    assert got == {"t1": None, "t2": 4}
    with pytest.raises(FileNotFoundError, match="test"):
        FS.scan_labels(spark, root, "test")


def test_prices_missing_file_and_key(spark):
    root = scratch_path(spark, "prices")
    r = FS.scan_prices(spark, f"{root}/none.yaml").first()
    assert (r.llm_input_per_1m_tokens, r.gpu_per_hour) == (None, None)
    FS.write_small_text(spark, f"{root}/p.yaml", "gpu_per_hour: 3.6\n")
    r = FS.scan_prices(spark, f"{root}/p.yaml").first()
    assert (r.llm_input_per_1m_tokens, r.gpu_per_hour) == (None, 3.6)


def test_extract_embedded_json(spark):
    df = spark.createDataFrame([("step 1 done",), ('RESULT {"meta.json": "{}", "eval/metrics.json": "x"}',)],
                               "value string")
    got = sorted((r.name, r.content) for r in FS.extract_embedded_json(df).collect())
    assert got == [("eval/metrics.json", "x"), ("meta.json", "{}")]


def test_atomic_swap_and_reuse(spark):
    path = scratch_path(spark, "swap")
    WR.atomic_write(spark, path, lambda p: spark.range(3).write.parquet(p))
    WR.atomic_write(spark, path, lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(path).count() == 5
    calls = []

    def build(p):
        calls.append(p)
        spark.range(7).write.parquet(p)

    prep = scratch_path(spark, "reuse")
    df1, reused1 = WR.reuse_prepared(spark, prep, "h1", build)
    df2, reused2 = WR.reuse_prepared(spark, prep, "h1", build)
    assert df2.count() == 7
    df3, reused3 = WR.reuse_prepared(spark, prep, "h2", build)  # input changed: rebuilt
    assert (reused1, reused2, reused3) == (False, True, False) and len(calls) == 2
    assert df3.count() == 7


def test_file_checksums_equal_sha256(spark):
    import hashlib

    root = scratch_path(spark, "sum")
    FS.write_small_text(spark, f"{root}/a.log", GOOD + "\n")
    got = FS.file_checksums(spark, f"{root}/a.log").select("sha256").first()[0]
    assert got == hashlib.sha256((GOOD + "\n").encode()).hexdigest()


def test_sequences_partition_pruning(spark):
    root = scratch_path(spark, "seq")
    df = spark.createDataFrame([("train", "t1", 0, "x"), ("test", "t2", 1, "z"), ("test", "t2", 0, "y")],
                               "split string, trace_id string, idx long, line string")
    WR.sink_sequences(df, root)
    s = FS.scan_sequences(spark, root, "test")
    assert [(r.trace_id, r.idx, r.line) for r in s.orderBy("idx").collect()] == [("t2", 0, "y"), ("t2", 1, "z")]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    assert s.select(F.col("split")).first()[0] == "test"


def test_extract_first_result_only(spark):
    df = spark.createDataFrame([("a", 1, "noise"), ("a", 2, 'RESULT {"x": "1"}'), ("a", 3, 'RESULT {"y": "2"}')],
                               "file string, line_no long, value string")
    got = [(r.name, r.content) for r in FS.extract_embedded_json(df, first_only=True).collect()]
    assert got == [("x", "1")]
