"""Every data-quality check and selection with one violation planted and one row that is fine."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweave.operators import quality as Q
from logweave.operators import splits as SP
from logweave.operators import templates as TP
from logweave.session import scratch_path
from logweave.sources import digests as DG
from logweave.sources import files as FS

GOOD = "2024-01-01T00:00:00.000Z INFO api trace=t1 order placed order_id=5"


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_unparsed_lines(spark):
    raw = spark.createDataFrame([(GOOD,), ("2024-01-01 no log line",), ("",)], "value string")
    assert values(Q.dq_unparsed_lines(raw), "value") == [("",), ("2024-01-01 no log line",)]


def test_split_overlap(spark):
    splits = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val"), ("b", "val")], "trace_id string, split string")
    assert values(Q.dq_split_overlap(splits), "trace_id", "n_splits") == [("a", 2)]
    assert values(SP.split_overlap(splits), "trace_id", "n_splits") == [("a", 2)]


def test_ids_in_two_splits_intersect(spark):
    splits = spark.createDataFrame([("a", "test"), ("a", "train"), ("b", "test"), ("c", "val")], "trace_id string, split string")
    of = lambda *names: splits.where(F.col("split").isin(*names)).select("trace_id")
    assert values(of("test").intersect(of("train", "val")), "trace_id") == [("a",)]


def test_label_counts(spark):
    labels = spark.createDataFrame([("test", "none")] * 2 + [("test", "truncated")], "split string, anomaly_type string")
    wanted = spark.createDataFrame([("test", "none", 2), ("test", "truncated", 2), ("dev", "none", 0), ("dev", "other", 1)],
                                   "split string, anomaly_type string, expected long")
    got = values(Q.dq_label_counts(labels, wanted), "split", "anomaly_type", "actual", "expected")
    assert got == [("dev", "other", None, 1), ("test", "truncated", 1, 2)]


def test_dirty_train(spark):
    lines = spark.createDataFrame([("a", "train", "api ERROR x"), ("b", "val", "api INFO ok"), ("c", "test", "api ERROR x")],
                                  "trace_id string, split string, template string")
    assert values(Q.dq_dirty_train(lines), "trace_id") == [("a",)]


def test_label_leak(spark):
    raw = spark.createDataFrame([(GOOD,), (GOOD + " Anomalous=1",)], "value string")
    assert values(Q.dq_label_leak(raw), "value") == [(GOOD + " Anomalous=1",)]


def test_mask_leak(spark):
    lines = spark.createDataFrame([("a user=<*> items=<*>",), ("a user=17 items=<*>",), ("a color=17",), ("a user=<b>",)], "template string")
    assert values(Q.dq_mask_leak(lines), "template") == [("a user=17 items=<*>",), ("a user=<b>",)]


def test_template_refs(spark):
    refs = spark.createDataFrame([(1,), (9,)], "template_id long")
    assert values(Q.dq_template_refs(refs, spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")), "template_id") == [(9,)]


def test_label_consistency(spark):
    answers = spark.createDataFrame([("a", "f", "visible_error", 1), ("b", "f", "truncated", 2), ("c", "f", "none", 3),
                                     ("d", "unknown", "other", 0), ("e", "f", "none", None)],
                                    "trace_id string, flow string, anomaly_type string, first_deviation_line long")
    heads = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", None)], "trace_id string, err_line long")
    # b has an error line and another type, c is normal with an index
    assert values(Q.dq_label_consistency(answers, heads), "trace_id") == [("b",), ("c",)]


def test_deviation_index(spark):
    schema = "trace_id string, anomaly_type string, {} long"
    labels = spark.createDataFrame([("a", "truncated", 3), ("b", "truncated", 3), ("c", "none", None), ("d", "none", None)], schema.format("first_deviation_index"))
    answers = spark.createDataFrame([("a", "truncated", 3), ("b", "truncated", 4), ("c", "none", None), ("d", "other", None)], schema.format("first_deviation_line"))
    assert values(Q.dq_deviation_index(labels, answers), "trace_id") == [("b",), ("d",)]


def test_storm_length(spark):
    runs = spark.createDataFrame([("a", 4), ("a", 2), ("b", 3), ("c", 7), ("d", 9)], "trace_id string, length long")
    answers = spark.createDataFrame([(t, "retry_storm") for t in "abc"] + [("d", "none")], "trace_id string, anomaly_type string")
    assert values(Q.dq_storm_length(runs, answers), "trace_id", "longest") == [("b", 3), ("c", 7)]


def test_flow_scope_and_services(spark):
    answers = spark.createDataFrame([("a", "f", "anomalous"), ("b", "g", "anomalous"), ("c", "g", "normal")], "trace_id string, flow string, verdict string")
    assert values(Q.dq_flow_scope(answers, ["f"]), "trace_id") == [("b",)]
    lines = spark.createDataFrame([(1, "api"), (2, "rogue")], "line_no long, service string")
    assert values(Q.dq_known_services(lines, spark.createDataFrame([("api",)], "service string")), "line_no") == [(2,)]


def test_line_counts(spark):
    rows = lambda *traces: spark.createDataFrame([(t,) for t in traces], "trace_id string")
    got = Q.dq_line_counts(rows("a", "a", "b", "d"), rows("a", "a", "b", "b", "c", "d"))
    assert values(got, "trace_id", "seq_lines", "raw_lines") == [("b", 1, 2), ("c", None, 1)]


def test_manifest_tells_changed_lost_and_new_files(spark):
    root = scratch_path(spark, "manifest")
    for name in ("same", "changed", "lost"):
        FS.write_small_text(spark, f"{root}/a/{name}.log", GOOD)
    for name, text in (("same", GOOD), ("changed", GOOD + " "), ("new", GOOD)):
        FS.write_small_text(spark, f"{root}/b/{name}.log", text)
    sums = lambda side: DG.file_digests(spark, f"{root}/{side}/*.log").withColumn(
        "file", F.regexp_extract("file", r"(\w+)\.log$", 1))
    assert values(Q.dq_manifest(sums("b"), sums("a")), "file") == [("changed",), ("lost",), ("new",)]


def test_unseen_template_traces(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x")], "trace_id string, line_no long, template string")
    dictionary = spark.createDataFrame([(1, "x", True), (2, "y", False)], "id long, text string, seen_in_train boolean")
    got = TP.unseen_template_traces(TP.join_template_ids(lines, dictionary))
    assert values(got, "trace_id", "n_unseen_lines", "n_lines") == [("a", 1, 2)]


def test_hard_negatives_are_normal_precursors_with_an_optional_line(spark):
    normal = spark.createDataFrame([("a", "precursor", 1), ("b", "precursor", 0), ("c", "background", 2), ("d", "precursor", 3)],
                                   "trace_id string, phase string, n_optional long")
    assert values(SP.hard_negatives(normal, 5), "trace_id") == [("a",), ("d",)]
    assert SP.hard_negatives(normal, 1).count() == 1


def test_quarantine_parts_lines_and_counts_them_in_one_pass(spark):
    root = scratch_path(spark, "quarantine-test")
    FS.write_small_text(spark, f"{root}/in/a.log", GOOD + "\n\nnothing\n" + GOOD.replace("2024-01-01", "2024-01-99") + "\n" + GOOD + "\n")
    lines = FS._numbered(spark.read.text(f"{root}/in/a.log"))
    good, rejects, counts = FS.quarantine(lines, f"{root}/out")
    assert counts == {"n_lines": 5, "n_good": 2, "n_blank": 1, "n_shape": 1, "n_timestamp": 1}
    assert values(good, "line_no", "trace_id", "content") == [(1, "t1", "api INFO order placed order_id=5"), (5, "t1", "api INFO order placed order_id=5")]
    assert values(rejects, "line_no", "reason") == [(2, "blank"), (3, "shape"), (4, "timestamp")]
    good, rejects, counts = FS.quarantine(lines.limit(0), f"{root}/none")
    assert (good.count(), rejects.count(), counts["n_lines"]) == (0, 0, 0)


# --- digests ----------------------------------------------------------------------------------


@pytest.mark.parametrize("buffer", [7, 1 << 20])
def test_digests_equal_hashlib_with_any_buffer(spark, buffer):
    import hashlib

    root = scratch_path(spark, "digest")
    texts = {"a": "", "b": "x", "c": "line é\n" * 1000}
    for name, text in texts.items():
        FS.write_small_text(spark, f"{root}/{name}.log", text)
    got = {r.file.rsplit("/", 1)[1][0]: (r.sha256, r.length) for r in DG.file_digests(spark, f"{root}/*.log", buffer).collect()}
    assert got == {n: (hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for n, t in texts.items()}

    blocks = DG.block_digests(spark, f"{root}/*.log", block=100, buffer=buffer)
    parts = {n: [t.encode()[i:i + 100] for i in range(0, max(1, len(t.encode())), 100)] for n, t in texts.items()}
    found = sorted((r.file.rsplit("/", 1)[1][0], r.block, r.sha256) for r in blocks.collect())
    assert found == sorted((n, i, hashlib.sha256(p).hexdigest()) for n, ps in parts.items() for i, p in enumerate(ps))

    def root_of(level: list[str], fan: int) -> str:
        while True:
            level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
            if len(level) == 1:
                return level[0]

    deepest = max(len(p) for p in parts.values())
    for fan in (3, 1000):
        levels = 1
        while deepest > fan ** levels:
            levels += 1
        tree = {r.file.rsplit("/", 1)[1][0]: (r.n_blocks, r.root) for r in DG.tree_digest(blocks, fan).collect()}
        for n, ps in parts.items():
            level = [hashlib.sha256(p).hexdigest() for p in ps]
            for _ in range(levels):
                level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
            assert tree[n] == (len(ps), level[0])


def test_a_large_file_is_hashed_in_constant_memory(tmp_path):
    """64 MB through a buffer of 64 KB: the task's allocations stay within a few buffers."""
    import hashlib
    import tracemalloc

    path = tmp_path / "large.bin"
    with open(path, "wb") as out:
        for _ in range(64):
            out.write(b"0123456789abcdef" * 65536)
    tracemalloc.start()
    got = DG._sha256(f"file:{path}", 0, 64 << 20, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == hashlib.sha256(path.read_bytes()).hexdigest()
    assert peak < 4 << 20
