"""The streaming ingest appends exactly the parsed, masked lines of new files, and keeps rejects."""

from __future__ import annotations

from logweave.session import scratch_path
from logweave.sources import files as FS
from logweave.streaming.ingest import ingest_logs, ingested


def test_ingest_picks_up_new_files_once(spark):
    root = scratch_path(spark, "stream")
    src, out, ck = f"{root}/src", f"{root}/out", f"{root}/ck"
    FS.write_small_text(spark, f"{src}/a.log",
                        "2024-01-01T00:00:00.000Z INFO api trace=t1 order  placed order_id=5\n"
                        "2024-01-01T00:00:01.000Z ERROR pay trace=t1 declined amount=3\n")
    ingest_logs(spark, src, out, ck).awaitTermination()
    FS.write_small_text(spark, f"{src}/b.log", "2024-01-02T00:00:00.000Z INFO api trace=t2 hello\n")
    ingest_logs(spark, src, out, ck).awaitTermination()  # resumes from the checkpoint
    good, rejects = ingested(spark, out)
    rows = sorted((r.trace_id, r.template, str(r.day)) for r in good.collect())
    assert rows == [("t1", "api INFO order placed order_id=<*>", "2024-01-01"), ("t1", "pay ERROR declined amount=<*>", "2024-01-01"),
                    ("t2", "api INFO hello", "2024-01-02")]
    assert rejects.count() == 0


def test_broken_lines_are_kept_and_counted_and_the_stream_goes_on(spark):
    root = scratch_path(spark, "stream-broken")
    src, out, ck = f"{root}/src", f"{root}/out", f"{root}/ck"
    FS.write_small_text(spark, f"{src}/a.log", "no log line\n\n2024-13-45T00:00:00.000Z INFO api trace=t1 x\n"
                        "2024-01-01T00:00:00.000Z INFO api trace=t1 fine\n")
    query = ingest_logs(spark, src, out, ck)
    query.awaitTermination()
    assert query.exception() is None
    seen = [p.observedMetrics["ingest"].asDict() for p in query.recentProgress if p.numInputRows]
    assert seen == [{"n_lines": 4, "n_good": 1, "n_blank": 1, "n_shape": 1, "n_timestamp": 1}]
    FS.write_small_text(spark, f"{src}/b.log", "2024-01-02T00:00:00.000Z INFO api trace=t2 later\n")
    ingest_logs(spark, src, out, ck).awaitTermination()
    good, rejects = ingested(spark, out)
    assert sorted(r.content for r in good.collect()) == ["api INFO fine", "api INFO later"]
    assert sorted((r.reason, r.value) for r in rejects.collect()) == [
        ("blank", ""), ("shape", "no log line"), ("timestamp", "2024-13-45T00:00:00.000Z INFO api trace=t1 x")]
