"""Line-rule detectors, answer contract, incident windows and split selection."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from logweave.operators import answers as AN
from logweave.operators import detect as D
from logweave.operators import splits as SP


def _ix(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, idx long, template string")


def test_keyword_and_error_rules(spark):
    ix = _ix(spark, [("t", 0, "api INFO ok"), ("t", 1, "api WARN request Timeout after 3s"),
                     ("t", 2, "pay ERROR declined"), ("u", 0, "api INFO ok")])
    kw = {r.trace_id: (r.pred_index, r.flagged, r.worst_line_text) for r in D.keyword_match(ix).collect()}
    assert kw == {"t": (1, True, "api WARN request Timeout after 3s"), "u": (None, False, "")}
    er = {r.trace_id: (r.verdict, r.anomaly_type, r.first_deviation_line)
          for r in D.error_level_match(ix).collect()}
    assert er == {"t": ("anomalous", "visible_error", 2), "u": ("normal", "none", None)}


def test_answer_contract(spark):
    good = '{"flow":"f","step_check":"a: 0","explanation":"x","verdict":"normal","anomaly_type":"none","first_deviation_line":null}'
    bad = '{"flow":"zzz","step_check":"a: 0","explanation":"x","verdict":"maybe","anomaly_type":"none","first_deviation_line":9,"extra":1}'
    df = spark.createDataFrame([("g", 3, good), ("b", 3, bad)], "trace_id string, n_lines long, answer string")
    v = {r.trace_id: r.violations for r in AN.answer_contract(df, ["f"]).collect()}
    assert list(v) == ["b"]
    assert set(v["b"].split(",")) == {"keys", "verdict", "first_deviation_line", "flow"}
    p = AN.answer_parse(df.where("trace_id = 'g'")).first()
    assert (p.flagged, p.pred_index, p.worst_line_text) == (False, None, "x")


def test_offset_timestamps(spark):
    df = spark.createDataFrame([("2024-01-08T01:00:00+01:00",), ("2024-01-08T00:30:00Z",),
                                ("2024-01-07T20:00:00.250-04:00",)], "s string")
    got = [r.t for r in df.select(SP.parse_offset_ts(F.col("s")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 8, 0, 0), dt.datetime(2024, 1, 8, 0, 30),
                   dt.datetime(2024, 1, 8, 0, 0, 0, 250000)]


def test_incident_windows(spark):
    inc = SP.typed_incidents(spark.createDataFrame(
        [("i1", "x", "f", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", "2024-01-04T00:00:00Z", 0)],
        "id string, title string, flow string, precursor_start string, start string, end string, list_pos int"))
    d = dt.datetime
    tr = spark.createDataFrame([("a", "f", d(2024, 1, 2)), ("b", "f", d(2024, 1, 3)), ("c", "f", d(2024, 1, 4)),
                                ("d", "g", d(2024, 1, 3)), ("e", "f", d(2024, 1, 5))],
                               "trace_id string, flow string, start timestamp_ntz")
    ph = {r.trace_id: r.phase for r in SP.incident_phase(tr, inc).collect()}
    assert ph == {"a": "precursor", "b": "incident", "c": "incident", "d": "background", "e": "background"}
    outside = sorted(r.trace_id for r in SP.range_anti_incident(tr, inc).collect())
    assert outside == ["e"]  # inclusive ends, any flow


def test_top_per_group_exact_with_hot_group(spark):
    rows = [("hot", f"{i:05d}") for i in range(5000)] + [("cold", f"{i:05d}") for i in range(3)]
    df = spark.createDataFrame(rows, "g string, h string")
    got = SP._top_per_group(df, "g", "h", 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r.h)
    assert sorted(by["hot"]) == ["00000", "00001", "00002", "00003"] and len(by["cold"]) == 3


def test_split_sizes_half_even(spark):
    pool = spark.range(25).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("trace_id"))
    s = {r.split: r["count"] for r in SP.split_train_val(pool).groupBy("split").count().collect()}
    assert s == {"val": 2, "train": 23}  # round(2.5) = 2


def test_split_takes_the_first_hashes_without_ranking_the_pool(spark):
    ids = [f"t{i}" for i in range(3000)]
    pool = spark.createDataFrame([(i,) for i in [*ids, None]], "trace_id string")
    split = SP.split_train_val(pool)
    order = sorted(ids, key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    # 300 of 3,001, one of them the trace without an id, which is in no split
    assert {r.trace_id for r in split.where("split = 'val'").collect()} == set(order[:299])
    assert {r.trace_id for r in split.where("split = 'train'").collect()} == set(order[299:])
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan, plan


def test_split_of_an_empty_and_a_tiny_pool(spark):
    pool = spark.range(4).select(F.col("id").cast("string").alias("trace_id"))
    assert SP.split_train_val(pool.limit(0)).collect() == []
    assert {r.split for r in SP.split_train_val(pool).collect()} == {"train"}  # round(0.4) = 0


def test_template_ids_follow_traces_in_later_splits(spark):
    """Two interleaved test traces: ids go trace by trace, not line by line."""
    import datetime as dt

    from logweave.operators import templates as TP

    t0 = dt.datetime(2024, 1, 5, 23, 59)
    lines = [("train", "a", "seen"), ("train", "b", "also seen"), ("test", "x", "x first"), ("test", "y", "y first"),
             ("test", "x", "x second"), ("test", "y", "x second"), ("test", "y", "y last"), ("test", "x", "seen")]
    df = spark.createDataFrame([(s, k, t0 + dt.timedelta(minutes=i), i, x) for i, (s, k, x) in enumerate(lines)],
                               "split string, trace_id string, ts timestamp_ntz, line_no long, template string")
    got = [r.text for r in TP.template_dictionary(df).orderBy("id").collect()]
    assert got == ["seen", "also seen", "x first", "x second", "y first", "y last"]


def test_incident_windows_need_no_nested_loop(spark):
    import datetime as dt

    from logweave.operators import splits as SP

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    inc = spark.createDataFrame([("i", "t", "f", day(3, 5), day(4), day(6, 5), 1), ("j", "t", "f", day(5), day(6), day(7), 0)],
                                "id string, title string, flow string, precursor_start timestamp_ntz, start timestamp_ntz, "
                                "end timestamp_ntz, list_pos int")
    rows = [("before", "f", day(3, 4)), ("edge", "f", day(3, 5)), ("pre", "f", day(3, 23)), ("in", "f", day(4)), ("both", "f", day(5, 1)),
            ("last", "f", day(6, 5)), ("other", "g", day(4)), ("after", "f", day(8)), ("none", "f", None)]
    traces = spark.createDataFrame(rows, "trace_id string, flow string, start timestamp_ntz")
    phases = {r.trace_id: (r.incident_id, r.phase) for r in SP.incident_phase(traces, inc).collect()}
    assert phases == {"before": (None, "background"), "edge": ("i", "precursor"), "pre": ("i", "precursor"), "in": ("i", "incident"),
                      "both": ("j", "precursor"), "last": ("j", "incident"), "other": (None, "background"),
                      "after": (None, "background"), "none": (None, "background")}
    outside = SP.range_anti_incident(traces, inc)
    assert {r.trace_id for r in outside.collect()} == {"before", "after", "none"}
    assert "NestedLoop" not in outside._jdf.queryExecution().executedPlan().toString()
