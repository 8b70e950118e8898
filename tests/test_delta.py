"""Incremental prepare: only touched days are written, and the store equals a full build."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pytest

from logweave.plans import delta as DL
from logweave.session import scratch_path
from logweave.sources import files as FS


def line(day: int, second: int, trace: str, words: str, level: str = "INFO") -> str:
    return f"2024-01-{day:02d}T00:00:{second:02d}.000Z {level} api trace={trace} {words}\n"


def files_of(root: str, day: str) -> set[tuple]:
    folder = urlparse(f"{root}/lines/day={day}").path
    return {(f, os.stat(f"{folder}/{f}").st_mtime_ns) for f in os.listdir(folder) if f.endswith(".parquet")} if os.path.isdir(folder) else set()


def state(spark, root: str):
    rows = sorted((r.trace_id, r.idx, str(r.ts), r.file.rsplit("/", 1)[1], r.line_no, r.template, r.day) for r in DL.lines(spark, root).collect())
    words = sorted(map(tuple, DL.dictionary(spark, root).collect()))
    model = sorted(map(tuple, DL.model(spark, root).select("k", "context", "next", "n").collect()))
    return rows, words, model


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "delta-test")


def test_updates_equal_a_full_build_and_leave_other_days_alone(spark, folder):
    logs, root = f"{folder}/logs", f"{folder}/store"

    def put(name, text):
        FS.write_small_text(spark, f"{logs}/{name}.log", text)

    def check(step):
        full = f"{folder}/full-{step}"
        DL.update(spark, full, f"{logs}/*.log")
        assert state(spark, root) == state(spark, full)
        model = sorted(map(tuple, DL.rebuilt_model(spark, root).select("k", "context", "next", "n").collect()))
        assert state(spark, root)[2] == model

    put("d1", line(1, 1, "a", "start") + line(1, 2, "b", "start user=5") + line(1, 9, "a", "end"))
    put("d2", line(2, 1, "c", "start"))
    assert DL.update(spark, root, f"{logs}/*.log") == {"files": 2, "days": ["20240101", "20240102"], "traces": 3}
    assert DL.update(spark, root, f"{logs}/*.log") == {"files": 0, "days": [], "traces": 0}

    # a new day: one trace of its own, one that began on day 2
    before = files_of(root, "20240101")
    put("d3", line(3, 1, "c", "end") + line(3, 2, "d", "start"))
    assert DL.update(spark, root, f"{logs}/*.log") == {"files": 1, "days": ["20240102", "20240103"], "traces": 2}
    assert before and files_of(root, "20240101") == before

    # a changed file: trace b is gone from it, trace a has another line
    late = files_of(root, "20240103")
    put("d1", line(1, 1, "a", "start") + line(1, 4, "a", "middle", "ERROR") + line(1, 9, "a", "end"))
    assert DL.update(spark, root, f"{logs}/*.log")["days"] == ["20240101"]
    assert files_of(root, "20240103") == late

    # an earlier line moves trace d to another day; the day it leaves is empty
    put("d0", line(2, 0, "d", "early"))
    assert DL.update(spark, root, f"{logs}/*.log")["days"] == ["20240102", "20240103"]
    assert files_of(root, "20240103") == set()
    check("moved")

    # a lost file takes its traces along
    fs, p = FS._hadoop_fs(spark, f"{logs}/d2.log")
    fs.delete(p, False)
    assert DL.update(spark, root, f"{logs}/*.log")["files"] == 1
    check("lost")


def test_a_crashed_update_is_done_again(spark, folder, monkeypatch):
    logs, root = f"{folder}/logs", f"{folder}/store"
    FS.write_small_text(spark, f"{logs}/d1.log", line(1, 1, "a", "start"))
    DL.update(spark, root, f"{logs}/*.log")
    FS.write_small_text(spark, f"{logs}/d2.log", line(2, 1, "a", "end") + line(2, 2, "b", "start"))

    def crash(*args):
        raise OSError("no manifest today")

    with monkeypatch.context() as m:
        m.setattr(DL, "atomic_write", crash)
        with pytest.raises(OSError, match="no manifest"):
            DL.update(spark, root, f"{logs}/*.log")
    assert DL.update(spark, root, f"{logs}/*.log")["files"] == 1
    DL.update(spark, f"{folder}/full", f"{logs}/*.log")
    assert state(spark, root) == state(spark, f"{folder}/full")
