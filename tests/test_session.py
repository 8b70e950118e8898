"""Scratch tables live in the application's own folder and can be dropped as a whole."""

from __future__ import annotations

from logweave import session
from logweave.sources.files import path_exists


def test_scratch_is_cleared(spark, monkeypatch):
    root = session.scratch_path(spark, "own-root")  # do not drop what other tests still read
    monkeypatch.setattr(session, "_scratch_root", lambda s: root)
    table = session.cut_lineage(spark.range(5), "some")
    assert table.count() == 5 and path_exists(spark, root)
    session.clear_scratch(spark)
    assert not path_exists(spark, root)
    assert session.cut_lineage(spark.range(3), "again").count() == 3


def test_scratch_names_are_new_and_per_application(spark):
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b and spark.sparkContext.applicationId in a
