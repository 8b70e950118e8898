"""The chunked ranks equal a plain window, also when one key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.operators.ranking import CHUNK_ROWS, dealt, hash_rank, rank_ordered, rank_within, running_total
from logweave.operators.traces import line_index


def test_rank_within_equals_row_number_with_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.random(), i) for i in range(3000)] + \
           [(f"k{rng.randint(0, 50)}", rng.random(), 3000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    chunk = F.floor(F.col("v") * 40)  # many chunks per key, monotone in v
    got = rank_within(df, ["k"], [F.col("v"), F.col("n")], chunk, "r")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("v", "n")).cast("long"))
    assert got.select("n", "r").exceptAll(want.select("n", "r")).count() == 0
    assert got.count() == len(rows)


def test_running_total_exclusive(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 7), (4, 1)], "o int, v int")
    got = running_total(df, [], [F.col("o")], F.floor(F.col("o") / 2), {"s": F.col("v")},
                        inclusive=False)
    assert [r.s for r in got.orderBy("o").collect()] == [0, 5, 5, 12]


def test_hash_rank_is_global_order(spark):
    df = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("h"))
    got = [r.h for r in hash_rank(df, "h", "r").orderBy("r").collect()]
    assert got == sorted(got) and len(got) == 2000


@pytest.mark.parametrize("rows", [100, 1_000_000])
def test_rank_ordered_equals_row_number(spark, rows):
    rng = random.Random(2)
    data = [("hot", rng.randrange(5), i) for i in range(3000)] + [(f"k{rng.randrange(40)}", rng.randrange(5), 3000 + i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, v int, n long").repartition(5)
    for keys in (["k"], []):
        got = rank_ordered(df, keys, [F.col("v"), F.col("n")], "r", rows)
        want = df.withColumn("r", F.row_number().over((W.partitionBy(*keys) if keys else W).orderBy("v", "n")).cast("long"))
        assert got.columns == ["k", "v", "n", "r"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_trace_in_one_second_is_spread_over_tasks(spark):
    """200,000 lines of one trace and second: chunks of about 65,536 rows, and no literal of the data in the plan."""
    lines = spark.range(200_000).select(F.lit("hot").alias("trace_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").alias("line_no"))
    placed, chunk = dealt(lines, ["trace_id"], [F.col("ts"), F.col("line_no")])
    sizes = [r["count"] for r in placed.groupBy(chunk.alias("c")).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * CHUNK_ROWS and sum(sizes) == 200_000
    indexed = line_index(lines)
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in next(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert indexed.where(F.col("idx") != F.col("line_no")).count() == 0


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "k string, v int")
    assert rank_ordered(none, ["k"], [F.col("v")]).collect() == []
    assert rank_ordered(none, [], [F.col("v")]).collect() == []
