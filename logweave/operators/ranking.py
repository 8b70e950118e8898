"""Skew-safe ordered operations: ranks, running totals and exact quantiles.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task, and a
window without ``partitionBy`` sends the whole table to one task. Both break when one trace
(or the whole table) holds a third of all rows. The helpers here split every key into
ordered *chunks* (a column that is monotone in the order: ``idx div 4096``, a file block, a hash
prefix, or the partition number of a range exchange with sampled split points), rank inside ``(key, chunk)`` with a normal window, and add
the exclusive running total of the chunk sizes, computed on the small ``(key, chunk)`` table.
The result equals the single-window result exactly; no task holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.session import cut_lineage

CHUNK = "_chunk"


#: A key with more rows than this is dealt over several tasks.
CHUNK_ROWS = 1 << 16
MAX_PARTS = 20_000
_PLACE = "_place"


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
          rows: int = CHUNK_ROWS) -> tuple[DataFrame, Column | None]:
    """``df`` and a chunk column for it, or None where no key holds more than ``rows`` rows.

    With a hot key (or, without keys, a large table) the rows are dealt by a range exchange on
    ``keys`` and ``order``: Spark samples the split points, so a key of any size, whatever its order
    values, falls into partitions of about ``rows`` rows. They are written with their
    partition's number, which is the chunk; nothing about the data enters the plan."""
    keys = list(keys)
    if keys:
        per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
        total, most = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    else:
        total = most = df.count()
    if most <= rows:
        return df, None
    by_range = df.repartitionByRange(min(MAX_PARTS, -(-total // rows)), *keys, *order)
    return cut_lineage(by_range.withColumn(_PLACE, F.spark_partition_id()), "dealt"), F.col(_PLACE)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  chunk: Column | None, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Add a running sum per value column (ordered by ``order`` within ``keys``).

    Values must be non-negative when ``inclusive`` (chunk sizes are read off the running sum).

    ``chunk`` must be non-decreasing along ``order`` within a key; None: one chunk per key. Ties in
    ``order`` are broken by the window sort, so give a total order when the result must be deterministic.
    """
    if chunk is None:
        whole = (W.partitionBy(*keys) if keys else W).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(v).over(whole), F.lit(0)).alias(n) for n, v in values.items()])
    keys = list(keys)
    tmp = {name: f"_v_{name}" for name in values}
    d = df.select("*", chunk.alias(CHUNK), *[v.alias(tmp[n]) for n, v in values.items()])
    frame = W.partitionBy(*keys, CHUNK).orderBy(*order)
    frame = frame.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    d = d.select("*", *[F.coalesce(F.sum(tmp[n]).over(frame), F.lit(0)).alias(f"_in_{n}")
                        for n in values])
    # chunk sizes from the windowed rows: the data is already clustered by (keys, chunk),
    # so this aggregate adds no shuffle
    if inclusive:
        sizes = d.groupBy(*keys, CHUNK).agg(*[F.max(f"_in_{n}").alias(f"_sz_{n}") for n in values])
    else:
        sizes = d.groupBy(*keys, CHUNK).agg(*[F.sum(tmp[n]).alias(f"_sz_{n}") for n in values])
    prev = (W.partitionBy(*keys) if keys else W).orderBy(CHUNK)
    prev = prev.rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, CHUNK, *[
        F.coalesce(F.sum(f"_sz_{n}").over(prev), F.lit(0)).alias(f"_off_{n}") for n in values])
    out = d.join(offsets, [*keys, CHUNK])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(n) for n in values])


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                chunk: Column | None, out: str = "rank") -> DataFrame:
    """1-based ``row_number`` within ``keys`` by ``order`` (must be a total order)."""
    return running_total(df, keys, order, chunk, {out: F.lit(1).cast("long")})


def rank_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rank",
                 rows: int = CHUNK_ROWS) -> DataFrame:
    """``rank_within`` where no column tells a chunk: hot keys are dealt by sampled split points."""
    placed, chunk = dealt(df, keys, order, rows)
    return rank_within(placed, keys, order, chunk, out).drop(_PLACE)


def hash_rank(df: DataFrame, hash_col: str, out: str = "rank", prefix_chars: int = 3) -> DataFrame:
    """Global 1-based rank by a uniform hex hash (e.g. md5): chunks are hash prefixes."""
    return rank_within(df, [], [F.col(hash_col)], F.substring(hash_col, 1, prefix_chars), out)
