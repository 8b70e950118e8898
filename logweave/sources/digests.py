"""File digests in constant memory: whole files streamed through a buffer, or block by block as a tree.

Spark lists the files and deals them out; a task opens each of its files itself and hashes while it
reads, so a file of any length costs one buffer. A SHA-256 of a whole file is one chain
and thus one task's work; ``block_digests`` hashes blocks of a file in parallel and
``tree_digest`` folds them, ``FAN`` digests at a time, into one root per file. Roots are equal if
and only if the files are, so a manifest may hold either.

Files are opened by ``pyarrow.fs`` (local, HDFS, S3, GCS, ABFS). A filesystem that only Spark can open
goes through Spark's ``binaryFile`` reader instead, which holds a file in one row (2 GB at most).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.files import _hadoop_fs

BUFFER = 1 << 20
BLOCK = 64 << 20
FAN = 1024


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """``(file, length)`` of every file of a glob, empty ones too (which Spark's readers pass over)."""
    system, path = _hadoop_fs(spark, glob)
    rows = [(s.getPath().toString(), s.getLen()) for s in system.globStatus(path) or [] if s.isFile()]
    return spark.createDataFrame(rows, "file string, length long")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def openable(path: str) -> bool:
    """Whether a task can open the file without Spark."""
    try:
        system, name = _opened(path)
        return system.get_file_info(name).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def _sha256(path: str, offset: int, size: int, buffer: int) -> str:
    system, name = _opened(path)
    digest = hashlib.sha256()
    with system.open_input_file(name) as source:
        source.seek(offset)
        left = size
        while left:
            part = source.read(min(buffer, left))
            if not part:
                raise OSError(f"{path} ends {left} bytes early")
            digest.update(part)
            left -= len(part)
    return digest.hexdigest()


def _hashed(ranges: DataFrame, buffer: int) -> DataFrame:
    """Add ``sha256`` to rows ``(file, block, offset, size)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True)
            yield batch.append_column("sha256", pa.array([_sha256(*row, buffer) for row in rows], pa.string()))

    return ranges.mapInArrow(run, "file string, block long, offset long, size long, sha256 string")


def file_digests(spark: SparkSession, glob: str, buffer: int = BUFFER) -> DataFrame:
    """``(file, sha256, length)`` of every file, each streamed through ``buffer`` bytes."""
    files = list_files(spark, glob)
    one = files.first()
    if one is not None and not openable(one["file"]):
        whole = spark.read.format("binaryFile").load(glob)
        return whole.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), "length")
    ranges = files.select("file", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("size"))
    return _hashed(ranges, buffer).select("file", "sha256", F.col("size").alias("length"))


def block_digests(spark: SparkSession, glob: str, block: int = BLOCK, buffer: int = BUFFER) -> DataFrame:
    """``(file, block, offset, size, sha256)``; an empty file is one empty block. Blocks are dealt over tasks."""
    last = F.greatest(F.floor((F.col("length") - 1) / block), F.lit(0)).cast("long")
    blocks = list_files(spark, glob).select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    offset = F.col("block") * block
    ranges = blocks.select("file", "block", offset.alias("offset"), F.least(F.lit(block), F.col("length") - offset).cast("long").alias("size"))
    return _hashed(ranges.repartition("file", "block"), buffer)


def tree_digest(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """``(file, n_blocks, root)``: SHA-256 over the hex digests of up to ``fan`` neighbours, level by level."""
    highest = blocks.agg(F.max("block")).first()[0]
    level = blocks.select("file", "block", "sha256", F.lit(1).cast("long").alias("n_blocks"))
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("block", "sha256")))  # at most ``fan`` digests
        joined = F.array_join(F.transform(ordered, lambda b: b["sha256"]), "")
        level = level.groupBy("file", F.floor(F.col("block") / fan).alias("block")).agg(
            F.sha2(joined, 256).alias("sha256"), F.sum("n_blocks").alias("n_blocks"))
        highest = (highest or 0) // fan
        if not highest:
            return level.select("file", "n_blocks", F.col("sha256").alias("root"))
