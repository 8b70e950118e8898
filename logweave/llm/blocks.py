"""Vectorised text helpers for Arrow batches: block iteration, word and line hashes.

All functions work on the raw UTF-8 bytes of a whole Arrow column. A batch is cut into
*blocks* of whole documents of about ``BLOCK_BYTES``; a document larger than that is a block
of its own, so memory stays a small multiple of the longest single text.

Hashes are 64-bit: the polynomial ``sum(code[byte_j] * P**j) mod 2**64`` of a byte range is the
difference of two prefix sums times the inverse power of its start, so every word, line or
window of a block is hashed without a Python loop. ``code`` is a fixed pseudo-random table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)

CODE = np.random.default_rng(20_240_601).integers(1, 2**64 - 1, 256, dtype=np.uint64)
CODE_LOWER = CODE.copy()
CODE_LOWER[65:91] = CODE[97:123]  # A-Z hash like a-z

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CONTINUES = np.zeros(256, bool)  # UTF-8 continuation bytes
_CONTINUES[0x80:0xC0] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept and made longer as needed."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.array([1], _U) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        have = have[: max(n, BLOCK_BYTES + 1)].copy()
        if len(have) <= 8 * BLOCK_BYTES:  # an over-long text does not stay in the worker
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], _U))[0])


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a DDL schema string or a struct type."""
    return df.mapInArrow(function, schema)


#: Arrow batches of whole texts, in bytes: Spark's 64 MB are held several times over by a task's JVM and worker.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to Arrow batches of ``BATCH_BYTES`` unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if _BATCH_CONF not in conf.getAll:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def carrying(df: DataFrame, columns: tuple[str, ...] | list[str], added: str) -> tuple[list[str], StructType]:
    """The columns to carry and the schema with the ``added`` ones (DDL), which win on equal names."""
    own = StructType.fromDDL(added)
    taken = {f.name.lower() for f in own.fields}
    kept = [c for c in columns if c.lower() not in taken]
    return kept, StructType([*(df.schema[c] for c in kept), *own.fields])


class Block:
    """Whole documents of a batch: their bytes, document offsets and prefix sums on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._prefix: dict[bool, np.ndarray] = {}

    def counts(self, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of set flags in each byte range."""
        total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 30 else np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[ends] - total[starts]).astype(np.int64)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        return self.counts(flags, self.offsets[:-1], self.offsets[1:])

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each byte range (equal ranges hash equally, wherever they stand)."""
        prefix = self._prefix.get(lower)
        if prefix is None:
            prefix = np.zeros(len(self.data) + 1, _U)
            np.cumsum((CODE_LOWER if lower else CODE)[self.data] * _power(_P, len(self.data)), out=prefix[1:])
            self._prefix[lower] = prefix
        inverse = _power(_P_INV, len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(_U))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, in order; words end at documents."""
        inside = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each ``\\n``-split line (the break excluded), in order."""
        breaks = np.flatnonzero(self.data == 10)
        owner = self.doc_of(breaks)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        doc_s = np.concatenate([np.arange(self.n), owner])
        doc_e = np.concatenate([owner, np.arange(self.n)])
        return starts[np.lexsort((starts, doc_s))], ends[np.lexsort((ends, doc_e))]

    def line_docs(self, n_lines_breaks: np.ndarray | None = None) -> np.ndarray:
        """Document index of each line of :meth:`lines`."""
        return np.repeat(np.arange(self.n), self.per_doc(self.data == 10) + 1)

    def code_points(self) -> np.ndarray:
        """Flags of the bytes that begin a code point."""
        return ~_CONTINUES[self.data]


def text_blocks(column: pa.Array) -> Iterator[Block]:
    """Blocks of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def window_hashes(words: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width``-word window inside one document, and the index of its first word."""
    if len(words) < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    n = len(words) - width + 1
    total = np.zeros(n, _U)
    for i in range(width):
        total = mix(total + words[i : i + n] + _U(i + 1))
    at = np.flatnonzero(docs[:n] == docs[width - 1 :])
    return total[at], at
