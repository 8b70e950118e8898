"""Fill-in-the-middle rearrangement of documents, cut at unit ends found by word-parallel arithmetic.

The UTF-8 bytes of a block of documents are viewed as 64-bit words. One subtraction-free test marks
every unit-ending byte (``\\n``) of a word with its top bit, a population count per word and one
running sum give the number of unit ends before any word, and the k-th unit end is a binary search
in that sum followed by a select inside a single word. Code points are counted the same way, from
marks on continuation bytes. No text is split and no line is ever an object.

A document of ``n`` units (``[^\\n]*\\n|[^\\n]+``) draws four numbers from the SHA-256 of
``seed:doc_id``: its prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units,
its middle after the larger one, ``h3`` decides whether it is rearranged, ``h4`` the order of parts.

Defined results: a null text counts as empty; an empty text and a text that holds a mark itself stay
plain; a null id draws like an empty one; repeated rows get equal results; extra columns are
carried, the operator's own win on equal names; an empty table gives an empty result. Texts are
taken whole; memory is a small multiple of the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import carrying, map_arrow, text_blocks

#: Marks of the three parts in the output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_ANY_MARK = "<[PSM]>"

_U = np.uint64
_ONES = _U(0x0101010101010101)
_HIGH = _U(0x8080808080808080)
_LOW7 = _U(0x7F7F7F7F7F7F7F7F)


class Marks:
    """Marked bytes of a buffer: how many lie before a byte, and where the k-th one is."""

    def __init__(self, marks: np.ndarray):
        """``marks``: 64-bit words whose bytes are 0x80 where marked, else 0."""
        self.marks = np.append(marks, _U(0))
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each position."""
        word, byte = at >> 3, (at & 7).astype(_U)
        lower = (_U(1) << (byte << _U(3))) - _U(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & lower)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, counted from one."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = (k - self.before[word]).astype(_U)
        running = (self.marks[word] >> _U(7)) * _ONES  # byte i: marks in bytes 0 to i
        reached = ((running | _HIGH) - left * _ONES) & _HIGH
        return 8 * word + 8 - np.bitwise_count(reached)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, zeros after the last one."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def byte_marks(words: np.ndarray, byte: int) -> Marks:
    """Marks on the bytes equal to ``byte``: exact, as no carry leaves a byte."""
    differs = words ^ (_U(byte) * _ONES)
    return Marks(~(((differs & _LOW7) + _LOW7) | differs | _LOW7))


def continuation_marks(words: np.ndarray) -> Marks:
    """Marks on the bytes 10xxxxxx."""
    return Marks(words & ~(words << _U(1)) & _HIGH)


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first hex groups of its digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units, byte ends of prefix and middle, and code points of both, of documents in one buffer."""
    words = as_words(data)
    breaks, follow = byte_marks(words, 10), continuation_marks(words)
    first = breaks.rank(starts)
    whole = breaks.rank(ends) - first
    filled = np.flatnonzero(ends > starts)
    tail = np.zeros(len(starts), np.int64)
    tail[filled] = data[ends[filled] - 1] != 10
    n = whole + tail
    chosen = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)

    def end_of(units: np.ndarray) -> np.ndarray:
        at = np.where(units > whole, ends, starts)
        inside = np.flatnonzero((units > 0) & (units <= whole))
        at[inside] = breaks.select(first[inside] + units[inside]) + 1
        return at

    low, high = end_of(chosen[:, 0]), end_of(chosen[:, 1])
    points = [b - a - (follow.rank(b) - follow.rank(a)) for a, b in ((starts, low), (low, high))]
    return n, low, high, *points


def rearrange(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 7, percent: int = 100, suffix_first_percent: int = 50
) -> DataFrame:
    """Replace ``text`` by n, form (plain, psm, spm), prefix_chars, middle_chars and output."""
    own = "n long, form string, prefix_chars long, middle_chars long, output string"
    names, schema = carrying(docs, [c for c in docs.columns if c != text], own)
    docs = docs.select(*(f"`{c}`" for c in names), F.col(f"`{doc_id}`").cast("string").alias("drawn_by"), F.col(f"`{text}`"))
    others = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(others + 1)
            marked = pa.compute.match_substring_regex(column, _ANY_MARK).fill_null(False).to_numpy(zero_copy_only=False)
            drawn = np.array([draws(seed, i) for i in batch.column(others).to_pylist()], np.int64).reshape(-1, 4)
            for block in text_blocks(column):
                rows = slice(block.first, block.first + block.n)
                starts, ends = block.offsets[:-1], block.offsets[1:]
                n, low, high, before, between = cuts(block.data, starts, ends, drawn[rows])
                plain = marked[rows] | (ends == starts) | (drawn[rows, 2] % 100 >= percent)
                spm = ~plain & (drawn[rows, 3] % 100 < suffix_first_percent)
                raw, out = block.data.tobytes(), []
                for s, lo, hi, e, is_plain, is_spm in zip(*(x.tolist() for x in (starts, low, high, ends, plain, spm)), strict=True):
                    if is_plain:
                        out.append(raw[s:e])
                    elif is_spm:
                        out.append(b"".join((SUFFIX, raw[hi:e], PREFIX, raw[s:lo], MIDDLE, raw[lo:hi])))
                    else:
                        out.append(b"".join((PREFIX, raw[s:lo], SUFFIX, raw[hi:e], MIDDLE, raw[lo:hi])))
                part = batch.slice(block.first, block.n)
                forms = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
                texts = pa.array(out, pa.binary()).cast(pa.string())
                columns = [pa.array(n), forms, pa.array(before, mask=plain), pa.array(between, mask=plain), texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:others], *columns], names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(docs, run, schema)


def restore(docs: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """Add ``restored``: the text rebuilt from an output and its form (a rearranged text holds no mark)."""
    parts = F.split(F.col(f"`{output}`"), _ANY_MARK, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    shape = F.col(f"`{form}`")
    return docs.withColumn(restored, F.when(shape == "psm", psm).when(shape == "spm", spm).otherwise(F.col(f"`{output}`")))
