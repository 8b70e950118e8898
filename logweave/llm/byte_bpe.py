"""Byte-level BPE encoding and decoding in linear time, exact to the merge ranks.

A rank file maps byte strings to ids (= merge ranks). Bytes are mapped to Latin-1 characters, so
one Aho-Corasick automaton over the whole vocabulary finds every token inside a pre-token. The
encoder walks left to right, always trying the longest token first, and accepts it only if it
is *compatible* with the token before it: the merges, run on the two tokens' bytes alone, give
exactly these two tokens. A sequence whose neighbours are all compatible is the merges' result,
and every prefix has only one, so a position that fails once is dead for good; each position is
left at most once per token ending there. Compatibility is memoised per pair of ids.

Pre-tokens come from the public split pattern. Text between single spaces is encoded once per
worker and memoised (two generations of at most ``MEMO`` entries; results do not depend on it).

Defined results: a null or empty text encodes to an empty list and decodes to empty bytes; a null
id list decodes to null; repeated rows and extra columns are carried along. Long texts are
encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from logweave.llm.blocks import carrying, map_arrow

MEMO = 250_000
EMIT_IDS = 1 << 19

#: White space of the split pattern's ``\\s`` (Unicode White_Space).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the lowest-ranked neighbouring pair until none is in the vocabulary."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        low = min(pairs)
        if low == 1 << 60:
            break
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _Memo(dict):
    """Value of a key by ``make``; two generations of at most ``limit`` keys, the older one dropped."""

    def __init__(self, make, limit: int | None = None):
        super().__init__()
        self.make = make
        self.limit = limit or MEMO
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class NotSeparable(Exception):
    """A space stands next to other white space, so the text can't be cut at its spaces."""


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.vocabulary[i] = token
        self.length = [len(t) for t in self.vocabulary]
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in self.vocabulary]
        self.pattern = regex.compile(pattern.replace(r"\S", f"[^{_WHITE}]").replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]"))
        self.starts_white = regex.compile(f"[{_WHITE}]")
        self.pairs = _Memo(self._compatible)
        self.pretokens = _Memo(lambda p: array("i", self.encode_pretoken(p.encode())).tobytes())
        self.pieces = _Memo(self._piece)

    def _shorter(self, token: bytes) -> int:
        """Id of the longest token that is a proper prefix, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.ranks:
                return self.ranks[token[:n]]
        return -1

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return merge_by_rank(self.vocabulary[pair[0]] + self.vocabulary[pair[1]], self.ranks) == list(pair)

    def encode_pretoken(self, text: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        if text in self.ranks:
            return [self.ranks[text]]
        length, shorter, pairs = self.length, self.shorter, self.pairs
        longest = [-1] * len(text)
        for end, (token, before) in self.automaton.iter(text.decode("latin-1")):
            longest[end - before] = token  # a later end is a longer match
        dead = bytearray(len(text) + 1)
        found: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not found or pairs[found[-1], token]):
                found.append(token)
                if end == len(text):
                    return found
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: give up the position, and the token before it
                dead[at] = 1
                token = found.pop()
                at -= length[token]
                token = shorter[token]

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``, which stands between single spaces."""
        if piece.isalpha():
            return array("i", self.encode_pretoken(b" " + piece.encode())).tobytes()
        if not piece or self.starts_white.match(piece):
            raise NotSeparable
        first, *rest = self.pattern.findall(" " + piece)
        head = self.pieces[first[1:]] if first[1:].isalpha() else self.pretokens[first]
        return head + b"".join(map(self.pretokens.__getitem__, rest))

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        first, *rest = text.split(" ")
        try:
            head = b"".join(map(self.pretokens.__getitem__, self.pattern.findall(first)))
            return head + b"".join(map(self.pieces.__getitem__, rest))
        except NotSeparable:
            return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()



class ByteDecoder:
    """Bytes of ids, gathered from one buffer of all tokens."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the end of each id's bytes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[ids] - (ends - size), size)
        return self.data[shift + np.arange(len(shift))], ends


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder of a rank file, built once."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


_decoders: dict[str, ByteDecoder] = {}


def decoder(path: str) -> ByteDecoder:
    if path not in _decoders:
        _decoders[path] = ByteDecoder(path)
    return _decoders[path]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column ``text`` by ``ids`` (array of int), other columns carried."""
    names, schema = carrying(df, [c for c in df.columns if c != text], f"`{ids}` array<int>")
    df = df.select(*(f"`{c}`" for c in names), text)
    at = others = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            done, parts, size = 0, [], 0
            for row, value in enumerate(batch.column(at)):
                parts.append(bpe.encode_bytes(value.as_py() or ""))
                size += len(parts[-1])
                if size >= 16 * EMIT_IDS or row + 1 == batch.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
                    own = batch.slice(done, len(parts))
                    columns = own.columns[:others] + [pa.ListArray.from_arrays(pa.array(offsets), values)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, ids])
                    done, parts, size = row + 1, [], 0

    return map_arrow(df, run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of each row's ids; all columns carried."""
    names, schema = carrying(df, df.columns, f"`{decoded}` binary")
    df = df.select(*(f"`{c}`" for c in names))
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder(path)
        for batch in batches:
            column = batch.column(at)
            offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            first = 0
            while first < len(column):  # rows of about EMIT_IDS ids
                last = int(np.searchsorted(offsets, offsets[first] + EMIT_IDS, side="right")) - 1
                last = min(max(last, first + 1), len(column))
                data, ends = tokens.decode(values[offsets[first] : offsets[last]])
                cuts = np.concatenate([[0], ends])[offsets[first : last + 1] - offsets[first]].astype(np.int64)
                part = batch.slice(first, last - first)
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                rows = pa.compute.if_else(part.column(at).is_valid(), rows.cast(pa.binary()), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*names, decoded])
                first = last

    return map_arrow(df, run, schema)
