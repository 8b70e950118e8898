"""Alignment of two tokenizers' ids on the same bytes, with corpus-wide link counts.

Tokenizer A (byte-level BPE, ``tokenizers`` file) encodes a space and the text, tokenizer B (pieces
with byte fallback, ``sentencepiece`` file) the text, to which it adds that space. Both id lists
become cumulative byte ends. The ends, as keys of two end-to-index dictionaries, are intersected as
hash sets; the sorted common ends slice both lists into groups, and inside each slice the last A and
the last B token, whose ranges end together, are linked.

Neither tokenizer looks across a single space between two other characters, so a text's result is
that of its *stretches* between such spaces, joined; they are memoised (a memo bounded by bytes,
which changes only speed), and new ones are encoded many at a time. Whether a tokenizer file has that property is
tried when it is loaded; if not, texts are aligned whole.

**Bounded tables.** Of two linked tokens one ends with the other's bytes, so the possible pairs
are given by the two vocabularies alone: at most the sum of their tokens' lengths (``pairs_of``
lists them), whatever the corpus. Each task counts its links in a vector over that list, Spark sums the
vectors' entries, and the totals travel back to the tasks as one array of that bounded length.

Defined results: a null or empty text, and a text whose joined A or B bytes are not the space and
the text (a ``\\u2581`` in it, for instance), has no tokens: zeros and an empty groups text. Repeated
rows count once each; extra columns are carried, own columns win on equal names; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.blocks import carrying, map_arrow, small_batches

MEMO_BYTES = 28 << 20  # texts and results a worker keeps, twice
KEEP_CHARS = 256  # longer stretches are not kept
WORK_CHARS = 1 << 20  # texts aligned together
JOINED_CHARS = 4096  # new stretches encoded as one text
EMIT_BYTES = 4 << 20

#: A space between two characters that are no white space: no token of either kind crosses it.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: White space (and the piece mark), which forbids a cut at the space beside it.
_WHITE = frozenset(c for c in [*map(chr, range(0x3001)), "▁"] if c.isspace() or c == "▁")
_UNCUT = [pair for c in sorted(_WHITE) for pair in (c + " ", " " + c)]

#: A stretch that may not stand beside another one after a single space.
_EDGES = re.compile(r"^[\s▁]|[\s▁]$")

_PROBES = ["one two  three\n four\tfive ,6 don't 'tis 7 8.9 été 中文 x", "a b c the of and", "A's 'S ' s жз - -- 1 22 333"]


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes as themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokens_a(path: str) -> tuple[object, list[bytes]]:
    """Tokenizer A and the bytes of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    added = {t["id"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if i in added else bytes(map(alphabet.__getitem__, token))
    return tokenizer, out


def tokens_b(path: str) -> tuple[object, list[bytes]]:
    """Tokenizer B and the bytes of its ids."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    return pieces, out


def pairs_of(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Every pair (A id, B id) of which one token's bytes end with the other's, sorted."""

    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for i, token in enumerate(tokens):
            if token:
                found.setdefault(token, []).append(i)
        return found

    in_a, in_b = by_bytes(a), by_bytes(b)
    pairs = set()
    for token, ids in in_a.items():
        for start in range(len(token)):
            pairs.update((i, j) for j in in_b.get(token[start:], ()) for i in ids)
    for token, ids in in_b.items():
        for start in range(1, len(token)):
            pairs.update((i, j) for i in in_a.get(token[start:], ()) for j in ids)
    return sorted(pairs)


class Aligner:
    """Both tokenizers, the list of possible pairs and the memo of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.bytes_a = tokens_a(path_a)
        self.b, self.bytes_b = tokens_b(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.size_a), len(self.size_b)
        # every id inside and at the end of its part of a group
        self.shown = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        self.pairs = np.array([i * len(self.bytes_b) + j for i, j in pairs_of(self.bytes_a, self.bytes_b)], np.int64)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0
        self.cuttable = all(self._ids(p) == self._joined(p) for p in _PROBES)

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def _joined(self, text: str) -> tuple[list[int], list[int]]:
        parts = [self._ids(s) for s in _CUT.split(text)]
        return [i for x, _ in parts for i in x], [i for _, y in parts for i in y]

    def stretches(self, text: str) -> tuple[list[str], bool]:
        """The text cut where both tokenizers may be cut (every stretch stands after one space), and
        whether every stretch may stand beside any other one."""
        if not self.cuttable:
            return [text], False
        if text[0] in _WHITE or text[-1] in _WHITE or any([pair in text for pair in _UNCUT]):
            return _CUT.split(text), False
        return text.split(" "), True

    def _pieces(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
        """The ids as text with the mark that follows each, group by group, A before B."""
        n_a, n_b = len(self.size_a), len(self.size_b)
        at_a, at_b = a.copy(), b + 2 * n_a
        at_a[ends_a - 1] += n_a
        at_b[ends_b - 1] += n_b
        number = np.arange(len(ends_a))
        group_a = np.repeat(number, np.diff(ends_a, prepend=0))
        group_b = np.repeat(number, np.diff(ends_b, prepend=0))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        return list(map(self.shown.__getitem__, np.concatenate([at_a, at_b])[order].tolist()))

    def _aligned(self, stretches: list[str]) -> list[tuple]:
        """(A ids, B ids, packed pair numbers, groups text) of each stretch, encoded as one text; zeros where the bytes differ."""
        text = " ".join(stretches)
        a, b = self._ids(text)
        whole = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return [self._aligned([s])[0] for s in stretches] if len(stretches) > 1 else [(0, 0, b"", "")]
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        at_a = dict(zip(np.cumsum(self.size_a[ids_a]).tolist(), range(1, len(a) + 1), strict=True))
        at_b = dict(zip(np.cumsum(self.size_b[ids_b]).tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(at_a.keys() & at_b.keys())
        ends_a, ends_b = (np.array(list(map(at.__getitem__, common)), np.int64) for at in (at_a, at_b))
        last = ids_a[ends_a - 1] * len(self.bytes_b) + ids_b[ends_b - 1]
        links = np.searchsorted(self.pairs, last).astype("<i4").tobytes()
        pieces = self._pieces(ids_a, ids_b, ends_a, ends_b)
        if len(stretches) == 1:
            return [(len(a), len(b), links, "".join(pieces)[:-1])]
        sizes = list(map(len, stretches if text.isascii() else [s.encode() for s in stretches]))
        cut = np.searchsorted(np.array(common), np.cumsum(np.array(sizes) + 1))  # the group that ends each stretch
        x, y = ends_a[cut], ends_b[cut]
        n_a, n_b = np.diff(x, prepend=0).tolist(), np.diff(y, prepend=0).tolist()
        g, p = [0, *(cut + 1).tolist()], [0, *(x + y).tolist()]
        return [(i, j, links[4 * g0 : 4 * g1], "".join(pieces[p0:p1])[:-1])
                for i, j, g0, g1, p0, p1 in zip(n_a, n_b, g, g[1:], p, p[1:], strict=False)]

    def _learn(self, beside: set[str], others: set[str]) -> list[str]:
        """Put new stretches into the young memo, from the old one or encoded. Those that may stand ``beside``
        each other are encoded together. Returns the ones too long to stay."""
        passing, together, size = [], [], 0
        for stretch in others:
            if self.cuttable and stretch and not _EDGES.search(stretch):
                beside.add(stretch)
            else:
                passing.append(stretch)
        old, young = self.old.get, self.young
        for stretch in beside:
            value = old(stretch)
            if value is not None:
                young[stretch] = value
                self.held += 400
            elif len(stretch) > KEEP_CHARS:
                passing.append(stretch)
            else:
                together.append(stretch)
                size += len(stretch)
                if size >= JOINED_CHARS:
                    self._remember(together)
                    together, size = [], 0
        if together:
            self._remember(together)
        for stretch in passing:
            young[stretch] = self._aligned([stretch])[0]
        return passing

    def _remember(self, stretches: list[str]) -> None:
        values = self._aligned(stretches)
        self.young.update(zip(stretches, values, strict=True))
        self.held += 350 * len(stretches) + sum([len(v[2]) + len(v[3]) for v in values]) + 2 * sum(map(len, stretches))

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, packed pair numbers, groups text) of each text."""
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        beside: set[str] = set()
        others: set[str] = set()
        cut = []
        for text in texts:
            parts, plain = self.stretches(text) if text else ([], True)
            (beside if plain else others).update(parts)
            cut.append(parts)
        passing = self._learn(beside - self.young.keys(), others - self.young.keys())
        out, value = [], self.young.__getitem__
        for parts in cut:
            n_a, n_b, links, shown = zip(*map(value, parts), strict=True) if parts else ((), (), (), ())
            if 0 in n_a:  # the bytes of a stretch differ
                out.append((0, 0, b"", ""))
            else:
                out.append((sum(n_a), sum(n_b), b"".join(links), ";".join(shown)))
        for stretch in passing:
            del self.young[stretch]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two tokenizer files, built once."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Replace ``text`` by n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and links.

    ``links`` packs one 32-bit number per link: its pair's place in :func:`pairs_of`.
    """
    own = "n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
    names, schema = carrying(docs, [c for c in docs.columns if c != text], own)
    docs = docs.select(*(f"`{c}`" for c in names), f"`{text}`")
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(path_a, path_b)
        for batch in batches:
            rows, texts, size, done, emitted = [], [], 0, 0, 0
            for row, value in enumerate(batch.column(at)):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                last = row + 1 == batch.num_rows
                if size >= WORK_CHARS or last:
                    rows += worker.align(texts)
                    emitted += sum(len(r[2]) + len(r[3]) for r in rows[-len(texts) :])
                    texts, size = [], 0
                if rows and (emitted >= EMIT_BYTES or last):
                    n_a, n_b, links, groups = zip(*rows, strict=True)
                    counts = pa.array([len(x) // 4 for x in links], pa.int64())
                    columns = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), counts, counts, pa.array(groups, pa.string()), pa.array(links, pa.binary())]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(done, len(rows)).columns[:at], *columns],
                        names=[*names, "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                    )
                    done, rows, emitted = done + len(rows), [], 0

    return map_arrow(small_batches(docs), run, schema)


def link_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Corpus-wide count of each linked pair: pair (its number), a, b, n, and whether n is its B id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            numbers, _ = _packed(batch.column(0))
            if len(numbers):
                seen = np.bincount(numbers, minlength=len(total))
                seen[: len(total)] += total
                total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["pair", "n"])

    sums = map_arrow(aligned.select("links"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.array(pairs_of(tokens_a(path_a)[1], tokens_b(path_b)[1]), np.int32).reshape(-1, 2)
    columns = {"pair": np.arange(len(pairs), dtype=np.int32), "a": pairs[:, 0], "b": pairs[:, 1]}
    possible = aligned.sparkSession.createDataFrame(pa.table(columns))
    return sums.join(possible, "pair").withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and each row's number of them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    numbers = np.frombuffer(data, "<i4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, "<i4")
    return numbers, np.diff(offsets) // 4


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Replace ``links`` by n_best (links of their B id's most frequent pairs) and count_sum."""
    found = counts.select("pair", "n", "best").toPandas()  # at most as many rows as the vocabularies allow pairs
    size = int(found["pair"].max()) + 1 if len(found) else 0
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n[found["pair"]], best[found["pair"]] = found["n"], found["best"]
    names, schema = carrying(aligned, [c for c in aligned.columns if c != "links"], "n_best long, count_sum long")
    aligned = aligned.select(*(f"`{c}`" for c in names), "links")
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes = _packed(batch.column(at))
            ends = np.cumsum(sizes)
            columns = []
            for values in (best, n):
                total = np.concatenate([[0], np.cumsum(values[numbers])])
                columns.append(pa.array(total[ends] - total[ends - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=[*names, "n_best", "count_sum"])

    return map_arrow(aligned, run, schema)
