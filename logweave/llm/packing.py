"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Texts are tokenised (``tokenizers`` file, one end id 0 after each text); only texts over the
capacity are cut, into full pieces and a shorter last one. Full pieces are sequences of
their own. All other pieces are dealt by hash into blocks of about ``BLOCK_ITEMS``. Every block is packed
by ``ISLANDS`` islands, each a Spark group that breeds its whole population and all generations:

* an individual is a list of bins; the first is best-fit decreasing, the others shuffled best-fit;
* crossover injects whole well-filled bins of one parent into the other, removes the bins that
  hold duplicates of the injected pieces, and best-fits the displaced pieces, largest first;
* mutation dissolves the worst-filled bins and as many drawn ones, and best-fits their pieces shuffled;
* a generation breeds a child of every individual, one by crossover and the others by mutation, and
  the best of parents and children live on;
* after each epoch every island keeps its population and sends its elite to the next island of its block;
* the block's best individual keeps its well-filled bins; the pieces of its worst bins (an eighth
  at most) migrate into a next, smaller round of blocks, until a round is a single block.

Only piece numbers and lengths travel through the search. Defined results: a null or empty text
is one piece holding only the end id; repeated rows are packed once each; extra columns
are carried; an empty table gives an empty result. No piece is dropped.
"""

from __future__ import annotations

import json
import random
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import carrying, map_arrow, small_batches
from logweave.llm.byte_bpe import _Memo
from logweave.session import cut_lineage

CAPACITY = 2048
BLOCK_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 3
POPULATION = 4
WELL_FILLED = 0.995
EMIT_BYTES = 8 << 20
MEMO = 130_000  # words and chunks a worker keeps, twice (later stages share its memory)


# --- tokenising -------------------------------------------------------------------------


class WordTokens:
    """Ids of a text, word by word, memoised; equal to encoding the whole text.

    The tokenizer's normaliser and split pattern never look across white space. A text of ASCII and
    Latin-1 letters is split here by the same pattern and its words merged by the tokenizer's model;
    of any other text the chunks between ASCII white space go through the same, or through the
    tokenizer itself. Strings of special tokens inside a text are ordinary text. ``forget`` drops
    the memos, so a worker that goes on to other work does not hold them.
    """

    #: Fixed value: the tokenizer's split pattern, for lower-case ASCII and Latin-1 letters.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
    PLAIN = re.compile(r"[!-~À-ÿ\t-\r ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes_shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>"
        self.forget()

    def forget(self) -> None:
        self.words = _Memo(self._word, MEMO)
        self.chunks = _Memo(self._chunk, MEMO)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(self.bytes_shown.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.SPLIT.findall(text.lower())))

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.by_word and self.PLAIN.fullmatch(text):
            return self._plain(text)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.by_word and self.PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row per piece: the other columns, then piece, start, length and ids (packed ``<u4``)."""
    names, schema = carrying(docs, [c for c in docs.columns if c != text], "piece int, start long, length long, ids binary")
    docs = docs.select(*(f"`{c}`" for c in names), text)
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(tokenizer)
        end_id = np.zeros(1, "<u4").tobytes()
        for batch in batches:
            rows, pieces, starts, parts, size = [], [], [], [], 0
            for row, value in enumerate(batch.column(at)):
                ids = coder.encode_bytes(value.as_py() or "") + end_id
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start // 4)
                    parts.append(ids[start : start + 4 * capacity])
                size += len(ids)
                if size >= EMIT_BYTES or row + 1 == batch.num_rows:
                    own = batch.take(pa.array(rows, pa.int64()))
                    columns = own.columns[:at]
                    columns += [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "piece", "start", "length", "ids"])
                    rows, pieces, starts, parts, size = [], [], [], [], 0
        coder.forget()

    return map_arrow(small_batches(docs), run, schema)


# --- the search inside one island -------------------------------------------------------


def _fill(members: list[int], lengths: list[int]) -> int:
    return sum(map(lengths.__getitem__, members))


def best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Put each item, in the given order, into the fullest bin that still holds it."""
    by_room: defaultdict[int, list[int]] = defaultdict(list)
    for i, members in enumerate(bins):
        by_room[capacity - _fill(members, lengths)].append(i)
    mask = sum(1 << room for room in by_room)
    for item in items:
        size = lengths[item]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            some = by_room[room]
            i = some.pop()
            if not some:
                mask ^= 1 << room
            bins[i].append(item)
        else:
            room, i = capacity, len(bins)
            bins.append([item])
        room -= size
        some = by_room[room]
        if not some:
            mask |= 1 << room
        some.append(i)
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (a nearly empty bin is easier to dissolve)."""
    return len(bins), -sum([(_fill(members, lengths) / capacity) ** 2 for members in bins])


def crossover(receiver: list[list[int]], donor: list[list[int]], lengths: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """Inject some of the donor's best-filled bins whole; best-fit what they displace."""
    ranked = sorted(donor, key=lambda members: -_fill(members, lengths))
    well = ranked[: max(1, len(ranked) // 2)]
    injected = draw.sample(well, max(1, len(well) // 4))
    held = {m for members in injected for m in members}
    child, displaced = [list(members) for members in injected], []
    for members in receiver:
        if held.isdisjoint(members):
            child.append(list(members))
        else:
            displaced += [m for m in members if m not in held]
    displaced.sort(key=lambda m: -lengths[m])
    return best_fit(child, displaced, lengths, capacity)


def mutation(bins: list[list[int]], lengths: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """Dissolve the worst-filled bins and as many of the others; best-fit their pieces, shuffled, into what stays."""
    ranked = sorted(range(len(bins)), key=lambda i: _fill(bins[i], lengths))
    n = max(1, len(ranked) // 8)
    dissolved = {*ranked[:n], *draw.sample(ranked[n:], min(n, len(ranked) - n))}
    pieces = [m for i, members in enumerate(bins) if i in dissolved for m in members]
    child = [list(members) for i, members in enumerate(bins) if i not in dissolved]
    return best_fit(child, _shuffled(pieces, lengths, draw), lengths, capacity)


def _shuffled(items: list[int], lengths: list[int], draw: random.Random) -> list[int]:
    """Larger ones rather sooner."""
    return sorted(items, key=lambda m: -lengths[m] * (0.7 + 0.3 * draw.random()))


def breed(lengths: list[int], seeds: list[list[list[int]]], capacity: int, seed: int) -> list[list[list[int]]]:
    """The population after all ``GENERATIONS``, best first; ``seeds`` are the one so far and the elites that arrived."""
    draw = random.Random(seed)
    items = sorted(range(len(lengths)), key=lambda m: -lengths[m])
    population = [p for i, p in enumerate(seeds) if p not in seeds[:i]]
    if not population:
        population.append(best_fit([], items, lengths, capacity))
    while len(population) < POPULATION:
        population.append(best_fit([], _shuffled(items, lengths, draw), lengths, capacity))
    born = len(population)
    scored = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda s: s[:2])[:POPULATION]
    for _ in range(GENERATIONS):
        receiver, donor = draw.sample(scored, 2)
        children = [crossover(receiver[2], donor[2], lengths, capacity, draw)]
        children += [mutation(parent[2], lengths, capacity, draw) for parent in scored if parent is not receiver]
        scored += [(fitness(child, lengths, capacity), born + i, child) for i, child in enumerate(children)]
        born += len(children)
        scored = sorted(scored, key=lambda s: s[:2])[:POPULATION]
    return [p for _, _, p in scored]


def evolve(lengths: list[int], seeds: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """The elite of :func:`breed`."""
    return breed(lengths, seeds, capacity, seed)[0]


def _individual(bin_of: np.ndarray) -> list[list[int]]:
    order = np.argsort(bin_of, kind="stable")
    cuts = (np.flatnonzero(np.diff(bin_of[order])) + 1).tolist()
    members = order.tolist()
    return [members[a:b] for a, b in pairwise([0, *cuts, len(members)])] if members else []


def _bin_of(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for i, members in enumerate(bins):
        out[members] = i
    return out


#: ``bins``: the number of the item's bin in every individual, best first.
_SEARCH = "block long, island int, origin int, uid long, length long, bins array<int>"


def _epoch(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        block, island = int(group["block"].iloc[0]), int(group["island"].iloc[0])
        group = group.sort_values("uid", kind="stable")
        own = group[group["origin"] == island]
        parts = [own, *(part for origin, part in group.groupby("origin") if origin != island)]
        seeds = [_individual(bin_of) for part in parts for bin_of in np.stack(part["bins"].to_list()).T]
        population = breed(own["length"].tolist(), seeds, capacity, seed=block * 1009 + island * 31 + len(seeds))
        return own.assign(bins=list(np.stack([_bin_of(bins, len(own)) for bins in population], axis=1)))

    return run


_PLACED = "uid long, sequence_id long, offset long, released boolean, length long"


def _placements(uid: np.ndarray, lengths: list[int], bins: list[list[int]], capacity: int, last: bool) -> pd.DataFrame:
    """Places of a block's items; the worst bins are released unless this is the last round."""
    fill = [sum(lengths[m] for m in members) for members in bins]
    worst = sorted(range(len(bins)), key=lambda i: (fill[i], i))[: max(1, len(bins) // 8)]
    released = set() if last else {i for i in worst if fill[i] < WELL_FILLED * capacity}
    rows = []
    for i, members in enumerate(bins):
        offset = 0
        for m in members:
            rows.append((uid[m], uid[members[0]], offset, i in released, lengths[m]))
            offset += lengths[m]
    return pd.DataFrame(rows, columns=["uid", "sequence_id", "offset", "released", "length"])


def _settle(capacity: int, last: bool):
    """The placements of the best island of a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        best = None
        for _, part in group.groupby("island"):
            part = part.sort_values("uid", kind="stable")
            lengths = part["length"].tolist()
            bins = _individual(part["bin"].to_numpy())
            score = fitness(bins, lengths, capacity)
            if best is None or score < best[0]:
                best = (score, part["uid"].to_numpy(), lengths, bins)
        return _placements(*best[1:], capacity, last)

    return run


# --- the distributed rounds -------------------------------------------------------------


def _one_round(items: DataFrame, n_blocks: int, salt: int, capacity: int) -> DataFrame:
    """Pack (uid, length) in ``n_blocks`` blocks of islands."""
    islands = (
        items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n_blocks)))
        .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
        .select("block", "island", F.col("island").alias("origin"), "uid", "length", F.array().cast("array<int>").alias("bins"))
    )
    epoch = _epoch(capacity)
    for step in range(EPOCHS):
        if step:  # the population stays, and a copy of its elite migrates to the next island of its block
            moved = islands.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
            bins = F.when(F.col("island") == F.col("origin"), F.col("bins")).otherwise(F.slice("bins", 1, 1))
            islands = moved.select("block", "island", "origin", "uid", "length", bins.alias("bins"))
        islands = islands.groupBy("block", "island").applyInPandas(epoch, _SEARCH)
    elites = islands.select("block", "island", "uid", "length", F.element_at("bins", 1).alias("bin"))
    return elites.groupBy("block").applyInPandas(_settle(capacity, n_blocks == 1), _PLACED)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces`` (columns ``length`` and any others)."""
    pieces = cut_lineage(pieces.drop("sequence_id", "offset").withColumn("_piece_uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") >= capacity).select("_piece_uid", F.col("_piece_uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity).select(F.col("_piece_uid").alias("uid"), "length")
    placed, left, salt = full, items.count(), 0
    while left:
        n_blocks = -(-left // BLOCK_ITEMS)
        done = cut_lineage(_one_round(items, n_blocks, salt, capacity), "packed")
        placed = placed.unionByName(done.where(~F.col("released")).select(F.col("uid").alias("_piece_uid"), "sequence_id", "offset"))
        items = done.where("released").select("uid", "length")
        left, salt = items.count(), salt + 1
    return pieces.join(placed, "_piece_uid").drop("_piece_uid")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Tokenise and place: every piece with its ids, sequence and offset."""
    return place(tokenise(docs, tokenizer, capacity, text), capacity)
