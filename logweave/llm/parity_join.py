"""N-gram Jaccard join by parity sketches: exact links of 80 % and more, and their components.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets with Jaccard
similarity of ``PERCENT`` or more differ in at most ``(|A| + |B|) * (100 - p) / (100 + p)`` shingles.

*Parity sketch.* Shingles are XOR-hashed into bits, so the Hamming distance of two sketches is never
larger than the sets' symmetric difference (equal shingles cancel, each other one flips one bit).
Two forms are used. The join form has ``k`` blocks of 2**64 virtual bits; a block's odd positions are
kept folded in one 64-bit word, and a differing shingle changes one block only. The check form is a
plain bitmap of about two bits per shingle, halved by XOR to compare sketches of different widths.

*Size bands and pigeonhole.* A band holds sets up to ``4**j`` shingles (and those that may pair
with them); all sets of a band use the same ``k`` blocks. Similar sets agree on all but ``d``
blocks, so of any global order of blocks each one's first ``d + 1`` hold one they share. Blocks are ordered
by a fixed-size count sketch of the corpus, rarest first, so passages that many documents share are
not used as keys; an empty block is no key. A set with fewer than ``d + 1`` filled blocks adds
the prefix of its shingles as keys; two such sets meet there.

*Verification.* Equal keys form buckets; of buckets with the same members one is kept. Members are
tested against their bucket's leader, links contract to components, and those left out
try the leaders of four other orders. What a bucket then still holds of different components is compared inside the task, in tiles: only pairs that size and Hamming distance allow are sent
on to the exact intersection. Equal sets are one
node, so copies never pair. Very frequent keys are salted; the salts' leaders meet in a second step.

Contract: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than five words are one shingle.
Defined results: null or blank text has no shingles and is linked with nothing (its component is itself);
rows of a null doc_id keep their set size, have a null component and link nothing; repeated rows
and ids each get their row; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.blocks import Block, map_arrow, mix, mix_int, text_blocks, window_hashes
from logweave.session import cut_lineage

WIDTH = 5
PERCENT = 80
BAND = 4
COUNTERS = 1 << 18
SLICES = 16
SEEN = 500_000
SALT_ROWS = 20_000
LEADER_ORDERS = 4
EMIT_KEYS = 1 << 20
FILTER_BITS = 1 << 24
TILE = 2048

_U = np.uint64


# --- sets and keys of a block of documents ----------------------------------------------


def shingle_sets(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted per document, and the offsets of the documents."""
    starts, ends = block.words()
    words, docs = block.hashes(starts, ends, lower=True), block.doc_of(starts)
    hashes, at = window_hashes(words, docs, width)
    owner = docs[at]
    count = np.bincount(docs, minlength=block.n)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(docs, short)
        extra = [mix_int(sum(mix_int(int(w) + i) for i, w in enumerate(words[f : f + count[s]])) + int(count[s])) for s, f in zip(short, first, strict=True)]
        hashes = np.concatenate([hashes, np.array(extra, _U)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(block.n + 1))


def set_digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit number per set (equal sets, equal numbers); 0 for an empty set."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(0x5E7D)), dtype=_U)])
    sizes = np.diff(offsets)
    out = mix(total[offsets[1:]] - total[offsets[:-1]] + mix(sizes.astype(_U)))
    return np.where(sizes > 0, out, _U(0))


def _blocks_of(size: int) -> int:
    return size // 2 if size >= 256 else 2 * size


def most_different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of similar sets of these sizes."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def join_keys(hashes: np.ndarray, offsets: np.ndarray, counters: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets: the set's index, the 64-bit key and its estimated count.

    Without ``counters`` all filled blocks are returned (to be counted).
    """
    sizes = np.diff(offsets)
    sets, bands = [], []
    upper, lower = BAND, 0
    while len(sizes) and lower <= sizes.max():
        own = np.flatnonzero((100 * sizes > PERCENT * lower) & (sizes <= upper) & (sizes > 0))
        sets.append(own)
        bands.append(np.full(len(own), upper))
        lower, upper = upper, upper * BAND
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    sets, bands = np.concatenate(sets), np.concatenate(bands)
    n = sizes[sets]
    entry = np.repeat(np.arange(len(sets)), n)  # one entry per (set, band)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + offsets[sets][entry]
    h = hashes[at]
    k = np.array([_blocks_of(int(b)) for b in bands], np.int64)
    seed = mix(bands.astype(_U) + _U(11))
    place = (mix(h + seed[entry]) % k[entry].astype(_U)).astype(np.int64)
    order = np.argsort((entry << 32) | place, kind="stable")
    entry, place, h = entry[order], place[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (place[1:] != place[:-1])])) if len(entry) else entry
    word = np.bitwise_xor.reduceat(mix(h ^ _U(0xB10C)), first) if len(first) else h
    entry, place = entry[first], place[first]
    keys = mix(word ^ mix(seed[entry] + place.astype(_U)))
    if counters is None:
        return sets[entry], keys, np.zeros(len(keys), np.int64)
    estimate = counters[(keys & _U(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((keys, estimate, entry))
    entry, keys, estimate = entry[order], keys[order], estimate[order]
    filled = np.bincount(entry, minlength=len(sets))
    rank = np.arange(len(entry)) - np.repeat(np.cumsum(filled) - filled, filled)
    wanted = most_different(n, np.minimum(bands, n * 100 // PERCENT)) + 1
    kept = rank < wanted[entry]
    out = [(sets[entry[kept]], keys[kept], estimate[kept])]
    for s in np.unique(sets[filled < wanted]):  # too few filled blocks: the shingles' own prefix
        own = np.sort(mix(hashes[offsets[s] : offsets[s + 1]] ^ _U(0xFA11)))
        own = own[: len(own) - -(-PERCENT * len(own) // 100) + 1]
        out.append((np.full(len(own), s), own, np.zeros(len(own), np.int64)))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def bitmap(hashes: np.ndarray) -> bytes:
    """Check form of the parity sketch: at least two bits per shingle, a power of two in all."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    place = mix(hashes ^ _U(0xB175)) & _U(bits - 1)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bitmaps, the wider one folded by XOR."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= PERCENT * union, for sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


# --- Spark jobs -------------------------------------------------------------------------


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, set (digest) and n (size) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                hashes, offsets = shingle_sets(block)
                ids = batch.column("doc_id").slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, _long(set_digests(hashes, offsets)), pa.array(np.diff(offsets).astype(np.int64))], names=["doc_id", "set", "n"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, set long, n long")


def count_keys(docs: DataFrame) -> np.ndarray:
    """The count sketch of all blocks: ``COUNTERS`` sums, whatever the input."""
    width = COUNTERS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                _, keys, _ = join_keys(*shingle_sets(block), None)
                total += np.bincount((keys & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = [total[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for part in group["counts"]:
            total += np.frombuffer(part, np.int64)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [total.tobytes()]})

    parts = map_arrow(docs.select("text"), run, "slice int, counts binary")
    rows = parts.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()  # COUNTERS numbers
    out = np.zeros(COUNTERS, np.int64)
    for row in rows:
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return out


def key_rows(docs: DataFrame, counters: np.ndarray) -> DataFrame:
    """key, salt, salts, set and n: the join keys of every distinct set (per task at least)."""
    sent = docs.sparkSession.sparkContext.broadcast(counters)  # COUNTERS numbers
    hot = max(SALT_ROWS, 4 * int(counters.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                hashes, offsets = shingle_sets(block)
                digests = set_digests(hashes, offsets)
                fresh = np.zeros(block.n, bool)
                for i, d in enumerate(digests.tolist()):  # a task sends a copy once
                    fresh[i] = d not in seen
                    seen.add(d)
                if len(seen) > SEEN:
                    seen.clear()
                sizes = np.diff(offsets)
                hashes = hashes[np.repeat(fresh, sizes)]
                digests, sizes = digests[fresh], sizes[fresh]
                own, keys, estimate = join_keys(hashes, np.concatenate([[0], np.cumsum(sizes)]), sent.value)
                salts = 1 + estimate // hot
                salt = (mix(digests[own] ^ _U(0x5A17)) % salts.astype(_U)).astype(np.int64)
                for start in range(0, len(own), EMIT_KEYS):
                    cut = slice(start, start + EMIT_KEYS)
                    yield pa.RecordBatch.from_arrays([
                        _long(keys[cut]), pa.array(salt[cut].astype(np.int32)), pa.array(salts[cut] > 1), _long(digests[own[cut]]), pa.array(sizes[own[cut]].astype(np.int32)),
                    ], names=["key", "salt", "salted", "set", "n"])

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select("text"), run, "key long, salt int, salted boolean, set long, n int")


def _turn(orders: int) -> tuple[Column, Column]:
    """One of ``orders`` hash orders of a bucket's members; equal sets are neighbours."""
    return F.xxhash64("set", F.pmod(F.col("key"), F.lit(orders)), F.lit(orders)), F.col("set")


def _led(rows: DataFrame, orders: int, *by: str) -> DataFrame:
    """Add the leader of each bucket: its first member in one of ``orders`` hash orders."""
    first = Window.partitionBy(*by).orderBy(*_turn(orders)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("leader", F.first("set").over(first)).withColumn("leader_n", F.first("n").over(first))


_LINK = ["key", "set", "n", "leader", "leader_n"]


def bucket_links(rows: DataFrame) -> DataFrame:
    """Every bucket member once, with its leader; buckets of one set vanish, and of the buckets that
    hold the same sets one stays.

    Copies in several tasks give the same row several times. In the order of the leaders they
    stand side by side, so they are dropped there: a repeated link would cancel in ``bit_xor``.
    """
    order = Window.partitionBy("key", "salt").orderBy(*_turn(1))
    led = _led(rows, 1, "key", "salt").withColumn("before", F.lag("set").over(order))
    led = led.where(F.col("before").isNull() | (F.col("before") != F.col("set"))).drop("before")
    kept = cut_lineage(led.where((F.col("set") != F.col("leader")) | F.col("salted")).drop("salt", "salted"), "bucket-links")
    tops = kept.where(F.col("set") == F.col("leader")).select("key", "set", "n").distinct()
    upper = _led(tops, 1, "key").where(F.col("set") != F.col("leader"))
    links = kept.where(F.col("set") != F.col("leader")).select(*_LINK).unionByName(upper.select(*_LINK))
    first, second = F.xxhash64("set", "leader"), F.xxhash64("set", "leader", F.lit(1))
    alike = links.groupBy("key").agg(F.bit_xor(first).alias("x"), F.bit_xor(second).alias("y"), F.count(F.lit(1)).alias("c"))
    alike = alike.groupBy("x", "y", "c").agg(F.min("key").alias("key")).select("key")
    return cut_lineage(links.join(alike, "key", "left_semi"), "buckets")


def _star(links: DataFrame) -> DataFrame:
    return links.select(F.col("set").alias("a"), F.col("n").alias("a_n"), F.col("leader").alias("b"), F.col("leader_n").alias("b_n")).distinct()


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, set, n) of buckets that hold more than one component, with their root."""
    rooted = members.join(roots, "set", "left").select("key", "set", "n", F.coalesce("root", "set").alias("root"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return cut_lineage(rooted.join(keys, "key", "left_semi"), "open-buckets")


def _bit_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` with the hashed values of the only column, whatever their number."""
    bit = F.pmod(F.xxhash64(keys.columns[0]), F.lit(FILTER_BITS))
    words = keys.select(bit.alias("bit")).selectExpr("cast(bit div 64 as int) AS word", "shiftleft(1L, cast(bit % 64 as int)) AS mask")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, mask in words.groupBy("word").agg(F.bit_or("mask")).collect():  # FILTER_BITS / 64 rows at most
        out[word] = mask
    return out.view(_U)


def fetch_sets(docs: DataFrame, sizes: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """set and its ``bitmap`` or ``hashes``, for the wanted sets, computed again from one document each.

    The wanted documents are picked by a bitmap of fixed size; its false hits fall to the join.
    """
    ids = sizes.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    picked = docs.sparkSession.sparkContext.broadcast(_bit_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            mine = (picked.value[bit // 64] >> (bit % 64).astype(_U)) & _U(1)
            for block in text_blocks(batch.column("text").filter(pa.array(mine.astype(bool)))):
                hashes, offsets = shingle_sets(block)
                parts = [hashes[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                values = [bitmap(p) if column == "bitmap" else p.tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([_long(set_digests(hashes, offsets)), pa.array(values, pa.binary())], names=["set", column])

    texts = docs.where(F.col("doc_id").isNotNull()).select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).cast("long").alias("bit"))
    found = map_arrow(texts, run, f"set long, {column} binary").join(wanted, "set", "left_semi").dropDuplicates(["set"])
    return cut_lineage(found, f"set-{column}")


def _sized() -> Column:
    return (100 * F.col("a_n") >= PERCENT * F.col("b_n")) & (100 * F.col("b_n") >= PERCENT * F.col("a_n"))


def _side(sets: DataFrame, name: str, column: str) -> DataFrame:
    return sets.select(F.col("set").alias(name), F.col(column).alias(f"{name}_{column}"))


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and Hamming distance allow a link."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = most_different(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            near = [hamming(x, y) for x, y in zip(batch.column("a_bitmap").to_pylist(), batch.column("b_bitmap").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(near, np.int64) <= limit))

    mapped = pairs.where(_sized()).join(_side(sets, "a", "bitmap"), "a").join(_side(sets, "b", "bitmap"), "b")
    return map_arrow(mapped.select("a", "b", "a_n", "b_n", "a_bitmap", "b_bitmap"), close, "a long, b long")


def exact_pairs(near: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar by exact intersection; only their sets are fetched."""
    near = cut_lineage(near, "near")
    sets = fetch_sets(docs, sizes, near.select(F.col("a").alias("set")).union(near.select("b")).distinct(), "hashes")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(batch.column("a_hashes").to_pylist(), batch.column("b_hashes").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = near.join(_side(sets, "a", "hashes"), "a").join(_side(sets, "b", "hashes"), "b")
    return map_arrow(full.select("a", "b", "a_hashes", "b_hashes"), exact, "a long, b long")


def _fold(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def close_in_tile(sets: np.ndarray, sizes: np.ndarray, roots: np.ndarray, tiles: np.ndarray, maps: list[bytes], apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that sizes and Hamming distance allow; ``apart``: of different tiles only."""
    order = np.argsort(sizes, kind="stable")
    sets, sizes, roots, tiles = sets[order], sizes[order], roots[order], tiles[order]
    widths = np.array([len(maps[i]) for i in order])
    found: tuple[list, list] = ([], [])
    upper = np.searchsorted(sizes, sizes * 100 // PERCENT, side="right")
    by_width = {w: np.frombuffer(b"".join(maps[i] for i in order[widths == w]), np.uint64).reshape(-1, w // 8) for w in np.unique(widths)}
    first = {w: int(np.flatnonzero(widths == w)[0]) for w in by_width}
    for i in range(len(sets)):
        w = widths[i]
        own = by_width[w][i - first[w]]
        others = np.arange(i + 1, upper[i])
        others = others[roots[others] != roots[i]]
        if apart:
            others = others[tiles[others] != tiles[i]]
        for v in np.unique(widths[others]):  # the same width, or the next ones, folded
            at = others[widths[others] == v]
            theirs = by_width[v][at - first[v]]
            while theirs.shape[1] > len(own):
                theirs = _fold(theirs)
            at = at[np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64) <= most_different(sizes[at], sizes[i])]
            found[0].append(np.full(len(at), sets[i]))
            found[1].append(sets[at])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found[0] or empty), np.concatenate(found[1] or empty)


def pairs_in_buckets(members: DataFrame) -> DataFrame:
    """Near pairs (a, b) of different components inside buckets, from (key, set, n, root, bitmap).

    A bucket of more than ``TILE`` sets is cut into tiles by hash; every two tiles meet in a task of
    their own, which compares bitmaps and sends on only what may be a link.
    """
    counts = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    cut = members.join(counts, "key").withColumn("tile", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "set", "n", "root", "bitmap")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            rows = pa.Table.from_batches(parts)
            columns = [rows.column(c).to_numpy() for c in ("set", "n", "root", "tile")]
            return close_in_tile(*columns, rows.column("bitmap").to_pylist(), rows.column("i")[0] != rows.column("j")[0])

        for batch in batches:
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            out = []
            for at in np.split(np.arange(batch.num_rows), cuts):
                now = (key[at[0]], i[at[0]], j[at[0]])
                if held and now != last:
                    out.append(close(held))
                    held = []
                held.append(batch.slice(at[0], len(at)))
                last = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _ in out])), pa.array(np.concatenate([b for _, b in out]))], names=["a", "b"])
        if held:
            a, b = close(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_arrow(ordered, run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """set and root (the smallest set of its component) of every linked set.

    Each round joins every node to its smallest neighbour, follows the pointers twice, and
    contracts the links; written tables cut the lineage.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut_lineage(links, "links")
    roots = links.select(F.col("a").alias("set")).union(links.select("b")).distinct().withColumn("root", F.col("set"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = cut_lineage(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        parent = cut_lineage(parent, "parents")
        up = parent.select(F.col("a").alias("root"), "p")
        roots = cut_lineage(roots.join(up, "root", "left").select("set", F.coalesce("p", "root").alias("root")), "roots")
        for side in ("a", "b"):
            up = parent.select(F.col("a").alias(side), "p")
            links = links.join(up, side, "left").withColumn(side, F.coalesce("p", side)).select("a", "b")
        links = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = cut_lineage(links, "links")
    return roots


def find_links(docs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all similar sets, and the components they give."""
    buckets = bucket_links(key_rows(docs, count_keys(docs)))
    members = buckets.select("key", "set", "n").union(buckets.select("key", "leader", "leader_n")).distinct()
    maps = fetch_sets(docs, sizes, members.select("set").distinct(), "bitmap")
    star = _star(buckets)
    links = cut_lineage(exact_pairs(near_pairs(star, maps), docs, sizes), "verified")
    # members that their leader left out try other leaders of their bucket
    still = open_buckets(members, components(links))
    other = _led(still, LEADER_ORDERS, "key").withColumn("leader_root", F.first("root").over(
        Window.partitionBy("key").orderBy(F.xxhash64("set", F.pmod(F.col("key"), F.lit(LEADER_ORDERS)), F.lit(LEADER_ORDERS)), "set").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    again = _star(other.where(F.col("root") != F.col("leader_root")))
    more = cut_lineage(exact_pairs(near_pairs(again, maps), docs, sizes), "verified")
    links = links.unionByName(more)
    # what is left meets tile by tile
    still = open_buckets(members.join(still.select("key").distinct(), "key", "left_semi"), components(links))
    rest = pairs_in_buckets(still.join(maps, "set"))
    tested = star.unionByName(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = cut_lineage(exact_pairs(rest.join(tested, ["a", "b"], "left_anti"), docs, sizes), "verified")
    links = links.unionByName(last)
    return links, components(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (columns doc_id and text)."""
    sizes = cut_lineage(set_sizes(docs), "set-sizes")
    _, roots = find_links(docs, sizes.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)))
    rooted = sizes.join(roots, "set", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("root"))
    lowest = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(lowest, "root", "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, all columns kept.

    A doc_id that several rows carry stays once at most; rows of a null doc_id all stay. The texts of
    documents that a bitmap of fixed size clears are not shuffled; its false hits fall to the join.
    """
    found = cut_lineage(near_duplicates(docs.select("doc_id", "text")), "components")
    chosen = F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("chosen")
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), chosen)
    # the ids that go, or that several rows carry; only rows that may have one of them are joined
    odd = cut_lineage(ids.where((F.col("chosen") == 0) | (F.col("times") > 1)), "odd-ids")
    marked = docs.sparkSession.sparkContext.broadcast(_bit_filter(odd.select("doc_id")))

    @F.pandas_udf("boolean")
    def may_be_odd(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        return pd.Series(((marked.value[at // 64] >> (at % 64).astype(_U)) & _U(1)).astype(bool))

    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).cast("long")
    candidate = F.col("doc_id").isNotNull() & may_be_odd(bit)
    plain, others = docs.where(~candidate), docs.where(candidate)
    single = others.join(odd.select("doc_id"), "doc_id", "left_anti")
    repeated = others.join(odd.where("chosen = 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return plain.select(*docs.columns).unionByName(single.select(*docs.columns)).unionByName(repeated.select(*docs.columns))
