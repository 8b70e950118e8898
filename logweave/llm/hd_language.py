"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector (drawn from a fixed seed and its code point). The vector
of an n-gram binds its letters, each permuted by its place: ``roll(a, 2) * roll(b, 1) * c``. A text
is the bundle (sum) of its n-gram vectors, a language prototype the bundle of all n-grams of its
training texts; the prediction is the prototype with the largest cosine.

Letters are lower-cased; any run of other characters counts as one space, also at both ends.
Prototypes are sums over the whole training table: tasks bundle their own rows, Spark adds the
partial bundles per language and dimension, and only ``languages x DIMENSIONS`` numbers reach
the driver. Long texts are profiled whole, in slices.

Defined results: null text, or a text without a letter, is ``und`` with score 0; equal cosines go
to the alphabetically first language; without training rows every text is ``und``; repeated rows
each get their row; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import carrying, map_arrow, small_batches

DIMENSIONS = 1024
ORDER = 3
SEED = 20_240
#: Cosines of texts without a common n-gram have a standard deviation of 1 / sqrt(DIMENSIONS).
NOISE = 4 / DIMENSIONS**0.5
RARE_LETTER = 0.0001
UNKNOWN = "und"
GROUP_CHARS = 200_000
SLICE = 1_000_000
GRAMS_AT_ONCE = 4096  # n-gram vectors held together

_letters: dict[int, np.ndarray] = {}
_alpha: list[np.ndarray] = []


def _is_alpha() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def letter_vector(code: int) -> np.ndarray:
    """The fixed random vector of a letter or of the space."""
    if code not in _letters:
        bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _letters[code] = (2 * bits - 1).astype(np.int8)
    return _letters[code]


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    """One bound vector per n-gram key (``ORDER`` code points of 21 bits)."""
    out = None
    for place in range(ORDER):
        codes = (keys >> (21 * (ORDER - 1 - place))) & 0x1FFFFF
        known, at = np.unique(codes, return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c)), ORDER - 1 - place) for c in known])
        out = table[at] if out is None else out * table[at]
    return out


def gram_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of a whole text and their counts; none without a letter."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = np.array([32], np.int64)
    any_letter = False
    text = text or ""
    for start in range(0, max(len(text), 1), SLICE):
        codes = np.frombuffer(text[start : start + SLICE].lower().encode("utf-32-le"), "<u4").astype(np.int64)
        letters = _is_alpha()[codes]
        any_letter |= bool(letters.any())
        codes = np.concatenate([tail, np.where(letters, codes, 32)])
        if start + SLICE >= len(text):
            codes = np.append(codes, 32)
        repeat = np.zeros(len(codes), bool)
        repeat[1:] = (codes[1:] == 32) & (codes[:-1] == 32)
        codes = codes[~repeat]
        n = len(codes) - ORDER + 1
        if n > 0:
            own = np.zeros(n, np.int64)
            for place in range(ORDER):
                own = (own << 21) | codes[place : place + n]
            found, times = np.unique(own, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times])).astype(np.int64)
        tail = codes[-(ORDER - 1):]
    return (keys, counts) if any_letter else (keys[:0], counts[:0])


def bundle_grams(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The bundle of each row's n-grams: ``counts`` (rows x keys) times the keys' vectors, which are made
    ``GRAMS_AT_ONCE`` at a time, so a text of any variety costs bounded memory."""
    total = np.zeros((len(counts), DIMENSIONS), np.float64)
    for start in range(0, len(keys), GRAMS_AT_ONCE):
        part = slice(start, start + GRAMS_AT_ONCE)
        total += counts[:, part] @ gram_vectors(keys[part]).astype(np.float32)
    return total


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``GROUP_CHARS``: first row, rows, distinct keys, counts (rows x keys)."""
    first, size, parts = 0, 0, []
    for row, value in enumerate(batch.column(column)):
        text = value.as_py()
        parts.append(gram_keys(text))
        size += len(text or "")
        if size >= GROUP_CHARS or row + 1 == batch.num_rows:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            owner = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
            counts = np.zeros((len(parts), len(keys)), np.float32)
            counts[owner, at] = np.concatenate([c for _, c in parts])
            yield first, len(parts), keys, counts
            first, size, parts = row + 1, 0, []


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each non-null value of ``lang``, bundled over all rows of ``docs``."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, n, keys, counts in _groups(batch, "text"):
                if not len(keys):
                    continue
                own = langs[first : first + n]
                here = sorted(set(own))
                per_lang = np.stack([counts[own == lang].sum(0, dtype=np.float64) for lang in here]).astype(np.float32)
                for lang, total in zip(here, bundle_grams(per_lang, keys), strict=True):
                    sums[lang] = sums.get(lang, 0) + total
        if sums:
            values = pa.array(np.concatenate(list(sums.values())))
            offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * DIMENSIONS)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.ListArray.from_arrays(offsets, values)], names=["lang", "bundle"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = map_arrow(small_batches(rows), bundle, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for lang, at, value in summed.collect():  # languages x DIMENSIONS numbers
        prototypes.setdefault(lang, np.zeros(DIMENSIONS))[at] = value
    return {lang: np.round(prototypes[lang]) for lang in sorted(prototypes)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score (the largest cosine, at least 0) to the columns ``keep``."""
    keep, schema = carrying(docs, keep, "lang_pred string, score double")
    langs = list(prototypes)
    unit = np.stack([p / max(np.linalg.norm(p), 1e-9) for p in prototypes.values()]).astype(np.float32) if langs else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, keys, counts in _groups(batch, "text"):
                names, scores = [UNKNOWN] * n, np.zeros(n)
                if len(keys) and langs:
                    vectors = bundle_grams(counts, keys).astype(np.float32)
                    norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
                    cosine = np.round((vectors @ unit.T).astype(np.float64) / norms[:, None], 6)
                    best = cosine.argmax(1)
                    seen = counts.any(1)
                    names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, seen, strict=True)]
                    scores = np.where(seen, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
                own = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), pa.array(names), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    wanted = [*keep, *(() if "text" in keep else ("text",))]
    return map_arrow(small_batches(docs.select(*(f"`{c}`" for c in wanted))), run, schema)


def alphabets(docs: DataFrame) -> str:
    """The letters that make up ``RARE_LETTER`` of the letters of some ``lang`` at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
                found = np.bincount(codes[_is_alpha()[codes]])
                total = sums.setdefault(lang, np.zeros(0, np.int64))
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
                sums[lang] = total
        for lang, total in sums.items():
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(total[own].astype(np.int64))], names=["lang", "code", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    letters = map_arrow(small_batches(rows), count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).collect()  # languages x letters numbers
    totals: dict[str, int] = {}
    for lang, _, n in letters:
        totals[lang] = totals.get(lang, 0) + n
    return "".join(sorted({chr(code) for lang, code, n in letters if n >= RARE_LETTER * totals[lang]}))


def filter_known(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = NOISE, letters: str = "") -> DataFrame:
    """The documents with a letter that are like a learned language, with their own columns.

    A document stays if its best cosine is ``min_score`` at least, or if at least half of its letters are
    among ``letters``: a text of few n-grams may share none with the prototype of its own language. One
    rule for texts of every length.
    """
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "text")
    told = identify(rows, prototypes, keep=("row",))
    own = F.regexp_replace(F.lower("row.text"), r"[^\p{L}]", "")
    strange = F.length(F.translate(own, letters, "")) if letters else F.length(own)
    familiar = (F.length(own) > 0) & (2 * strange <= F.length(own))
    return told.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= min_score) | familiar)).select("row.*")


def held_out(doc_id: Column) -> Column:
    """Documents that no prototype learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
