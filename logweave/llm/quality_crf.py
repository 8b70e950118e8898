"""Quality rules by line sequence labelling: a linear-chain CRF marks content and boilerplate lines.

A document is a sequence of ``\\n``-split lines that hold a word. Every line gets a small vector
of layout features (letters in upper case, symbol characters, words glued to symbols, column
bars, words in windows that their line repeats, duplicates of an earlier line ...). A two-state linear-chain
conditional random field scores label sequences; Viterbi decoding marks each line *content* or
*boilerplate*, and the share of word characters in content lines decides retention.

Training uses a bounded, documented sample of labelled documents (``MAX_TRAIN_DOCS`` rows of the
labels table of at most ``MAX_TRAIN_CHARS`` characters, chosen by hash): document labels give
first line labels, the lines of rejected documents are relabelled by a logistic model of single lines, and
the likelihood is maximised by gradient steps over exact forward-backward marginals.

Defined results: a null or empty text has no words and fails the base rule; without labelled
rows no line is boilerplate and only the base rule rejects; repeated rows each get their row; extra
columns are carried. Long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import SPACE, Block, carrying, map_arrow, mix, small_batches, text_blocks, window_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
MAX_TRAIN_DOCS = 800
MAX_TRAIN_CHARS = 8_000

#: Fixed value: the symbol characters of the base rule.
SYMBOLS = b"#*$%&|<>"

FEATURES = (
    "bias", "upper_share", "symbol_share", "glued_words", "bar_words", "repeat_share", "duplicate",
    "digit_share", "ends_sentence", "short_line", "exclaim_words", "mean_word",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _case_flags(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper- and lower-case letters, ASCII and the two-byte Latin ones led by 0xC3."""
    after = np.concatenate([[0], data[:-1]]) == 0xC3
    upper = _UPPER[data] | (after & (data >= 0x80) & (data <= 0x9E))
    lower = _LOWER[data] | (after & (data >= 0x9F) & (data <= 0xBF))
    return upper, lower


def repeated_words(words: np.ndarray, docs: np.ndarray, width: int = 3) -> np.ndarray:
    """Flags of the words inside a ``width``-word window that its document holds twice or more."""
    flags = np.zeros(len(words), bool)
    hashes, at = window_hashes(words, docs, width)
    if len(hashes):
        order = np.argsort(keyed := hashes ^ mix(docs[at].astype(np.uint64) + np.uint64(77)), kind="stable")
        ranked = keyed[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        for i in range(width):
            flags[at[order[twice]] + i] = True
    return flags


def analyse(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts per document; features, document index and word characters per line with a word."""
    data = block.data
    starts, ends = block.words()
    word_doc = block.doc_of(starts)
    inside = block.code_points() & ~SPACE[data]
    words = block.hashes(starts, ends)
    repeats = repeated_words(words, word_doc)
    line_s, line_e = block.lines()
    line_doc = block.line_docs()
    first_word = np.searchsorted(starts, line_s)
    n_line_words = np.searchsorted(starts, line_e) - first_word
    full = n_line_words > 0
    line_s, line_e, line_doc, n_line_words, first_word = (x[full] for x in (line_s, line_e, line_doc, n_line_words, first_word))
    keyed = block.hashes(line_s, line_e) ^ mix(line_doc.astype(np.uint64) + np.uint64(99))
    order = np.argsort(keyed, kind="stable")  # stable: the first of equal lines stays first
    duplicate = np.zeros(len(keyed), bool)
    duplicate[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]

    def by_doc(docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(docs, weights, minlength=block.n).astype(np.int64)

    base = {
        "n_words": by_doc(word_doc),
        "word_chars": block.per_doc(inside),
        "n_symbols": block.per_doc(_SYMBOL[data]),
        "n_dup_lines": by_doc(line_doc, duplicate),
        "n_repeat_words": by_doc(word_doc, repeats),
    }
    loops = repeated_words(words, np.searchsorted(line_s, starts, side="right"))  # inside one line
    upper, lower = _case_flags(data)
    chars = np.maximum(block.counts(inside, line_s, line_e), 1)
    n_upper = block.counts(upper, line_s, line_e)
    letters = np.maximum(n_upper + block.counts(lower, line_s, line_e), 1)

    def per_line(word_flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(word_flags)])
        return total[first_word + n_line_words] - total[first_word]

    last = data[ends - 1] if len(ends) else data[:0]
    size = ends - starts
    glued = _SYMBOL[last] & (size > 1)
    bar = (last == ord("|")) & (size == 1)
    exclaim = (last == ord("!")) & (size > 2)
    exclaim[exclaim] = data[ends[exclaim] - 2] == ord("!")
    line_last = last[first_word + n_line_words - 1] if len(line_s) else last
    features = np.stack([
        np.ones(len(line_s)),
        n_upper / letters,
        block.counts(_SYMBOL[data], line_s, line_e) / chars,
        per_line(glued) / np.maximum(n_line_words, 1),
        per_line(bar) / np.maximum(n_line_words, 1),
        per_line(loops) / np.maximum(n_line_words, 1),
        duplicate,
        block.counts(_DIGIT[data], line_s, line_e) / chars,
        line_last == ord("."),
        n_line_words < 4,
        per_line(exclaim) / np.maximum(n_line_words, 1),
        np.minimum(chars / np.maximum(n_line_words, 1), 20) / 10,
    ], axis=1).astype(np.float64) if len(line_s) else np.zeros((0, len(FEATURES)))
    return base, features, line_doc, chars


# --- the conditional random field: states 0 = boilerplate, 1 = content -------------------


def viterbi(unary: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best label sequence of one document; ``unary`` is (lines, 2). Ties go to content."""
    n = len(unary)
    if not n:
        return np.zeros(0, np.int8)
    t00, t01, t10, t11 = transition.ravel().tolist()
    a, b = unary[0].tolist()
    back = []
    for u0, u1 in unary[1:].tolist():
        from0, to0 = (0, a + t00) if a + t00 > b + t10 else (1, b + t10)
        from1, to1 = (0, a + t01) if a + t01 > b + t11 else (1, b + t11)
        back.append((from0, from1))
        a, b = to0 + u0, to1 + u1
    state = 0 if a > b else 1
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return np.array(path[::-1], np.int8)


def _padded(features: np.ndarray, docs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
    _, index, count = np.unique(docs, return_index=True, return_counts=True)
    x = np.zeros((len(count), count.max(), features.shape[1]))
    y = np.zeros((len(count), count.max()), np.int64)
    for i, (at, n) in enumerate(zip(index, count, strict=True)):
        x[i, :n], y[i, :n] = features[at : at + n], labels[at : at + n]
    return x, y, np.arange(count.max())[None, :] < count[:, None]


def fit_lines(features: np.ndarray, labels: np.ndarray, steps: int = 500, rate: float = 0.2, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights of independent lines, both labels weighing the same (Adam)."""
    share = np.array([np.mean(labels == y) for y in (0, 1)])
    weight = 1 / (2 * np.maximum(share[labels], 1e-9)) / len(labels)
    w = np.zeros(features.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = (weight * (labels - p)) @ features - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit_crf(features: np.ndarray, docs: np.ndarray, labels: np.ndarray, start: np.ndarray, steps: int = 80, rate: float = 0.2, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam over exact forward-backward marginals; rows grouped by document.

    ``start`` holds first weights. Returns the weights (features,) of *content against boilerplate* and the 2 x 2 transitions.
    """
    x, y, mask = _padded(features, docs, labels)
    n_docs, length, width = x.shape
    w, trans = start.copy(), np.zeros((2, 2))
    moments = [np.zeros(width), np.zeros(width), np.zeros((2, 2)), np.zeros((2, 2))]
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    n_lines = mask.sum()
    for step in range(1, steps + 1):
        u = np.stack([np.zeros((n_docs, length)), x @ w], axis=2)
        forward, backward = np.zeros((n_docs, length, 2)), np.zeros((n_docs, length, 2))
        forward[:, 0] = u[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(forward[:, t - 1, 0, None] + trans[0], forward[:, t - 1, 1, None] + trans[1]) + u[:, t]
            forward[:, t] = np.where(mask[:, t, None], nxt, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            v = u[:, t + 1] + backward[:, t + 1]
            prev = np.logaddexp(trans[:, 0] + v[:, 0, None], trans[:, 1] + v[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], prev, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p1 = np.exp(forward[..., 1] + backward[..., 1] - z[:, None])
        g_w = np.einsum("dt,dtf->f", np.where(mask, (y == 1) - p1, 0.0), x) / n_lines - ridge * w
        pair = np.exp(forward[:, :-1, :, None] + trans + (u + backward)[:, 1:, None, :] - z[:, None, None, None])
        g_t = (seen - np.where(both[..., None, None], pair, 0.0).sum((0, 1))) / n_lines - ridge * trans
        for k, (param, grad) in enumerate(((w, g_w), (trans, g_t))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad**2
            param += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return w, trans


def _unary(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.stack([np.zeros(len(features)), features @ w], axis=1)


def decode(features: np.ndarray, line_doc: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Viterbi labels of all lines (grouped by document); without a model all are content."""
    if model is None:
        return np.ones(len(features), np.int8)
    unary = _unary(features, model[0])
    cuts = np.flatnonzero(np.diff(line_doc)) + 1
    parts = [viterbi(part, model[1]) for part in np.split(unary, cuts)] if len(features) else []
    return np.concatenate(parts) if parts else np.zeros(0, np.int8)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit the CRF on at most ``max_docs`` labelled texts of at most ``max_chars`` characters."""
    labelled = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    short = docs.where(F.length("text") <= max_chars)
    there = labelled.join(short.select("doc_id"), "doc_id").distinct()  # ids only are shuffled
    half = max(1, max_docs // 2)
    rows = []
    for value in (0, 1):  # two bounded top-n reads of ids, then of the texts they name
        ids = there.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).collect()
        texts = short.where(F.col("doc_id").isin([r["doc_id"] for r in ids])).groupBy("doc_id").agg(F.min("text").alias("text"))
        rows += [(r["text"], value) for r in texts.orderBy("doc_id").collect()]
    if len({v for _, v in rows}) < 2:
        return None
    features, line_doc, quality = [], [], []
    for block in text_blocks(pa.array([t for t, _ in rows], pa.string())):
        _, f, d, _ = analyse(block)
        features.append(f)
        line_doc.append(d + block.first)
    features, line_doc = np.concatenate(features), np.concatenate(line_doc)
    quality = np.array([v for _, v in rows])[line_doc]
    # the document's label gives first line labels; independent lines then say which lines of a
    # rejected document look like those of kept ones, and the chain is fitted on the result
    target = quality
    for _ in range(2):
        weights = fit_lines(features, target)
        target = np.where(quality == 1, 1, features @ weights >= 0).astype(int)
        junk = np.bincount(line_doc, target == 0, minlength=len(rows))[line_doc] > 0
        target = np.where(junk, target, quality)
    return fit_crf(features, line_doc, target, weights)


def label_quality(docs: DataFrame, model, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, min_share: float = MIN_CONTENT_SHARE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts, content share and verdict of every whole text; columns ``keep`` are carried."""
    keep, schema = carrying(docs, keep, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double, base_failed boolean, kept boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                base, features, line_doc, chars = analyse(block)
                content = decode(features, line_doc, model) == 1
                own = np.bincount(line_doc, chars * content, minlength=block.n)
                total = np.bincount(line_doc, chars, minlength=block.n)
                share = np.where(total > 0, own / np.maximum(total, 1), 0.0)
                failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat * base["n_words"])
                part = batch.slice(block.first, block.n)
                columns = [part.column(c) for c in keep] + [pa.array(v) for v in base.values()]
                columns += [pa.array(np.bincount(line_doc, minlength=block.n).astype(np.int64)), pa.array(np.bincount(line_doc, content, minlength=block.n).astype(np.int64))]
                columns += [pa.array(share), pa.array(failed), pa.array(~failed & (share >= min_share))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *base, "n_lines", "n_content_lines", "content_share", "base_failed", "kept"])

    wanted = [*keep, *(() if "text" in keep else ("text",))]
    return map_arrow(small_batches(docs.select(*(f"`{c}`" for c in wanted))), run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the method keeps, with their own columns."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "text")
    return label_quality(rows, train(docs, labels), keep=("row",)).where("kept").select("row.*")
