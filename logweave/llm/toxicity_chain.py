"""Toxicity by classifier chains: categories are predicted one after the other.

The chain is ``CATEGORIES`` in order. Each link is a logistic model on the presence of words
and word beginnings (inflected and compound forms), and on the probabilities of all earlier categories; the last category is the overall verdict. In
training the earlier probabilities are *out of fold* (``FOLDS`` folds), so a later model learns how far
an earlier one can be trusted on unseen texts; at prediction they are the earlier models' own outputs.

Labels: the labels table has one flag per document. It is the target of the last link; a
document shows an earlier category if it is flagged and holds a seed word of that category. The words
used as features are the ``VOCABULARY`` ones most associated with the flag. Training reads at most
``MAX_TRAIN_DOCS`` labelled texts of at most ``MAX_TRAIN_CHARS`` characters, picked by hash; prediction
reads every whole text.

Defined results: a null or empty text has no words and gets the models' score without words, never
flagged; without labelled rows of both kinds no text is flagged and all scores are 0; repeated
rows each get their row; extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import carrying, map_arrow

#: Seed words of the categories before the overall one.
SEEDS = {
    "insult": frozenset("idiot moron loser clown fool dumb stupid jerk".split()),
    "contempt": frozenset("worthless pathetic useless hopeless".split()),
    "dehumanising": frozenset("scum trash vermin garbage filth".split()),
    "disgust": frozenset("disgusting revolting repulsive vile".split()),
}
CATEGORIES = (*SEEDS, "toxic")

THRESHOLD = 0.5
FOLDS = 5
VOCABULARY = 256
PREFIXES = (4, 5)
MIN_DOCS = 3
MIN_CHI = 20.0
MAX_TRAIN_DOCS = 2000
MAX_TRAIN_CHARS = 8_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The lower-case words of a text, and their beginnings (``PREFIXES`` letters and a star)."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Weights and a last bias by maximum likelihood. One class alone gives a constant."""
    if y.min(initial=1) == y.max(initial=0):
        return np.append(np.zeros(x.shape[1]), 20.0 if len(y) and y[0] else -20.0)
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        grad = x.T @ (y - _sigmoid(x @ w)) / len(y) - ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category; later ones also weigh the earlier probabilities."""
    fold = np.arange(len(x)) % FOLDS
    earlier = np.zeros((len(x), 0))
    models = []
    for c in range(targets.shape[1]):
        z, y = np.hstack([x, earlier]), targets[:, c]
        models.append(fit_logistic(z, y))
        out_of_fold = np.zeros(len(x))
        for k in range(FOLDS):
            test = fold == k
            w = fit_logistic(z[~test], y[~test], steps=150)
            out_of_fold[test] = _sigmoid(z[test] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return models


def predict_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """Probabilities (rows x categories), each from the words and the earlier probabilities."""
    out = np.zeros((len(x), 0))
    for w in models:
        z = np.hstack([x, out])
        out = np.hstack([out, _sigmoid(z @ w[:-1] + w[-1])[:, None]])
    return out


def choose_words(texts: list[set[str]], flags: np.ndarray) -> list[str]:
    """The words with the largest chi-square against the flag, in at least ``MIN_DOCS`` texts."""
    seen, flagged = collections.Counter(), collections.Counter()
    for words, flag in zip(texts, flags, strict=True):
        seen.update(words)
        if flag:
            flagged.update(words)
    n, p = len(texts), int(flags.sum())

    def chi(word: str) -> float:
        a, b = flagged[word], seen[word] - flagged[word]
        c, d = p - a, n - p - b
        return n * (a * d - b * c) ** 2 / max((a + b) * (c + d) * p * (n - p), 1)

    common = [(chi(w), w) for w, k in seen.items() if k >= MIN_DOCS]
    return [w for x, w in sorted(common, key=lambda f: (-f[0], f[1])) if x >= MIN_CHI][:VOCABULARY]


def _presence(texts: list[set[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)))
    for i, words in enumerate(texts):
        x[i, [vocabulary[w] for w in words & vocabulary.keys()]] = 1
    return x


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> tuple[dict[str, int], list[np.ndarray]] | None:
    """Vocabulary and chain, fitted on a bounded sample of labelled texts (ids are picked first)."""
    labelled = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("flag"))
    short = docs.where(F.length("text") <= max_chars)
    there = labelled.join(short.select("doc_id"), "doc_id").distinct()  # ids only are shuffled
    rows = []
    for value in (0, 1):
        ids = there.where(F.col("flag") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, max_docs // 2)).collect()
        texts = short.where(F.col("doc_id").isin([r["doc_id"] for r in ids])).groupBy("doc_id").agg(F.min("text").alias("text"))
        rows += [(t, value) for t in dict.fromkeys(r["text"] for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").collect())]
    if len({v for _, v in rows}) < 2:
        return None
    texts = [words_of(t) for t, _ in rows]
    flags = np.array([v for _, v in rows])
    vocabulary = {w: i for i, w in enumerate(choose_words(texts, flags))}
    targets = np.stack([*(np.array([int(f and bool(words & seeds)) for words, f in zip(texts, flags, strict=True)]) for seeds in SEEDS.values()), flags], axis=1)
    return vocabulary, fit_chain(_presence(texts, vocabulary), targets)


def score(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add a probability per category (``p_<category>``) and the verdict ``toxic``."""
    keep, schema = carrying(docs, keep, ", ".join([*(f"p_{c} double" for c in CATEGORIES), "toxic boolean"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(v.as_py()) for v in batch.column("text")]
            if model is None:
                p = np.zeros((len(texts), len(CATEGORIES)))
            else:
                p = predict_chain(_presence(texts, model[0]), model[1])
            flagged = (p[:, -1] >= THRESHOLD) & np.array([bool(t) for t in texts], bool)
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(p[:, i]) for i in range(len(CATEGORIES))), pa.array(flagged)], names=[*keep, *(f"p_{c}" for c in CATEGORIES), "toxic"])

    wanted = [*keep, *(() if "text" in keep else ("text",))]
    return map_arrow(docs.select(*(f"`{c}`" for c in wanted)), run, schema)
