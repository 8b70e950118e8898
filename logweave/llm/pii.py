"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans are the exact patterns (email, ip, card, phone) and always stay. A wider candidate
search also proposes written-out addresses (``name at host dot org``), spaced ``@`` signs, national
phone numbers and card-like groups. On every candidate a panel of labelers votes 1 (personal),
-1 (not) or 0 (abstains): the strict pattern, a gazetteer of endings and issuer prefixes, words before
the span, words that speak against it, checksums and shapes. The votes of the whole corpus are
counted per (kind, vote and feature pattern) by Spark; expectation-maximisation over those counts
estimates each labeler's reliability, and a logistic span classifier is fitted on the resulting
probabilities. A candidate outside base spans is added if the classifier gives ``THRESHOLD``.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated
rows each get their row; extra columns are carried; an empty table gives an empty result. Long texts
are searched whole, in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.blocks import carrying, map_arrow, small_batches

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.95
CONTEXT = 40

#: Address endings, words that announce a kind, and words that speak against it.
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu".split())
ANNOUNCE = {
    "email": frozenset("email e-mail mail contact write correo courriel".split()),
    "ip": frozenset("ip address host server addr".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono".split()),
}
AGAINST = frozenset("version v release isbn issn doi rfc section chapter order invoice token key sha hash build".split())

LABELERS = ("strict", "gazetteer", "announced", "contradicted", "checksum", "shape")

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin inside a run of digits, so the look-behinds only save work
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[]\x20?at\x20?[)\]]\x20?|\x20at\x20|\x20@\x20)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's exact spans, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:  # the local part is the whole run before the sign, the domain what follows it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _AT_DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            found.append(("email", start, done))
        # the next sign's local part starts after this one in any case
        done = max(done, at + 1)
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans (True) and the wider proposals outside them (False)."""
    base = base_spans(text)
    out = [(k, s, e, True) for k, s, e in base]
    wide = [("email", m) for m in _SPELLED.finditer(text)] if " at " in text or "@" in text or "(at" in text or "[at" in text or "( at" in text or "[ at" in text else []
    wide += [("phone", m) for m in _NATIONAL.finditer(text)]
    wide += [("card", m) for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 13 <= len(_digits(m[0])) <= 19]
    begins: list[int] = []  # base spans, overlapping ones as one
    ends: list[int] = []
    for _, start, end in sorted(base, key=lambda b: b[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(start)
            ends.append(end)
    reach = 0  # the end of the last accepted proposal
    for kind, m in sorted(wide, key=lambda x: (x[1].start(), KINDS.index(x[0]))):
        start, end = m.span()
        at = bisect_right(ends, start)
        if start >= reach and (at == len(ends) or begins[at] >= end):
            out.append((kind, start, end, False))
            reach = end
    return out


def votes(text: str, span: tuple[str, int, int, bool]) -> tuple[int, ...]:
    """One vote per labeler: 1 personal, -1 not, 0 abstains."""
    kind, start, end, strict = span
    value = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])][-3:]
    digits = _digits(value)
    gazetteer = checksum = shape = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", value.rstrip(")] ").lower())[-1] in ENDINGS else -1
        shape = 1 if "@" in value or "(" in value or "[" in value else -1
    elif kind == "ip":
        shape = 1 if all(len(p) <= 3 for p in value.split(".")) else -1
        checksum = -1 if value.startswith("0.") else 0
    elif kind == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[:1] in "3456" else -1
        shape = 1 if 15 <= len(digits) <= 16 else -1
    else:
        shape = 1 if value.startswith(("+", "(")) else 0
        checksum = 1 if len(digits) >= 10 else -1
    return (
        1 if strict else 0, gazetteer, 1 if any(w in ANNOUNCE[kind] for w in before) else 0,
        -1 if any(w in AGAINST for w in before) else 0, checksum, shape,
    )


# --- expectation-maximisation over vote counts, and the span classifier -----------------


def reliabilities(patterns: np.ndarray, counts: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-class EM: P(vote | class) per labeler, the prior, and each pattern's P(personal)."""
    n, panel = patterns.shape
    posterior = np.where(patterns.sum(1) > 0, 0.9, 0.1)
    for _ in range(steps):
        prior = np.clip(np.array([(counts * (1 - posterior)).sum(), (counts * posterior).sum()]) + 1, 1, None)
        prior = prior / prior.sum()
        table = np.zeros((2, panel, 3))
        for cls, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for vote in (-1, 0, 1):
                # a pseudo-count that leans to honest votes fixes which class is "personal"
                honest = 2.0 if vote == (1 if cls else -1) else 1.0
                table[cls, :, vote + 1] = (weight[:, None] * (patterns == vote)).sum(0) + honest
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[None, :] + np.stack([np.log(table[c, np.arange(panel), patterns + 1]).sum(1) for c in (0, 1)], axis=1)
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
    return table, prior, posterior


def _design(patterns: np.ndarray) -> np.ndarray:
    """One-hot votes and a bias."""
    return np.concatenate([np.ones((len(patterns), 1)), *[(patterns == v).astype(float) for v in (-1, 1)]], axis=1)


def fit_classifier(patterns: np.ndarray, counts: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Ridge logistic regression on soft labels; counts weigh in by their logarithm."""
    x, w = _design(patterns), np.zeros(1 + 2 * patterns.shape[1])
    weight = np.log1p(counts) / max(np.log1p(counts).sum(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (weight * (target - p)) - 1e-4 * w)
    return w


def train(docs: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier per kind, from the votes on all candidates of ``docs``."""
    schema = "kind string, " + ", ".join(f"v{i} int" for i in range(len(LABELERS)))

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py() or ""
                rows += [(span[0], *votes(text, span)) for span in candidates(text)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (1 + len(LABELERS))
            arrays = [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", *(f"v{i}" for i in range(len(LABELERS)))])

    keys = ["kind", *(f"v{i}" for i in range(len(LABELERS)))]
    counted = map_arrow(small_batches(docs.select("text")), cast, schema).groupBy(*keys).count().orderBy(*keys).collect()  # at most kinds x 3**labelers rows
    model = {}
    for kind in KINDS:
        rows = [r for r in counted if r["kind"] == kind]
        if rows:
            patterns = np.array([[r[k] for k in keys[1:]] for r in rows])
            counts = np.array([r["count"] for r in rows], float)
            _, _, posterior = reliabilities(patterns, counts)
            model[kind] = fit_classifier(patterns, counts, posterior).tolist()
    return model


def find_spans(text: str, model: dict[str, list[float]], threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and the added, by kind as listed, then start."""
    base, every = [], []
    for span in candidates(text):
        if span[3]:
            base.append(span[:3])
            every.append(span[:3])
        elif span[0] in model:
            score = _design(np.array([votes(text, span)])) @ np.array(model[span[0]])
            if 1 / (1 + np.exp(-score[0])) >= threshold:
                every.append(span[:3])
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans_of(batch: pa.RecordBatch, at: int, model: dict) -> tuple[list, list]:
    texts = [v.as_py() for v in batch.column(at)]
    return texts, [find_spans(t or "", model) for t in texts]


def detect(docs: DataFrame, model: dict[str, list[float]], text: str = "text") -> DataFrame:
    """Replace the text by base_spans and spans (arrays of kind, start, end)."""
    names, schema = carrying(docs, [c for c in docs.columns if c != text], f"base_spans {_SPANS}, spans {_SPANS}")

    def rows(spans) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own] for own in spans], _SPAN_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _spans_of(batch, len(names), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], rows([b for b, _ in found]), rows([a for _, a in found])], names=[*names, "base_spans", "spans"])

    return map_arrow(small_batches(docs.select(*(f"`{c}`" for c in names), text)), run, schema)


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask(docs: DataFrame, model: dict[str, list[float]], text: str = "text") -> DataFrame:
    """The same rows and columns, personal data in the text masked (a null text stays null)."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _spans_of(batch, at, model)
            masked = [mask_text(t, spans) if spans else t for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(small_batches(docs), run, docs.schema)
