"""Fill-in-the-middle, exact top-k and tokenizer alignment against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import align_tokens, fill_in_middle, inner_topk

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- fill in the middle ---------------------------------------------------------------------


def plain_form(text: str, doc_id: object, percent: int = 100, spm_percent: int = 50) -> tuple:
    """(n, form, prefix, middle, output) by the definition, on lists of lines."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def line_texts() -> list[str | None]:
    draw = random.Random(5)
    alphabet = ["\n", "\n", "a", "é", "中", "𝄞", "\x8a", "\x0b", "Ċ", " ", "\r"]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", "\n", "\n\n\n", "x", "<P>", "a\n<S>b\n", "a <\nM>", "<S\nP>\n", "é\n" * 4000, "中" * 50_000]
    return texts + ["".join(draw.choices(alphabet, k=400_000))]


@pytest.mark.parametrize("percent", [100, 60])
def test_rearranged_texts_follow_the_definition_and_come_back(spark, percent):
    rows = list(enumerate(line_texts())) + [(7, "twice\nsame"), (7, "twice\nsame"), (None, "no\nid\nat all\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fill_in_middle.restore(fill_in_middle.rearrange(docs, percent=percent))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect()), key=str)
    wanted = sorted(((i, *plain_form(t or "", i, percent), t or "") for i, t in rows), key=str)
    assert got == wanted
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rearranging_carries_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", 3)], "doc_id long, text string, form string, `odd name` int")
    made = fill_in_middle.rearrange(docs)
    assert made.columns == ["doc_id", "odd name", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.first()["odd name"] == 3
    assert fill_in_middle.restore(fill_in_middle.rearrange(docs.limit(0))).collect() == []
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert fill_in_middle.rearrange(nulls).first().asDict() == {
        "doc_id": None, "n": 0, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": "",
    }


def test_rank_and_select_agree_with_a_loop():
    draw = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 64, 1001):
        data = draw.choice(np.array([10, 11, 138, 9, 0x8A, 0], np.uint8), size)
        marks = fill_in_middle.byte_marks(fill_in_middle.as_words(data), 10)
        at = np.flatnonzero(data == 10)
        assert marks.rank(np.arange(size + 1)).tolist() == [int((data[:i] == 10).sum()) for i in range(size + 1)]
        assert marks.select(np.arange(1, len(at) + 1)).tolist() == at.tolist()


# --- exact top-k ----------------------------------------------------------------------------


def plain_topk(rows: list[tuple], asks, k: int, scale: float) -> list[tuple]:
    """The definition: every score as a Python integer, sorted."""
    ok = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if asks(i)}):
        own = min((np.float32(v).tolist() for i, v in rows if i == q and v is not None and None not in v and all(map(np.isfinite, v))))
        own = [int(np.floor(np.float64(x) * scale)) for x in own]
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(own))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def topk(spark, rows: list[tuple], k: int = 5, partitions: int = 5, scale: float = 256) -> list[tuple]:
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(partitions)
    found = inner_topk.search(table, F.col("vec_id") % 10 == 0, k=k, scale=scale)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, found.collect()))


def test_topk_equals_all_scores_sorted(spark, monkeypatch):
    monkeypatch.setattr(inner_topk, "LEAST_ROWS", 64)  # many shards
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((6, 24))
    vectors = centres[draw.integers(0, 6, 700)] + 0.3 * draw.standard_normal((700, 24))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    assert topk(spark, rows) == plain_topk(rows, lambda i: i % 10 == 0, 5, 256)


def test_topk_of_ties_odd_vectors_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(inner_topk, "LEAST_ROWS", 50)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [0.5, 0.25, -0.125]) for i in range(400)]  # one vector fills the table
    rows += [(1000 + i, [0.5 + i / 64, -1.0, 0.0]) for i in range(40)]
    rows += [(2000, None), (2010, []), (2011, []), (2020, [None, 1.0, 1.0]), (2030, [nan, 1.0, 1.0]), (2040, [inf, 0.0, 0.0]), (2050, [0.0, 0.0, 0.0])]
    rows += [(2060, [1.0, 2.0]), (2061, [3.0, 4.0]), (2070, [1.0] * 5), (None, [9.0, 9.0, 9.0])]
    rows += [(2080, [1.0, 1.0, 0.0]), (2080, [0.0, 1.0, 1.0]), (1001, [0.5, 0.5, 0.5]), (1001, [0.5, 0.5, 0.5])]
    assert topk(spark, rows) == plain_topk(rows, lambda i: i % 10 == 0, 5, 256)
    assert topk(spark, rows, k=1000) == plain_topk(rows, lambda i: i % 10 == 0, 1000, 256)


def test_topk_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21)) + i, 3.0]) for i in range(30)]
    assert topk(spark, rows) == plain_topk(rows, lambda i: i % 10 == 0, 5, 256)
    huge = [(0, [3e38, 0.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0])]
    assert topk(spark, huge, k=2) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_topk_of_nothing(spark):
    assert topk(spark, []) == []
    assert topk(spark, [(0, [1.0])]) == []
    assert topk(spark, [(0, None), (10, [float("nan")])]) == []


# --- alignment ------------------------------------------------------------------------------


def token_texts() -> list[str | None]:
    draw = random.Random(9)
    words = ["the", "don't", "Straße", "naïve", "中文字符", "x=1;", "12345", "\n", "\t", "  ", " ", "'s", "🙂", "<s>", "<0x41>", "<|endoftext|>", "é", "HTTPServer"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 40))) for _ in range(150)]
    texts += ["".join(draw.choices(words, k=12)) for _ in range(100)]
    return texts + [None, "", " ", "\n", " a", "a ", "a  b", "a▁b", "▁", "ab" * 3000, "the of and " * 3000, "﻿x", "a\x00b"]


def plain_alignment(texts: list[str | None]) -> list[dict]:
    """The definition on whole texts: offsets by running sums, pairs by comparing all ends."""
    a, bytes_a = align_tokens.tokens_a(FILES[0])
    b, bytes_b = align_tokens.tokens_b(FILES[1])
    docs = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(v[i] for i in ids) != whole for v, ids in ((bytes_a, ids_a), (bytes_b, ids_b))):
            docs.append({"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "pairs": []})
            continue
        ends_a, ends_b = (np.cumsum([len(v[i]) for i in ids]).tolist() for v, ids in ((bytes_a, ids_a), (bytes_b, ids_b)))
        common = [e for e in ends_a if e in set(ends_b)]
        group_of = lambda e: sum(c < e for c in common)
        if len(common) > 500:
            lookup = np.searchsorted(common, np.arange(max(ends_a) + 1), side="left")
            group_of = lambda e: int(lookup[e])
        groups = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[group_of(e)][side].append(i)
        at_b = {}
        for i, e in zip(ids_b, ends_b, strict=True):
            at_b.setdefault(e, []).append(i)
        pairs = [(i, j) for i, e in zip(ids_a, ends_a, strict=True) for j in at_b.get(e, ())]
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        docs.append({"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": len(groups), "n_links": len(pairs), "groups": shown, "pairs": pairs})
    total = Counter(p for d in docs for p in d["pairs"])
    highest: dict[int, int] = {}
    for (_, j), n in total.items():
        highest[j] = max(highest.get(j, 0), n)
    for d in docs:
        pairs = d.pop("pairs")
        d["n_best"] = sum(total[p] == highest[p[1]] for p in pairs)
        d["count_sum"] = sum(total[p] for p in pairs)
    return docs


@pytest.mark.parametrize("memo", [48 << 20, 20_000])
def test_alignment_equals_whole_text_definition(spark, monkeypatch, memo):
    monkeypatch.setattr(align_tokens, "MEMO_BYTES", memo)
    texts = token_texts() + ["the same row"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    aligned = align_tokens.align(docs, *FILES)
    got = align_tokens.score_links(aligned, align_tokens.link_counts(aligned, *FILES)).orderBy("doc_id").collect()
    for text, row, wanted in zip(texts, got, plain_alignment(texts), strict=True):
        assert {c: row[c] for c in wanted} == wanted, text


def test_stretches_are_cut_or_whole():
    worker = align_tokens.aligner(*FILES)
    assert worker.cuttable
    assert worker.stretches("a b  c\n d") == (["a", "b  c\n d"], False)
    assert worker.stretches("a b c") == (["a", "b", "c"], True)
    assert worker.stretches("\na b")[1] is False
    worker.cuttable = False
    try:
        assert worker.stretches("a b c") == (["a b c"], False)
        assert worker.align(["the cat"])[0][:2] == (2, 2)
    finally:
        worker.cuttable = True


def test_possible_pairs_are_the_suffix_pairs():
    a, b = [b"ab", b"b", b"", b"cab"], [b"b", b"ab", b"x", b"b"]
    wanted = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))
    assert align_tokens.pairs_of(a, b) == wanted


def test_alignment_carries_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "z"), (None, None, 6, "y")], "doc_id long, text string, n_a int, more string")
    aligned = align_tokens.align(docs, *FILES)
    scored = align_tokens.score_links(aligned, align_tokens.link_counts(aligned, *FILES))
    assert scored.columns == ["doc_id", "more", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted((r.more, r.n_a, r.count_sum) for r in scored.collect()) == [("y", 0, 0), ("z", 2, 2)]
    none = align_tokens.align(docs.limit(0), *FILES)
    assert align_tokens.score_links(none, align_tokens.link_counts(none, *FILES)).collect() == []
