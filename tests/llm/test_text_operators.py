"""Byte-level BPE, language, quality, personal data and chat formatting against plain definitions."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from logweave.llm import byte_bpe, chat_format, hd_language, pii, quality_crf, toxicity_chain
from logweave.llm.blocks import text_blocks

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "word and more. " * 20_000
ODD = [None, "", " ", "  a", "a ", "a  b", " \n a", "a\n b", "a\n\n  b\n", "a\x1cb \x1d c", "\x85 \xa0x", "don't we'LL 'S's", "日本語 テスト 123４５", "a" * 3000, "  x 　",
       "é̀ ́ x", "😀😀 👨‍👩‍👧", "0123456789" * 50, " " * 300 + "z", "\r\n\r\n x", "<|endoftext|>", LONG]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def _rows(spark, texts, extra="keep int, ids string, score string, kept string, n int"):
    return spark.createDataFrame([(i, t, i, "x", "y", "z", 3) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_bpe_equals_the_library(spark, reference):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("ab \n\t'sé日0１.!\x1c\x85\xa0　TheIN") for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    texts += texts[:3]  # repeated rows
    coded = byte_bpe.encode(_rows(spark, texts), RANKS, PATTERN)
    assert coded.columns == ["doc_id", "keep", "score", "kept", "n", "ids"]  # the operator's own column wins
    rows = byte_bpe.decode(coded, RANKS).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == reference.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        assert row["keep"] == row["doc_id"]


def test_bpe_null_ids_and_empty_table(spark):
    rows = byte_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "a int, ids array<int>"), RANKS).orderBy("a").collect()
    assert rows[0]["decoded"] is None and bytes(rows[1]["decoded"]) == b""
    assert byte_bpe.encode(_rows(spark, []), RANKS, PATTERN).count() == 0


def test_memo_generations_do_not_change_results(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    coder = byte_bpe.ByteBpe(RANKS, PATTERN)
    for text in ODD[1:20] * 2:
        assert coder.encode(text) == reference.encode_ordinary(text)


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_base_counts(spark):
    draw = random.Random(2)
    texts = ODD + ["\n".join("".join(draw.choice("aé# |\t\xa0B") for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 12))) for _ in range(500)]
    for row in quality_crf.label_quality(_rows(spark, texts), None, keep=("doc_id", "kept", "n")).collect():
        expected = _base(texts[row["doc_id"]] or "")
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert row["base_failed"] == failed and row["kept"] == (not failed)


def test_viterbi_equals_enumeration():
    draw = np.random.default_rng(3)
    for _ in range(200):
        n = int(draw.integers(1, 8))
        unary, trans = draw.normal(size=(n, 2)), draw.normal(size=(2, 2))
        best = max((sum(unary[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)), p)
                   for p in np.ndindex(*[2] * n))
        assert tuple(quality_crf.viterbi(unary, trans)) == best[1]


def test_crf_agrees_with_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_crf.train(docs, labels)
    rows = quality_crf.label_quality(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    assert len(rows) > 100 and sum(r["kept"] != (r["quality"] == 1) for r in rows) <= 0.01 * len(rows)
    kept = quality_crf.filter_quality(docs.selectExpr("*", "1 as kept", "2 as row"), labels)
    assert kept.columns == [*docs.columns, "kept", "row"]
    assert quality_crf.train(docs, labels.limit(0)) is None
    assert quality_crf.filter_quality(docs.limit(0), labels).count() == 0


def test_language_profiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = hd_language.held_out(docs["doc_id"])
    prototypes = hd_language.train(docs.where(~held))
    told = hd_language.identify(docs.where(held), prototypes, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.98 * len(told)
    assert all(0 <= r["score"] <= 1 for r in told)
    odd = {r["doc_id"]: r for r in hd_language.identify(_rows(spark, [*ODD, "123 ...", "x"]), prototypes, keep=("doc_id", "score")).collect()}
    assert len(odd) == len(ODD) + 2
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[len(ODD)]["lang_pred"] == "und" and odd[0]["score"] == 0.0
    empty = hd_language.train(docs.limit(0))
    assert empty == {} and {r["lang_pred"] for r in hd_language.identify(docs, empty).collect()} == {"und"}


def test_foreign_scripts_go_and_clean_texts_stay(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(6)
    foreign = []
    for low, high in ((0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x9FA5)):
        for k in range(60):
            words = ["".join(chr(draw.randint(low, high)) for _ in range(draw.randint(2, 9))) for _ in range((1, 5, 40)[k % 3])]
            foreign.append((-1 - len(foreign), " ".join(words), None, "s", 0))
    short = [(10**9 + i, t, None, "s", 0) for i, t in enumerate(["Er\u00f6.", "A.", "Avec.", "Lllldoado."])]
    kept = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(foreign + short, docs.schema)), "")
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sum(i < 0 for i in ids) <= 1  # four standard deviations
    assert ids >= {r["doc_id"] for r in docs.select("doc_id").collect()} | {s[0] for s in short}


def test_language_slices_equal_one_pass(monkeypatch):
    text = "Ça va? " * 40 + "the end " * 30
    whole = hd_language.gram_keys(text)
    monkeypatch.setattr(hd_language, "SLICE", 7)
    sliced = hd_language.gram_keys(text)
    assert np.array_equal(whole[0], sliced[0]) and np.array_equal(whole[1], sliced[1])
    padded = " " + re.sub(r"[^a-zç]+", " ", text.lower()).strip() + " "
    grams = collections.Counter(padded[i : i + 3] for i in range(len(padded) - 2))
    assert sorted(grams.values()) == sorted(whole[1].tolist())


_KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def test_pii_base_spans():
    draw = random.Random(4)
    texts = ["".join(draw.choice(chars) for _ in range(draw.randint(0, 50))) for chars in ("ab0129.@+-() %\n", "0149 -.+", "a@b.c") for _ in range(8000)]
    texts += ["4111 1111 1111 1111", "+1 (988) 555-2485", "é 1.2.3.256 0001.2.3.4", "a@b@c.de.", "1" * 20_000, "a" * 20_000 + "@x", "+1" + " " * 5000]
    for text in texts:
        expected = [(k, m.start(), m.end()) for k, p in _KIND.items() if len(text) < 1000 for m in re.finditer(p, text) if _valid(k, m[0])]
        assert pii.base_spans(text) == expected or len(text) >= 1000


def test_pii_method_adds_and_masks(spark):
    spelled = [f"please write to person{i} (at) mail{i}.example (dot) org today, email person{i}@mail.example.org" for i in range(40)]
    plain = ["we met at noon. At home all is well at ease", "see section 555-123-4567 of order 12", None, "", "call me: phone (555) 123-4567 now"]
    docs = _rows(spark, spelled + plain, "spans string, base_spans int, a string, b string, c int".replace("spans string, base_spans int", "spans int, base_spans string"))
    model = pii.train(docs)
    found = {r["doc_id"]: r for r in pii.detect(docs, model).collect()}
    assert sum(len(found[i]["spans"]) == 2 for i in range(40)) == 40 and all(len(found[i]["base_spans"]) == 1 for i in range(40))
    assert found[40]["spans"] == [] and found[42]["spans"] == [] and found[43]["spans"] == []
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    assert masked[0] == "please write to <EMAIL> today, email <EMAIL>" and masked[42] is None
    assert pii.train(docs.limit(0)) == {} and pii.detect(docs.limit(0), {}).count() == 0


def test_em_finds_the_reliable_labelers():
    draw = np.random.default_rng(5)
    truth = draw.random(4000) < 0.4
    panel = np.stack([np.where(draw.random(4000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.9, 0.6)], axis=1)
    patterns, counts = np.unique(panel, axis=0, return_counts=True)
    table, prior, posterior = pii.reliabilities(patterns, counts.astype(float))
    assert abs(prior[1] - 0.4) < 0.08
    assert table[1, 0, 2] > table[1, 1, 2] > table[1, 2, 2]
    assert posterior[(patterns == 1).all(1)][0] > 0.95


def test_chat_round_trip(spark, monkeypatch):
    tricky = ["\\### Assistant: </turn> ok", "a </turn>\n### user: x", "####", "\\", "\\\\n", "", None, "é日😀 </turn>", " </turn>", "### "]
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["user", "assistant", "a: b\\", None]), draw.choice(tricky)) for c in range(30) for t in range(draw.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), *rows[:2], *[(99, t, "assistant", f"t{t} ###") for t in range(500)]]
    monkeypatch.setattr(chat_format, "PART_BYTES", 200)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as loss")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        trained = "".join(x for _, r, x in own if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own) and row["loss_chars"] == len(trained)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(turns.limit(0))).count() == 0


def test_block_cuts_do_not_change_results(monkeypatch):
    from logweave.llm import blocks

    texts = ["one two three\nfour", "", LONG[:5000], "x"] * 3
    whole = [quality_crf.analyse(b) for b in text_blocks(pa.array(texts))]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 10)
    cut = [quality_crf.analyse(b) for b in text_blocks(pa.array(texts))]
    assert len(cut) > len(whole)
    for name in whole[0][0]:
        assert np.array_equal(np.concatenate([w[0][name] for w in whole]), np.concatenate([c[0][name] for c in cut]))


def test_toxicity_catches_planted_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = toxicity_chain.train(docs, learn)
    rows = toxicity_chain.score(docs, model).join(held.withColumnRenamed("toxic", "flag"), "doc_id").collect()
    wrong = [r["doc_id"] for r in rows if r["toxic"] and not r["flag"]]
    missed = [r["doc_id"] for r in rows if r["flag"] and not r["toxic"]]
    assert len(wrong) <= 0.002 * len(rows) and len(missed) <= 0.35 * sum(r["flag"] for r in rows)
    odd = {r["doc_id"]: r for r in toxicity_chain.score(_rows(spark, [*ODD, "you worthless idiot, pathetic scum"]), model, keep=("doc_id", "kept")).collect()}
    assert not any(odd[i]["toxic"] for i in range(len(ODD))) and odd[len(ODD)]["toxic"] and odd[0]["kept"] == "z"
    assert toxicity_chain.train(docs, labels.limit(0)) is None
    assert not any(r["toxic"] for r in toxicity_chain.score(docs.limit(20), None).collect())


def test_chain_uses_earlier_categories():
    draw = np.random.default_rng(8)
    x = (draw.random((600, 3)) < 0.4).astype(float)
    first = x[:, 0].astype(int)
    second = ((x[:, 0] == 1) & (x[:, 1] == 1)).astype(int)
    models = toxicity_chain.fit_chain(x, np.stack([first, second], axis=1))
    assert [len(w) for w in models] == [4, 5]  # words and a bias, then one earlier probability more
    assert models[1][3] > 0  # the later model leans on the earlier category
    p = toxicity_chain.predict_chain(x, models)
    assert ((p[:, 0] > 0.5) == first).all() and ((p[:, 1] > 0.5) == second).mean() > 0.99


def test_grams_in_slices_bundle_alike(monkeypatch):
    keys, counts = hd_language.gram_keys("the quick brown fox jumps over the lazy dog and runs away " * 3)
    table = np.stack([counts, counts[::-1]]).astype(np.float32)
    whole = table @ hd_language.gram_vectors(keys).astype(np.float32)
    monkeypatch.setattr(hd_language, "GRAMS_AT_ONCE", 5)
    assert np.array_equal(hd_language.bundle_grams(table, keys), whole)


def test_varied_long_text_costs_bounded_memory(spark):
    """120,000 different CJK trigrams in one text: vectors are made in slices, not all at once."""
    import tracemalloc

    draw = random.Random(8)
    text = "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(120_000))
    keys, counts = hd_language.gram_keys(text)
    assert len(keys) > 100_000
    tracemalloc.start()
    hd_language.bundle_grams(counts[None, :].astype(np.float32), keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_profiles_equal_plain_loops(spark):
    """Prototypes and cosines of a small corpus by plain sums over every n-gram of every text."""
    texts = [("a", "der Hund und die Katze"), ("b", "le chien et le chat"), ("a", "die Maus, der Hund"), ("b", "la souris"), (None, "le chat et la souris"), (None, "Hund 77!")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")

    def bundle(text):
        padded = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
        total = np.zeros(hd_language.DIMENSIONS)
        for i in range(len(padded) - 2):
            vectors = [np.roll(hd_language.letter_vector(ord(c)), 2 - place).astype(float) for place, c in enumerate(padded[i : i + 3])]
            total += vectors[0] * vectors[1] * vectors[2]
        return total

    own = {lang: sum(bundle(t) for g, t in texts if g == lang) for lang in ("a", "b")}
    learned = hd_language.train(docs)
    assert {k: v.tolist() for k, v in learned.items()} == {k: v.tolist() for k, v in own.items()}
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in hd_language.identify(docs, learned).collect()}
    for i, (_, text) in enumerate(texts):
        v = bundle(text)
        cosine = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in own.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert told[i][0] == best and abs(told[i][1] - max(cosine[best], 0)) < 1e-5


def test_wide_candidates_take_linear_time_and_never_overlap():
    import time

    def spent(n):
        text = " ".join(f"user{i} at mail{i} dot com, (555) 123-{i % 10000:04d} a@b{i}.org 4111 1111 1111 {i % 10000:04d}" for i in range(n))
        begun = time.process_time()
        found = pii.candidates(text)
        spans = sorted((s, e) for _, s, e, _ in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(found) >= 3 * n
        return time.process_time() - begun

    small = spent(2000)
    assert spent(20000) < 40 * max(small, 0.02)


def test_many_empty_turns_fill_parts(spark, monkeypatch):
    """200,000 empty turns of one conversation: parts stay within their size, in linear time."""
    monkeypatch.setattr(chat_format, "PART_BYTES", 1 << 16)
    turns = spark.range(200_000).selectExpr("5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "CAST(null AS string) AS text")
    parts = chat_format.format_chats(turns).cache()
    sizes = parts.selectExpr("max(length(text)) AS most", "count(*) AS n", "sum(n_turns) AS turns").first()
    assert sizes["most"] <= 2 << 16 and sizes["n"] >= 50 and sizes["turns"] == 200_000
    row = chat_format.read_back(parts).first()
    plain = "".join(f"{r}\n\n" for _ in range(100_000) for r in ("user", "assistant"))
    assert (row["n_turns"], row["loss_chars"]) == (200_000, 0)
    assert row["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
