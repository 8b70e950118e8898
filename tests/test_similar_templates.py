"""Similarity templates and wildcard lookup against plain pairwise definitions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators import similar_templates as ST
from logweave.operators.components import connected_components


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    least = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return least


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_label_spreading(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(120)]  # a long path
    edges += [(2000, 2001 + i) for i in range(300)] + [(3000, 3000)]  # a hub, a loop
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == plain_components(edges)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def similar(a: list[str], b: list[str]) -> bool:
    head = lambda x: [ST.WILDCARD if re.search("[0-9]", t) else t for t in x[:2]]
    if len(a) != len(b) or head(a) != head(b):
        return False
    return 100 * sum(x == y for x, y in zip(a, b, strict=True)) >= 90 * len(a)


def plain_learn(texts):
    lines = sorted({t for t in texts if t is not None})
    tokens = {t: t.split() for t in lines}
    edges = [(a, b) for i, a in enumerate(lines) for b in lines[i:] if similar(tokens[a], tokens[b])]
    comp = plain_components(edges)
    members = {}
    for t in lines:
        members.setdefault(comp[t], []).append(tokens[t])
    shown = {c: " ".join(col[0] if len(set(col)) == 1 else ST.WILDCARD for col in zip(*rows, strict=True)) for c, rows in members.items()}
    return {t: shown[comp[t]] for t in lines}


def some_lines(seed: int, n: int) -> list[str | None]:
    draw = random.Random(seed)
    shapes = []
    for length in (3, 9, 10, 11, 19, 20, 21, 30, 33):
        for s in range(3):
            shapes.append((length, [f"w{draw.randrange(6)}x" if i > 1 else f"head{'7' * (s == 2)}{s}" for i in range(length)]))
    out = []
    for _ in range(n):
        length, shape = draw.choice(shapes)
        line = list(shape)
        for _ in range(draw.randrange(0, 4)):
            line[draw.randrange(length)] = draw.choice(["v", "w", f"id{draw.randrange(50)}"])
        out.append(" ".join(line))
    return out + [None, "", "one", out[0] + "  "]


@pytest.mark.parametrize("pairs", [2, 8, 1000])
def test_learned_templates_equal_the_pairwise_definition(spark, pairs):
    texts = some_lines(3, 500)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.template for r in ST.learn(df, pairs=pairs).collect()}
    assert got == plain_learn(texts)


def test_many_values_of_one_statement_cost_edges_not_pairs(spark):
    """3,000 lines differ in two unique values of 20 tokens: no group is compared pairwise."""
    lines = [" ".join(["pay", "INFO"] + [f"word{chr(97 + i)}" for i in range(16)] + [f"u{i}", f"k{i}"]) for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    tokens = df.select(F.md5("text").alias("id"), ST.tokens_of(F.col("text")).alias("tokens"))
    links = ST.similar_links(tokens)
    assert links.count() <= 3000 * 20
    got = {r.template for r in ST.learn(df).collect()}
    assert got == {" ".join(lines[0].split()[:18]) + " <*> <*>"}


def plain_match(texts, templates):
    out = {}
    for text in {t for t in texts if t is not None}:
        tokens = text.split()
        best = []
        for template in templates:
            fixed = template.split(" ")
            if ST.WILDCARD in fixed and len(fixed) == len(tokens) and all(f in (ST.WILDCARD, t) for f, t in zip(fixed, tokens, strict=True)):
                best.append((fixed.count(ST.WILDCARD), template))
        if best:
            out[text] = min(best)[1]
    return out


def test_lookup_equals_checking_every_template(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choices("abc", k=draw.randrange(1, 5))) for _ in range(200)] + [None, "", "zz"]
    templates = [" ".join(draw.choices(["a", "b", "c", ST.WILDCARD], k=draw.randrange(1, 5))) for _ in range(40)]
    templates += [ST.WILDCARD, f"{ST.WILDCARD} {ST.WILDCARD}"]
    got = ST.match(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in templates], "template string"))
    assert {r.text: r.template for r in got.collect()} == plain_match(texts, templates)


def planted_lines(spark):
    base = "pay INFO paid order of user {} with card in shop"
    rows = [("train", base.format(u), i) for i, u in enumerate(["ann", "bob", "ann"])]
    rows += [("train", "pay INFO short line", 3)]
    rows += [("val", base.format("eve"), 4), ("val", base.format("eve").replace("shop", "store"), 5)]
    rows += [("test", base.format("kim"), 6), ("test", "pay INFO short lines", 7), ("test", None, 8)]
    return spark.createDataFrame(rows, "split string, text string, line_no long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def test_later_lines_are_matched_against_the_frozen_dictionary(spark):
    lines = planted_lines(spark)
    assigned = ST.assign_over_splits(lines)
    dictionary = ST.dictionary_over_splits(lines, assigned)
    wild = "pay INFO paid order of user <*> with card in shop"
    own = "pay INFO paid order of user eve with card in store"
    got = [tuple(r) for r in dictionary.orderBy("id").collect()]
    assert got == [(1, wild, 5, 3, True), (2, "pay INFO short line", 1, 1, True), (3, own, 1, 0, False), (4, "pay INFO short lines", 1, 0, False)]
    ids = ST.with_template_ids(lines, assigned, dictionary)
    assert {r.line_no: (r.template_id, r.seen_in_train) for r in ids.collect()} == {
        0: (1, True), 1: (1, True), 2: (1, True), 3: (2, True), 4: (1, True), 5: (3, False), 6: (1, True), 7: (4, False), 8: (None, None)}


def test_learning_from_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert ST.learn(none).collect() == []
    assert ST.match(none, spark.createDataFrame([("a <*>",)], "template string")).collect() == []
    lines = planted_lines(spark).limit(0)
    assert ST.dictionary_over_splits(lines, ST.assign_over_splits(lines)).collect() == []
