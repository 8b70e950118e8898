"""Templates of similar lines: clustering at a similarity, and lookup against a frozen dictionary.

**Clustering** (``learn``). Two lines are similar if they have the same number ``n`` of tokens, agree on
their first two tokens (tokens with a digit count as a placeholder there) and carry the same token at
``PERCENT`` % of all positions at least, that is, differ at ``m = (100 - PERCENT) * n div 100``
positions at most. The clusters are the connected components of similar lines; a cluster's template
has the common token at each position, or ``<*>`` where its lines differ. Lines of fewer than ten
tokens differ nowhere, so exact grouping is their clustering. The result does not depend on the
order of the lines.

No line is compared with all others. Lines that differ at ``m`` positions at most agree on one of
``m + 1`` parts of their positions (pigeonhole), so they share the key of that part. A small group of
lines with one key is compared pair by pair (at most ``PAIRS`` rows per line). In a large one only
the positions at which its lines really vary are open; if these are ``m`` or fewer, the group is
similar as a whole, and one edge from each line to the group's smallest ties it: a statement with
billions of values costs edges, never pairs. Otherwise the open positions are dealt into ``m + 1`` parts
once more, and the group falls into smaller ones. Exact at every size; no group is cut off.

**Lookup** (``match``). A line fits a template if they have as many tokens and agree wherever the
template has one. Each template with wildcards is filed under its rarest fixed token (number of
tokens, position, token); a line asks for each of its tokens by equi-join, and is checked position
by position. The template with most fixed tokens wins, ties to the smaller text.

**Splits** (``dictionary_over_splits``). The train split is learned first and frozen; lines of later
splits take the template of an equal train line, else the best fitting train template, else they are
clustered among the unmatched lines of their split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.components import connected_components
from logweave.operators.ranking import rank_ordered
from logweave.operators.templates import split_rank
from logweave.session import cut_lineage

#: Fixed value: the similarity of two lines of one template, in per cent.
PERCENT = 90
#: Fixed value: leading tokens that similar lines share.
PREFIX = 2
WILDCARD = "<*>"
PAIRS = 32


def tokens_of(text: Column) -> Column:
    """Tokens of a line between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def allowed(n: Column, percent: int = PERCENT) -> Column:
    """Positions at which similar lines of ``n`` tokens may differ."""
    return F.floor(n * (100 - percent) / 100).cast("int")


def differences(a: Column, b: Column) -> Column:
    """Number of positions with different tokens, of equally long arrays."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", *parts))


def _only_varying(group: DataFrame, keep: list[str]) -> DataFrame:
    """Open positions at which all lines of a group agree are closed: no two lines differ there."""
    tokens = group.select("key", F.explode("open").alias("at"), "tokens").withColumn("token", F.get("tokens", F.col("at")))
    spread = tokens.groupBy("key", "at").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    varying = spread.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("low") < F.col("high"), F.col("at")))).alias("open"))
    return group.select("key", *keep, "lead").join(varying, "key")


def _cut_again(group: DataFrame, keep: list[str]) -> DataFrame:
    """Each line once per part of its open positions: the part joins the key and is open no more."""
    parts = group.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m"))))
    of_part = lambda i: F.pmod(i, F.col("m") + 1) == F.col("part")
    joined = F.filter("open", lambda p, i: of_part(i))
    left = F.filter("open", lambda p, i: ~of_part(i))
    shown = F.transform(joined, lambda p: F.concat(p.cast("string"), F.lit(":"), F.get("tokens", p)))
    return parts.select(*keep, _digest(F.col("key"), F.array_join(shown, "\u0001")).alias("key"), left.alias("open"))


def similar_links(lines: DataFrame, percent: int = PERCENT, by: tuple[str, ...] = (), pairs: int = PAIRS) -> DataFrame:
    """Edges ``(a, b)`` between line ids whose components are the clusters of similar lines.

    ``lines``: distinct ``(id, tokens)`` and the columns ``by``, inside which clusters stay."""
    n = F.size("tokens")
    head = F.transform(F.slice("tokens", 1, PREFIX), lambda t: F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t))
    keep = ["id", "tokens", "m"]
    first = _digest(n.cast("string"), F.array_join(head, "\u0001"), *[F.col(c).cast("string") for c in by])
    group = lines.withColumn("m", allowed(n, percent)).where(F.col("m") > 0).select(
        *keep, first.alias("key"), F.sequence(F.lit(0), n - 1).alias("open"))
    found = None
    while True:
        sizes = group.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lead")).where(F.col("size") > 1)
        group = cut_lineage(group.join(sizes, "key"), "similar-groups")
        few = group.where(F.col("size") <= pairs).select("key", *keep)
        other = few.select("key", F.col("id").alias("b"), F.col("tokens").alias("others"))
        near = few.join(other, "key").where((F.col("b") < F.col("id")) & (differences(F.col("tokens"), F.col("others")) <= F.col("m")))
        many = _only_varying(group.where(F.col("size") > pairs), keep)
        whole = F.size("open") <= F.col("m")
        stars = many.where(whole & (F.col("id") != F.col("lead"))).select(F.col("id").alias("a"), F.col("lead").alias("b"))
        links = stars.unionByName(near.select(F.col("id").alias("a"), "b")).distinct()
        found = links if found is None else found.unionByName(links)
        many = many.where(~whole)
        if many.isEmpty():
            return found
        group = _cut_again(many, keep)


def learn(texts: DataFrame, text: str = "text", percent: int = PERCENT, by: tuple[str, ...] = (), pairs: int = PAIRS) -> DataFrame:
    """``(by..., text, template)`` for every distinct line text; null texts are left out."""
    own = texts.where(F.col(text).isNotNull()).select(*by, F.col(text).alias("text")).distinct()
    own = own.select("*", tokens_of(F.col("text")).alias("tokens"))
    lines = cut_lineage(own.select("*", _digest(F.col("text"), *[F.col(c).cast("string") for c in by]).alias("id")), "lines")
    cluster = connected_components(similar_links(lines.select("id", "tokens", *by), percent, by, pairs))
    cluster = cluster.select(F.col("node").alias("id"), "component")
    linked = cut_lineage(lines.join(cluster, "id"), "clusters")
    per_place = linked.select("component", F.posexplode("tokens").alias("at", "token")).groupBy("component", "at").agg(
        F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(WILDCARD).alias("token"))
    # one row per token of the template
    common = per_place.groupBy("component").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "token"))), lambda e: e["token"]), " ").alias("template"))
    alone = lines.join(cluster, "id", "left_anti")
    return linked.join(common, "component").select(*by, "text", "template").unionByName(
        alone.select(*by, "text", F.array_join("tokens", " ").alias("template")))


def match(texts: DataFrame, templates: DataFrame, text: str = "text", template: str = "template") -> DataFrame:
    """``(text, template)``: the best fitting template with wildcards of every distinct text that fits one."""
    wild = templates.select(F.col(template).alias("template")).distinct().select("template", F.split("template", " ").alias("fixed"))
    wild = wild.where(F.array_contains("fixed", WILDCARD)).withColumn("n", F.size("fixed"))
    places = wild.select("template", "n", F.posexplode("fixed").alias("at", "token")).where(F.col("token") != WILDCARD)
    often = places.groupBy("n", "at", "token").agg(F.count("*").alias("often"))
    anchors = places.join(often, ["n", "at", "token"]).groupBy("template").agg(
        F.min_by(F.struct("at", "token"), F.struct("often", "at")).alias("anchor"))
    filed = wild.join(anchors, "template", "left").select(
        "n", F.coalesce("anchor.at", F.lit(-1)).alias("at"), F.coalesce("anchor.token", F.lit("")).alias("token"), "template", "fixed")
    asked = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    asked = asked.select("text", tokens_of(F.col("text")).alias("tokens"))
    every = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("token"))),
                     F.transform("tokens", lambda t, i: F.struct(i.alias("at"), t.alias("token"))))
    asks = asked.select("text", "tokens", F.size("tokens").alias("n"), F.inline(every))
    misfit = F.exists(F.zip_with("fixed", "tokens", lambda f, t: (f != WILDCARD) & (f != t)), lambda d: d)
    fits = asks.join(filed, ["n", "at", "token"]).where(~misfit)
    n_wild = F.size(F.filter("fixed", lambda f: f == WILDCARD))
    return fits.groupBy("text").agg(F.min_by("template", F.struct(n_wild.alias("n_wild"), "template")).alias("template"))


def assign_over_splits(lines: DataFrame, split: str = "split", text: str = "text", train: str = "train",
                       percent: int = PERCENT) -> DataFrame:
    """``(split, text, template)`` of every distinct line text of every split."""
    seen = cut_lineage(lines.where(F.col(text).isNotNull()).select(
        F.col(split).alias("split"), F.col(text).alias("text")).distinct(), "split-texts")
    learned = cut_lineage(learn(seen.where(F.col("split") == train), percent=percent), "learned")
    later = seen.where(F.col("split") != train).join(learned, "text", "left").withColumnRenamed("template", "equal")
    rest = later.where(F.col("equal").isNull())
    fitting = match(rest, learned).withColumnRenamed("template", "fitting")
    placed = cut_lineage(later.join(fitting, "text", "left").select(
        "split", "text", F.coalesce("equal", "fitting").alias("template")), "placed")
    own = learn(placed.where(F.col("template").isNull()).select("split", "text"), percent=percent, by=("split",))
    return (learned.select(F.lit(train).alias("split"), "text", "template")
            .unionByName(placed.where(F.col("template").isNotNull())).unionByName(own))


def dictionary_over_splits(lines: DataFrame, assigned: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """id (from 1: train templates by first line, then those of later splits in split order), text, count,
    train_count, seen_in_train of every template. ``lines`` also holds ``ts`` and ``line_no``."""
    placed = lines.withColumnRenamed(text, "_text").join(
        assigned.select(F.col("split").alias(split), F.col("text").alias("_text"), "template"), [split, "_text"])
    first = F.min(F.struct(split_rank(split).alias("split"), F.col("ts").alias("ts"), F.col("line_no").alias("line_no")))
    found = placed.groupBy("template").agg(
        first.alias("first"), F.count("*").alias("count"), F.count_if(F.col(split) == "train").alias("train_count"))
    ranked = rank_ordered(cut_lineage(found, "dictionary"), [], [F.col("first"), F.col("template")], out="id")
    return ranked.select(F.col("id").cast("long").alias("id"), F.col("template").alias("text"), "count", "train_count",
                         (F.col("train_count") > 0).alias("seen_in_train"))


def with_template_ids(lines: DataFrame, assigned: DataFrame, dictionary: DataFrame, split: str = "split",
                      text: str = "text") -> DataFrame:
    """Every line with ``template``, ``template_id`` and ``seen_in_train``: equi-joins on (split, text)."""
    ids = assigned.join(dictionary.select(F.col("text").alias("template"), F.col("id").alias("template_id"), "seen_in_train"), "template")
    return lines.join(ids.select(F.col("split").alias(split), F.col("text").alias(text), "template", "template_id", "seen_in_train"),
                      [split, text], "left")
