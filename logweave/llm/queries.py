"""Registry of the training-data operators: thin queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import (
    align_tokens,
    byte_bpe,
    chat_format,
    collision_ann,
    fill_in_middle,
    hd_language,
    inner_topk,
    packing,
    parity_join,
    pii,
    quality_crf,
    toxicity_chain,
    url_templates,
)
from logweave.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    return collision_ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and the CRF's verdict for every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, _table(spark, sf_dir, "labels"))
    return quality_crf.label_quality(docs, model)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of the bytes decoded from them."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return byte_bpe.decode(coded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; prototypes learn only from documents not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = hd_language.train(docs.where(~hd_language.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    told = hd_language.identify(docs, prototypes)
    return told.select("doc_id", hd_language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: A conversation whose texts hold the template's own control strings.
_TRICKY = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from the formatted output."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = turns.sparkSession.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(cut_lineage(chat_format.format_chats(turns.unionByName(own)), "chats"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-duplicate component of every document."""
    return parity_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in the packed sequences."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(digests)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and toxicity verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity_chain.score(docs, toxicity_chain.train(docs, _table(spark, sf_dir, "labels")))


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document: counts and digest of the base ones, and all spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.train(docs))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest("base_spans").cast("binary"), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document rearranged for fill-in-the-middle and of the text rebuilt from it."""
    made = fill_in_middle.rearrange(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fill_in_middle.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def op12_inner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every vector whose id is divisible by 50."""
    return inner_topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' ids on every document, links scored by their corpus-wide counts."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align_tokens.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), *files)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    kept = cut_lineage(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return align_tokens.score_links(kept, align_tokens.link_counts(kept, *files))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_ann": op1_collision_ann,
    "op2_quality_crf": op2_quality_crf,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_hd_language": op4_hd_language,
    "op5_url_templates": op5_url_templates,
    "op6_chat_format": op6_chat_format,
    "op7_parity_join": op7_parity_join,
    "op8_packing": op8_packing,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_pii": op10_pii,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_inner_topk": op12_inner_topk,
    "op13_align_tokens": op13_align_tokens,
}

_LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>')"

ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRICKY}'
  UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || replace({_ESCAPED.format("role")}, ':', '\:') || ': ' || {_ESCAPED.format("text")} || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op7_parity_join": rf"""
WITH RECURSIVE word_lists AS (
  SELECT doc_id, regexp_extract_all({_LOWER_AZ}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM word_lists
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id""",
    "op11_fill_in_middle": r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
    CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM drawn
), placed AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS lo,
    CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS hi
  FROM cut
), parts AS (
  SELECT doc_id, t, n, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
    "op12_inner_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
