"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_tools, embedding_dedup, embedding_whitening, jaccard_join, line_dedup, packing, quality_gam, quality_rules, spelling, substring_dedup, toxicity, vector_search
from ._shared import load


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(load(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    back = bpe.decode(ids, ranks, pattern)
    return back.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_gam.score(docs, load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_tools.from_conversations(load(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "kind", "call_id", "linked", "duplicate", "valid_arguments", "order_turn", "order_level", "cyclic", "json")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, load(spark, sf_dir, "labels")).drop("text")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(load(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_embedding_near_dedup, op4_best_fit_packing, op5_substring_dedup, op6_bpe_round_trip, op7_ngram_jaccard_join, op8_quality_classifier, op9_chat_formatting, op10_quality_rules, op11_embedding_whitening, op12_spelling_variants, op13_exact_top_k)}


#: plain_parts() and link() once more; walk has every path along what parts need, up to one that meets a place twice.
_CHAT_SQL = r"""
WITH RECURSIVE p AS (
  SELECT conv_id, turn, role, text, CAST('0x' || substr(md5(coalesce(text, '')), 1, 6) AS BIGINT) AS code, coalesce(length(text), 0) AS size,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind
  FROM conversations
), q AS (
  SELECT *, CAST(CASE WHEN role = 'user' AND code % 11 = 0 THEN turn - 2 WHEN role = 'user' THEN turn WHEN role = 'assistant' THEN turn - 1 END AS VARCHAR) AS call_id,
    CAST(CASE WHEN role = 'user' AND code % 7 = 0 THEN turn + 2 WHEN role = 'user' AND code % 3 <> 0 THEN turn - 2 END AS VARCHAR) AS needed
  FROM p
), ends AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_at, min(turn) FILTER (kind = 'result') AS result_at
  FROM q WHERE call_id IS NOT NULL AND kind <> 'message' GROUP BY ALL
), m AS (
  SELECT q.*, CASE kind WHEN 'call' THEN call_at WHEN 'result' THEN result_at END AS own, CASE kind WHEN 'call' THEN result_at WHEN 'result' THEN call_at END AS mate
  FROM q LEFT JOIN ends USING (conv_id, call_id)
), need AS (
  SELECT conv_id, turn AS v, mate AS u FROM m WHERE kind = 'result' AND own = turn AND mate IS NOT NULL
  UNION SELECT m.conv_id, turn, result_at FROM m JOIN ends e ON m.conv_id = e.conv_id AND m.needed = e.call_id WHERE kind = 'call' AND own = turn AND e.result_at IS NOT NULL
), late AS (SELECT DISTINCT conv_id FROM need WHERE u >= v),
edge AS (SELECT * FROM need SEMI JOIN late USING (conv_id)),
size AS (SELECT conv_id, count(DISTINCT turn) AS places FROM conversations GROUP BY conv_id),
walk AS (
  SELECT conv_id, v, u, CAST(1 AS BIGINT) AS steps FROM edge
  UNION SELECT w.conv_id, w.v, n.u, w.steps + 1 FROM walk w JOIN edge n ON w.conv_id = n.conv_id AND w.u = n.v JOIN size s ON w.conv_id = s.conv_id WHERE w.steps < s.places
), state AS (
  SELECT w.conv_id, v AS turn, max(struct_pack(t := u, l := steps)) AS far, bool_or(steps >= places) AS cyclic FROM walk w JOIN size USING (conv_id) GROUP BY ALL
)
SELECT m.conv_id, m.turn, kind, call_id,
  coalesce(own = m.turn AND mate IS NOT NULL, false) AS linked, coalesce(own <> m.turn, false) AS duplicate,
  CASE WHEN kind = 'call' THEN text IS NOT NULL AND (code % 13 <> 0) END AS valid_arguments,
  CASE WHEN NOT cyclic AND far.t >= m.turn THEN far.t ELSE m.turn END AS order_turn,
  CASE WHEN NOT cyclic AND far.t >= m.turn THEN far.l ELSE 0 END AS order_level, coalesce(cyclic, false) AS cyclic,
  CASE kind
    WHEN 'call' THEN '{"role":' || to_json(role) || ',"tool_call":{"arguments":{"options":{"fields":[true,{"a":null,"b":1.5}],"size":' || size || '},"pages":' || (size // 2) || CASE WHEN size % 2 = 1 THEN '.5' ELSE '' END
      || ',"prompt":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || CASE WHEN code % 13 = 0 THEN '"0' || m.turn || '"' ELSE CAST(m.turn AS VARCHAR) END || '},"id":' || coalesce(CAST(to_json(call_id) AS VARCHAR), 'null') || ',"name":"reply"}}'
    WHEN 'result' THEN '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || to_json(role) || ',"tool_call_id":' || to_json(call_id) || '}'
    ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' END AS json
FROM m LEFT JOIN state s ON m.conv_id = s.conv_id AND m.turn = s.turn
"""


_SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS code
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, q.place AS asked, v.vec_id, v.place, CAST(list_sum(list_transform(list_zip(q.code, v.code), p -> p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON len(q.code) = len(v.code) AND q.place <> v.place
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST, place) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_formatting": _CHAT_SQL, "op13_exact_top_k": _SEARCH_SQL}
