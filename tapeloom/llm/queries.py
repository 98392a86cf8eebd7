"""The queries op1_ ... op10_ and pipeline: thin calls of the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import backoff, bpe, chat, decontaminate, gif, jaccard, ordinal, pii, secrets, toxicity
from tapeloom.llm.common import table
from tapeloom.llm.spans import listed

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _counts(kinds: tuple[str, ...]) -> list:
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_counts(secrets.KINDS[:3]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied", "owners", "repos")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    return ordinal.rate(docs, model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), F.coalesce(F.col("tail") >= 0.5, F.lit(True)).alias("kept"))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.store(table(spark, sf_dir, "documents"))
    row = F.struct("doc_id", "n_bytes", F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"))
    read = gif.decode(stored, carry=row)
    return read.select(
        "carried.doc_id",
        "carried.n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        "carried.media_bytes",
        "carried.media_sha256",
        F.concat_ws(":", F.col("n_frames").cast("string"), F.col("duration_ms").cast("string"), F.array_join(F.col("histogram").cast("array<string>"), ",")).alias("feature"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=fold != 0)
    return toxicity.score(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_counts(pii.KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(-F.col("score") / F.greatest(F.col("n_words"), F.lit(1)), 4).alias("nats_per_word"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _turn_id(turn: Column) -> Column:
    return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))


#: The arguments of an exchange: what a user's turn asks of the assistant.
EXCHANGE = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call, identified by conversation and turn, that follows the user turn two before;
    the assistant's turn after it is its result."""
    turns = table(spark, sf_dir, "conversations")
    calls = turns.filter("role = 'user'").select(
        _turn_id(F.col("turn")).alias("call_id"),
        _turn_id(F.col("turn") - 2).alias("parent_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("arguments"),
    )
    results = turns.filter("role = 'assistant'").select(_turn_id(F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return chat.link(calls, results, EXCHANGE)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_secrets": op1_secrets,
        "op2_quality": op2_quality,
        "op3_stupid_backoff": op3_stupid_backoff,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_tool_calls": op5_tool_calls,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_gif": op7_gif,
        "op8_toxicity": op8_toxicity,
        "op9_decontamination": op9_decontamination,
        "op10_pii": op10_pii,
    }


OP3_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
pos AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM words),
grams AS (
  SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM pos),
c1 AS (SELECT w, count(*) AS n FROM grams GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM grams WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM grams WHERE u IS NOT NULL GROUP BY u, v, w),
total AS (SELECT count(*)::DOUBLE AS n FROM grams),
p AS (
  SELECT g.doc_id, CASE
      WHEN c3.n >= 2 THEN c3.n::DOUBLE / h2.n
      WHEN c2.n >= 2 THEN (CASE WHEN g.u IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END) * c2.n / h1.n
      ELSE (CASE WHEN g.u IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END) * (CASE WHEN g.v IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END) * c1.n / (SELECT n FROM total) END AS s
  FROM grams g JOIN c1 ON c1.w = g.w
  LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN c1 h1 ON h1.w = g.v
  LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN c2 h2 ON h2.v = g.u AND h2.w = g.v),
s AS (SELECT doc_id, count(*) AS n, sum(ln(s)) AS score FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, round(coalesce(s.score, 0), 4) AS score, round(-coalesce(s.score, 0) / greatest(coalesce(s.n, 0), 1), 4) AS nats_per_word
FROM documents d LEFT JOIN s USING (doc_id)
"""


OP5_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS parent_id, min(coalesce(text, '')) AS text, min(turn) AS turn, count(*) - 1 AS repeats
  FROM conversations WHERE role = 'user' GROUP BY 1, 2),
depths AS (
  SELECT call_id, 0 AS depth FROM calls WHERE parent_id NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, d.depth + 1 FROM calls c JOIN depths d ON c.parent_id = d.call_id),
answers AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
rows AS (
  SELECT coalesce(c.call_id, a.call_id) AS call_id, c.call_id IS NOT NULL AS called, d.depth, c.text, c.turn, c.repeats, a.content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status
  FROM calls c JOIN depths d USING (call_id) FULL JOIN answers a ON a.call_id = c.call_id)
SELECT call_id, depth::BIGINT AS depth, status, coalesce(repeats, 0)::BIGINT AS repeats,
  '{"arguments":' || CASE WHEN called THEN '{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' ELSE 'null' END
  || ',"call_id":' || to_json(call_id)::VARCHAR || ',"depth":' || coalesce(depth::VARCHAR, 'null') || ',"errors":[],"name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END
  || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS line
FROM rows
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_tool_calls": OP5_SQL, "op3_stupid_backoff": OP3_SQL}
