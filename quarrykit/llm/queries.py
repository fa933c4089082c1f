"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrykit.llm import chat, linedup, minhash, mixing, packing, pii, quality, sketch, suffix, toxicity
from quarrykit.llm.common import WORD, table


#: The key of pseudonyms of test tables; it protects nothing.
TEST_KEY = "quarrykit-test-key"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(extra))


def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.judged(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), TEST_KEY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assigned(table(spark, sf_dir, "documents"))


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprinted(table(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.clustered(table(spark, sf_dir, "documents"), k=2, threshold=0.8)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_chat, op4_linedup, op5_pii, op6_packing, op7_mixing, op8_sketch, op9_suffix, op10_minhash)}


_OP3 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 9) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewrites
  FROM c GROUP BY conv_id"""


def _op7() -> str:
    """Water-filling, then a round of every share in mixing.ROUNDS."""
    same = "IS NOT DISTINCT FROM"
    out = rf"""WITH s0 AS (SELECT row_number() OVER () AS id, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, 0 AS extra FROM documents),
  src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s0 GROUP BY source), w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM src),
  l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {mixing.MAX_EPOCHS} AS DOUBLE)
    / sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  t AS (SELECT source, source_size, least(weight * (SELECT max(level) FROM l), CAST(source_size * {mixing.MAX_EPOCHS} AS DOUBLE)) AS target FROM l),
  g0 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t), r0 AS (SELECT *, target - whole * source_size AS rest FROM g0)"""
    for i, share in enumerate(mixing.ROUNDS):
        out += f""",
  f{i} AS (SELECT s.id, s.source, g.rest, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) AS upto FROM s{i} s JOIN r{i} g ON s.source {same} g.source WHERE s.extra = 0 AND s.size > 0 AND s.size <= g.rest * {share}),
  k{i} AS (SELECT * FROM f{i} WHERE upto <= rest), s{i + 1} AS (SELECT s.* REPLACE (CASE WHEN k.id IS NULL THEN s.extra ELSE 1 END AS extra) FROM s{i} s LEFT JOIN k{i} k ON s.id = k.id),
  r{i + 1} AS (SELECT g.* REPLACE (g.rest - coalesce(x.took, 0) AS rest) FROM r{i} g LEFT JOIN (SELECT source, max(upto) AS took FROM k{i} GROUP BY source) x ON g.source {same} x.source)"""
    n = len(mixing.ROUNDS)
    return out + f"""
  SELECT s.doc_id, s.size, g.source_size, g.target, g.whole + s.extra AS copies, s.size * (g.whole + s.extra) AS taken FROM s{n} s JOIN r{n} g ON s.source {same} g.source"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": _OP3, "op7_mixing": _op7()}
