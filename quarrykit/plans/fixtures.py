"""Views over the test tables that stand in for the engine's real inputs, in Spark and in DuckDB SQL with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption table: uid, doc_id, caption, lang, lang_score, width, height, status, source, n_chars, score texts and floats."""
    d = F.col("doc_id")
    s = (d * 7 % 101).cast("string")
    kind = d % 10
    score_text = F.when(kind == 0, F.concat(s, F.lit(","))).when(kind == 1, F.concat(s, F.lit("\nbecause"))).when(kind == 2, F.concat(s, F.lit(".0"))).when(kind == 3, F.lit("")).when(kind == 4, F.concat(F.lit(" "), s)).otherwise(s)
    quality = F.when(d % 31 == 0, F.lit(None).cast("double")).when(d % 29 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 1000.0)
    return read(spark, sf_dir, "documents").select(
        F.md5(d.cast("string")).alias("uid"), "doc_id", F.col("text").alias("caption"), "lang", ((d * 37) % 101 / 100.0).alias("lang_score"),
        ((d * 37) % 900).alias("width"), F.when(d % 23 != 0, (d * 91) % 700).alias("height"),
        F.when(d % 17 == 0, "failed_to_download").otherwise("success").alias("status"), "source", "n_chars", score_text.alias("score_text"), quality.alias("quality_score"),
    )


CAPTIONS = r"""captions AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS uid, doc_id, text AS caption, lang, ((doc_id * 37) % 101) / 100.0 AS lang_score,
    (doc_id * 37) % 900 AS width, CASE WHEN doc_id % 23 <> 0 THEN (doc_id * 91) % 700 END AS height,
    CASE WHEN doc_id % 17 = 0 THEN 'failed_to_download' ELSE 'success' END AS status, source, n_chars,
    CASE doc_id % 10 WHEN 0 THEN CAST(doc_id * 7 % 101 AS VARCHAR) || ',' WHEN 1 THEN CAST(doc_id * 7 % 101 AS VARCHAR) || chr(10) || 'because'
      WHEN 2 THEN CAST(doc_id * 7 % 101 AS VARCHAR) || '.0' WHEN 3 THEN '' WHEN 4 THEN ' ' || CAST(doc_id * 7 % 101 AS VARCHAR) ELSE CAST(doc_id * 7 % 101 AS VARCHAR) END AS score_text,
    CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN CAST('nan' AS DOUBLE) ELSE n_chars / 1000.0 END AS quality_score
  FROM documents)"""

#: The parse of score texts in SQL.
SCORE = r"""CASE WHEN regexp_full_match(trim(trim(split_part(score_text, chr(10), 1), ','), ';'), '\s*[+-]?\d+(_\d+)*\s*') THEN CAST(regexp_replace(trim(trim(split_part(score_text, chr(10), 1), ','), ';'), '[\s_]', '', 'g') AS BIGINT) END"""
INTEGER = r"""CASE WHEN regexp_full_match(score_text, '\s*[+-]?\d+(_\d+)*\s*') THEN CAST(regexp_replace(score_text, '[\s_]', '', 'g') AS BIGINT) END"""


def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id multiset: uids of every third document, those of every sixth twice, and five that no document has."""
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").where(d % 3 == 0).select(F.md5(d.cast("string")).alias("uid"), F.explode(F.array_repeat(F.lit(1), F.when(d % 6 == 0, 2).otherwise(1))).alias("x")).select("uid")
    return rows.unionByName(spark.range(5).select(F.md5(F.concat(F.lit("none-"), F.col("id").cast("string"))).alias("uid")))


SUBSET = """subset AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS uid FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT md5(CAST(doc_id AS VARCHAR)) FROM documents WHERE doc_id % 6 = 0
  UNION ALL SELECT md5('none-' || CAST(i AS VARCHAR)) FROM range(5) t(i))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with ten golds, a prediction, types, group, and probabilities of four classes."""
    d = F.col("doc_id")
    golds = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("a"), (d * k % 4).cast("string")))
    p = F.array(*(((d * (3 + i) + i) % 11) / 10.0 for i in range(4)))
    return read(spark, sf_dir, "documents").select(
        d.alias("question_id"), golds.alias("golds"), F.concat(F.lit("a"), (d % 3).cast("string")).alias("answer"), F.concat(F.lit("q"), (d % 5).cast("string")).alias("question_type"),
        F.concat(F.lit("t"), (d % 3).cast("string")).alias("answer_type"), F.when(d % 13 != 0, F.concat(F.lit("g"), (d % 4).cast("string"))).alias("grp"), F.concat(F.lit("a"), (d * d % 5).cast("string")).alias("gold"),
        F.when(d % 2 == 0, "yes").otherwise("no").alias("yes_gold"), F.when((d * 7) % 5 < 2, "Yes.,").otherwise("no").alias("yes_answer"), p.alias("p"), (d * d % 4).cast("int").alias("cls"), "source",
    )


ANSWERS = """answers AS (
  SELECT doc_id AS question_id, [('a' || CAST(doc_id * k % 4 AS VARCHAR)) FOR k IN [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]] AS golds, 'a' || CAST(doc_id % 3 AS VARCHAR) AS answer,
    'q' || CAST(doc_id % 5 AS VARCHAR) AS question_type, 't' || CAST(doc_id % 3 AS VARCHAR) AS answer_type, CASE WHEN doc_id % 13 <> 0 THEN 'g' || CAST(doc_id % 4 AS VARCHAR) END AS grp,
    'a' || CAST(doc_id * doc_id % 5 AS VARCHAR) AS gold, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS yes_gold, CASE WHEN (doc_id * 7) % 5 < 2 THEN 'Yes.,' ELSE 'no' END AS yes_answer,
    [((doc_id * (3 + i) + i) % 11) / 10.0 FOR i IN [0, 1, 2, 3]] AS p, CAST(doc_id * doc_id % 4 AS INTEGER) AS cls, source
  FROM documents)"""
