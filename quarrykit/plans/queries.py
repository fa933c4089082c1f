"""The reference operators as queries, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions import answers as ans
from quarrykit.functions import boxes, scores, text
from quarrykit.operators import batching, filters, packing, prompts, reshard, scorers, tasks, vectors
from quarrykit.plans.fixtures import ANSWERS, CAPTIONS, INTEGER, SCORE, SUBSET, answers, captions, read, subset
from quarrykit.streaming import workers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


HI_LO = "CAST(CAST('0x' || substr(uid, 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS uid_hi, CAST(CAST('0x' || substr(uid, 17, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS uid_lo"
SHAPE = "width IS NOT NULL AND height IS NOT NULL AND least(width, height) >= 10 AND greatest(width, height) <= 4.0 * least(width, height)"
UNICODE_WORDS = r"list_filter(regexp_split_to_array(caption, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda t: t <> '')"


# ----------------------------------------------------------------- filters


@query("p01_no_filter", f"WITH {CAPTIONS} SELECT uid FROM captions")
def _(spark, d):
    return filters.apply("no_filter", captions(spark, d)).select("uid")


@query("p02_basic_filter", f"WITH {CAPTIONS} SELECT {HI_LO} FROM captions WHERE {SHAPE} AND status = 'success'")
def basic_filter(spark, d):
    return filters.sorted_uids(filters.apply("basic_filter", captions(spark, d)))


@query("p04_p06_caption_features", f"""WITH {CAPTIONS} SELECT uid, len({UNICODE_WORDS}) AS n_words, length(caption) AS n_chars,
  len(list_distinct(string_split(caption, ' '))) AS n_distinct, len(string_split(caption, ' ')) AS n_parts, ({SHAPE}) AS shape_ok FROM captions""")
def _(spark, d):
    c = F.col("caption")
    parts = F.split(c, " ")
    return captions(spark, d).select("uid", text.n_words(c).cast("long").alias("n_words"), F.length(c).cast("long").alias("n_chars"), F.size(F.array_distinct(parts)).cast("long").alias("n_distinct"), F.size(parts).cast("long").alias("n_parts"), text.good_shape(F.col("width"), F.col("height")).alias("shape_ok"))


_LANGS = ", ".join(f"('{k}', {v})" for k, v in text.LANGUAGE_THRESHOLDS.items())
_MAIN = ", ".join(f"'{x}'" for x in text.MAIN_LANGUAGES)
_SHIFTED = "CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE 'xx' END"


@query("p08_p09_language_cut", f"""WITH {CAPTIONS}, t(lang, thr) AS (VALUES {_LANGS}), c AS (SELECT uid, lang_score, {_SHIFTED} AS l FROM captions)
  SELECT uid, coalesce(lang_score < thr, true) AS non_english_kept, CASE WHEN l IN ({_MAIN}) THEN lang_score > -1 ELSE lang_score <= 0.2 END AS language_kept FROM c LEFT JOIN t ON t.lang = c.l""")
def _(spark, d):
    k = F.col("doc_id") % 4
    lang = F.when(k == 0, F.col("lang")).when(k == 1, "ja").when(k == 2, "zh").otherwise("xx")
    c = captions(spark, d).withColumn("l", lang)
    return c.select("uid", text.non_english_kept(F.col("l"), F.col("lang_score")).alias("non_english_kept"), text.language_kept(F.col("l"), F.col("lang_score")).alias("language_kept"))


_ODD = """CASE doc_id % 12 WHEN 0 THEN 'IMG_' || caption WHEN 1 THEN 'photo_123' WHEN 2 THEN 'https://a.b/c' WHEN 3 THEN 'rs=w:10,h:20' WHEN 4 THEN 'table 7' WHEN 5 THEN 'Image 0012.JPG'
  WHEN 6 THEN 'e4yf 4a68' WHEN 7 THEN 'menu' WHEN 8 THEN 'DSC_0001 sunset.jpeg' WHEN 9 THEN 'x ii iv 12' ELSE caption END"""


def _odd() -> F.Column:
    k = F.col("doc_id") % 12
    table = {1: "photo_123", 2: "https://a.b/c", 3: "rs=w:10,h:20", 4: "table 7", 5: "Image 0012.JPG", 6: "e4yf 4a68", 7: "menu", 8: "DSC_0001 sunset.jpeg", 9: "x ii iv 12"}
    out = F.when(k == 0, F.concat(F.lit("IMG_"), F.col("caption")))
    for i, v in table.items():
        out = out.when(k == i, v)
    return out.otherwise(F.col("caption"))


def _sql_list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


_BARE = "lower(c)"
for _item in text.REMOVED:
    _BARE = f"replace({_BARE}, '{_item}', '')"
_START = "CASE " + " ".join(f"WHEN starts_with(x, '{w}') THEN {len(w)}" for w in text.START_WORDS) + " ELSE 0 END"
_END = "CASE " + " ".join(f"WHEN ends_with(y, '{w}') THEN {len(w)}" for w in text.END_WORDS) + " ELSE 0 END"
_GOOD = r"""length(t) > 1 AND t NOT IN ('ii', 'iii', 'iv', 'vi', 'vii', 'viii', 'ix') AND length(regexp_replace(t, '[^a-z]', '', 'g')) > 1
  AND NOT (length(regexp_replace(t, '[^a-z]', '', 'g')) <= 2 AND length(t) - length(regexp_replace(t, '[^a-z]', '', 'g')) >= 3)
  AND NOT (len(regexp_extract_all(t, '\pN+|\PN+')) - 1 >= 2 AND length(t) >= 4)"""
_PREFIX_SQL = " OR ".join(f"regexp_matches(lower(c), '^(?:{p})')" for p in text.BAD_PREFIXES)


@query("p10_p11_bad_patterns", rf"""WITH {CAPTIONS}, o AS (SELECT uid, {_ODD} AS c FROM captions), x AS (SELECT uid, c, {_BARE} AS x FROM o), y AS (SELECT uid, c, substr(x, {_START} + 1) AS y FROM x),
  z AS (SELECT uid, c, substr(y, 1, length(y) - {_END}) AS z FROM y)
  SELECT uid, NOT ({_PREFIX_SQL}) AS no_bad_prefix, lower(c) NOT IN ({_sql_list(text.BAD_TEXTS)}) AND len(list_filter(regexp_split_to_array(z, '[\s\-_.,]'), lambda t: {_GOOD})) > 0 AS no_bad_pattern FROM z""")
def _(spark, d):
    c = captions(spark, d).select("uid", _odd().alias("c"))
    return c.select("uid", text.no_bad_prefix(F.col("c")).alias("no_bad_prefix"), text.no_bad_pattern(F.col("c")).alias("no_bad_pattern"))


@query("p10_p11_bad_patterns_whole")
def _(spark, d):
    """The same predicates over whole captions."""
    c = F.col("caption")
    return captions(spark, d).select("uid", text.no_bad_prefix(c).alias("no_bad_prefix"), text.no_bad_pattern(c).alias("no_bad_pattern"))


@query("p12_frequent_bad_text", f"""WITH {CAPTIONS}, bad AS (SELECT DISTINCT substr(lower(caption), 1, 1000) AS t FROM captions WHERE doc_id % 9 = 0)
  SELECT uid FROM captions WHERE substr(lower(caption), 1, 1000) NOT IN (SELECT t FROM bad)""")
def _(spark, d):
    c = captions(spark, d)
    bad = c.where("doc_id % 9 = 0").select(text.cut_key(F.col("caption")).alias("text"))
    return filters.without_bad_texts(c, bad).select("uid")


@query("p14_p15_score_parse", f"WITH {CAPTIONS} SELECT uid, {SCORE} AS score, {INTEGER} AS strict_score FROM captions")
def _(spark, d):
    return captions(spark, d).select("uid", scores.score_value(F.col("score_text")).alias("score"), scores.as_integer(F.col("score_text")).alias("strict_score"))


@query("p16_p19_score_threshold", f"WITH {CAPTIONS} SELECT uid FROM captions WHERE status = 'success' AND {SCORE} >= 60")
def _(spark, d):
    return filters.by_score_text(captions(spark, d), "score_text", 60).select("uid")


@query("p20_quality_threshold", f"""WITH {CAPTIONS}, x AS (SELECT uid, caption AS c, quality_score, {_BARE.replace("lower(c)", "lower(caption)")} AS x FROM captions), y AS (SELECT *, substr(x, {_START} + 1) AS y FROM x), z AS (SELECT *, substr(y, 1, length(y) - {_END}) AS z FROM y)
  SELECT uid FROM z WHERE NOT isnan(quality_score) AND quality_score >= 2.5 AND lower(c) NOT IN ({_sql_list(text.BAD_TEXTS)})
  AND len(list_filter(regexp_split_to_array(z, '[\\s\\-_.,]'), lambda t: {_GOOD})) > 0""".replace("\\\\", "\\"))
def _(spark, d):
    return filters.by_quality(captions(spark, d), "quality_score", 2.5).select("uid")


@query("p23_clip_threshold", f"WITH {CAPTIONS} SELECT uid FROM captions WHERE NOT isnan(quality_score) AND quality_score >= 1.5")
def _(spark, d):
    return filters.apply("clip_score", captions(spark, d), score="quality_score", threshold=1.5).select("uid")


_TOP = """r AS (SELECT quality_score AS v, row_number() OVER (ORDER BY (quality_score IS NULL OR isnan(quality_score)), quality_score DESC) - 1 AS i, count(*) OVER () AS n FROM captions)"""


@query("t01_top_fraction", f"WITH {CAPTIONS}, {_TOP} SELECT uid FROM captions WHERE NOT isnan(quality_score) AND quality_score >= (SELECT v FROM r WHERE i = CAST(floor(n * 0.3) AS BIGINT))")
def _(spark, d):
    return filters.by_fraction(captions(spark, d), "quality_score", 0.3).select("uid")


@query("t01_orders_top_fraction", "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT v FROM r WHERE i = CAST(floor(n * 0.3) AS BIGINT))")
def _(spark, d):
    return filters.by_fraction(read(spark, d, "orders"), "o_totalprice", 0.3).select("o_orderkey")


@query("t02_threshold_and_tie_share", f"""WITH {CAPTIONS}, s AS (SELECT {INTEGER} AS v FROM captions), k AS (SELECT v FROM s WHERE v IS NOT NULL), n AS (SELECT CAST(floor(count(*) * 0.4) AS BIGINT) AS n FROM k),
  c AS (SELECT v, count(*) AS ties, sum(count(*)) OVER (ORDER BY v DESC) AS upto FROM k GROUP BY v)
  SELECT v AS threshold, CAST(upto - ties AS BIGINT) AS above, ties, (n - (upto - ties)) / ties AS prob FROM c, n WHERE upto > n ORDER BY v DESC LIMIT 1""")
def _(spark, d):
    return filters.text_threshold_and_share(captions(spark, d), "score_text", 0.4)


@query("t02_text_fraction")
def _(spark, d):
    return filters.by_text_fraction(captions(spark, d), "score_text", 0.4).select("uid")


@query("p25_text_entity", f"""WITH {CAPTIONS}, w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS word FROM benchmark),
  e AS (SELECT word FROM w WHERE length(word) > 6)
  SELECT uid FROM captions WHERE lang = 'en' AND len(list_filter(regexp_split_to_array(lower(caption), '\\s+'), lambda t: t IN (SELECT word FROM e))) > 0""".replace("\\\\", "\\").replace("len(list_filter(regexp_split_to_array(lower(caption), '\\s+'), lambda t: t IN (SELECT word FROM e))) > 0", "list_has_any(regexp_split_to_array(lower(caption), '\\s+'), (SELECT list(word) FROM e))"))
def _(spark, d):
    word = F.explode(F.array_distinct(text.words(F.lower("text")))).alias("word")
    lexicon = read(spark, d, "benchmark").select(word).distinct().select("word", F.length("word").alias("entity"))
    return filters.mentions_entity(captions(spark, d), lexicon, lexicon.where("entity > 6").select("entity")).select("uid")


# ----------------------------------------------------------------- vectors

_NEAREST_RANKED = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT vec_id AS id, e AS ce FROM v WHERE vec_id < 16),
  k AS (SELECT vec_id, label, id, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(e, ce) DESC, id) AS r FROM v, c), n AS (SELECT vec_id, label, id AS centroid FROM k WHERE r = 1)"""


def _centroids(spark, d):
    return read(spark, d, "embeddings").where("vec_id < 16").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("j05_nearest_centroid", f"WITH {_NEAREST_RANKED} SELECT vec_id, centroid FROM n")
def _(spark, d):
    return vectors.nearest_centroid(read(spark, d, "embeddings"), _centroids(spark, d)).select("vec_id", "centroid")


@query("j06_target_clusters", f"WITH {_NEAREST_RANKED} SELECT vec_id FROM n WHERE centroid IN (SELECT centroid FROM n WHERE label = 3)")
def _(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.in_target_clusters(e, _centroids(spark, d), e.where("label = 3")).select("vec_id")


@query("p27_image_based", f"WITH {CAPTIONS}, {_NEAREST_RANKED} SELECT uid FROM captions JOIN n ON vec_id = doc_id WHERE lang = 'en' AND len({UNICODE_WORDS}) > 1 AND length(caption) > 5 AND NOT isnan(quality_score) AND quality_score >= 0.5 AND centroid IN (SELECT centroid FROM n WHERE label = 3)")
def _(spark, d):
    e = read(spark, d, "embeddings")
    rows = captions(spark, d).join(e, F.col("doc_id") == F.col("vec_id"))
    return vectors.image_based(rows, _centroids(spark, d), e.where("label = 3"), "quality_score", 0.5).select("uid")


@query("v01_kmeans")
def _(spark, d):
    return vectors.kmeans(read(spark, d, "embeddings"), 10).select("id", F.size("v").cast("long").alias("width"))


# ----------------------------------------------------------------- resharding


@query("j01_select_copies", f"WITH {CAPTIONS}, {SUBSET}, n AS (SELECT uid, count(*) AS copies FROM subset GROUP BY uid) SELECT c.uid, c.uid || '-' || CAST(j AS VARCHAR) AS key, c.source FROM captions c JOIN n USING (uid), range(100) t(j) WHERE j < copies")
def _(spark, d):
    return reshard.select_copies(captions(spark, d), subset(spark, d)).select("uid", "key", "source")


@query("j02_never_found", f"WITH {CAPTIONS}, {SUBSET} SELECT uid FROM subset WHERE uid NOT IN (SELECT uid FROM captions)")
def _(spark, d):
    return reshard.never_found(captions(spark, d), subset(spark, d))


@query("u02_union_of_selections", f"WITH {CAPTIONS} SELECT uid FROM captions WHERE {SCORE} >= 85 AND status = 'success' UNION SELECT uid FROM captions WHERE NOT isnan(quality_score) AND quality_score >= 2")
def _(spark, d):
    c = captions(spark, d)
    return reshard.union_of_selections(filters.by_score_text(c, "score_text", 85), filters.by_threshold(c, "quality_score", 2))


_TABLE = "s AS (SELECT source AS shard, count(*) AS size FROM documents GROUP BY source), t AS (SELECT shard, size, CAST(coalesce(sum(size) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_start, CAST(sum(size) OVER () AS BIGINT) AS total FROM s)"


def _shards(spark, d):
    return read(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("size"))


@query("s16_shard_table", f"WITH {_TABLE} SELECT * FROM t")
def _(spark, d):
    return reshard.shard_table(_shards(spark, d))


@query("w03_plan_tasks", f"WITH {_TABLE} SELECT shard, greatest(least(data_start // CAST(ceil(total / 7) AS BIGINT), CAST(ceil(total / ceil(total / 7)) AS BIGINT) - 1), 0) AS worker FROM t")
def _(spark, d):
    return reshard.plan_tasks(reshard.shard_table(_shards(spark, d)), 7).select("shard", "worker")


@query("s12_new_shards", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, i // 300 AS shard, i % 300 AS at FROM o")
def _(spark, d):
    return reshard.new_shards(read(spark, d, "documents").select("doc_id"), "doc_id", 300).select("doc_id", F.col("shard").cast("long").alias("shard"), F.col("at").cast("long").alias("at"))


@query("s13_shard_stats", "SELECT source AS shard, count(*) AS successes FROM documents GROUP BY source")
def _(spark, d):
    return reshard.shard_stats(read(spark, d, "documents").withColumnRenamed("source", "shard"))


@query("s17_dataset_size", f"WITH {_TABLE} SELECT CAST(sum(coalesce(size, 0)) AS BIGINT) AS size FROM (VALUES ('src0'), ('src1'), ('none')) w(shard) LEFT JOIN s USING (shard)")
def _(spark, d):
    return reshard.dataset_size(spark.createDataFrame([("src0",), ("src1",), ("none",)], "shard string"), _shards(spark, d))


@query("j03_parquet_of_shard", "SELECT DISTINCT source AS shard, CASE WHEN source = 'src0' THEN 'p1' WHEN source = 'src1' THEN 'p2' END AS parquet FROM documents")
def _(spark, d):
    mapping = spark.createDataFrame([("p1", ["src0", "src1"]), ("p2", ["src1"])], "parquet string, shards array<string>")
    return reshard.parquet_of_shard(mapping, read(spark, d, "documents").select(F.col("source").alias("shard")).distinct())


@query("j04_with_boxes", "SELECT d.doc_id AS uid, l.doc_id IS NOT NULL AS boxes_found, l.quality AS face_bboxes FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    boxed = read(spark, d, "labels").select(F.col("doc_id").alias("uid"), F.col("quality").alias("face_bboxes")).withColumn("face_bboxes", F.col("face_bboxes"))
    return reshard.with_boxes(read(spark, d, "documents").select(F.col("doc_id").alias("uid")), boxed).select("uid", F.col("face_bboxes"), "boxes_found")


@query("s11_group_members", """WITH m AS (SELECT conv_id, turn AS at, 'c' || CAST(conv_id * 10 + turn // 2 AS VARCHAR) AS prefix, CASE WHEN turn % 2 = 0 THEN 'json' ELSE 'txt' END AS suffix FROM conversations)
  SELECT CAST(conv_id AS VARCHAR) AS url, prefix AS key, string_agg(suffix, ',' ORDER BY suffix) AS suffixes FROM m GROUP BY conv_id, prefix""")
def _(spark, d):
    name = F.concat(F.lit("c"), (F.col("conv_id") * 10 + F.floor(F.col("turn") / 2)).cast("string"), F.when(F.col("turn") % 2 == 0, ".JSON").otherwise(".txt"))
    members = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("url"), F.col("turn").alias("at"), name.alias("name"), F.col("text").cast("binary").alias("data"))
    return reshard.group_members(members).select("url", "key", F.array_join(F.array_sort(F.map_keys("parts")), ",").alias("suffixes"))


# ----------------------------------------------------------------- packing, prompts, batches

_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


def _lengths(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("shard"), F.col("doc_id").alias("key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("length"))


@query("k06_first_fit_decreasing")
def _(spark, d):
    return packing.pack(_lengths(spark, d))


@query("k06_bin_totals", f"WITH l AS (SELECT source AS shard, {_WORDS} AS n FROM documents) SELECT shard, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_overfull FROM l GROUP BY shard")
def _(spark, d):
    bins = packing.pack(_lengths(spark, d)).groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t"))
    return bins.groupBy("shard").agg(F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.count_if((F.col("t") > packing.CONTEXT) & (F.col("n") > 1)).alias("n_overfull"))


@query("k02_caption_lengths", f"SELECT doc_id, {_WORDS} + 144 + 0 AS length FROM documents")
def _(spark, d):
    return _lengths(spark, d).select(F.col("key").alias("doc_id"), (F.col("length") + packing.IMAGE_TOKENS).alias("length"))


@query("d05_d06_sft_lengths", f"SELECT conv_id, turn, 729 + {_WORDS} AS align, {_WORDS} AS finetune, 729 + {_WORDS} AS sft FROM conversations")
def _(spark, d):
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    marks = F.regexp_count("text", F.lit("<image>"))
    return read(spark, d, "conversations").select("conv_id", "turn", prompts.modality_length("align", n, marks).alias("align"), prompts.modality_length("finetune", n, marks).alias("finetune"), prompts.sft_length(n).alias("sft"))


def _turns(spark, d):
    """Conversations without system rows, turns numbered anew from 0."""
    rows = read(spark, d, "conversations").where("role <> 'system'")
    return rows.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("at"), F.col("text").alias("message"))


def _prompt_sql(family: str) -> str:
    t = prompts.TEMPLATES[family]
    m = "trim(message, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

    def filled(template: str, message: str) -> str:
        a, b = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in template.split("{m}"))
        return f"'{a}' || {message} || '{b}'"

    answer = f"CASE WHEN {m} = '' THEN ' ' ELSE {m} END"
    turn = f"CASE WHEN pos = 0 THEN {filled(t['first'], m)} WHEN pos % 2 = 0 THEN {filled(t['human'], m)} ELSE {filled(t['gpt'], answer)} END"
    return f"WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS message FROM conversations WHERE role <> 'system') SELECT conv_id, rtrim(string_agg({turn}, '' ORDER BY pos)) AS prompt FROM t GROUP BY conv_id"


for _family in prompts.TEMPLATES:
    query(f"d08_prompt_{_family}", _prompt_sql(_family))((lambda f: lambda spark, d: prompts.conversation_prompt(_turns(spark, d), f))(_family))


@query("t07_stratified_slim", "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('21-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS n FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE n <= 64")
def _(spark, d):
    return batching.slim(read(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderkey", 64, 21, "o_orderpriority")


@query("t06_slim", "SELECT doc_id FROM documents ORDER BY md5('21-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def _(spark, d):
    return batching.slim(read(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("t08_demonstrations", "WITH p AS (SELECT item_id FROM benchmark ORDER BY md5('21-' || CAST(item_id AS VARCHAR)), item_id LIMIT 3) SELECT doc_id, (SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY md5('21-' || CAST(item_id AS VARCHAR))) FROM p) AS shown FROM documents")
def _(spark, d):
    out = batching.with_demonstrations(read(spark, d, "documents").select("doc_id"), read(spark, d, "benchmark"), "item_id", 3)
    return out.select("doc_id", F.array_join(F.transform("demos", lambda x: x["item_id"].cast("string")), ",").alias("shown"))


@query("b01_padded_batches", f"WITH l AS (SELECT doc_id, doc_id // 8 AS batch, least({_WORDS}, 64) AS n FROM documents) SELECT doc_id, batch, n AS n_mask, max(n) OVER (PARTITION BY batch) AS n_ids FROM l")
def _(spark, d):
    ids = F.transform(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.length(w).cast("long") + 1)
    ids = F.filter(ids, lambda x: x > 1)
    rows = read(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("ids"))
    out = batching.padded(rows, "batch", "ids", 0, 64)
    return out.select("doc_id", "batch", F.size(F.filter("attention_mask", lambda x: x)).cast("long").alias("n_mask"), F.size("ids").cast("long").alias("n_ids"))


@query("b03_split_modality")
def _(spark, d):
    rows = _lengths(spark, d).select(F.col("key").alias("id"), (F.col("key") % 3 > 0).alias("multimodal"), "length")
    return batching.split_modality(rows, 64, 4)


@query("b05_b06_ranks", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, i % 4 AS stride, (i // 16) % 4 AS blocks FROM r")
def _(spark, d):
    rows = reshard.new_shards(read(spark, d, "documents").select("doc_id"), "doc_id", 1 << 40)
    return rows.select("doc_id", batching.rank_of(F.col("at"), 4).cast("long").alias("stride"), batching.rank_of(F.col("at"), 4, 16).cast("long").alias("blocks"))


@query("b08_resampled")
def _(spark, d):
    return batching.resampled(_shards(spark, d).select("shard"), 100, 3, 1)


# ----------------------------------------------------------------- scorers


@query("e01_soft_accuracy", f"""WITH {ANSWERS}, m AS (SELECT *, len(list_filter(golds, lambda g: g = answer)) AS m FROM answers), s AS (SELECT *, m * least(m - 1, 3) + (10 - m) * least(m, 3) AS points FROM m),
  k AS (SELECT 'overall' AS kind, 'all' AS name, points FROM s UNION ALL SELECT 'question_type', question_type, points FROM s UNION ALL SELECT 'answer_type', answer_type, points FROM s)
  SELECT kind, name, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM k GROUP BY kind, name""")
def _(spark, d):
    rows = answers(spark, d).withColumn("points", ans.soft_accuracy_30(F.col("answer"), F.col("golds")))
    return scorers.soft_accuracy(rows, "points", "question_type", "answer_type").drop("accuracy")


@query("t11_majority", f"""WITH {ANSWERS}, u AS (SELECT question_id, unnest(golds) AS g, generate_subscripts(golds, 1) AS i FROM answers), c AS (SELECT question_id, g, count(*) AS n, min(i) AS i FROM u GROUP BY question_id, g)
  SELECT question_id, g AS majority FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, i) AS r FROM c) WHERE r = 1""")
def _(spark, d):
    return answers(spark, d).select("question_id", ans.majority(F.col("golds")).alias("majority"))


@query("t09_argmax", f"WITH {ANSWERS} SELECT question_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS best FROM answers")
def _(spark, d):
    return answers(spark, d).select("question_id", ans.argmax(F.col("p")).alias("best"))


@query("e08_e09_argmax_accuracy", f"WITH {ANSWERS}, b AS (SELECT source, list_position(p, list_max(p)) - 1 = cls AS ok FROM answers) SELECT source, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS n_correct, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy FROM b GROUP BY source")
def _(spark, d):
    out = scorers.accuracy(answers(spark, d), ans.argmax(F.col("p")) == F.col("cls"), ["source"])
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("n_correct", F.col("n_correct").cast("long"))


@query("a03_micro_macro", f"WITH {ANSWERS}, s AS (SELECT source, count_if(answer = gold) AS c, count(*) AS n FROM answers GROUP BY source) SELECT round(sum(c) / sum(n), 6) AS micro, round(avg(c / n), 6) AS macro FROM s")
def _(spark, d):
    out = scorers.micro_and_macro(answers(spark, d), F.col("answer") == F.col("gold"), "source")
    return out.select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("e06_pope_f1", f"""WITH {ANSWERS}, b AS (SELECT answer_type, yes_gold = 'yes' AS g, lower(trim(trim(yes_answer, ','), '.')) = 'yes' AS p FROM answers), c AS (SELECT answer_type, CAST(count_if(g AND p) AS BIGINT) AS tp, CAST(count_if(NOT g AND p) AS BIGINT) AS fp, CAST(count_if(g AND NOT p) AS BIGINT) AS fn FROM b GROUP BY answer_type)
  SELECT *, round(coalesce(tp * 2.0 / nullif(tp * 2 + fp + fn, 0), 0), 6) AS f1 FROM c""")
def _(spark, d):
    out = scorers.f1(answers(spark, d), F.col("yes_gold") == "yes", text.yes_no(F.col("yes_answer")) == "yes", ["answer_type"])
    return out.select("answer_type", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), F.round("f1", 6).alias("f1"))


@query("a11_roc_auc", f"WITH {ANSWERS}, x AS (SELECT answer_type, p[1] AS s, yes_gold = 'yes' AS g FROM answers), q AS (SELECT a.answer_type, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM x a JOIN x b ON a.answer_type = b.answer_type AND a.g AND NOT b.g GROUP BY a.answer_type) SELECT answer_type, round(auc, 6) AS auc FROM q")
def _(spark, d):
    out = scorers.roc_auc(answers(spark, d), F.col("yes_gold") == "yes", F.element_at("p", 1), ["answer_type"])
    return out.where("auc is not null").select("answer_type", F.round("auc", 6).alias("auc"))


@query("a12_roc_auc_ovo", f"""WITH {ANSWERS}, c AS (SELECT unnest([0, 1, 2, 3]) AS a), pr AS (SELECT x.a AS a, y.a AS b FROM c x, c y WHERE x.a <> y.a),
  q AS (SELECT pr.a, pr.b, avg(CASE WHEN m.p[pr.a + 1] > n.p[pr.a + 1] THEN 1.0 WHEN m.p[pr.a + 1] = n.p[pr.a + 1] THEN 0.5 ELSE 0.0 END) AS auc FROM pr, answers m, answers n WHERE m.cls = pr.a AND n.cls = pr.b GROUP BY pr.a, pr.b)
  SELECT round(avg(auc), 6) AS auc FROM q""")
def _(spark, d):
    return scorers.roc_auc_ovo(answers(spark, d), "cls", "p", 4).select(F.round("auc", 6).alias("auc"))


@query("a13_average_precision", f"""WITH {ANSWERS}, s AS (SELECT answer_type, p[1] AS s, count_if(yes_gold = 'yes') AS k, count(*) AS n FROM answers GROUP BY answer_type, p[1]), u AS (SELECT *, sum(k) OVER w AS tp, sum(n) OVER w AS al FROM s WINDOW w AS (PARTITION BY answer_type ORDER BY s DESC))
  SELECT answer_type, round(coalesce(sum(k * tp / al) / nullif(sum(k), 0), 0), 6) AS ap FROM u GROUP BY answer_type""")
def _(spark, d):
    return scorers.average_precision(answers(spark, d), F.col("yes_gold") == "yes", F.element_at("p", 1), ["answer_type"]).select("answer_type", F.round("ap", 6).alias("ap"))


@query("a06_chi_square", f"""WITH {ANSWERS}, k AS (SELECT grp, gold, answer FROM answers WHERE grp IS NOT NULL), g AS (SELECT grp, gold AS a, count(*) AS e FROM k GROUP BY 1, 2), p AS (SELECT grp, answer AS a, count(*) AS o FROM k GROUP BY 1, 2),
  x AS (SELECT g.grp, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS x, sum(e) AS w FROM g LEFT JOIN p USING (grp, a) GROUP BY g.grp) SELECT round(sum(x * w) / sum(w) / 100, 6) AS chi_square FROM x""")
def _(spark, d):
    return scorers.chi_square(answers(spark, d), "grp", "gold", "answer").select(F.round("chi_square", 6).alias("chi_square"))


@query("a04_grouped_means", f"""WITH {ANSWERS}, c AS (SELECT question_type, answer_type, CASE WHEN answer = gold THEN 1.0 ELSE 0.0 END AS ok FROM answers), k AS (SELECT 'question_type' AS kind, question_type AS name, ok FROM c UNION ALL SELECT 'answer_type', answer_type, ok FROM c)
  SELECT kind, name, count(*) AS n, round(avg(ok), 6) AS mean FROM k GROUP BY kind, name""")
def _(spark, d):
    rows = answers(spark, d).withColumn("ok", (F.col("answer") == F.col("gold")).cast("double"))
    return scorers.grouped_means(rows, "ok", "question_type", "answer_type").withColumn("mean", F.round("mean", 6))


@query("e14_e18_contains", f"WITH {ANSWERS} SELECT question_id, contains(lower(yes_answer), lower(yes_gold)) AS lowered, contains(yes_answer, yes_gold) AS exact FROM answers")
def _(spark, d):
    gold, out = F.col("yes_gold"), F.col("yes_answer")
    return answers(spark, d).select("question_id", scorers.contained(gold, out, True).alias("lowered"), scorers.contained(gold, out, False).alias("exact"))


@query("u07_merged_results", "WITH r AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id AS question_id, max(turn) AS rank, arg_max(n, turn) AS n FROM r GROUP BY conv_id")
def _(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.length("text").cast("long").alias("n"))
    return scorers.merged_results(rows)


@query("e10_box_accuracy", """WITH b AS (SELECT doc_id, ((doc_id * 3) % 50) / 100.0 AS x1, ((doc_id * 5) % 50) / 100.0 AS y1, ((doc_id * 7) % 50 + 51) / 100.0 AS x2, ((doc_id * 11) % 50 + 51) / 100.0 AS y2,
    ((doc_id * 2) % 40) / 100.0 AS g1, ((doc_id * 3) % 40) / 100.0 AS h1, ((doc_id * 5) % 40 + 41) / 100.0 AS g2, ((doc_id * 7) % 40 + 41) / 100.0 AS h2, doc_id % 7 > 1 AS ok FROM documents),
  i AS (SELECT *, greatest(least(x2, g2) - greatest(x1, g1), 0) * greatest(least(y2, h2) - greatest(y1, h1), 0) AS i FROM b)
  SELECT doc_id, CASE WHEN ok THEN round(i / ((x2 - x1) * (y2 - y1) + (g2 - g1) * (h2 - h1) - i), 6) END AS iou, NOT ok AS invalid FROM i""")
def _(spark, d):
    k = F.col("doc_id")
    cell = lambda a, off: F.format_string("%d.%02d", F.floor(((k * a) % 50 + off) / 100), F.pmod((k * a) % 50 + off, F.lit(100)))
    raw = F.when(k % 7 == 0, "nothing here").when(k % 7 == 1, "[0.5, 0.5, 0.2, 0.9]").otherwise(F.concat(F.lit("["), F.concat_ws(", ", cell(3, 0), cell(5, 0), cell(7, 51), cell(11, 51)), F.lit("]")))
    gold = F.array(*((((k * a) % 40 + off) / 100.0) for a, off in ((2, 0), (3, 0), (5, 41), (7, 41))))
    rows = read(spark, d, "documents").select("doc_id", boxes.parsed(raw).alias("box"), gold.alias("gold"))
    return rows.select("doc_id", F.when(F.col("box").isNotNull(), F.round(boxes.iou(F.col("box"), F.col("gold")), 6)).alias("iou"), F.col("box").isNull().alias("invalid"))


@query("x17_x20_boxes", "SELECT doc_id, round((doc_id % 100) / 640.0, 2) AS x1, round((doc_id % 50) / 480.0, 2) AS y1, CASE WHEN doc_id % 25 <= 9 THEN 0 WHEN doc_id % 25 <= 16 THEN 1 WHEN doc_id % 25 <= 20 THEN 2 ELSE 3 END AS clutter FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    box = F.array((k % 100).cast("double"), (k % 50).cast("double"), (k % 100 + 100).cast("double"), (k % 50 + 100).cast("double"))
    n = boxes.normalised(box, F.lit(640.0), F.lit(480.0))
    return read(spark, d, "documents").select("doc_id", n[0].alias("x1"), n[1].alias("y1"), boxes.clutter(k % 25).alias("clutter"))


@query("x02_x08_cleaning", r"""SELECT item_id, split_part(lower(translate(text, chr(10) || '.,', '')), '<|endofchunk|>', 1) AS cleaned, lower(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) AS plain,
  trim(replace(replace(replace(lower(text), ',', ''), '?', ''), '''s', ' ''s')) AS tokens FROM benchmark""")
def _(spark, d):
    c = F.col("text")
    return read(spark, d, "benchmark").select("item_id", text.clean_output(c).alias("cleaned"), text.strip_punctuation(c).alias("plain"), text.eval_tokens(c).alias("tokens"))


@query("x02_x03_vqa_normalise")
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", ans.plain_words(ans.plain_punctuation(F.col("text"))).alias("normal"))


@query("x09_anls", r"""WITH t AS (SELECT item_id, lower(trim(t)) AS a, lower(trim(substr(t, 1 + item_id % 8))) AS b FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)), s AS (SELECT item_id, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s FROM t)
  SELECT item_id, round(CASE WHEN s >= 0.5 THEN s ELSE 0 END, 6) AS anls FROM s""")
def _(spark, d):
    plain = F.regexp_replace("text", "[^ -~]", "")  # DuckDB counts edits in bytes
    return read(spark, d, "benchmark").select("item_id", F.round(ans.anls(plain, F.array(F.substr(plain, (1 + F.col("item_id") % 8).cast("int")))), 6).alias("anls"))


@query("x09_anls_whole")
def _(spark, d):
    """ANLS of whole benchmark texts against themselves without their first 0 to 7 characters."""
    gold = F.substr(F.col("text"), (1 + F.col("item_id") % 8).cast("int"))
    return read(spark, d, "benchmark").select("item_id", F.round(ans.anls(F.col("text"), F.array(gold)), 6).alias("anls"))


@query("e12_mmmu_parse")
def _(spark, d):
    k = F.col("doc_id")
    response = F.when(k % 4 == 0, "The answer is (B).").when(k % 4 == 1, "C").when(k % 4 == 2, F.concat(F.lit("so it is "), (k % 9).cast("string"))).otherwise(F.col("text"))
    rows = read(spark, d, "documents").select("doc_id", response.alias("r"), F.array(*map(F.lit, ("red", "green", "blue", "grey"))).alias("o"), F.array((k % 5).cast("string")).alias("g"))
    return rows.select("doc_id", ans.parse_choice(F.col("r"), F.col("o"), F.col("doc_id").cast("string")).alias("letter"), ans.open_correct(F.col("r"), F.col("g")).alias("open_correct"))


@query("e20_cider", r"""WITH p AS (SELECT doc_id AS image, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS w FROM documents),
  r AS (SELECT d.doc_id AS image, k AS ref, list_filter(regexp_split_to_array(substr(coalesce(text, ''), 1 + 20 * k), '\s+'), lambda t: t <> '') AS w FROM documents d, range(2) t(k)),
  hg AS (SELECT image, k, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) a(k)) GROUP BY 1, 2, 3),
  rg AS (SELECT image, ref, k, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM r, range(1, 5) a(k)) GROUP BY 1, 2, 3, 4),
  df AS (SELECT k, gram, count(DISTINCT image) AS df FROM rg GROUP BY 1, 2), ln AS (SELECT ln(count(DISTINCT image)) AS l FROM r),
  h AS (SELECT image, hg.k, hg.gram, n, n * (l - ln(greatest(coalesce(df, 0), 1))) AS w FROM hg LEFT JOIN df USING (k, gram), ln), q AS (SELECT image, ref, rg.k, rg.gram, n, n * (l - ln(greatest(coalesce(df, 0), 1))) AS w FROM rg LEFT JOIN df USING (k, gram), ln),
  hn AS (SELECT image, k, sqrt(sum(w * w)) AS nn FROM h GROUP BY 1, 2), qn AS (SELECT image, ref, k, sqrt(sum(w * w)) AS nn FROM q GROUP BY 1, 2, 3),
  hl AS (SELECT image, coalesce(sum(n) FILTER (k = 2), 0) AS len FROM h GROUP BY 1), ql AS (SELECT image, ref, coalesce(sum(n) FILTER (k = 2), 0) AS len FROM q GROUP BY 1, 2),
  dt AS (SELECT q.image, q.ref, q.k, sum(least(h.w, q.w) * q.w) AS d FROM q JOIN h ON h.image = q.image AND h.k = q.k AND h.gram = q.gram GROUP BY 1, 2, 3),
  c AS (SELECT DISTINCT image, ref FROM r), s AS (SELECT c.image, c.ref, sum(d / CASE WHEN hn.nn * qn.nn = 0 THEN 1 ELSE hn.nn * qn.nn END) AS v FROM c JOIN dt USING (image, ref) JOIN hn ON hn.image = c.image AND hn.k = dt.k JOIN qn ON qn.image = c.image AND qn.ref = c.ref AND qn.k = dt.k GROUP BY 1, 2)
  SELECT c.image, round(sum(coalesce(v, 0) * exp(-power(coalesce(hl.len, 0) - coalesce(ql.len, 0), 2) / 72.0) / 4) / count(*) * 10, 5) AS cider FROM c LEFT JOIN s USING (image, ref) LEFT JOIN hl ON hl.image = c.image LEFT JOIN ql ON ql.image = c.image AND ql.ref = c.ref GROUP BY c.image""")
def _(spark, d):
    """CIDEr of every document's whole text against itself and itself without its first 20 characters."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("image"), F.coalesce("text", F.lit("")).alias("text"))
    refs = docs.select("image", F.explode(F.array(F.lit(0), F.lit(1))).alias("ref"), "text").withColumn("text", F.substr(F.col("text"), 1 + 20 * F.col("ref")))
    return scorers.cider(docs, refs).select("image", F.round("cider", 5).alias("cider"))


@query("e22_bleu4")
def _(spark, d):
    docs = read(spark, d, "documents")
    pred = docs.select(F.col("doc_id").alias("image"), F.col("text"))
    refs = docs.select(F.col("doc_id").alias("image"), F.lit(0).alias("ref"), F.substr(F.col("text"), F.lit(5)).alias("text"))
    return scorers.bleu4_counts(pred, refs)


# ----------------------------------------------------------------- questions and references


def _index(spark, d, **conditions):
    rows = answers(spark, d)
    questions = rows.select("question_id", (F.col("question_id") % 97).alias("image_id"), F.concat(F.lit("q "), F.col("question_id").cast("string")).alias("question"))
    return tasks.question_index(questions, rows.select("question_id", F.col("golds").alias("answers"), "question_type", "answer_type"), **conditions)


_INDEX = f"WITH {ANSWERS}, ix AS (SELECT *, question_id % 97 AS image_id, 'q ' || question_id AS question FROM answers)"


@query("j09_p35_question_index", f"{_INDEX} SELECT question_id, image_id, question, question_type, answer_type FROM ix WHERE image_id IN (1, 5, 8, 90) AND question_type IN ('q0', 'q3') AND answer_type IN ('t0', 't2')")
def _(spark, d):
    return _index(spark, d, image_ids=[1, 5, 8, 90], question_types=["q0", "q3"], answer_types=["t0", "t2"]).select("question_id", "image_id", "question", "question_type", "answer_type")


@query("e02_e03_vqa_scores", f"""{_INDEX}, m AS (SELECT *, CASE WHEN question_id % 11 = 0 THEN -1 ELSE len(list_filter(golds, lambda g: g = answer)) END AS m FROM ix),
  s AS (SELECT *, CASE WHEN m < 0 THEN 0 ELSE m * least(m - 1, 3) + (10 - m) * least(m, 3) END AS points FROM m),
  k AS (SELECT 'overall' AS kind, 'all' AS name, points FROM s UNION ALL SELECT 'question_type', question_type, points FROM s UNION ALL SELECT 'answer_type', answer_type, points FROM s)
  SELECT kind, name, count(*) AS n, CAST(sum(points) AS BIGINT) AS points, round(sum(points) * 100.0 / (count(*) * 30), 2) AS accuracy FROM k GROUP BY kind, name""")
def _(spark, d):
    # Predictions in another dress, which the normalisation takes off; every eleventh question has none.
    said = answers(spark, d).where("question_id % 11 <> 0").select("question_id", F.concat(F.lit("The "), F.upper("answer"), F.lit("!")).alias("answer"))
    index = _index(spark, d).withColumn("answers", F.transform("answers", lambda a: F.concat(F.lit("an "), a)))
    return tasks.vqa_scores(said, index, plain_golds=True)


@query("j11_split_label", "SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id * 3 FROM benchmark) THEN 'test' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    test = read(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return tasks.with_split(read(spark, d, "documents").select("doc_id"), "doc_id", test)


@query("j12_w06_demonstrations", "WITH f AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT source, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY r)) AS prompt_md5 FROM f WHERE r <= 5 GROUP BY source")
def _(spark, d):
    return tasks.demonstrations(read(spark, d, "documents"), "source", "doc_id", "text").select("source", "n", F.md5("prompt").alias("prompt_md5"))


_REFS = "refs AS (SELECT doc_id AS ref_id, doc_id * 2 AS ann_id, doc_id % 41 AS image_id, doc_id % 7 AS category_id, ['train', 'val', 'testA', 'testB', 'testAB', 'testC'][doc_id % 6 + 1] AS split, ['left ' || doc_id, 'right ' || doc_id, 'big one'][1 : doc_id % 4] AS sentences FROM documents)"


def _refs(spark, d):
    k = F.col("doc_id")
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "testA", "testB", "testAB", "testC"))), (k % 6 + 1).cast("int"))
    sentences = F.slice(F.array(F.concat(F.lit("left "), k.cast("string")), F.concat(F.lit("right "), k.cast("string")), F.lit("big one")), F.lit(1), (k % 4).cast("int"))
    return read(spark, d, "documents").select(k.alias("ref_id"), (k * 2).alias("ann_id"), (k % 41).alias("image_id"), (k % 7).alias("category_id"), split.alias("split"), sentences.alias("sentences"))


@query("p34_reference_filter", f"WITH {_REFS} SELECT 'test' AS asked, ref_id FROM refs WHERE split LIKE '%test%' AND category_id IN (1, 2) UNION ALL SELECT 'testA', ref_id FROM refs WHERE split LIKE '%A%' UNION ALL SELECT 'testAB', ref_id FROM refs WHERE split = 'testAB' AND image_id IN (3, 4, 5) UNION ALL SELECT 'val', ref_id FROM refs WHERE split = 'val'")
def _(spark, d):
    refs = _refs(spark, d)
    asked = [("test", {"category_ids": [1, 2]}), ("testA", {}), ("testAB", {"image_ids": [3, 4, 5]}), ("val", {})]
    parts = [tasks.reference_filter(refs, split=name, **more).select(F.lit(name).alias("asked"), "ref_id") for name, more in asked]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("j13_expressions", f"WITH {_REFS} SELECT ref_id, CAST(i - 1 AS INTEGER) AS sent, sentences[i] AS sentence, (ref_id * 2 % 100) / 4.0 AS x FROM refs, unnest(range(1, len(sentences) + 1)) u(i) WHERE ref_id % 5 <> 0")
def _(spark, d):
    boxes = _refs(spark, d).where("ref_id % 5 <> 0").select("ann_id", F.array((F.col("ann_id") % 100) / 4.0, F.lit(1.0)).alias("bbox"))
    return tasks.expressions(_refs(spark, d), boxes).select("ref_id", "sent", "sentence", F.element_at("bbox", 1).alias("x"))


@query("e10_e11_box_scores", "WITH b AS (SELECT ['refcoco', 'refcoco+', 'refcocog'][doc_id % 3 + 1] AS name, doc_id % 7 <> 0 AND doc_id * 13 % 100 >= 50 AS hit FROM documents), k AS (SELECT * FROM b UNION ALL SELECT 'All', hit FROM b) SELECT name, count(*) AS n, CAST(count_if(hit) AS BIGINT) AS n_correct, round(count_if(hit) / count(*), 6) AS accuracy FROM k GROUP BY name")
def _(spark, d):
    k = F.col("doc_id")
    # One box of width 1 and one of a hundredth more or less of it: their overlap is the width.
    width = (k * 13 % 100) / 100.0
    overlap = boxes.iou(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0), width, F.lit(1.0)))
    rows = read(spark, d, "documents").select(F.element_at(F.array(*map(F.lit, ("refcoco", "refcoco+", "refcocog"))), (k % 3 + 1).cast("int")).alias("set"), F.when(k % 7 != 0, overlap).alias("iou"))
    return tasks.box_scores(rows, F.col("iou"), "set", 0.5).select("name", "n", F.col("n_correct").cast("long").alias("n_correct"), F.round("accuracy", 6).alias("accuracy"))


# ----------------------------------------------------------------- streams and windows


@query("w01_trailing_means", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW), 9) AS trailing_mean FROM events")
def _(spark, d):
    rows = read(spark, d, "events").withColumn("step", F.struct("ts", "event_id"))
    return workers.trailing_means(rows, "value", "step", 128, "user_id").select("event_id", F.round("trailing_mean", 9).alias("trailing_mean"))


@query("g02_alive_workers", "SELECT user_id AS name, max(ts) AS last_beat FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 12 HOUR")
def _(spark, d):
    return workers.alive(read(spark, d, "events").select(F.col("user_id").alias("name"), "ts"), "2024-01-30 00:00:00", 12 * 3600)


@query("g04_shortest_queue", "WITH w AS (SELECT user_id, count(*) AS q, 1 + user_id % 7 AS speed FROM events GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS name, q + 1 AS queue FROM w ORDER BY CAST(q AS DOUBLE) / speed, CAST(user_id AS VARCHAR) LIMIT 1")
def _(spark, d):
    w = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("queue"))
    return workers.shortest_queue(w.select(F.col("user_id").cast("string").alias("name"), F.lit("m,n").alias("models"), (1 + F.col("user_id") % 7).cast("double").alias("speed"), "queue"), "m")


@query("g03_registry_stream")
def _(spark, d):
    """The registry over the events table as a stream: users register and beat in turns, and a purchase signs them off."""
    import tempfile
    import uuid

    kind = F.when(F.col("event_type") == "purchase", "remove").when(F.col("event_id") % 50 < 25, "register").otherwise("beat")
    at = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    name = f"registry_{uuid.uuid4().hex}"
    # A file stream reads a folder, and the table may be one file: it is written as a folder first.
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("name"), kind.alias("kind"), F.lit("m").alias("models"), F.lit(1.0).alias("speed"), F.lit(0).cast("long").alias("queue"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{at}/{name}-in")
    events = spark.readStream.schema(rows.schema).parquet(f"{at}/{name}-in")
    run = workers.registry(events).writeStream.format("parquet").option("path", f"{at}/{name}-out").option("checkpointLocation", f"{at}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/{name}-out").groupBy("known", "registered").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
