"""Caption-table filters and their thresholds (P01-P30, T01-T04), and the router over them.

A caption table has uid, caption, width, height, status, lang, lang_score; scores are
columns of it or of a side table joined on uid.  Every filter returns the uids it
keeps, duplicates included; `sorted_uids` turns them into the sorted id table that a
reshard takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import scores, text


def basic(captions: DataFrame, strict: bool = False, bad_texts: DataFrame | None = None) -> DataFrame:
    """Shape and download status; P03 with `strict`: the full rule, language and text included.

    bad_texts: a table of frequent bad captions (column text), parameter of the data set (P12).
    """
    keep = text.good_shape(F.col("width"), F.col("height")) & (F.col("status") == "success")
    if strict:
        c = F.col("caption")
        keep = keep & (F.col("lang") == "en") & text.long_enough(c) & text.no_bad_prefix(c) & text.no_bad_pattern(c) & (text.unique_ratio(c) > 0.5)
    out = captions.where(keep)
    return without_bad_texts(out, bad_texts) if bad_texts is not None else out


def without_bad_texts(captions: DataFrame, bad_texts: DataFrame) -> DataFrame:
    """Captions whose first 1000 characters, in lower case, are not listed."""
    listed = bad_texts.select(F.col("text").alias("__bad")).distinct()
    return captions.join(listed, text.cut_key(F.col("caption")) == F.col("__bad"), "left_anti")


def caption_filter(captions: DataFrame) -> DataFrame:
    """P07."""
    c = F.col("caption")
    return captions.where((F.col("lang") == "en") & text.long_enough(c, 1, 5))


#: Bins of a round of the search for a rank.
RANK_BINS = 256


def _at_rank(values: DataFrame, n: int) -> tuple | None:
    """(value, rows above it, rows with it) at position n from the top, of a column v without nulls; None if there are fewer rows.

    Quantiles cut the range into bins, whose counts say which one holds the position; that
    bin is cut again until it is one value.  No task sorts values, and the driver gets RANK_BINS counts a round.
    """
    above = 0
    while True:
        least, most, cuts = values.agg(F.min("v"), F.max("v"), F.percentile_approx("v", [i / RANK_BINS for i in range(1, RANK_BINS)], 10_000)).first()
        if least is None:
            return None
        # The least and the largest value are bins of their own, so what lies between shrinks whatever the ties.
        edges = F.array(*map(F.lit, sorted({least, *cuts})))
        number = F.when(F.col("v") == most, RANK_BINS + 1).otherwise(F.size(F.filter(edges, lambda e: e < F.col("v"))))
        bins = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] > n:
                break
            above += r["n"]
        else:
            return None
        if r["low"] == r["high"]:
            return r["low"], above, r["n"]
        values = values.where(F.col("v").between(r["low"], r["high"]))


def top_fraction_threshold(table: DataFrame, score: str, fraction: float) -> DataFrame:
    """One row, `threshold`: the score at position int(N * fraction) from the top, NaN and null last; null if these are all.

    A later >= keeps that position as well, so at least n + 1 rows.
    """
    values = table.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).alias("v"))
    found = _at_rank(values, int(table.count() * fraction))
    return table.sparkSession.range(1).select(F.lit(found[0] if found else None).cast(table.schema[score].dataType).alias("threshold"))


def by_threshold(table: DataFrame, score: str, threshold: float) -> DataFrame:
    """NaN and null never pass."""
    return table.where(~F.isnan(score) & (F.col(score) >= threshold))


def by_fraction(table: DataFrame, score: str, fraction: float) -> DataFrame:
    cut = top_fraction_threshold(table, score, fraction)
    return table.join(F.broadcast(cut), ~F.isnan(score) & (F.col(score) >= F.col("threshold"))).drop("threshold")


def by_score_text(table: DataFrame, score: str, threshold: int, need_success: bool = True) -> DataFrame:
    """Scores that are texts."""
    keep = scores.above(F.col(score), threshold)
    return table.where(keep & (F.col("status") == "success") if need_success else keep)


def text_threshold_and_share(table: DataFrame, score: str, fraction: float) -> DataFrame:
    """Threshold, ties, above, prob: what share of the rows at the threshold completes the fraction of integer scores."""
    ints = table.select(scores.as_integer(F.col(score)).alias("v")).where("v is not null")
    n = int(ints.count() * fraction)
    value, above, ties = _at_rank(ints, n) or (None, None, None)
    kind = ints.schema["v"].dataType
    row = table.sparkSession.range(1 if ties else 0)
    return row.select(F.lit(value).cast(kind).alias("threshold"), F.lit(above).cast("long").alias("above"), F.lit(ties).cast("long").alias("ties"), F.lit((n - above) / ties if ties else None).cast("double").alias("prob"))


def by_text_fraction(table: DataFrame, score: str, fraction: float, seed: int = 42) -> DataFrame:
    """T02 applied: all above the threshold and the tie share of those at it, drawn by hash of uid; a share of 0 keeps all ties."""
    cut = F.broadcast(text_threshold_and_share(table, score, fraction))
    v = scores.score_value(F.col(score))
    tie = (v == F.col("threshold")) & ((F.col("prob") == 0) | scores.hash_share(F.col("uid"), seed, F.col("prob")))
    return table.crossJoin(cut).where((F.col("status") == "success") & ((v > F.col("threshold")) | tie)).select(*table.columns)


def by_quality(table: DataFrame, score: str, threshold: float, bad_texts: DataFrame | None = None) -> DataFrame:
    """A float score, the bad-pattern test and the list of bad texts; status is not looked at."""
    out = by_threshold(table, score, threshold).where(text.no_bad_pattern(F.col("caption")))
    return without_bad_texts(out, bad_texts) if bad_texts is not None else out


def mentions_entity(captions: DataFrame, lexicon: DataFrame, entities: DataFrame) -> DataFrame:
    """English captions with a word whose sense (lexicon: word, entity) is among entities (entity)."""
    wanted = lexicon.join(entities.select("entity").distinct(), "entity", "left_semi").select("word").distinct()
    english = captions.where(F.col("lang") == "en")
    found = english.select("uid", F.explode(F.array_distinct(text.words(F.lower("caption")))).alias("word")).join(wanted, "word", "left_semi")
    return english.join(found.select("uid").distinct(), "uid", "left_semi")


def sorted_uids(kept: DataFrame) -> DataFrame:
    """uid_hi, uid_lo in ascending order, duplicates kept."""
    return kept.select(scores.uid_hi(F.col("uid")).alias("uid_hi"), scores.uid_lo(F.col("uid")).alias("uid_lo")).orderBy("uid_hi", "uid_lo")


def sample_with_replacement(table: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Exactly int(n * ratio) draws with replacement; draw d takes the row at hash(d) mod n in key order."""
    n = table.count()
    numbered = table.withColumn("__at", F.row_number().over(Window.orderBy(key)) - 1)
    draws = table.sparkSession.range(int(n * ratio)).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("__at"))
    return draws.join(numbered, "__at").drop("__at")


# ----------------------------------------------------------------- router

Filter = Callable[..., DataFrame]
FILTERS: dict[str, Filter] = {
    "no_filter": lambda t, **_: t,
    "basic_filter": lambda t, **o: basic(t, o.get("strict", False), o.get("bad_texts")),
    "text_based": lambda t, **o: mentions_entity(t, o["lexicon"], o["entities"]),
    "laion2b": lambda t, **_: by_threshold(t, "clip_b32_similarity_score", 0.28).where(F.col("lang") == "en"),
    "clip_score": lambda t, **o: by_threshold(t, o["score"], o["threshold"]) if o.get("threshold") is not None else by_fraction(t, o["score"], o["fraction"]),
    **{
        f"{m}_score": (lambda s: lambda t, **o: by_score_text(t, s, o["threshold"]) if o.get("threshold") is not None else by_text_fraction(t, s, o["fraction"]))(f"{m}_score")
        for m in ("image_text_matching", "object_detail_fulfillment", "caption_text_quality", "semantic_understanding")
    },
    **{m: (lambda s: lambda t, **o: by_quality(t, s, o["threshold"], o.get("bad_texts")))(m) for m in ("quality_score", "reward_quality_score", "dfn_clipscore")},
}
#: Scores that only take a threshold.
THRESHOLD_ONLY = {"caption_text_quality_score", "semantic_understanding_score", "quality_score", "reward_quality_score", "dfn_clipscore"}


def check_options(name: str, threshold: float | None = None, fraction: float | None = None, score: str | None = None, **_: object) -> None:
    """The options that a filter takes and those that exclude each other."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; known: {sorted(FILTERS)}")
    scored = name == "clip_score" or name.endswith("_score") or name.endswith("clipscore")
    if not scored and (threshold is not None or fraction is not None):
        raise ValueError(f"{name} takes neither threshold nor fraction")
    if scored and (threshold is None) == (fraction is None):
        raise ValueError(f"{name} takes either a threshold or a fraction")
    if name in THRESHOLD_ONLY and fraction is not None:
        raise ValueError(f"{name} takes a threshold only")
    if fraction is not None and not 0 <= fraction < 1:
        raise ValueError("fraction must be at least 0 and below 1")
    if (name == "clip_score") != (score is not None):
        raise ValueError("clip_score, and no other filter, needs the name of its score column")


def apply(name: str, table: DataFrame, **options: object) -> DataFrame:
    """The rows of the table that the named filter keeps."""
    check_options(name, **{k: v for k, v in options.items() if k in ("threshold", "fraction", "score")})
    return FILTERS[name](table, **options)
