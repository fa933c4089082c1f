"""Questions with their annotations, demonstrations, and referring expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import answers as ans
from quarrykit.operators import scorers

#: Splits that are named by their last letter, and the one that takes every test split.
LETTER_SPLITS = ("testA", "testB", "testC")
ANY_TEST = "test"


def _among(column: str, values: Iterable | None) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(*values)


def question_index(questions: DataFrame, annotations: DataFrame, image_ids: Iterable | None = None, question_types: Iterable | None = None, answer_types: Iterable | None = None) -> DataFrame:
    """Annotations with their questions, of the given images and types; None takes all.

    The conditions stand on the scans, as the join is an inner one by question_id.
    """
    wanted = annotations.where(_among("question_type", question_types) & _among("answer_type", answer_types))
    return wanted.join(questions.where(_among("image_id", image_ids)), "question_id")


def with_split(rows: DataFrame, key: str, test_keys: DataFrame, test: str = "test", other: str = "train") -> DataFrame:
    """Rows with a column split: `test` for those whose key is in test_keys (of the same column)."""
    marked = test_keys.select(F.col(key).alias("__key"), F.lit(True).alias("__in")).distinct()
    return rows.join(marked, F.col(key) == F.col("__key"), "left").withColumn("split", F.when(F.col("__in"), test).otherwise(other)).drop("__key", "__in")


def demonstrations(dev: DataFrame, subject: str, order: str, text: str, size: int = 5) -> DataFrame:
    """Subject, n, prompt: the first `size` rows of each subject in order, one after the other."""
    first = dev.withColumn("__at", F.row_number().over(Window.partitionBy(subject).orderBy(order))).where(F.col("__at") <= size)
    held = F.array_sort(F.collect_list(F.struct("__at", F.col(text).alias("text"))))
    return first.groupBy(subject).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(held, lambda r: r["text"]), "\n\n").alias("prompt"))


def vqa_scores(predictions: DataFrame, index: DataFrame, plain_golds: bool = False) -> DataFrame:
    """Kind, name, n, points, accuracy (overall, by question type, by answer type) of (question_id, answer) against an index with `answers`.

    Predictions are normalised (X02, X03), golds too with `plain_golds`; a question without a prediction counts as wrong.
    """
    plain = lambda c: ans.plain_words(ans.plain_punctuation(F.btrim(F.regexp_replace(c, r"[\n\t]", " "))))
    golds = F.transform("answers", plain) if plain_golds else F.col("answers")
    rows = index.join(predictions.select("question_id", plain(F.col("answer")).alias("answer")), "question_id", "left")
    scored = rows.withColumn("points", F.coalesce(ans.soft_accuracy_30(F.col("answer"), golds), F.lit(0)))
    return scorers.soft_accuracy(scored, "points", "question_type", "answer_type")


def reference_filter(refs: DataFrame, image_ids: Iterable | None = None, category_ids: Iterable | None = None, ref_ids: Iterable | None = None, split: str | None = None) -> DataFrame:
    """References of the given images, categories, ids and split."""
    name = F.col("split")
    if split is None:
        in_split = F.lit(True)
    elif split == ANY_TEST:
        in_split = name.contains(ANY_TEST)
    else:
        in_split = name.contains(split[-1]) if split in LETTER_SPLITS else name == split
    return refs.where(_among("image_id", image_ids) & _among("category_id", category_ids) & _among("ref_id", ref_ids) & in_split)


def expressions(refs: DataFrame, annotations: DataFrame) -> DataFrame:
    """A row for each sentence of a reference, with its number and the annotation's box."""
    boxes = annotations.select("ann_id", "bbox")
    return refs.join(boxes, "ann_id").select("*", F.posexplode("sentences").alias("sent", "sentence")).drop("sentences")


def box_scores(rows: DataFrame, overlap: Column, group: str, least: float) -> DataFrame:
    """Name, n, n_correct, accuracy of each group and of All; a box that is no box (null overlap) is wrong."""
    hit = F.coalesce(overlap >= least, F.lit(False))
    each = rows.select(hit.alias("__hit"), F.explode(F.array(F.lit("All"), F.col(group).cast("string"))).alias("name"))
    return scorers.accuracy(each, F.col("__hit"), ["name"])
