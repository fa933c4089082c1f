"""Evaluation metrics over predictions and golds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_results(results: DataFrame, key: str = "question_id", file: str = "rank") -> DataFrame:
    """Of several results of a key the one of the last file."""
    cols = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(file)).alias("r")).select(key, "r.*")


def check_same_keys(predictions: DataFrame, golds: DataFrame, key: str = "question_id") -> None:
    """Fails if a key is on one side only."""
    missing = golds.join(predictions, key, "left_anti").count()
    extra = predictions.join(golds, key, "left_anti").count()
    if missing or extra:
        raise ValueError(f"{missing} golds without prediction, {extra} predictions without gold")


def accuracy(rows: DataFrame, correct: Column, by: list[str] | None = None) -> DataFrame:
    """N, n_correct and accuracy, of all rows or by group."""
    g = rows.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("n_correct"), F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("accuracy"))


def micro_and_macro(rows: DataFrame, correct: Column, split: str) -> DataFrame:
    """One row: micro over all rows and macro, the unweighted mean of the splits' accuracies."""
    per = accuracy(rows, correct, [split])
    return per.agg((F.sum("n_correct") / F.sum("n")).alias("micro"), F.avg("accuracy").alias("macro"))


def soft_accuracy(rows: DataFrame, points: str, question_type: str, answer_type: str, full: int = 30) -> DataFrame:
    """Overall, by question type and by answer type in one pass (grouping sets): kind, name, n, points."""
    sets = rows.select(points, F.explode(F.array(F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("question_type").alias("kind"), F.col(question_type).alias("name")), F.struct(F.lit("answer_type").alias("kind"), F.col(answer_type).alias("name")))).alias("g"))
    return sets.groupBy("g.kind", "g.name").agg(F.count(F.lit(1)).alias("n"), F.sum(points).alias("points")).withColumn("accuracy", F.round(F.col("points") * 100.0 / (F.col("n") * full), 2))


def f1(rows: DataFrame, gold: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """A10: tp, fp, fn and f1 (0 where undefined) of boolean columns."""
    g = rows.select(*(by or []), F.coalesce(gold, F.lit(False)).alias("__g"), F.coalesce(predicted, F.lit(False)).alias("__p")).groupBy(*(by or []))
    out = g.agg(F.count_if(F.col("__g") & F.col("__p")).alias("tp"), F.count_if(~F.col("__g") & F.col("__p")).alias("fp"), F.count_if(F.col("__g") & ~F.col("__p")).alias("fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")), F.lit(0.0)))


def roc_auc(rows: DataFrame, gold: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the curve by rank sums over distinct scores, ties at half; null with one class only."""
    keys = by or []
    per = rows.select(*keys, score.alias("__s"), gold.cast("long").alias("__g")).groupBy(*keys, "__s").agg(F.sum("__g").alias("p"), F.sum(1 - F.col("__g")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"))


def average_precision(rows: DataFrame, gold: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """The sum over distinct thresholds, from the top, of precision times gain in recall."""
    keys = by or []
    per = rows.select(*keys, score.alias("__s"), gold.cast("long").alias("__g")).groupBy(*keys, "__s").agg(F.sum("__g").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__s"))
    upto = per.withColumn("tp", F.sum("p").over(w)).withColumn("all", F.sum("n").over(w))
    return upto.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p")), F.lit(0.0)).alias("ap"))


def roc_auc_ovo(rows: DataFrame, gold: str, probabilities: str, classes: int) -> DataFrame:
    """The mean over unordered pairs of classes of both directions' areas.

    Each row gives a line for every other class, so the join of pairs is an explode of classes - 1 rows.
    """
    other = F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("other")
    lines = rows.select(F.col(gold).alias("g"), F.col(probabilities).alias("p"), other).where("g <> other")
    pair = [F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b")]
    lines = lines.select(*pair, "g", "p")
    both = lines.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("c"), (F.col("g") == F.col("a")).alias("pos"), F.element_at("p", (F.col("a") + 1).cast("int")).alias("s")), F.struct(F.col("b").alias("c"), (F.col("g") == F.col("b")).alias("pos"), F.element_at("p", (F.col("b") + 1).cast("int")).alias("s")))).alias("x")).select("a", "b", "x.*")
    per = roc_auc(both, F.col("pos"), F.col("s"), ["a", "b", "c"])
    return per.groupBy("a", "b").agg(F.avg("auc").alias("auc")).agg(F.avg("auc").alias("auc"))


def average_precision_macro(rows: DataFrame, gold: str, probabilities: str, classes: int) -> DataFrame:
    """A13, multi-class: the mean over classes of one-against-all average precision."""
    lines = rows.select(F.col(gold).alias("g"), F.posexplode(F.slice(probabilities, 1, classes)).alias("c", "s"))
    return average_precision(lines, F.col("g") == F.col("c"), F.col("s"), ["c"]).agg(F.avg("ap").alias("ap"))


def chi_square(rows: DataFrame, group: str, gold: str, predicted: str) -> DataFrame:
    """One row: the distance of predicted from gold answers in each group, over gold answers, weighted by group size, / 100."""
    known = rows.where(F.col(group).isNotNull())
    g = known.groupBy(group, F.col(gold).alias("a")).agg(F.count(F.lit(1)).alias("e"))
    p = known.groupBy(group, F.col(predicted).alias("a")).agg(F.count(F.lit(1)).alias("o"))
    o = F.coalesce("o", F.lit(0))
    per = g.join(p, [group, "a"], "left").groupBy(group).agg(F.sum((o - F.col("e")) * (o - F.col("e")) / F.col("e")).alias("x"), F.sum("e").alias("w"))
    return per.agg(F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("s")).select((F.col("s") / 100).alias("chi_square"))


def grouped_means(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """Kind, name, n and mean by each grouping, in one pass."""
    lines = rows.select(value, F.explode(F.array(*(F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("name")) for g in groups))).alias("g"))
    return lines.groupBy("g.kind", "g.name").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def weighted_accuracy(groups: DataFrame) -> DataFrame:
    """(accuracy, n) -> their average weighted by n, null without rows."""
    return groups.agg(F.try_divide(F.sum(F.col("accuracy") * F.col("n")), F.sum("n")).alias("accuracy"))


def contained(gold: Column, output: Column, lower: bool) -> Column:
    """The gold text inside the output; with `lower`, whatever the case."""
    return F.lower(output).contains(F.lower(gold)) if lower else output.contains(gold)


# ----------------------------------------------------------------- caption scores


def ngram_counts(texts: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """Keys, k, gram, n of a table with a text column: the 1- to `most`-grams of words and how often they occur."""
    # The words are a column of their own: inside the lambdas an expression would be split anew for every n-gram.
    split = texts.select(*keys, F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "").alias("__t"))
    grams = reduce(lambda a, b: F.concat(a, b), (_grams(F.col("__t"), k) for k in range(1, most + 1)))
    return split.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.k", "g.gram").agg(F.count(F.lit(1)).alias("n"))


def _grams(t: Column, k: int) -> Column:
    starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(t, i, k), " ").alias("gram")))


def cider(predictions: DataFrame, references: DataFrame, sigma: float = 6.0, most: int = 4) -> DataFrame:
    """(image, text) and (image, ref, text) -> image, cider.

    Document frequency counts images.  Norms come from each side's own n-grams; the
    product only needs n-grams of both sides, so the join is by image and n-gram.
    """
    images = references.select("image").distinct()
    hyp = ngram_counts(predictions.join(images, "image", "left_semi"), ["image"], most)
    ref = ngram_counts(references, ["image", "ref"], most)
    df = ref.select("image", "k", "gram").distinct().groupBy("k", "gram").agg(F.count(F.lit(1)).alias("df"))
    total = images.agg(F.log(F.count(F.lit(1)).cast("double")).alias("logn"))

    def weighted(counts: DataFrame) -> DataFrame:
        idf = F.col("logn") - F.log(F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).cast("double"))
        return counts.join(df, ["k", "gram"], "left").crossJoin(F.broadcast(total)).withColumn("w", F.col("n") * idf)

    h, r = weighted(hyp), weighted(ref)
    length = F.coalesce(F.sum(F.when(F.col("k") == 2, F.col("n"))), F.lit(0))
    norms = [F.sqrt(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("w") * F.col("w"))), F.lit(0.0))).alias(f"norm{k}") for k in range(1, most + 1)]
    hn = h.groupBy("image").agg(length.alias("hlen"), *(c.alias(f"h{i}") for i, c in enumerate(norms, 1)))
    rn = r.groupBy("image", "ref").agg(length.alias("rlen"), *(c.alias(f"r{i}") for i, c in enumerate(norms, 1)))
    dots = r.select("image", "ref", "k", "gram", F.col("w").alias("rw")).join(h.select("image", "k", "gram", F.col("w").alias("hw")), ["image", "k", "gram"]).groupBy("image", "ref").agg(*(F.sum(F.when(F.col("k") == k, F.least("hw", "rw") * F.col("rw"))).alias(f"d{k}") for k in range(1, most + 1)))
    # A reference without a word has no n-gram; it counts among the references all the same.
    refs = references.select("image", "ref").distinct().join(rn, ["image", "ref"], "left").join(hn, "image", "left").join(dots, ["image", "ref"], "left")
    penalty = F.exp(-F.pow(F.coalesce("hlen", F.lit(0)) - F.coalesce("rlen", F.lit(0)), F.lit(2)) / (2 * sigma * sigma))
    parts = [F.coalesce(F.try_divide(F.col(f"d{k}"), F.when(F.col(f"h{k}") * F.col(f"r{k}") == 0, F.lit(1.0)).otherwise(F.col(f"h{k}") * F.col(f"r{k}"))), F.lit(0.0)) for k in range(1, most + 1)]
    return refs.withColumn("s", reduce(lambda a, b: a + b, parts) * penalty / most).groupBy("image").agg((F.sum("s") / F.count(F.lit(1)) * 10).alias("cider"))


def bleu4_counts(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """One row: matched and total n-grams of order 1 to 4 over the corpus, lengths, and BLEU-4."""
    hyp = ngram_counts(predictions, ["image"])
    ref = ngram_counts(references, ["image", "ref"]).groupBy("image", "k", "gram").agg(F.max("n").alias("most"))
    both = hyp.join(ref, ["image", "k", "gram"], "left")
    sums = [x for k in range(1, 5) for x in (F.sum(F.when(F.col("k") == k, F.least("n", F.coalesce("most", F.lit(0))))).alias(f"m{k}"), F.sum(F.when(F.col("k") == k, F.col("n"))).alias(f"t{k}"))]
    n_tokens = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    lens = predictions.select("image", n_tokens(F.col("text")).alias("c"))
    near = references.select("image", n_tokens(F.col("text")).alias("r")).join(lens, "image").groupBy("image").agg(F.first("c").alias("c"), F.min(F.struct(F.abs(F.col("r") - F.col("c")).alias("d"), "r"))["r"].alias("r"))
    out = both.agg(*sums).crossJoin(near.agg(F.sum("c").alias("c"), F.sum("r").alias("r")))
    log_p = reduce(lambda a, b: a + b, (F.log(F.col(f"m{k}") / F.col(f"t{k}")) for k in range(1, 5))) / 4
    brevity = F.when(F.col("c") < F.col("r"), 1 - F.col("r") / F.col("c")).otherwise(0.0)
    return out.withColumn("bleu4", F.when(reduce(lambda a, b: a & b, (F.col(f"m{k}") > 0 for k in range(1, 5))), F.exp(log_p + brevity)).otherwise(0.0))
