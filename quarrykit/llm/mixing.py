"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything runs as DataFrame operations.  The water level needs no loop: with the
sources in ascending order of cap / weight, the level that remains if all before a
source are clamped rises while clamping is right and falls after, so it is the
maximum over the sources.  Fractions take whole documents in the order of a seeded
hash while they fit, in rounds: each goes on with the documents that fit what
the round before left over, so the mix stays just under each source's target.

Defined cases: null source is a source of its own, last in order; null or empty text
has size 0 and its document is repeated like others of its source, taking no words;
sources of size 0 get target 0 and no copies; repeated rows and equal ids share one hash and are
taken together; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import n_words, small, stored

SEED = "mix-1"
MAX_EPOCHS = 3
#: Fixed value: hexadecimal digits of the hash that split a source into 4096 buckets for its running sums.
BUCKET_DIGITS = 3
#: One round a value: it takes documents of at most this share of what is missing, so that what stays missing shrinks by as much.
ROUNDS = (1.0, 0.25, 0.25, 1.0)


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weight_cycle: int = 3) -> DataFrame:
    """source, source_size, target of a table with source and size. One row a source passes through one task, never a document."""
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = source.withColumn("weight", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("weight") - 1) % weight_cycle + 1).cast("long"))
    ratio = [(F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs).cast("double") / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    leveled = leveled.withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", F.least(F.col("weight") * F.col("level"), (F.col("source_size") * max_epochs).cast("double")).alias("target"))


def plan(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, whole (copies of every document) and one rule a round.

    A round takes, of the documents not taken yet whose size fits what is missing,
    those with the smallest hashes while they fit; its rule is (fits, cutoff).
    """
    goal = targets(sizes, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rules", F.expr("cast(array() as array<struct<fits:double,cutoff:string>>)"))
    goal = stored(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    for share in ROUNDS:
        free = (
            sizes.alias("s").join(small(goal).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
            .where((F.col("s.size") > 0) & (F.col("s.size") <= F.col("g.rest") * share) & ~ruled(F.col("g.rules"), F.col("s.size"), F.col("s.key")))
            .select("s.source", "s.size", "s.key", "g.rest", F.substring("s.key", 1, BUCKET_DIGITS).alias("bucket"))
        )
        cells = free.groupBy("source", "bucket").agg(F.sum("size").alias("cell"), F.max("rest").alias("rest"))
        cells = cells.withColumn("upto", F.sum("cell").over(Window.partitionBy("source").orderBy("bucket")))
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("cell")).alias("before"))))
        edge = stored(cells.groupBy("source").agg(first.alias("e"), F.max("upto").alias("all")).select("source", "all", "e.*"), "mix-edges")
        at_edge = free.alias("s").join(small(edge).alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.bucket") == F.col("e.bucket")))
        keys = at_edge.groupBy("s.source", "s.key").agg(F.sum("s.size").alias("size"), F.max("e.before").alias("before"), F.max("s.rest").alias("rest"))
        keys = keys.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
        last = keys.where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "upto")).alias("l"))
        step = goal.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").join(last.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
        cutoff = F.when(F.col("e.all").isNull(), F.lit("")).otherwise(F.coalesce("l.l.key", "e.bucket", F.lit("g")))
        took = F.coalesce("l.l.upto", "e.before", "e.all", F.lit(0))
        rules = F.concat("g.rules", F.array(F.struct((F.col("g.rest") * share).alias("fits"), cutoff.alias("cutoff"))))
        goal = stored(step.select("g.source", "g.source_size", "g.target", "g.whole", rules.alias("rules"), (F.col("g.rest") - took).alias("rest")), "mix-plan")
    return goal


def ruled(rules: Column, size: Column, key: Column) -> Column:
    """Whether a rule takes a document of this size and hash once more; never one without words."""
    return (size > 0) & F.exists(rules, lambda r: (size <= r["fits"]) & (key <= r["cutoff"]))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("key"))


def assigned(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row of docs (doc_id, source, text)."""
    sizes = stored(sized(docs, seed), "mix-sizes")
    return (
        sizes.alias("s").join(small(plan(sizes, max_epochs)).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
        .withColumn("copies", F.col("p.whole") + ruled(F.col("p.rules"), F.col("s.size"), F.col("s.key")).cast("long"))
        .select("s.doc_id", "s.size", "p.source_size", "p.target", "copies", (F.col("s.size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; columns are those of docs."""
    p = small(plan(stored(sized(docs, seed), "mix-sizes"), max_epochs)).select(*(F.col(c).alias(f"__mix_{c}") for c in ("source", "whole", "rules")))
    joined = docs.join(p, docs["source"].eqNullSafe(F.col("__mix_source")))
    copies = (F.col("__mix_whole") + ruled(F.col("__mix_rules"), n_words(docs["text"]), order_key(docs["doc_id"], seed)).cast("long")).cast("int")
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*(docs[c] for c in docs.columns))
