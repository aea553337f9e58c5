"""Mixing sources to target weights: documents get hash-random keys, are sorted by key within their source, and the running
sum of their words is cut at the source's exact budget, after as many whole epochs as the budget holds."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import number
from .common import cut, tasks, word_count

#: The weights of the sources in code-point order, repeating; the share of all words; the most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size), one row each, with `target`.

    The share of all words goes to the sources by weight; what exceeds `most` times a source's words is reshared among the
    others until none exceeds it: every source gets min(most * size, weight * level) for one level. The level rises from
    that of all sources, each time leaving out those that are full, until no more are; a round is one aggregation.
    """
    numbered = number(sources.withColumn("last", F.col("source").isNull()), ["last", "source"], "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    known = cut(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    budget = float(known.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        held, open_ = known.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:  # all are full
            return known.select("source", "source_size", F.col("cap").alias("target"))
        higher = (budget - (held or 0.0)) / open_
        if higher <= level:
            return known.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))
        level = higher


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Every document with what the mix takes of it: (doc_id, size, source_size, target, taken, row).

    size is the number of words, 0 for a null or empty text. The null source is one more source, the last. Within a
    source the documents' order is that of a hash of doc_id; rows with the same doc_id keep any order among each other
    by size. The words taken from a source are its target, rounded to whole words; the last document is cut. `row`
    tells rows of the same doc_id apart.
    """
    n = tasks(docs)
    key = F.xxhash64("doc_id", F.lit(seed))
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", key))
    # ranges of a uniform key: bucket b holds the keys of the b-th part of all longs, so buckets are in the keys' order
    rows = rows.withColumn("bucket", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    start = sums.withColumn("start", F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words"))
    start = start.join(goal, same(start, goal)).select(start["source"].alias("s"), start["bucket"].alias("b"), "start", "source_size", "target")
    inner = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inner))
    placed = placed.join(start, placed["source"].eqNullSafe(F.col("s")) & (placed["bucket"] == F.col("b")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    before = F.col("start") + F.col("upto") - F.col("size")
    part = F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "source")


def take(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them, with the columns of docs, whatever their names: a row for each epoch, the last cut after as many
    words as are taken. Documents without words are not taken. Rows that share doc_id, source and number of words share what
    is taken; a null doc_id or source is a value like others. An empty table gives no row."""
    keys = {"quire_doc": "doc_id", "quire_source": "source", "quire_size": "size"}
    taken = mix(docs, **how).filter("taken > 0").groupBy(*(F.col(c).alias(n) for n, c in keys.items())).agg(F.max("taken").alias("quire_taken"))
    rows = docs.withColumn("quire_words", word_count(F.col("text")))
    met = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("quire_doc")) & F.col("source").eqNullSafe(F.col("quire_source")) & (F.col("quire_words") == F.col("quire_size")))
    met = met.withColumn("quire_epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quire_taken") / F.col("quire_words")).cast("int"))))
    left = F.col("quire_taken") - (F.col("quire_epoch") - 1) * F.col("quire_words")
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)  # each with the white space before it
    text = F.when(left >= F.col("quire_words"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    return met.withColumn("text", text).select(*docs.columns)
