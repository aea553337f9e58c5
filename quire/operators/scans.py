"""Scans over ordered rows that go on from partition to partition, so that a frequent key is spread over many tasks.

Rows are sorted over all partitions by key and order and written. Of each partition only the last key goes on in the next, so one row a partition
tells what comes before, and each partition goes on from there.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import number
from .parts import PART, carried, inside, placed, sums_before


def _inside(keys, order):
    return inside(keys, order).rowsBetween(W.unboundedPreceding, 0)


def _before(keys):
    return W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def _with_parts(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their key and partition."""
    there = parts.select(*(F.col(k).alias(f"quire_k{i}") for i, k in enumerate(keys)), F.col(PART).alias("quire_p"), *(c for c in parts.columns if c not in (*keys, PART)))
    same = F.col(PART) == F.col("quire_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"quire_k{i}"))
    return rows.join(there, same).drop("quire_p", *(f"quire_k{i}" for i in range(len(keys))))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of the values of their key up to and with each. The order must be one of distinct rows; null counts as nothing."""
    return sums_before(rows, keys, order, value, "quire_own", "quire_base").withColumn(name, F.col("quire_base") + F.col("quire_own")).select(*rows.columns, name)


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the last value of their key, up to and with each, that is not null."""
    here = placed(rows, keys, order).withColumn("quire_own", F.last(value, ignorenulls=True).over(_inside(keys, order)))
    met = carried(here, keys, order, "quire_own", "quire_base", lambda v: F.last(v, ignorenulls=True))
    return met.withColumn(name, F.coalesce("quire_own", "quire_base")).select(*rows.columns, name)


def shifted(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before each of its key, null for the first."""
    seen = inside(keys, order)
    here = placed(rows, keys, order).withColumn("quire_first", F.row_number().over(seen) == 1).withColumn("quire_prev", F.lag(value).over(seen))
    met = carried(here.withColumn("quire_end", F.struct(F.col(value).alias("v"))), keys, order, "quire_end", "quire_base", F.last)
    return met.withColumn(name, F.when(F.col("quire_first"), F.col("quire_base.v")).otherwise(F.col("quire_prev"))).select(*rows.columns, name)


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: (keys, run, value, n), run from 1. A run that crosses partitions is one."""
    named = rows.select(*keys, *order, value, F.struct(F.col(value).alias("v")).alias("quire_v"))
    met = shifted(named, keys, order, "quire_v", "quire_before")
    new = F.col("quire_before").isNull() | ~F.col(value).eqNullSafe(F.col("quire_before.v"))
    marked = running(met.select(*keys, *order, value, new.cast("long").alias("quire_new")), keys, order, "quire_new", "run")
    return marked.groupBy(*keys, "run").agg(F.min(value).alias(value), F.count("*").alias("n"))


def depths(rows: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """rows with `depth`, how many brackets are open after each, and `stray`, whether it closes one that never opened. step: 1 opens, -1 closes,
    0 and null do nothing. A stray bracket leaves the depth at 0."""
    own = F.coalesce(F.col(step), F.lit(0)).cast("long")
    inside = _inside(keys, order)
    here = placed(rows, keys, order).withColumn("quire_s", F.sum(own).over(inside))
    here = here.withColumn("quire_low", F.min("quire_s").over(inside)).withColumn("quire_prev", F.min("quire_s").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    # a partition is summed up by its unmatched closers (how low it goes) and its sum
    parts = here.groupBy(*keys, PART).agg(F.sum(own).alias("quire_sum"), F.min("quire_s").alias("quire_least"))
    parts = parts.withColumn("quire_base", F.coalesce(F.sum("quire_sum").over(_before(keys)), F.lit(0)))
    parts = parts.select(*keys, PART, "quire_base", F.least(F.lit(0), F.min(F.col("quire_base") + F.col("quire_least")).over(_before(keys))).alias("quire_floor"))
    met = _with_parts(here, parts, keys)
    low = F.least("quire_floor", F.col("quire_base") + F.col("quire_low"))
    earlier = F.least("quire_floor", F.col("quire_base") + F.col("quire_prev"))  # least() passes over nulls
    return met.select(*rows.columns, (F.col("quire_base") + F.col("quire_s") - low).alias("depth"), (low < earlier).alias("stray"))


def blocks(rows: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """The balanced blocks: (keys, level, begin, end), level from 1, begin and end the order columns of the rows that open and close it, as structs.
    Brackets that are never closed or never opened are in no block."""
    known = depths(rows.select(*keys, *order, step), keys, order, step).filter((F.col(step) != 0) & ~F.col("stray"))
    level = F.when(F.col(step) > 0, F.col("depth")).otherwise(F.col("depth") + 1)
    known = known.withColumn("level", level)
    # on one level openers and closers alternate: an opener's closer is the next row of its level
    nth = number(known, [*keys, "level", *order], "quire_place")
    side = lambda s, name: nth.filter(F.col(step) == s).select(*(F.col(k).alias(f"{name}_{k}") for k in (*keys, "level")), F.struct(*order).alias(name), (F.col("quire_place") + (1 if s > 0 else 0)).alias("quire_place"))
    met = side(1, "begin").join(side(-1, "end"), "quire_place")
    for k in (*keys, "level"):
        met = met.filter(F.col(f"begin_{k}").eqNullSafe(F.col(f"end_{k}")))
    return met.select(*(F.col(f"begin_{k}").alias(k) for k in (*keys, "level")), "begin", "end")


def _marked(rows: DataFrame, keys: list[str], order: list[str], found: DataFrame) -> DataFrame:
    """rows with `quire_mark`: 1 where a block of `found` begins, -1 where it ends, else 0."""
    ends = found.select(*keys, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("quire_mark")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("quire_mark")))).alias("e")).select(*keys, *(F.col(f"e.at.{c}").alias(c) for c in order), "e.quire_mark")
    met = rows.join(ends.select(*(F.col(c).alias(f"quire_{c}") for c in (*keys, *order)), "quire_mark"), [F.col(c).eqNullSafe(F.col(f"quire_{c}")) for c in (*keys, *order)], "left")
    return met.select(*rows.columns, F.coalesce("quire_mark", F.lit(0)).alias("quire_mark"))


def without_blocks(rows: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """rows less those that lie in a balanced block, its brackets included; stray and unclosed brackets stay."""
    marked = _marked(rows, keys, order, blocks(rows, keys, order, step))
    covered = running(marked, keys, order, "quire_mark", "quire_cover")
    return covered.filter((F.col("quire_cover") == 0) & (F.col("quire_mark") == 0)).select(*rows.columns)


def flattened(rows: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """rows less the brackets of balanced blocks, with `level`, how many blocks each lies in."""
    marked = _marked(rows, keys, order, blocks(rows, keys, order, step))
    return running(marked, keys, order, "quire_mark", "level").filter("quire_mark = 0").select(*rows.columns, "level")
