"""Rows sorted over all partitions, and what is carried from one partition to the next."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut

PART = "quire_part"
#: Rows of a partition; their number grows with the rows, so that a task's memory does not.
ROWS = 250_000
LEAST = 8


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `quire_part`, the partition by key and order that each is in, dealt out by it. They are counted first, for partitions of bounded size."""
    n = max(LEAST, -(-rows.count() // ROWS))
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id())).repartition(n, PART)


def inside(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, PART).orderBy(*order)


def carried(here: DataFrame, keys: list[str], order: list[str], own: str, name: str, total) -> DataFrame:
    """here with `name`: what the partitions before have of the row's key, null if nothing. `own` in the last row of a key in a partition stands for the partition, and
    `total` over a window of such values for all up to one. Only a partition's last key goes on in the next, so what is carried is one row a partition, and is broadcast."""
    key = F.struct(*(F.col(k).alias(f"quire_k{i}") for i, k in enumerate(keys)), F.lit(0).alias("quire_k"))
    ends = here.withColumn("quire_more", F.lead(F.lit(1)).over(inside(keys, order))).filter("quire_more IS NULL").select(PART, key.alias("k"), F.struct(F.col(own).alias("v")).alias("own"))
    tails = ends.groupBy(PART).agg(F.max(F.struct("k", "own")).alias("t")).select(PART, "t.k", F.col("t.own.v").alias("v"))
    upto = W.partitionBy("k").orderBy(PART).rowsBetween(W.unboundedPreceding, 0)
    base = tails.select(F.lead(PART).over(W.orderBy(PART)).alias("quire_p"), F.col("k").alias("quire_key"), total("v").over(upto).alias(name))
    met = here.withColumn("quire_here", key).join(F.broadcast(base), F.col(PART) == F.col("quire_p"), "left")
    return met.withColumn(name, F.when(F.col("quire_here").eqNullSafe(F.col("quire_key")), F.col(name))).drop("quire_p", "quire_key", "quire_here")


def sums_before(rows: DataFrame, keys: list[str], order: list[str], value: str, own: str, base: str) -> DataFrame:
    """rows in partitions with `own`, the sum of the values of their key up to and with each in the partition, and `base`, that of the partitions before; null counts as nothing."""
    upto: Column = F.sum(value).over(inside(keys, order).rowsBetween(W.unboundedPreceding, 0))
    here = placed(rows, keys, order).withColumn(own, F.coalesce(upto, F.lit(0)))
    return carried(here, keys, order, own, base, F.sum).withColumn(base, F.coalesce(base, F.lit(0)))
