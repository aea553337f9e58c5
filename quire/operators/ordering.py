"""Operators on ordered rows: newest wins, offsets, numbering without gaps."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut
from .parts import sums_before


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in the order; partial maxima meet, so a frequent key is no burden."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*")


def offsets(rows: DataFrame, keys: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """The sum of the sizes before each row of its key. Rows are sorted over all partitions by key and order; a partition sums what it has
    of a key, and what the partitions before have of it is added, so a frequent key is spread over many."""
    met = sums_before(rows, keys, order, size, "quire_own", "quire_base")
    return met.withColumn(name, (F.col("quire_base") + F.col("quire_own") - F.coalesce(F.col(size), F.lit(0))).cast("long")).select(*rows.columns, name)


def number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 0 in the order of distinct keys: sorted over all partitions, counted in each, and shifted by the counts before."""
    placed = cut(rows.repartitionByRange(*order).withColumn("quire_part", F.spark_partition_id()))
    counts = placed.groupBy("quire_part").agg(F.count("*").alias("n"))  # one row a partition
    start = counts.select("quire_part", (F.sum("n").over(W.orderBy("quire_part")) - F.col("n")).alias("quire_start"))
    inside = placed.withColumn("quire_nth", F.row_number().over(W.partitionBy("quire_part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(start), "quire_part").withColumn(name, (F.col("quire_start") + F.col("quire_nth")).cast("long")).drop("quire_part", "quire_nth", "quire_start")


def inserted(rows: DataFrame, extra: DataFrame, keys: list[str], order: str, at: str, name: str) -> DataFrame:
    """rows and extra together with `name`, their places from 0 for each key: each of extra stands before the row whose place was its `at`, in the order of extra's
    own `order`; what stands beyond the end comes last. Columns that one of both lacks are null."""
    placed = _numbered(rows, keys, [order], "quire_at").withColumn("quire_kind", F.lit(1)).withColumn("quire_order", F.col(order))
    more = extra.withColumn("quire_at", F.col(at).cast("long")).withColumn("quire_kind", F.lit(0)).withColumn("quire_order", F.col(order)).drop(at)
    both = placed.unionByName(more, allowMissingColumns=True)
    return _numbered(both, keys, ["quire_at", "quire_kind", "quire_order"], name).drop("quire_at", "quire_kind", "quire_order")


def _numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return offsets(rows.withColumn("quire_one", F.lit(1)), keys, order, "quire_one", name).drop("quire_one")
