"""Lookups in ranges."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges up to this number are literals of the plan.
LITERAL_RANGES = 64


def ranges(rows: DataFrame, code: str, known: list[tuple[int, int, int]]) -> DataFrame:
    """rows with `cid`: first + code - lo of the last of the known ranges (lo, hi, first) that holds the code, else 0. The ranges of a map
    are cut where one begins or ends, so that each code has one piece at most; a long list of pieces is broadcast."""
    if len(known) <= LITERAL_RANGES:
        holds = [F.when(F.col(code).between(lo, hi), F.lit(first) + F.col(code) - lo) for lo, hi, first in reversed(known)]
        return rows.withColumn("cid", F.coalesce(*holds, F.lit(0)) if holds else F.lit(0))
    starts = sorted({x for lo, hi, _ in known for x in (lo, hi + 1)})
    shift: dict[int, int | None] = {}
    for at in starts:
        shift[at] = next((first - lo for lo, hi, first in reversed(known) if lo <= at <= hi), None)
    pieces = rows.sparkSession.createDataFrame([(a, b - 1, shift[a]) for a, b in zip(starts, starts[1:]) if shift[a] is not None], "quire_lo long, quire_hi long, quire_shift long")
    found = rows.join(F.broadcast(pieces), F.col(code).between(F.col("quire_lo"), F.col("quire_hi")), "left")  # a list of the caller's
    return found.withColumn("cid", F.coalesce(F.col(code) + F.col("quire_shift"), F.lit(0))).select(*rows.columns, "cid")


def first_found(rows: DataFrame, key: str, tables: list[DataFrame], value: str) -> DataFrame:
    """rows with `value` from the first of the tables (key, value), each with distinct keys, that has the key; null if none has."""
    named = [t.select(F.col(key), F.col(value).alias(f"quire_{i}")) for i, t in enumerate(tables)]
    met = reduce(lambda a, b: a.join(b, key, "left"), named, rows)
    return met.withColumn(value, F.coalesce(*(F.col(f"quire_{i}") for i in range(len(tables))))).select(*rows.columns, value)
