"""Joins that spread a frequent key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than a thousandth of all rows, so there are fewer than this many.
HEAVY_KEYS = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of their group (inner join on a key that is never null). groups has one row of bounded size for each key, and in `count` how
    many rows have it; heavy keys' groups are broadcast, all others are joined by shuffle."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    heavy, light = groups.filter(F.col(count) > total / HEAVY_KEYS), groups.filter(F.col(count) <= total / HEAVY_KEYS)
    here = rows.join(F.broadcast(heavy), key)
    return here.unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))
