"""Joins of intervals that overlap."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of stretches: 2 ** -LEVELS to 2 ** LEVELS times the intervals' mean length.
LEVELS = 30


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of intervals (lo, hi), right open, of the same keys that overlap: left's columns, and right's keys aside as r_*.

    An interval's level is that of the shortest stretches at least as long as it is, so it touches two of them at most, and of each higher level
    two at most. Intervals meet in the stretches of the higher of their two levels, and a pair is given out in the first that both touch; however long an interval,
    it is copied twice for each level that occurs. Intervals with lo >= hi or a null overlap nothing.
    """
    length = F.col("hi") - F.col("lo")
    sides = [t.filter("lo < hi") for t in (left, right)]
    mean = sides[0].select(length.alias("n")).unionAll(sides[1].select(length.alias("n"))).agg(F.avg("n")).first()[0]
    if not mean:
        mean = 1.0
    own = F.least(F.greatest(F.ceil(F.log2(length.cast("double") / mean)), F.lit(-LEVELS)), F.lit(LEVELS)).cast("int")
    used = sorted({r[0] for t in sides for r in t.select(own.alias("level")).distinct().collect()})  # 2 * LEVELS + 1 at most
    stretch = lambda x, level: F.floor(F.col(x).cast("double") / (F.pow(F.lit(2.0), level) * mean)).cast("long")

    def spread(t: DataFrame) -> DataFrame:
        t = t.withColumn("quire_own", own)
        t = t.withColumn("quire_level", F.explode(F.filter(F.lit(used).cast("array<int>"), lambda x: x >= F.col("quire_own"))))
        return t.withColumn("quire_at", F.explode(F.sequence(stretch("lo", F.col("quire_level")), stretch("hi", F.col("quire_level")))))

    here, there = (spread(t) for t in sides)
    there = there.select(*keys, "quire_level", "quire_at", F.col("quire_own").alias("quire_r_own"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    met = here.join(there, [*keys, "quire_level", "quire_at"]).filter(F.greatest("quire_own", "quire_r_own") == F.col("quire_level"))
    first = F.greatest(stretch("lo", F.col("quire_level")), stretch("r_lo", F.col("quire_level"))) == F.col("quire_at")
    return met.filter((F.col("lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("hi")) & first).drop("quire_own", "quire_r_own", "quire_level", "quire_at")
