"""Lookups of many codes in many ranges, by sorting both together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .scans import last_known, running


def pieces(known: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, nth, lo, hi, first), of which a later one overrides earlier ones, as disjoint starts: (keys, at, nth, lo, first), with nulls in nth, lo and
    first where no range holds what follows.

    Ranges begin and end at events, which are numbered. A range is parted into blocks of a power of two of events, the last range of each
    block is kept by an aggregation, and every event asks the blocks that hold it, of the sizes that occur; so ranges that lie inside each other
    cost a logarithm, and none is compared with all others.
    """
    ends = known.select(*keys, F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("at")).distinct()
    nth = running(ends.withColumn("one", F.lit(1)), keys, ["at"], "one", "quire_nth")
    place = lambda name: nth.select(*keys, F.col("at").alias(name), F.col("quire_nth").alias(f"quire_{name}"))
    spans = known.withColumn("quire_end", F.col("hi") + 1).join(place("lo"), [*keys, "lo"]).join(place("quire_end").withColumnRenamed("quire_quire_end", "quire_hi"), [*keys, "quire_end"])
    parts = spans.select(*keys, "nth", "lo", "first", F.explode(dyadic("quire_lo", "quire_hi")).alias("b")).select(*keys, "nth", "lo", "first", "b.*")
    best = parts.groupBy(*keys, "scale", "block").agg(F.max(F.struct("nth", "lo", "first")).alias("best"))
    best = cut(best)
    used = sorted(r[0] for r in best.select("scale").distinct().collect())  # as many as the bits of a count
    asked = nth.select(*keys, "at", F.explode(blocks_of("quire_nth", used)).alias("b")).select(*keys, "at", "b.*")
    met = asked.join(best, [*keys, "scale", "block"]).select(*keys, "at", "best")
    # an event that no block holds is there too, with nulls
    held = met.unionByName(ends.withColumn("best", F.lit(None).cast(best.schema["best"].dataType))).groupBy(*keys, "at").agg(F.max("best").alias("best"))
    return held.select(*keys, "at", "best.*")


def blocks_of(place: str, scales: list[int]):
    """The blocks (scale, block) of these scales that hold a number."""
    return F.transform(F.lit(scales).cast("array<int>"), lambda s: F.struct(s.alias("scale"), F.floor(F.col(place) / F.pow(F.lit(2.0), s)).cast("long").alias("block")))


def dyadic(lo: str, hi: str):
    """The blocks (scale, block) that part the numbers from lo to hi - 1: of each scale at most the first and the last that fit and that no larger one covers."""
    size = lambda s: F.pow(F.lit(2.0), s)
    first, end = (lambda s: F.ceil(F.col(lo) / size(s))), (lambda s: F.floor(F.col(hi) / size(s)))
    one = lambda s, block: F.struct(s.alias("scale"), block.cast("long").alias("block"))
    scales = F.sequence(F.lit(0), F.ceil(F.log2(F.col(hi) - F.col(lo) + 1)).cast("int"))

    def fits(s):
        a, b, up_a, up_b = first(s), end(s), first(s + 1) * 2, end(s + 1) * 2
        inside = F.sequence(F.lit(0), F.lit(1))
        left = F.filter(F.transform(inside, lambda i: a + i), lambda x: (x < b) & ((x < up_a) | (up_a >= up_b)))
        right = F.filter(F.transform(inside, lambda i: b - 1 - i), lambda x: (x >= a) & (x >= up_b) & (up_a < up_b))
        return F.transform(F.array_distinct(F.concat(left, right)), lambda x: one(s, x))

    return F.flatten(F.transform(scales, fits))


def last_holding(rows: DataFrame, known: DataFrame, keys: list[str], code: str, name: str) -> DataFrame:
    """rows with `name`, (nth, lo, first) of the last range (nth largest) of known (keys, nth, lo, hi, first) that holds their code, with nulls in it or null itself where none does. Codes
    and the starts of disjoint pieces are sorted together, and the last start before a code is carried to it over all partitions."""
    starts = pieces(known, keys).select(*keys, F.col("at").alias("quire_code"), F.lit(0).alias("quire_kind"), F.struct("nth", "lo", "first").alias("quire_start"))
    asked = rows.select(*keys, F.col(code).cast("long").alias("quire_code"), F.lit(1).alias("quire_kind"), F.monotonically_increasing_id().alias("quire_id"), *(F.col(c).alias(f"quire_r_{c}") for c in rows.columns if c not in keys))
    found = last_known(starts.unionByName(asked, allowMissingColumns=True), keys, ["quire_code", "quire_kind", "quire_id"], "quire_start", "quire_found").filter("quire_kind = 1")
    return found.select(*(F.col(c if c in keys else f"quire_r_{c}").alias(c) for c in rows.columns), F.when(F.col("quire_code").isNotNull(), F.col("quire_found")).alias(name))


def lookup(rows: DataFrame, known: DataFrame, keys: list[str], code: str, name: str, fixed: bool = False) -> DataFrame:
    """rows with `name`: first + code - lo (with fixed: first) of the last range (nth largest) of known (keys, nth, lo, hi, first) that holds their code, else 0. A code of null gives 0."""
    found = last_holding(rows, known, keys, code, "quire_held")
    value = F.col("quire_held.first") + (F.lit(0) if fixed else F.col(code).cast("long") - F.col("quire_held.lo"))
    return found.select(*rows.columns, F.coalesce(value, F.lit(0)).alias(name))


def reverse(known: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges from values back to codes: (keys, nth, lo, hi, first) with lo and hi values and first the code of lo. Where several codes have a value, that of
    the earliest range is the one: ranges are numbered the other way round."""
    return known.select(*keys, (-F.col("nth")).alias("nth"), F.col("first").alias("lo"), (F.col("first") + F.col("hi") - F.col("lo")).alias("hi"), F.col("lo").alias("first"))


def coded(rows: DataFrame, known: DataFrame, undefined: DataFrame, keys: list[str], code: str, name: str) -> DataFrame:
    """rows with `name`: what the last range of known that holds their code makes of it, else the one value of the last such range of undefined, else 0; both
    (keys, nth, lo, hi, first), with values from 0. With the length of codes among the keys, equal codes of other lengths are others. A code of null gives 0."""
    # values moved by one, so that 0 tells that no range holds the code
    found = lookup(rows, known.withColumn("first", F.col("first") + 1), keys, code, "quire_cid")
    both = lookup(found, undefined, keys, code, "quire_undefined", fixed=True)
    return both.select(*rows.columns, F.when(F.col("quire_cid") > 0, F.col("quire_cid") - 1).otherwise(F.col("quire_undefined")).alias(name))
