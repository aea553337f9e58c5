"""Joins of many points with many boxes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import ranges
from .ordering import number
from .scans import last_known

#: Sizes of tiles: 2 ** -LEVELS to 2 ** LEVELS times the boxes' mean extent.
LEVELS = 20


def boxes_at(points: DataFrame, boxes: DataFrame, fine: int = 1) -> DataFrame:
    """Every pair of a point (x, y, ...) and a box (x0, x1, y0, y1, ...), borders included, that holds it: the points' columns, and the boxes' as b_*.

    Boxes lie in tiles at least as wide as they are, so in at most four; each size of tiles that a box has is a level, and points are looked
    up once in each level that occurs. A pair meets in one tile only, the point's. Boxes with x0 > x1, y0 > y1 or a null hold nothing; those wider
    than the widest tile or thinner than the thinnest are in the last level and spread over the tiles they touch. With `fine` a tile is so many times smaller, so
    fewer points meet boxes that do not hold them, and a box has up to (fine + 1) ** 2 tiles.
    """
    sound = boxes.filter((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    mean = sound.agg(F.avg(F.col("x1") - F.col("x0")).alias("x"), F.avg(F.col("y1") - F.col("y0")).alias("y")).first()
    unit = {"x": mean["x"] or 1.0, "y": mean["y"] or 1.0}
    extent = F.greatest(*((F.col(f"{a}1") - F.col(f"{a}0")).cast("double") / unit[a] for a in "xy"))
    level = F.when(extent <= 0, F.lit(-LEVELS)).otherwise(F.least(F.greatest(F.ceil(F.log2(extent)), F.lit(-LEVELS)), F.lit(LEVELS))).cast("int")
    tile = lambda value, axis, at: F.floor(value.cast("double") / (F.pow(F.lit(2.0), at) * (unit[axis] / fine))).cast("long")
    named = sound.select(*(F.col(c).alias(f"b_{c}") for c in boxes.columns), level.alias("quire_level"))
    for a in "xy":
        named = named.withColumn(f"quire_{a}", F.explode(F.sequence(tile(F.col(f"b_{a}0"), a, F.col("quire_level")), tile(F.col(f"b_{a}1"), a, F.col("quire_level")))))
    used = sorted(r[0] for r in named.select("quire_level").distinct().collect())  # 2 * LEVELS + 1 at most
    at = points.withColumn("quire_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    at = at.select("*", *(tile(F.col(a), a, F.col("quire_level")).alias(f"quire_{a}") for a in "xy"))
    met = at.join(named, ["quire_level", "quire_x", "quire_y"])
    inside = F.col("x").between(F.col("b_x0"), F.col("b_x1")) & F.col("y").between(F.col("b_y0"), F.col("b_y1"))
    return met.filter(inside).drop("quire_level", "quire_x", "quire_y")


def _ranked(rows: DataFrame, marks: DataFrame, axes: dict[str, str]) -> DataFrame:
    """rows with, for each (column, name) of axes, the column's place among the numbered marks (at, nth): 2 * nth on a mark, one more behind it, -1 before all. Marks and
    rows are sorted together."""
    for column, name in axes.items():
        heads = marks.select(F.col("at").alias("quire_at"), F.lit(0).alias("quire_kind"), F.struct("at", "nth").alias("quire_mark"))
        asked = rows.withColumn("quire_at", F.col(column)).withColumn("quire_kind", F.lit(1))
        held = last_known(heads.unionByName(asked, allowMissingColumns=True), [], ["quire_at", "quire_kind"], "quire_mark", "quire_last").filter("quire_kind = 1")
        place = F.col("quire_last.nth") * 2 + F.when(F.col("quire_last.at") == F.col(column), 0).otherwise(1)
        rows = held.select(*rows.columns, F.coalesce(place, F.lit(-1)).alias(name))
    return rows


def topmost(points: DataFrame, boxes: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, order) of all points: the largest `order` among the boxes that hold it, null if none does. Rows with one key count as one point.

    No pair of a point and a box is made: boxes are parted into stretches of a power of two of the places between the boxes' borders on one axis, and in each stretch
    points are looked up on the other axis as in a map of ranges, of which the one with the largest order counts. Points at one place and boxes of one shape are one,
    so n points and m boxes cost some n log m + m log(m) ** 2 rows at most, however many boxes lie on each other.
    """
    sound = boxes.filter((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).groupBy("x0", "x1", "y0", "y1").agg(F.max(order).alias("nth"))
    places = points.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    shapes, sizes = cut(sound), {}
    for a in "xy":
        marks = cut(number(shapes.select(F.explode(F.array(f"{a}0", f"{a}1")).alias("at")).distinct(), ["at"], "nth"))
        shapes = _ranked(shapes, marks, {f"{a}0": f"quire_{a}0", f"{a}1": f"quire_{a}1"})
        places, sizes[a] = _ranked(places, marks, {a: f"quire_{a}"}), marks.count()
    places = cut(places)
    a, b = sorted("xy", key=sizes.get)
    parts = shapes.withColumn("quire_end", F.col(f"quire_{a}1") + 1).select("nth", F.col(f"quire_{b}0").alias("lo"), F.col(f"quire_{b}1").alias("hi"), F.explode(ranges.dyadic(f"quire_{a}0", "quire_end")).alias("p"))
    known = cut(parts.groupBy(F.col("p.scale").alias("quire_s"), F.col("p.block").alias("quire_k"), "lo", "hi").agg(F.max("nth").alias("nth")).withColumn("first", F.lit(0).cast("long")))
    used = sorted(r[0] for r in known.select("quire_s").distinct().collect())  # as many as the bits of a count
    cells = places.select("quire_x", "quire_y").distinct()
    asked = cells.select("quire_x", "quire_y", F.col(f"quire_{b}").alias("code"), F.explode(ranges.blocks_of(f"quire_{a}", used)).alias("p")).select("quire_x", "quire_y", "code", F.col("p.scale").alias("quire_s"), F.col("p.block").alias("quire_k"))
    held = ranges.last_holding(asked, known, ["quire_s", "quire_k"], "code", "found").groupBy("quire_x", "quire_y").agg(F.max("found.nth").alias(order))
    found = places.join(held, ["quire_x", "quire_y"]).select("x", "y", order)
    return points.select(*key, "x", "y").join(found, ["x", "y"], "left").groupBy(*key).agg(F.max(order).alias(order))


#: Polygons of more sides than this are looked up side by side.
SIDES = 1000
#: Tiles of a polygon's size on each axis: with 4, a polygon meets some 1.5 times the points in the box around it.
FINE = 4


def in_polygons(points: DataFrame, sides: DataFrame, key: list[str]) -> DataFrame:
    """(key, polygon) of the points (key, x, y) that lie in a polygon, of which sides (polygon, ax, ay, bx, by) are the sides: an odd number of them is
    crossed by the ray from the point to larger x. A point meets a polygon once, in the box around it, and counts its sides there, so of the rows that arise all but those
    in the box and not in the polygon are results. Polygons of more than SIDES sides are looked up by their sides."""
    high = sides.filter("ay <> by")
    around = cut(high.groupBy("polygon").agg(F.count("*").alias("quire_n"), F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1")))
    crossed = lambda c: ((F.col("y") < c("ay")) != (F.col("y") < c("by"))) & (F.col("x") < c("ax") + (F.col("y") - c("ay")) * (c("bx") - c("ax")) / (c("by") - c("ay")))
    spots = points.select(*key, "x", "y").distinct()
    listed = high.join(around.filter(F.col("quire_n") <= SIDES), "polygon").groupBy("polygon", "x0", "x1", "y0", "y1").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("sides"))
    inside = F.size(F.filter("b_sides", lambda e: crossed(lambda c: e[c]))) % 2 == 1
    found = boxes_at(spots, cut(listed), FINE).filter(inside).select(*key, F.col("b_polygon").alias("polygon"))
    long = around.filter(F.col("quire_n") > SIDES)
    if long.isEmpty():
        return found
    boxes = high.join(long.select("polygon", "x0"), "polygon").select("*", F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1"), F.greatest("ax", "bx").alias("x1"))
    odd = boxes_at(spots, boxes).filter(crossed(lambda c: F.col(f"b_{c}"))).groupBy(*key, F.col("b_polygon").alias("polygon")).agg(F.count("*").alias("n"))
    return found.unionByName(odd.filter("n % 2 = 1").drop("n"))
