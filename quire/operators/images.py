"""Histograms and thresholds of levels."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut


def histogram(rows: DataFrame, level: str, levels: int) -> DataFrame:
    """(level, n) of all levels from 0 on."""
    counts = rows.groupBy(F.col(level).cast("long").alias("level")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(levels).toDF("level").join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def otsu(rows: DataFrame, group: str, level: str) -> DataFrame:
    """(group, threshold): the level at which the variance between the levels up to it and those above is largest, the smallest of several."""
    h = rows.groupBy(group, F.col(level).alias("v")).agg(F.count("*").alias("n"))
    up, every = W.partitionBy(group).orderBy("v"), W.partitionBy(group)
    c = h.select(group, "v", F.sum("n").over(up).alias("w0"), F.sum("n").over(every).alias("t"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum(F.col("n") * F.col("v")).over(every).alias("s")).filter("t > w0")
    between = F.round(F.col("w0") * (F.col("t") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("t") - F.col("w0")), 2), 6)
    return c.groupBy(group).agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def _spread(w, r, g, b):
    """The share of the squares' sum that one mean colour takes away."""
    x, y, z = (F.col(c).cast("double") for c in (r, g, b))
    return (x * x + y * y + z * z) / F.col(w)


def coloured_boxes(pixels: DataFrame, keys: list[str], colours: int, shift: int = 1) -> DataFrame:
    """pixels (keys, r, g, b: 0 to 255) as cells in boxes of at most `colours` for each key: (keys, cell_r, cell_g, cell_b, box: from 0, n, sum_r, sum_g, sum_b).

    A cell is what remains of a colour without its last `shift` bits, and from the first aggregation on only cells are handled: their number does not grow with
    that of the pixels. Each round cuts, for all keys at once, the box with the largest variance (the first of equal ones) across the axis and at the level that leave
    the least variance in the two halves (red before green before blue, then the lowest level); the upper half is the new box. Moments of the halves are running sums over the
    box's levels, at most 256 of an axis. A key stops early if no box with more than one cell varies. Rows with a null among r, g and b are left out.
    """
    sums = ("n", "sum_r", "sum_g", "sum_b", "squares")
    rgb = [F.col(c).cast("long") for c in "rgb"]
    level = [F.shiftright(c, shift).alias(f"cell_{n}") for c, n in zip(rgb, "rgb", strict=True)]
    full = pixels.filter("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").select(*keys, *level, *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))
    cells = full.groupBy(*keys, "cell_r", "cell_g", "cell_b").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"), F.sum(F.expr("r * r + g * g + b * b")).alias("squares"))
    # keys are joined as one struct, which also holds where one of them is null
    cells = cut(cells.select(F.struct(*keys).alias("quire_key"), "cell_r", "cell_g", "cell_b", F.lit(0).alias("box"), *sums))
    axis, every = W.partitionBy("quire_key", "axis"), lambda c: F.col(f"all_{c}") - F.col(f"low_{c}")
    for new in range(1, colours):
        boxes = cells.groupBy("quire_key", "box").agg(F.count("*").alias("quire_cells"), *(F.sum(c).alias(c) for c in sums)).withColumn("variance", F.col("squares") - _spread("n", "sum_r", "sum_g", "sum_b"))
        chosen = boxes.filter("quire_cells > 1 AND variance > 0").groupBy("quire_key").agg(F.max_by("box", F.struct("variance", -F.col("box"))).alias("box"))
        inside = cells.join(chosen, ["quire_key", "box"])
        axes = F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(f"cell_{c}").alias("level")) for i, c in enumerate("rgb"))))
        levels = inside.select("quire_key", "box", *sums[:4], axes.alias("at")).groupBy("quire_key", "box", "at.axis", "at.level").agg(*(F.sum(c).alias(c) for c in sums[:4]))
        upto = levels.select("quire_key", "box", "axis", "level", *(F.sum(c).over(axis.orderBy("level")).alias(f"low_{c}") for c in sums[:4]), *(F.sum(c).over(axis).alias(f"all_{c}") for c in sums[:4]))
        halves = upto.filter("low_n < all_n").select("*", *(every(c).alias(f"high_{c}") for c in sums[:4]))
        gain = _spread("low_n", "low_sum_r", "low_sum_g", "low_sum_b") + _spread("high_n", "high_sum_r", "high_sum_g", "high_sum_b")
        best = halves.groupBy("quire_key").agg(F.max_by(F.struct("box", "axis", "level"), F.struct(gain, -F.col("axis"), -F.col("level"))).alias("quire_cut"))
        place = F.element_at(F.array("cell_r", "cell_g", "cell_b"), F.col("quire_cut.axis") + 1)
        goes = (F.col("box") == F.col("quire_cut.box")) & (place > F.col("quire_cut.level"))
        moved = cut(cells.join(best, "quire_key", "left").withColumn("box", F.when(goes, new).otherwise(F.col("box"))).drop("quire_cut"))
        if moved.filter(F.col("box") == new).isEmpty():
            break
        cells = moved
    return cells.select(*(F.col(f"quire_key.{k}").alias(k) for k in keys), "cell_r", "cell_g", "cell_b", "box", *sums[:4])


def palette(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box, n, r, g, b): the mean colour of each box, cut off to whole numbers."""
    means = boxes.groupBy(*keys, "box").agg(F.sum("n").alias("n"), *(F.floor(F.sum(f"sum_{c}") / F.sum("n")).alias(c) for c in "rgb"))
    return means.select(*keys, "box", "n", "r", "g", "b")
