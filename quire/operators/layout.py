"""Tables as they are laid out: collapsed borders, and widths of columns under cells that span several."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .parts import LEAST, ROWS


def collapsed_borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, row, col, row_span, col_span, top, bottom, left, right: widths of strokes, null for none) to one row for each edge of the grid: (keys, side, row, col,
    width, own_row, own_col). side is `h` for the edge above (row, col) and `v` for the one left of it. Of the cells that meet at an edge the wider stroke
    holds; of equally wide ones the first, which is the cell above or to the left. The edges inside a cell that spans several are none."""
    many = lambda start, span: F.sequence(F.col(start), F.col(start) + F.col(span) - 1)
    edge = lambda side, row, col, width, rank: F.struct(F.lit(side).alias("side"), row.alias("row"), col.alias("col"), F.col(width).alias("width"), F.lit(rank).alias("rank"))
    across = F.flatten(F.transform(many("col", "col_span"), lambda c: F.array(edge("h", F.col("row"), c, "top", 1), edge("h", F.col("row") + F.col("row_span"), c, "bottom", 0))))
    down = F.flatten(F.transform(many("row", "row_span"), lambda r: F.array(edge("v", r, F.col("col"), "left", 1), edge("v", r, F.col("col") + F.col("col_span"), "right", 0))))
    cells = cut(cells)
    # as many partitions as keep what a task sorts bounded
    parts = max(LEAST, -(-cells.count() // ROWS))
    edges = cells.select(*keys, F.col("row").alias("own_row"), F.col("col").alias("own_col"), F.explode(F.concat(across, down)).alias("e")).select(*keys, "own_row", "own_col", "e.*").repartition(parts, *keys, "side", "row", "col")
    order = F.struct(F.coalesce("width", F.lit(0.0)).alias("w"), (-F.col("rank")).alias("r"), (-F.col("own_row")).alias("y"), (-F.col("own_col")).alias("x"))
    best = edges.groupBy(*keys, "side", "row", "col").agg(F.max_by(F.struct("width", "own_row", "own_col"), order).alias("best"))
    return best.select(*keys, "side", "row", "col", F.coalesce("best.width", F.lit(0.0)).alias("width"), "best.own_row", "best.own_col")


def column_ends(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, col, col_span, least: the width that a cell needs) to the smallest place of each column's end that leaves every cell its width: (keys, col, place).

    A cell asks that the end of its last column lies `least` behind the end of the column before its first; and no column is narrower than 0. The places are the
    longest paths over these demands: each round all cells push the ends behind them, and rounds stop when nothing moves, after as many as the longest chain of
    cells has. Demands are first reduced to the widest one of each (first, last) column, so a hot column is an aggregation. A null width is 0.
    """
    widest = cells.groupBy(*keys, F.col("col").alias("a"), (F.col("col") + F.col("col_span")).alias("b")).agg(F.max(F.coalesce("least", F.lit(0.0))).alias("least"))
    widest = cut(widest)
    ends = widest.select(*keys, F.explode(F.sequence(F.col("a"), F.col("b"))).alias("at")).distinct()
    single = ends.select(*keys, F.col("at").alias("a"), (F.col("at") + 1).alias("b"), F.lit(0.0).alias("least")).join(ends.withColumnRenamed("at", "b"), [*keys, "b"], "left_semi")
    demands = cut(widest.unionByName(single.select(*widest.columns)).groupBy(*keys, "a", "b").agg(F.max("least").alias("least")))
    now = cut(ends.select(*keys, "at", F.lit(0.0).alias("place")))
    while True:
        pushed = demands.join(now.select(*keys, F.col("at").alias("a"), "place"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("at")).agg(F.max(F.col("place") + F.col("least")).alias("quire_new"))
        moved = cut(now.join(pushed, [*keys, "at"], "left").select(*keys, "at", F.greatest("place", "quire_new").alias("place"), (F.col("quire_new") > F.col("place")).alias("quire_moved")))
        now = moved.drop("quire_moved")
        if moved.filter("quire_moved").isEmpty():
            return now.filter("at > 0").select(*keys, (F.col("at") - 1).alias("col"), "place")
