"""Connected components as joins: alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups


#: Edges up to whose number their vertices' smallest neighbours are broadcast: two rows of three numbers an edge at most.
BROADCAST_EDGES = 500_000


def _with_least(rows: DataFrame, least: DataFrame, edges: int, most: int) -> DataFrame:
    return rows.join(F.broadcast(least), "u") if edges <= most else join_groups(rows, least, "u", "n", 2 * edges)


def components(edges: DataFrame, most_broadcast: int = BROADCAST_EDGES) -> DataFrame:
    """edges (a, b), long, in any order and number: (id, component) of every vertex that has an edge to another one, where
    component is the smallest id that it reaches. Each round's edges are written to the shared folder. The edges of a hub
    are not gathered: its smallest neighbour is broadcast to them, as are those of all vertices where edges are few."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    said = _state(now)
    while said[0]:
        both = now.unionAll(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = cut(_with_least(both.filter("v > u"), low, said[0], most_broadcast).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, least, said[0], most_broadcast).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(joined.unionAll(least.select("u", "m")).distinct())
        before, said = said, _state(now)
        if said == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u", F.lit(1)) % 1_000_000_007)).first())
