"""Reference counts and reachability over edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .ordering import number

#: Rounds after which what is known is written as one table, so that no plan grows with the rounds.
REWRITE = 8


def ref_counts(nodes: DataFrame, edges: DataFrame, node: str, target: str) -> DataFrame:
    """How many edges lead to each node, 0 included; edges are counted before they meet the nodes."""
    counted = edges.groupBy(F.col(target).alias(node)).agg(F.count("*").alias("refs"))
    return nodes.join(counted, node, "left").select(node, F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that the roots (node) reach over edges (src, dst), with the fewest steps: (node, depth). Each round joins the newest
    nodes only and is written; it ends where nothing new is found, so cycles end and chains of any length are followed."""
    edges = cut(edges.select("src", "dst"))
    known = cut(roots.select("node", F.lit(0).alias("depth")).distinct())
    front, depth = known, 0
    while True:
        depth += 1
        found = edges.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        front = cut(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        known = known if depth % REWRITE else cut(known)


def prune(nodes: DataFrame, edges: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """The nodes that the roots reach, with the references that reached nodes have to them: nodes, refs. All others go."""
    alive = cut(reachable(edges, roots).select("node"))
    counted = edges.join(alive, F.col("src") == F.col("node"), "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("refs"))
    kept = nodes.join(alive.withColumnRenamed("node", node), node, "left_semi")
    return kept.join(counted.withColumnRenamed("node", node), node, "left").withColumn("refs", F.coalesce("refs", F.lit(0)).cast("long"))


def imported(nodes: DataFrame, edges: DataFrame, roots: DataFrame, taken: int, replaced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What copying the roots (node) into another collection brings there, of `taken` objects: ((node, new_id), (src, label, dst) in new ids). Copied is what the
    roots reach, loops included, without what `replaced` (node, new_id) names: such nodes are there already, and references to them lead to theirs. Ids follow the
    nodes' order from taken + 1. References to what is no node become null."""
    inner = edges if replaced is None else edges.join(replaced.select(F.col("node").alias("dst")), "dst", "left_anti")
    inner = inner.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    reached = reachable(inner, roots.join(nodes, "node", "left_semi")).select("node")
    ids = cut(number(reached, ["node"], "nth").select("node", (F.col("nth") + taken + 1).alias("new_id")))
    every = ids if replaced is None else ids.unionByName(replaced.select("node", "new_id"))
    out = edges.join(ids.select(F.col("node").alias("src"), F.col("new_id").alias("new_src")), "src")
    out = out.join(every.select(F.col("node").alias("dst"), F.col("new_id").alias("new_dst")), "dst", "left")
    return ids, out.select(F.col("new_src").alias("src"), "label", F.col("new_dst").alias("dst"))


def list_places(rows: DataFrame, node: str, following: str) -> DataFrame:
    """rows (node, following, or null at a list's end) with `to_end`, the steps from each node to its list's end, null in a loop. Steps
    double in each round, so a list of n nodes takes log n rounds. No round passes the nodes through the driver for a broadcast."""
    now = cut(rows.select(F.col(node).alias("a"), F.col(following).alias("b"), F.when(F.col(following).isNull(), 0).otherwise(1).cast("long").alias("steps")))
    rounds = max(1, int(now.count())).bit_length()
    for _ in range(rounds):
        if now.filter("b IS NOT NULL").isEmpty():
            break
        onward = now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more"))
        now = cut(now.join(onward.hint("merge"), "b", "left").select("a", F.col("c").alias("b"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return rows.join(now.select(F.col("a").alias(node), F.when(F.col("b").isNull(), F.col("steps")).alias("to_end")), node)
