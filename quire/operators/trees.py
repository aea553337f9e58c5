"""Trees of any depth, given as (node, parent, ord).

Every step follows pointers that double their reach each round: after round k a node points to its ancestor 2 ** k above. A tree of
depth d takes about log2(d) rounds, however wide it is. Each round is written. Children meet in aggregations, and siblings are
numbered by sorted offsets, so a wide node is spread over tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .ordering import offsets


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes whose parent is null where it is no node or the node itself."""
    known = nodes.select(F.col("node").alias("quire_p"))
    met = nodes.join(known, F.col("parent") == F.col("quire_p"), "left")
    return met.withColumn("parent", F.when(F.col("quire_p") != F.col("node"), F.col("quire_p"))).select(*nodes.columns)


def _doubled(now: DataFrame, step) -> DataFrame:
    """now (node, p, ...) after rounds of step(rows with a pointer, all rows) until no pointer is left, or until they have reached over all
    nodes: those that still have one then hang on a loop."""
    now = cut(now)
    n = now.count()
    for _ in range(max(1, n).bit_length() + 1):
        if now.filter("p IS NOT NULL").isEmpty():
            break
        now = cut(step(now))
    return now


def upward(nodes: DataFrame, sums: list[str], inherited: list[str] | None = None) -> DataFrame:
    """nodes with `depth` (0 at a root), with total_<c> for each column of sums, added up over the node and all below it, and with near_<c> for each
    of inherited: its own value or else that of the nearest ancestor that has one. Nodes on or under a loop have a depth of null."""
    inherited = inherited or []
    first = rooted(nodes).withColumn("p", F.col("parent")).withColumn("steps", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long"))
    first = first.select("*", *(F.coalesce(F.col(c), F.lit(0)).alias(f"total_{c}") for c in sums), *(F.col(c).alias(f"near_{c}") for c in inherited))

    def step(now):
        below = now.filter("p IS NOT NULL").groupBy(F.col("p").alias("node")).agg(F.lit(1).alias("quire_any"), *(F.sum(f"total_{c}").alias(f"quire_{c}") for c in sums))
        now = now.join(below, "node", "left").select(*(c for c in now.columns if not c.startswith("total_")), *((F.col(f"total_{c}") + F.coalesce(f"quire_{c}", F.lit(0))).alias(f"total_{c}") for c in sums))
        jump = now.select(F.col("node").alias("p"), F.col("p").alias("quire_p"), F.col("steps").alias("quire_steps"), *(F.col(f"near_{c}").alias(f"quire_near_{c}") for c in inherited))
        met = now.filter("p IS NOT NULL").join(jump, "p")
        changed = {"p": F.col("quire_p"), "steps": F.col("steps") + F.col("quire_steps"), **{f"near_{c}": F.coalesce(f"near_{c}", f"quire_near_{c}") for c in inherited}}
        return now.filter("p IS NULL").unionByName(met.select(*(changed[c].alias(c) if c in changed else c for c in now.columns)))

    out = _doubled(first, step)
    names = [f"total_{c}" for c in sums] + [f"near_{c}" for c in inherited]
    return out.select(*nodes.columns, F.when(F.col("p").isNull(), F.col("steps")).alias("depth"), *names)


def in_order(nodes: DataFrame, weight: str, name: str, inherited: list[str] | None = None) -> DataFrame:
    """What upward() gives, and `name`: the weights of all nodes that come before the node if each is followed by what is below it, siblings by
    ord, then node. With weights of 1 it is the place in preorder, with 1 for leaves only a leaf's place among leaves. Null at a loop."""
    known = cut(upward(rooted(nodes), [weight], inherited))
    beside = offsets(known.select("node", "parent", "ord", F.col(f"total_{weight}").alias("quire_size")), ["parent"], ["ord", "node"], "quire_size", "quire_before")
    above = known.select(F.col("node").alias("parent"), F.coalesce(F.col(weight), F.lit(0)).alias("quire_above"))
    started = beside.join(above, "parent", "left").select("node", F.col("parent").alias("p"), (F.col("quire_before") + F.coalesce("quire_above", F.lit(0))).cast("long").alias("quire_place"))

    def step(now):
        jump = now.select(F.col("node").alias("p"), F.col("p").alias("quire_p"), F.col("quire_place").alias("quire_more"))
        met = now.filter("p IS NOT NULL").join(jump, "p").select("node", F.col("quire_p").alias("p"), (F.col("quire_place") + F.col("quire_more")).alias("quire_place"))
        return now.filter("p IS NULL").unionByName(met)

    found = _doubled(started, step).select("node", F.when(F.col("p").isNull(), F.col("quire_place")).alias(name))
    return known.join(found, "node")


def shown_counts(nodes: DataFrame, is_open: str) -> DataFrame:
    """The counts of an outline: (node, shown). An open node counts all below it that no closed node hides, as a positive number; a closed one those that it
    would show if it were open, negated."""
    tree = rooted(nodes)
    state = tree.select(F.col("node").alias("parent"), F.coalesce(F.col(is_open), F.lit(False)).alias("quire_open"))
    # without the edges below closed nodes, what a node shows is all that is below it
    parted = cut(tree.join(state, "parent", "left").select("node", F.col("parent").alias("quire_up"), F.when(F.col("quire_open"), F.col("parent")).alias("parent"), F.col(is_open).alias("quire_open"), F.lit(1).cast("long").alias("n")))
    sizes = cut(upward(parted, ["n"]))
    hidden = sizes.filter("quire_up IS NOT NULL AND parent IS NULL").groupBy(F.col("quire_up").alias("node")).agg(F.sum("total_n").alias("quire_hidden"))
    own = F.when(F.col("quire_open"), F.col("total_n") - 1).otherwise(-F.coalesce("quire_hidden", F.lit(0)))
    return sizes.join(hidden, "node", "left").select("node", own.cast("long").alias("shown"))


def leaf_at(nodes: DataFrame, weight: str, place: int) -> DataFrame:
    """The leaf (a node of weight 1 with none of weight below it) at a place among all leaves. Leaf counts tell which child holds the place, so only the
    children of the nodes on the way down are numbered."""
    known = cut(upward(rooted(nodes), [weight]).filter(F.col(f"total_{weight}") > 0))
    beside = known.filter("parent IS NULL")
    while True:
        held = offsets(beside.withColumn("quire_all", F.lit(0)), ["quire_all"], ["ord", "node"], f"total_{weight}", "quire_at")
        own = F.lit(place) - F.col("quire_at")
        found = held.filter((own >= 0) & (own < F.col(f"total_{weight}"))).withColumn("quire_rest", own).first()
        if found is None:
            return known.limit(0)
        here = known.filter(F.col("node") == found["node"])
        beside, place = known.filter(F.col("parent") == found["node"]), found["quire_rest"] - (found[weight] or 0)
        if place < 0 or beside.isEmpty():
            return here


def place_of(nodes: DataFrame, weight: str, node) -> DataFrame:
    """(node, place): the weights of all nodes before a node in preorder. Only the siblings of its ancestors and its own are added up."""
    known = cut(upward(rooted(nodes), [weight]))
    at, place = known.filter(F.col("node") == node).first(), 0
    if at is None or at["depth"] is None:
        return known.select("node", F.lit(0).cast("long").alias("place")).limit(0)
    while True:
        up = F.col("parent").isNull() if at["parent"] is None else F.col("parent") == at["parent"]
        before = F.struct("ord", "node") < F.struct(F.lit(at["ord"]).alias("ord"), F.lit(at["node"]).alias("node"))
        place += known.filter(up & before).agg(F.sum(f"total_{weight}")).first()[0] or 0
        if at["parent"] is None:
            return known.filter(F.col("node") == node).select("node", F.lit(place).cast("long").alias("place"))
        at = known.filter(F.col("node") == at["parent"]).first()
        place += at[weight] or 0
