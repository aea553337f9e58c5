"""Structural equality of objects that refer to each other."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .graphs import REWRITE
from .joins import HEAVY_KEYS, with_group
from .parts import LEAST, ROWS

#: Three hash functions of a reference; their sums over an object's references are the same however these are ordered.
SEEDS = (11, 29, 47)
#: A frequent source's references are dealt into so many groups.
SALTS = 256


def _hash(seed: int, *columns):
    """32 bits, so that sums of them are longs."""
    return F.xxhash64(*columns, F.lit(seed)).bitwiseAND(0xFFFFFFFF)


def structural_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, class): two nodes are of one class if their content is equal, and each reference of one has a counterpart of the other with an equal
    label and a target of one class; class is its smallest node.

    nodes (node, content), distinct and never null; edges (src, label, dst), repeated ones count. An edge that leads to no node is a reference to
    nothing, equal to any other such. Partition refinement: classes begin with equal contents and are parted by their references' classes until
    their number stays, so objects that refer to each other in circles come out too. Rounds go by sums of hashes; what they come to is compared reference by
    reference, and where hashes have met by chance, rounds with such a comparison each take their place. References are counted before they meet, so an
    object with very many is no single group.
    """
    links = cut(edges.groupBy("src", "label", "dst").agg(F.count("*").alias("n")))
    found = _hashed(nodes, links)
    return _compared(nodes, links) if found is None else found


def _hashed(nodes: DataFrame, links: DataFrame) -> DataFrame | None:
    """The classes by hashes, or None if some of them are too large. A round looks only at references to nodes that the round before gave a new class, and only
    nodes with such references get one, so what refers to leaves alone is settled after one round."""
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("quire_d"))
    start = cut(nodes.select("node", "content", F.xxhash64("content").alias("class")).join(into, "node", "full").withColumn("quire_d", F.coalesce("quire_d", F.lit(0))))
    begun = start.filter("class IS NOT NULL")
    contents = begun.select("content", "class").distinct().groupBy("class").count().agg(F.count("*").alias("hashes"), F.sum("count").alias("kinds")).first()
    if contents.hashes != (contents.kinds or 0):
        return None
    nothing = start.filter("class IS NULL AND node IS NOT NULL").select(F.col("node").alias("dst"), F.col("class").alias("to"), "quire_d")
    to_null = links.filter("dst IS NULL").select("src", "label", F.lit(None).cast("long").alias("to"), "n")
    now = begun.select("node", F.col("class").alias("begun"), "class", "quire_d", F.lit(0).cast("long").alias("quire_o"))
    settled, before, rounds = now.limit(0), contents.hashes, 0
    while True:
        rounds += 1
        told = _told(links, now, nothing, to_null) if rounds == 1 else _told(links, now)
        sums = told.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("kinds"), *(F.try_sum(F.try_multiply("n", _hash(s, "label", "to"))).alias(f"s{i}") for i, s in enumerate(SEEDS)))
        signed = now.join(sums, "node", "left").withColumn("moved", F.col("kinds").isNotNull())
        sign = F.xxhash64("class", "kinds", *(F.coalesce(f"s{i}", F.lit(-1)) for i in range(len(SEEDS))))
        signed = cut(signed.select("node", "begun", F.when(F.col("moved"), sign).otherwise(F.col("class")).alias("class"), "quire_d", F.greatest("quire_o", F.coalesce("kinds", F.lit(0))).alias("quire_o"), "moved"))
        seen = {r.moved: r for r in signed.groupBy("moved", "class").agg(F.max("quire_d").alias("d")).groupBy("moved").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()}
        settled, now = settled.unionByName(signed.filter("NOT moved").drop("moved")), signed.filter("moved").drop("moved")
        after = sum(r.n for r in seen.values())
        if after <= before or seen[True].d == 0:
            break
        before, settled = seen[True].n, settled if rounds % REWRITE else cut(settled)
    last = settled.unionByName(now)
    groups = cut(last.groupBy("class").agg(F.min("node").alias("first"), F.count("*").alias("size"), (F.min("begun") == F.max("begun")).alias("pure")))
    if not groups.filter("NOT pure").isEmpty() or not _differing(_told(links, last, nothing, to_null), last, groups).isEmpty():
        return None
    return with_group(last.select("node", "class"), groups, "class", "size").select("node", F.col("first").alias("class"))


def _told(links: DataFrame, now: DataFrame, nothing: DataFrame | None = None, to_null: DataFrame | None = None) -> DataFrame:
    """(src, label, to, n): references with their targets' classes. What very many refer to is broadcast, so that no task sorts all its references."""
    targets = now.filter("quire_d > 0").select(F.col("node").alias("dst"), F.col("class").alias("to"), "quire_d")
    targets = targets if nothing is None else targets.unionByName(nothing)
    told = with_group(links.filter("dst IS NOT NULL"), targets, "dst", "quire_d").select("src", "label", "to", "n")
    return told if to_null is None else told.unionByName(to_null)


def _differing(told: DataFrame, last: DataFrame, groups: DataFrame) -> DataFrame:
    """What some nodes of a class refer to and others of it do not: references (label, to, n) that fewer nodes have than the class holds."""
    own = last.filter("quire_o > 0").select(F.col("node").alias("src"), "class", "quire_o")
    total = own.agg(F.sum("quire_o")).first()[0] or 0
    parts = max(LEAST, -(-total // ROWS))
    heavy = own.filter(F.col("quire_o") > max(SALTS, total / HEAVY_KEYS)).select("src", F.lit(SALTS).alias("salts"))
    # a salt follows from label and target, so equal references of one node stay together
    dealt = told.join(F.broadcast(heavy), "src", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("label", "to"), "salts"), F.lit(0))).drop("salts")
    own = own.join(F.broadcast(heavy), "src", "left").select("src", "class", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    refs = dealt.repartition(parts, "src", "salt").join(own.repartition(parts, "src", "salt"), ["src", "salt"]).groupBy("src", "salt", "class", "label", "to").agg(F.sum("n").alias("n"))
    held = refs.groupBy("class", "label", "to", "n").agg(F.count("*").alias("nodes"))
    return held.join(groups.select("class", "size"), "class").filter("nodes < size")


def _compared(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes by rounds that compare: objects are first parted by sums of hashes of their references, and every object's references are then compared with
    those of its class's smallest node; where sums agree and references do not, whole sorted references part them."""
    named = nodes.groupBy("content").agg(F.min("node").alias("class"), F.count("*").alias("quire_n"))
    content = nodes.join(named, nodes["content"].eqNullSafe(named["content"])).select("node", "class")
    now = cut(content)
    # what very many refer to is broadcast, so that no task sorts all its references
    degree = cut(links.groupBy("dst").agg(F.count("*").alias("quire_d")))
    astray = cut(links.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "label", F.lit(None).cast(now.schema["class"].dataType).alias("to"), "n"))
    total = now.select("class").distinct().count()
    while True:
        targets = now.select(F.col("node").alias("dst"), F.col("class").alias("to")).join(degree, "dst")
        told = with_group(links, targets, "dst", "quire_d").select("src", "label", "to", "n").unionByName(astray)
        refs = cut(told.groupBy("src", "label", "to").agg(F.sum("n").alias("n")))
        sums = refs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("kinds"), *(F.sum(_hash(s, "label", "to", "n").cast("decimal(20,0)")).alias(f"s{i}") for i, s in enumerate(SEEDS)))
        signed = now.join(sums, "node", "left").select("node", F.struct("class", "kinds", *(f"s{i}" for i in range(len(SEEDS)))).alias("sign"))
        signed = signed.select("node", F.struct("sign.class", F.coalesce("sign.kinds", F.lit(0)).alias("kinds"), *(F.coalesce(f"sign.s{i}", F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(len(SEEDS)))).alias("sign"))
        groups = signed.groupBy("sign").agg(F.min("node").alias("first"), F.count("*").alias("n"))
        guessed = cut(with_group(signed, groups, "sign", "n").select("node", "first"))
        now = cut(_checked(guessed, refs))
        before, total = total, now.select("class").distinct().count()
        if before == total:
            return now


def _checked(guessed: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, class) from guesses (node, first): nodes whose references differ from those of their first are parted by their sorted references."""
    others = guessed.filter("node <> first")
    own = refs.join(others.select(F.col("node").alias("src"), "first"), "src").select("src", "first", "label", "to", "n")
    there = refs.select(F.col("src").alias("first"), F.col("label").alias("l"), F.col("to").alias("t"), F.col("n").alias("m"))
    met = own.join(there, (own["first"] == there["first"]) & own["label"].eqNullSafe(there["l"]) & own["to"].eqNullSafe(there["t"]) & (own["n"] == there["m"]), "left_anti")
    odd = cut(met.select(F.col("src").alias("node")).distinct())  # as many kinds on both sides, so one side suffices
    if odd.isEmpty():
        return guessed.select("node", F.col("first").alias("class"))
    listed = refs.join(odd.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("label", "to", "n"))).alias("refs"))
    parted = listed.join(guessed, "node").groupBy("first", "refs").agg(F.min("node").alias("class"), F.collect_list("node").alias("all"))
    moved = parted.select(F.explode("all").alias("node"), "class")
    return guessed.join(odd, "node", "left_anti").select("node", F.col("first").alias("class")).unionByName(moved)
