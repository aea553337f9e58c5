"""Queries over trees of any depth, balanced blocks, references, streams, ranges and boxes."""

from pyspark.sql import functions as F

from ..operators import equality, flow, graphs, images, layout, ordering, patterns, ranges, scans, spatial, trees
from ..scratch import scratch_path
from ..sources.tables import table
from ..streaming import writer
from .catalog import query

_STEP = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END"
_BLOCKS = f"""WITH s AS (SELECT *, sum(step) OVER w AS s FROM (SELECT *, {_STEP} AS step FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT *, least(0, min(s) OVER w) AS low, least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prev FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    l AS (SELECT *, CAST(s - low + CASE WHEN step < 0 THEN 1 ELSE 0 END AS BIGINT) AS level FROM m WHERE step <> 0 AND low >= prev),
    n AS (SELECT *, lead(event_id) OVER w AS end_id, lead(ts) OVER w AS end_ts, lead(step) OVER w AS next FROM l WINDOW w AS (PARTITION BY user_id, level ORDER BY ts, event_id)),
    b AS (SELECT user_id, level, event_id AS begin_id, ts AS begin_ts, end_id, end_ts FROM n WHERE step = 1 AND next = -1)"""


def _events(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(kind == "view", 1).when(kind == "click", -1).otherwise(0).alias("step"))


@query(f"{_BLOCKS} SELECT user_id, level, begin_id, end_id FROM b")
def balanced_blocks(spark, sf_dir):
    """What opens and what closes it, over each user's events."""
    found = scans.blocks(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "step")
    return found.select("user_id", "level", F.col("begin.event_id").alias("begin_id"), F.col("end.event_id").alias("end_id"))


_COVER = "(SELECT count(*) FROM b WHERE b.user_id = e.user_id AND (b.begin_ts, b.begin_id) <= (e.ts, e.event_id) AND (e.ts, e.event_id) <= (b.end_ts, b.end_id))"


@query(f"{_BLOCKS} SELECT user_id, event_id FROM events e WHERE {_COVER} = 0")
def strip_blocks(spark, sf_dir):
    """What is left when balanced blocks go with all that is in them."""
    return scans.without_blocks(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "step").select("user_id", "event_id")


@query(f"{_BLOCKS} SELECT user_id, event_id, CAST({_COVER} AS BIGINT) AS level FROM events e WHERE event_id NOT IN (SELECT begin_id FROM b UNION ALL SELECT end_id FROM b)")
def flatten_blocks(spark, sf_dir):
    """What is left when only the marks of balanced blocks go."""
    return scans.flattened(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "step").select("user_id", "event_id", F.col("level").cast("long").alias("level"))


def _tree(spark, sf_dir):
    """Regions, nations and suppliers as one tree."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), c)
    row = lambda node, parent, key, leaf, value, open_: (node.alias("node"), parent.cast("string").alias("parent"), F.col(key).cast("long").alias("ord"), F.lit(leaf).cast("long").alias("leaf"), value.alias("value"), open_.alias("open"))
    region = t("region").select(*row(name("r", "r_regionkey"), F.lit(None), "r_regionkey", 0, F.col("r_name"), F.col("r_regionkey") % 2 == 0))
    nation = t("nation").select(*row(name("n", "n_nationkey"), name("r", "n_regionkey"), "n_nationkey", 0, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("n_nationkey") % 3 > 0))
    supplier = t("supplier").select(*row(name("s", "s_suppkey"), name("n", "s_nationkey"), "s_suppkey", 1, F.when(F.col("s_acctbal") > 5000, F.col("s_name")), F.lit(True)))
    return region.unionByName(nation).unionByName(supplier)


_PAGES = "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY r_regionkey, n_nationkey, s_suppkey) - 1 AS BIGINT) AS page FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(_PAGES)
def page_tree_flatten(spark, sf_dir):
    """The leaves of a tree in order."""
    return trees.in_order(_tree(spark, sf_dir), "leaf", "page").filter("leaf = 1").select(F.col("ord").alias("s_suppkey"), "page")


@query(f"SELECT s_suppkey FROM ({_PAGES}) WHERE page = 7")
def page_by_index(spark, sf_dir):
    """The page at a place: on the way down, the child whose leaves hold the place."""
    return trees.leaf_at(_tree(spark, sf_dir), "leaf", 7).select(F.col("ord").alias("s_suppkey"))


@query(f"SELECT page FROM ({_PAGES}) WHERE s_suppkey = 5")
def page_index_of(spark, sf_dir):
    """The place of a page: the leaves before it beside it and beside its ancestors."""
    return trees.place_of(_tree(spark, sf_dir), "leaf", "s5").select(F.col("place").alias("page"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS inherited
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def inherit_nearest(spark, sf_dir):
    """An attribute of a node, or else of its nearest ancestor that has it."""
    return trees.upward(_tree(spark, sf_dir), [], ["value"]).filter("leaf = 1").select(F.col("ord").alias("s_suppkey"), F.col("near_value").alias("inherited"))


@query("""SELECT 'r' || n_regionkey AS node, count(s_suppkey) AS leaves FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey
    UNION ALL SELECT 'n' || n_nationkey, count(s_suppkey) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def leaf_counts(spark, sf_dir):
    """The leaves under each node."""
    return trees.upward(_tree(spark, sf_dir), ["leaf"]).filter("leaf = 0").select("node", F.col("total_leaf").alias("leaves"))


@query("""SELECT n_regionkey, CAST(CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE -1 END * (count(DISTINCT n_nationkey) + count(CASE WHEN n_nationkey % 3 > 0 THEN s_suppkey END)) AS BIGINT) AS shown FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey""")
def outline_counts(spark, sf_dir):
    """The counts of an outline: open items count what their open items show too, closed ones store it negated."""
    shown = trees.shown_counts(_tree(spark, sf_dir), "open").filter(F.col("node").startswith("r"))
    return shown.select(F.substring("node", 2, 20).cast("int").alias("n_regionkey"), "shown")


@query("""SELECT event_id, CAST(count(CASE WHEN event_type = 'view' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS depth,
    CASE WHEN event_type = 'view' THEN count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE 1 END AS size,
    CAST(row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS BIGINT) AS place FROM events""")
def deep_tree(spark, sf_dir):
    """A tree as deep as a user has views: each event hangs on the user's last view before it."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.struct("user_id", "ts", "event_id").alias("ord"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("own"))
    seen = scans.last_known(events, ["user_id"], ["ts", "event_id"], "own", "upto")
    # the last view up to an event is, for a view, itself: its parent is the view before
    views = seen.filter("own IS NOT NULL")
    runs = scans.shifted(views, ["user_id"], ["ts", "event_id"], "own", "parent").select("event_id", "parent", "ord")
    rest = seen.filter("own IS NULL").select("event_id", F.col("upto").alias("parent"), "ord")
    nodes = runs.unionByName(rest).select(F.col("event_id").alias("node"), "parent", "ord", F.lit(1).cast("long").alias("one"))
    return trees.in_order(nodes, "one", "place").select(F.col("node").alias("event_id"), "depth", F.col("total_one").alias("size"), "place")


@query("""WITH lines AS (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS sign FROM lineitem GROUP BY l_orderkey),
    o AS (SELECT o_orderkey, o_custkey, min('o' || o_orderkey) OVER (PARTITION BY o_orderstatus, coalesce(sign, '')) AS class FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
    s AS (SELECT o_custkey, string_agg(class, ',' ORDER BY class) AS sign FROM o GROUP BY o_custkey),
    c AS (SELECT c_custkey, min('c' || c_custkey) OVER (PARTITION BY c_mktsegment, coalesce(sign, '')) AS class FROM customer LEFT JOIN s ON o_custkey = c_custkey)
    SELECT 'o' || o_orderkey AS node, class FROM o UNION ALL SELECT 'c' || c_custkey, class FROM c UNION ALL SELECT DISTINCT 'f' || l_returnflag || l_linestatus, 'f' || l_returnflag || l_linestatus FROM lineitem""")
def structural_equality(spark, sf_dir):
    """Orders are equal by their status and their lines' flags, customers by their segment and their orders' classes."""
    t = lambda n: table(spark, sf_dir, n)
    flag = F.concat(F.lit("f"), "l_returnflag", "l_linestatus")
    nodes = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("c:"), "c_mktsegment").alias("content"))
    nodes = nodes.unionByName(t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("o:"), "o_orderstatus").alias("content"))).unionByName(t("lineitem").select(flag.alias("node"), flag.alias("content")).distinct())
    edges = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("order").alias("label"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    edges = edges.unionByName(t("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.lit("line").alias("label"), flag.alias("dst")))
    return equality.structural_classes(nodes, edges)


@query("SELECT doc_id, CAST(max(strlen(text)) AS BIGINT) AS size, CAST(sum(max(strlen(text))) OVER (ORDER BY doc_id) - max(strlen(text)) AS BIGINT) AS byte_offset FROM documents GROUP BY doc_id")
def stream_xref(spark, sf_dir):
    """Documents that arrive as a stream, each written once behind those before it, and the finished table of where they are."""
    here, folder = scratch_path(spark), scratch_path(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"))
    docs.write.parquet(here)
    writer.write_stream(spark.readStream.schema(docs.schema).parquet(here), folder).awaitTermination()
    return writer.finish(spark, folder).select(F.col("id").alias("doc_id"), "size", "byte_offset")


def _known(spark, sf_dir):
    width = F.floor(F.col("o_totalprice") / 5000).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("map"), F.col("o_orderkey").alias("nth"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + width).alias("hi"), (F.col("o_orderkey") * 100).alias("first"))


_KNOWN = "(SELECT o_orderstatus AS map, o_orderkey AS nth, o_custkey AS lo, o_custkey + CAST(floor(o_totalprice / 5000) AS BIGINT) AS hi, o_orderkey * 100 AS first FROM orders)"


@query(f"""SELECT p_partkey, p_partkey % 2000 AS code, s.map, coalesce((SELECT arg_max(k.first + p_partkey % 2000 - k.lo, k.nth) FROM {_KNOWN} k WHERE k.map = s.map AND p_partkey % 2000 BETWEEN k.lo AND k.hi), 0) AS cid
    FROM part, (SELECT DISTINCT o_orderstatus AS map FROM orders) s""")
def range_map_lookup(spark, sf_dir):
    """Codes through the ranges of several maps, as many as there are orders; the last range that holds a code counts, and none gives 0."""
    known = _known(spark, sf_dir)
    codes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2000).alias("code"), F.explode(F.lit(["F", "O", "P"])).alias("map"))
    return ranges.lookup(codes, known, ["map"], "code", "cid").select("p_partkey", "code", "map", "cid")


@query(f"""SELECT l_orderkey, l_linenumber, coalesce((SELECT arg_min(k.lo + v - k.first, k.nth) FROM {_KNOWN} k WHERE v BETWEEN k.first AND k.first + k.hi - k.lo), 0) AS code FROM (SELECT *, l_orderkey * 100 + l_linenumber AS v FROM lineitem)""")
def reverse_range_map(spark, sf_dir):
    """Values back to the codes that stand for them; of several the earliest range's."""
    known = ranges.reverse(_known(spark, sf_dir).drop("map"), [])
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("v"))
    return ranges.lookup(values, known, [], "v", "code").select("l_orderkey", "l_linenumber", "code")


@query("""SELECT l_orderkey, l_linenumber, max(p_partkey) AS p_partkey FROM lineitem LEFT JOIN part ON l_quantity >= p_size AND l_quantity <= p_size + 5 AND l_extendedprice / l_quantity >= p_retailprice AND l_extendedprice / l_quantity <= p_retailprice + 50
    GROUP BY l_orderkey, l_linenumber""")
def object_at_point(spark, sf_dir):
    """For each line, as a point, the topmost of the parts, as boxes, that holds it."""
    boxes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 5).cast("double").alias("x1"), F.col("p_retailprice").alias("y0"), (F.col("p_retailprice") + 50).alias("y1"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"))
    return spatial.topmost(points, boxes, ["l_orderkey", "l_linenumber"], "p_partkey")


@query("""WITH c AS (SELECT s_suppkey, s_acctbal AS cx, s_nationkey * 10.0 AS cy, 100.0 + s_suppkey % 7 * 50 AS r FROM supplier),
    v AS (SELECT s_suppkey, [(cx - r, cy - r / 20), (cx + r, cy - r / 20), (cx, cy), (cx + r, cy + r / 20), (cx - r, cy + r / 20)] AS p FROM c),
    s AS (SELECT s_suppkey, unnest([{'a': p[i], 'b': p[i % 5 + 1]} FOR i IN range(1, 6)]) AS e FROM v),
    t AS (SELECT s_suppkey, e.a[1] AS ax, e.a[2] AS ay, e.b[1] AS bx, e.b[2] AS by_ FROM s),
    q AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 10.0 + c_custkey % 9 - 4 AS y FROM customer)
    SELECT c_custkey, s_suppkey FROM q JOIN t ON y >= least(ay, by_) AND y <= greatest(ay, by_) AND x <= greatest(ax, bx)
    WHERE (y < ay) <> (y < by_) AND x < ax + (y - ay) * (bx - ax) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1""")
def segment_containment(spark, sf_dir):
    """Customers, as points, in the polygons of suppliers: an odd number of a polygon's sides lies to the right."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("cx"), (F.col("s_nationkey") * 10.0).alias("cy"), (100.0 + F.col("s_suppkey") % 7 * 50).alias("r"))
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    corners = [(cx - r, cy - r / 20), (cx + r, cy - r / 20), (cx, cy), (cx + r, cy + r / 20), (cx - r, cy + r / 20)]
    side = lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
    sides = s.select(F.col("s_suppkey").alias("polygon"), F.explode(F.array(*(side(a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)))).alias("e")).select("polygon", "e.*")
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 10.0 + F.col("c_custkey") % 9 - 4).alias("y"))
    return spatial.in_polygons(points, sides, ["c_custkey"]).select("c_custkey", F.col("polygon").alias("s_suppkey"))


#: view, then perhaps signup, then clicks, then purchase.
FUNNEL = {(0, "view"): (1, True), (1, "view"): (1, True), (2, "view"): (1, True), (3, "view"): (1, True), (4, "view"): (1, True), (1, "signup"): (2, False), (1, "click"): (3, False), (2, "click"): (3, False), (3, "click"): (3, False), (3, "purchase"): (4, False)}


@query("""WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, string_agg(CASE event_type WHEN 'signup' THEN 's' ELSE event_type[1] END, '') OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT *, length(regexp_extract(seen, 'vs?c+p$')) AS n FROM s) SELECT e.user_id, b.event_id AS begin_id, e.event_id AS end_id, e.n FROM m e JOIN s b ON b.user_id = e.user_id AND b.i = e.i - e.n + 1 WHERE e.n > 0""")
def block_pattern(spark, sf_dir):
    """Successive events of a user that follow a pattern."""
    found = patterns.matches(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", FUNNEL, {4})
    return found.select("user_id", F.col("begin.event_id").alias("begin_id"), F.col("end.event_id").alias("end_id"), "n")


_CELLS = """(SELECT l_orderkey % 500 AS tab, l_orderkey // 500 AS "row", CAST(l_linenumber AS BIGINT) AS "col", max(l_quantity) AS up, max(l_tax) AS down, max(l_discount * 10) AS left_, max(l_quantity / 50) AS right_ FROM lineitem GROUP BY ALL)"""


@query(f"""WITH c AS {_CELLS}, e AS (SELECT tab, 'h' AS side, "row" + 1 AS "row", "col", down AS width, 0 AS rank, "row" AS own_row, "col" AS own_col FROM c UNION ALL SELECT tab, 'h', "row", "col", up, 1, "row", "col" FROM c
    UNION ALL SELECT tab, 'v', "row", "col" + 1, right_, 0, "row", "col" FROM c UNION ALL SELECT tab, 'v', "row", "col", left_, 1, "row", "col" FROM c)
    SELECT tab, side, "row", "col", width, own_row, own_col FROM (SELECT *, row_number() OVER (PARTITION BY tab, side, "row", "col" ORDER BY width DESC, rank) AS n FROM e) WHERE n = 1""")
def border_collapse(spark, sf_dir):
    """Lines as cells of tables: of the two strokes at an edge the wider one, the first of equal ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("tab"), F.floor(F.col("l_orderkey") / 500).alias("row"), F.col("l_linenumber").cast("long").alias("col"))
    cells = lines.agg(F.max("l_quantity").alias("top"), F.max("l_tax").alias("bottom"), F.max(F.col("l_discount") * 10).alias("left"), F.max(F.col("l_quantity") / 50).alias("right"))
    return layout.collapsed_borders(cells.withColumn("row_span", F.lit(1)).withColumn("col_span", F.lit(1)), ["tab"])


@query("""WITH RECURSIVE c AS (SELECT l_orderkey % 200 AS tab, l_linenumber - 1 AS a, least(l_linenumber - 1 + 1 + l_suppkey % 3, 9) AS b, max(l_quantity) AS least FROM lineitem GROUP BY ALL),
    n AS (SELECT DISTINCT tab, unnest(range(a, b + 1)) AS pos FROM c), d AS (SELECT * FROM c UNION ALL SELECT n.tab, n.pos, n.pos + 1, 0 FROM n JOIN n m ON m.tab = n.tab AND m.pos = n.pos + 1),
    p(tab, pos, place) AS (SELECT tab, pos, 0.0::DOUBLE FROM n UNION SELECT * FROM (SELECT d.tab, d.b, max(p.place + d.least) FROM p JOIN d ON d.tab = p.tab AND d.a = p.pos GROUP BY d.tab, d.b))
    SELECT tab, pos - 1 AS col, max(place) AS place FROM p WHERE pos > 0 GROUP BY tab, pos""")
def column_widths(spark, sf_dir):
    """The smallest places of columns that leave all cells their widths, those that span several columns too."""
    line = table(spark, sf_dir, "lineitem")
    span = F.least(1 + F.col("l_suppkey") % 3, 10 - F.col("l_linenumber")).cast("int")
    cells = line.select((F.col("l_orderkey") % 200).alias("tab"), (F.col("l_linenumber") - 1).alias("col"), span.alias("col_span"), F.col("l_quantity").alias("least"))
    return layout.column_ends(cells, ["tab"])


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 's' || s_suppkey END, CASE WHEN n_nationkey % 5 = 0 THEN 'n' || n_nationkey END, 'black') AS colour,
    coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey END, 12) AS size,
    coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, 0) AS margin FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def style_cascade(spark, sf_dir):
    """Properties of a box: its own, else the nearest ancestor's if they are inherited, else their default."""
    key, kind = F.col("ord"), F.substring("node", 1, 1)
    boxes = _tree(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), "s_acctbal"), "node", "left")
    own_colour = F.when((kind == "s") & (key % 4 == 0) | (kind == "n") & (key % 5 == 0), F.col("node"))
    own_size = F.when((kind == "s") & (key % 3 == 0) | (kind != "s") & (key % 2 == 0), key)
    styled = boxes.withColumn("colour", own_colour).withColumn("size", own_size).withColumn("margin", F.when(key % 2 == 0, F.col("s_acctbal")))
    found = trees.upward(styled, [], ["colour", "size"]).filter("leaf = 1")
    return found.select(F.col("ord").alias("s_suppkey"), F.coalesce("near_colour", F.lit("black")).alias("colour"), F.coalesce("near_size", F.lit(12)).cast("long").alias("size"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


@query("""WITH t AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pos, 1 AS kind FROM events
    UNION ALL SELECT c_custkey, -1 - c_custkey, c_custkey % 40, 0 FROM customer UNION ALL SELECT c_custkey, -100000000 - c_custkey, c_custkey % 7, 0 FROM customer)
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos, kind, event_id) - 1 AS BIGINT) AS place FROM t""")
def inject_commands(spark, sf_dir):
    """Rows put in at given places of a sequence, and all numbered anew."""
    extra = lambda start, every: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.lit(start) - F.col("c_custkey")).alias("event_id"), (F.col("c_custkey") % every).alias("at"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    return ordering.inserted(rows, extra(-1, 40).unionByName(extra(-100000000, 7)), ["user_id"], "event_id", "at", "place").select("user_id", "event_id", "place")


@query("""WITH RECURSIVE n AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey FROM part),
    e AS (SELECT 'c' || o_custkey AS src, 'order' AS label, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || o_orderkey, 'owner', 'c' || o_custkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'part', 'p' || l_partkey FROM lineitem),
    roots AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 37 = 1), old AS (SELECT 'p' || p_partkey AS node, p_partkey AS new_id FROM part WHERE p_partkey % 3 = 0),
    r(node) AS (SELECT node FROM roots UNION SELECT dst FROM r JOIN e ON src = node WHERE dst IN (SELECT node FROM n) AND dst NOT IN (SELECT node FROM old)),
    ids AS (SELECT node, row_number() OVER (ORDER BY node) + 1000000 AS new_id FROM r)
    SELECT s.new_id AS src, label, coalesce(d.new_id, o.new_id) AS dst FROM e JOIN ids s ON s.node = e.src LEFT JOIN ids d ON d.node = e.dst LEFT JOIN old o ON o.node = e.dst""")
def import_graph(spark, sf_dir):
    """Customers copied with all that they refer to: ids anew, parts that are there already kept, and references to what is not there emptied."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), c)
    customers = t("customer").filter("c_custkey % 10 > 0")
    nodes = customers.select(name("c", "c_custkey").alias("node")).unionAll(t("orders").select(name("o", "o_orderkey"))).unionAll(t("part").select(name("p", "p_partkey")))
    edge = lambda df, src, label, dst: df.select(src.alias("src"), F.lit(label).alias("label"), dst.alias("dst"))
    c, o = name("c", "o_custkey"), name("o", "o_orderkey")
    edges = edge(t("orders"), c, "order", o).unionAll(edge(t("orders"), o, "owner", c)).unionAll(edge(t("lineitem"), name("o", "l_orderkey"), "part", name("p", "l_partkey")))
    roots = customers.filter("c_custkey % 37 = 1").select(name("c", "c_custkey").alias("node"))
    there = t("part").filter("p_partkey % 3 = 0").select(name("p", "p_partkey").alias("node"), F.col("p_partkey").alias("new_id"))
    return graphs.imported(nodes, edges, roots, 1_000_000, there)[1]


@query("""WITH RECURSIVE w AS (SELECT p_partkey % 5 AS flow, p_partkey, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS word FROM (SELECT *, regexp_extract_all(p_name, '[^ ]+') AS l FROM part)),
    n AS (SELECT flow, row_number() OVER v - 1 AS pos, sum(length(word) + 1) OVER v - length(word) - 1 AS start FROM w WINDOW v AS (PARTITION BY flow ORDER BY p_partkey, i)),
    e AS (SELECT flow, pos, start FROM n UNION ALL SELECT flow, count(*), sum(length(word) + 1) FROM w GROUP BY flow),
    nxt AS (SELECT flow, pos, width, CASE width WHEN 12 THEN a WHEN 14 THEN b ELSE c END AS next FROM (SELECT flow, pos, greatest(pos + 1, max(pos) OVER (PARTITION BY flow ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 13 FOLLOWING)) AS a,
        greatest(pos + 1, max(pos) OVER (PARTITION BY flow ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 15 FOLLOWING)) AS b, greatest(pos + 1, max(pos) OVER (PARTITION BY flow ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 17 FOLLOWING)) AS c FROM e), (VALUES (12), (14), (16)) t(width)),
    slots AS (SELECT *, row_number() OVER (ORDER BY box, line) - 1 AS slot FROM (SELECT s_nationkey * 10000000 + s_suppkey AS box, 12 + s_nationkey // 9 * 2 AS width, unnest(range(2 + s_suppkey % 4)) AS line FROM supplier)),
    r AS (SELECT flow, 0::BIGINT AS slot, 0::BIGINT AS pos FROM (SELECT DISTINCT flow FROM w) UNION ALL SELECT r.flow, r.slot + 1, nxt.next FROM r JOIN slots ON slots.slot = r.slot JOIN nxt ON nxt.flow = r.flow AND nxt.width = slots.width AND nxt.pos = r.pos)
    SELECT r.flow, box, line, r.pos AS first, nxt.next - r.pos AS words FROM r JOIN slots ON slots.slot = r.slot JOIN nxt ON nxt.flow = r.flow AND nxt.width = slots.width AND nxt.pos = r.pos WHERE r.pos < (SELECT count(*) FROM w WHERE w.flow = r.flow)""")
def linked_boxes(spark, sf_dir):
    """The names of the parts as five texts, each of which flows through a box of every supplier."""
    words = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("flow"), "p_partkey", F.posexplode(F.regexp_extract_all("p_name", F.lit("[^ ]+"), 0)).alias("i", "word"))
    key = F.col("s_nationkey")
    box = table(spark, sf_dir, "supplier").select((key.cast("long") * 10_000_000 + F.col("s_suppkey")).alias("box"), (12 + F.floor(key / 9) * 2).alias("box_width"), (2 + F.col("s_suppkey") % 4).alias("lines"))
    boxes = box.withColumn("flow", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return flow.linked_boxes(words.withColumn("size", F.length("word")), boxes, ["flow"], ["p_partkey", "i"], "size", 1)


_SPREAD = "({0}r::DOUBLE * {0}r + {0}g::DOUBLE * {0}g + {0}b::DOUBLE * {0}b) / {0}n"
_HALVES = ", ".join(f"low_{c}, all_{c} - low_{c} AS high_{c}" for c in "nrgb")
_RUNNING = ", ".join(f"sum({c}) OVER (PARTITION BY k, axis ORDER BY level) AS low_{c}, sum({c}) OVER (PARTITION BY k, axis) AS all_{c}" for c in "nrgb")
_ROUND = f"""
    x{{i}} AS MATERIALIZED (SELECT k, arg_max(box, (v, -box)) AS box FROM (SELECT k, box, sum(s) - (sum(r)::DOUBLE * sum(r) + sum(g)::DOUBLE * sum(g) + sum(b)::DOUBLE * sum(b)) / sum(n) AS v, count(*) AS cells FROM c{{h}} GROUP BY k, box) WHERE cells > 1 AND v > 0 GROUP BY k),
    l{{i}} AS MATERIALIZED (SELECT k, box, axis, level, sum(n)::BIGINT AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM (SELECT c.*, unnest([0, 1, 2]) AS axis, unnest([cr, cg, cb]) AS level FROM c{{h}} c JOIN x{{i}} USING (k, box)) GROUP BY k, box, axis, level),
    b{{i}} AS MATERIALIZED (SELECT k, arg_max((box, axis, level), ({_SPREAD.format("low_")} + {_SPREAD.format("high_")}, -axis, -level)) AS best FROM (SELECT k, box, axis, level, {_HALVES} FROM (SELECT *, {_RUNNING} FROM l{{i}}) WHERE low_n < all_n) GROUP BY k),
    c{{i}} AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN box = best[1] AND [cr, cg, cb][best[2] + 1] > best[3] THEN {{i}} ELSE box END AS box) FROM c{{h}} c LEFT JOIN b{{i}} USING (k))"""


@query("WITH c0 AS MATERIALIZED (SELECT l_returnflag AS k, x.r >> 1 AS cr, x.g >> 1 AS cg, x.b >> 1 AS cb, 0 AS box, count(*) AS n, sum(x.r)::BIGINT AS r, sum(x.g)::BIGINT AS g, sum(x.b)::BIGINT AS b, sum(x.r * x.r + x.g * x.g + x.b * x.b)::BIGINT AS s FROM (SELECT l_returnflag, CAST(floor(l_quantity * 5) AS BIGINT) % 256 AS r, CAST(floor(l_extendedprice / 400) AS BIGINT) % 256 AS g, CAST(l_partkey * l_linenumber % 256 AS BIGINT) AS b FROM lineitem) x GROUP BY ALL),"
       + ",".join(_ROUND.format(i=i, h=i - 1) for i in range(1, 8)) + " SELECT k AS l_returnflag, box, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r) // sum(n) AS BIGINT) AS r, CAST(sum(g) // sum(n) AS BIGINT) AS g, CAST(sum(b) // sum(n) AS BIGINT) AS b FROM c7 GROUP BY k, box")
def quantised_palette(spark, sf_dir):
    """The eight colours that stand for all colours of a picture: boxes of the least variance. Lines are the pixels of three pictures."""
    whole = lambda c: F.floor(c).cast("long") % 256
    pixels = table(spark, sf_dir, "lineitem").select("l_returnflag", whole(F.col("l_quantity") * 5).alias("r"), whole(F.col("l_extendedprice") / 400).alias("g"), (F.col("l_partkey") * F.col("l_linenumber") % 256).alias("b"))
    return images.palette(images.coloured_boxes(pixels, ["l_returnflag"], 8), ["l_returnflag"])


@query("""WITH k AS (SELECT o_orderstatus AS map, 1 + o_orderkey % 2 AS len, o_orderkey AS nth, o_custkey * 2 AS lo, o_custkey * 2 + 3 AS hi, o_orderkey * 100 AS first FROM orders),
    u AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS map, 1 + c_custkey % 2 AS len, c_custkey AS nth, c_custkey AS lo, c_custkey + 9 AS hi, c_nationkey AS first FROM customer),
    c AS (SELECT p_partkey, s.map, 1 + p_partkey % 2 AS len, p_partkey % 1000 AS code FROM part, (VALUES ('F'), ('O'), ('P')) s(map))
    SELECT p_partkey, map, len, code, CAST(coalesce((SELECT arg_max(first + code - lo, nth) FROM k WHERE k.map = c.map AND k.len = c.len AND code BETWEEN lo AND hi), (SELECT arg_max(first, nth) FROM u WHERE u.map = c.map AND u.len = c.len AND code BETWEEN lo AND hi), 0) AS BIGINT) AS cid FROM c""")
def code_map_lengths(spark, sf_dir):
    """Codes of two lengths through the ranges of several maps; codes in none of them take the value of the last range for undefined codes."""
    t = lambda n: table(spark, sf_dir, n)
    known = t("orders").select(F.col("o_orderstatus").alias("map"), (1 + F.col("o_orderkey") % 2).alias("len"), F.col("o_orderkey").alias("nth"), (F.col("o_custkey") * 2).alias("lo"), (F.col("o_custkey") * 2 + 3).alias("hi"), (F.col("o_orderkey") * 100).alias("first"))
    kind = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("c_custkey") % 3 + 1).cast("int"))
    undefined = t("customer").select(kind.alias("map"), (1 + F.col("c_custkey") % 2).alias("len"), F.col("c_custkey").alias("nth"), F.col("c_custkey").alias("lo"), (F.col("c_custkey") + 9).alias("hi"), F.col("c_nationkey").cast("long").alias("first"))
    codes = t("part").select("p_partkey", F.explode(F.lit(["F", "O", "P"])).alias("map"), (1 + F.col("p_partkey") % 2).alias("len"), (F.col("p_partkey") % 1000).alias("code"))
    return ranges.coded(codes, known, undefined, ["map", "len"], "code", "cid")
