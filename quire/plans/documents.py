"""More queries over the driver's tables: colours, functions, matrices, trees and lists, reference tables, text."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour, curves, matrix, text
from ..operators import graphs, intervals, lookups, ordering
from ..sources.tables import table
from .catalog import first_equal, query

_Q = "(SELECT *, l_quantity / 50 AS q FROM lineitem)"


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("t"), F.col("l_discount").alias("d"), (F.col("l_quantity") / 50).alias("q"))


def _rounded(spark, sf_dir, columns, names):
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *((F.round(c, 7) + F.lit(0.0)).alias(n) for c, n in zip(columns, names, strict=True)))


rgb = lambda: (F.col("t"), F.col("d"), F.col("q"))


def _poly(i):
    sql = {"c": "l_tax", "m": "l_discount", "y": "q", "k": "0.1::DOUBLE"}
    return "least(1, greatest(0, 1 + (" + " + ".join(f"({v[i]!r}) * " + " * ".join(sql[x] for x in n) for n, v in colour.CMYK_POLYNOMIAL.items()) + ") / 255))"


@query(f"SELECT l_orderkey, l_linenumber, round({_poly(0)}, 7) + 0.0 AS r, round({_poly(1)}, 7) + 0.0 AS g, round({_poly(2)}, 7) + 0.0 AS b FROM {_Q}")
def cmyk_polynomial(spark, sf_dir):
    """CMYK to RGB by the polynomial."""
    return _rounded(spark, sf_dir, colour.cmyk_to_rgb_polynomial(*rgb(), F.lit(0.1)), "rgb")


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN w = 0 THEN 0 ELSE (w - l_tax) / w END, 7) + 0.0 AS c, round(CASE WHEN w = 0 THEN 0 ELSE (w - l_discount) / w END, 7) + 0.0 AS m,
    round(CASE WHEN w = 0 THEN 0 ELSE (w - q) / w END, 7) + 0.0 AS y, round(1 - w, 7) + 0.0 AS k FROM (SELECT *, greatest(l_tax, l_discount, q) AS w FROM {_Q})""")
def rgb_to_cmyk(spark, sf_dir):
    return _rounded(spark, sf_dir, colour.rgb_to_cmyk(*rgb()), "cmyk")


@query(f"SELECT l_orderkey, l_linenumber, round(pow(q, 1.8 / 2.2), 7) AS gray FROM {_Q}")
def cal_gray(spark, sf_dir):
    """Calibrated gray by its gamma, shown with 1 / 2.2."""
    return _rounded(spark, sf_dir, [colour.cal_gray(F.col("q"), 1.8)], ["gray"])


@query(f"""WITH f AS (SELECT *, (q * 100 + 16) / 116 AS m, (q * 100 + 16) / 116 + (l_tax * 100) / 500 AS l, (q * 100 + 16) / 116 - (l_discount * 100) / 200 AS n FROM {_Q}),
    x AS (SELECT *, CASE WHEN l >= 6.0 / 29 THEN l * l * l ELSE (l - 4.0 / 29) * 108 / 841 END AS x, CASE WHEN m >= 6.0 / 29 THEN m * m * m ELSE (m - 4.0 / 29) * 108 / 841 END AS y, CASE WHEN n >= 6.0 / 29 THEN n * n * n ELSE (n - 4.0 / 29) * 108 / 841 END AS z FROM f)
    SELECT l_orderkey, l_linenumber, round(sqrt(greatest(0, (x * 3.2404542 - y * 1.5371385 - z * 0.4985314) / (3.2404542 - 1.5371385 - 0.4985314))), 7) + 0.0 AS r,
    round(sqrt(greatest(0, (-x * 0.9692660 + y * 1.8760108 + z * 0.0415560) / (-0.9692660 + 1.8760108 + 0.0415560))), 7) + 0.0 AS g, round(sqrt(greatest(0, (x * 0.0556434 - y * 0.2040259 + z * 1.0572252) / (0.0556434 - 0.2040259 + 1.0572252))), 7) + 0.0 AS b FROM x""")
def lab_to_rgb(spark, sf_dir):
    return _rounded(spark, sf_dir, colour.lab_to_rgb(F.col("q") * 100, F.col("t") * 100, F.col("d") * 100), "rgb")


@query("SELECT p_partkey, (['#000', '#800', '#080', '#008', '#fff'])[least(greatest(p_size // 8, 0), 4) + 1] AS colour FROM part")
def indexed_palette(spark, sf_dir):
    """Colours by their place in a palette; places beyond it are its ends."""
    return table(spark, sf_dir, "part").select("p_partkey", colour.indexed(["#000", "#800", "#080", "#008", "#fff"], F.floor(F.col("p_size") / 8)).alias("colour"))


@query(f"""SELECT l_orderkey, l_linenumber, round(1 - least(1, 0.9 * pow(q, 1.2) + 0.05 * q), 7) + 0.0 AS r, round(1 - least(1, 0.2 * pow(q, 1.2) + 0.05 * q), 7) + 0.0 AS g, round(1 - least(1, 0.05 * q), 7) + 0.0 AS b FROM {_Q}""")
def separation_tint(spark, sf_dir):
    """A tint's transform into an alternate space, here CMYK, and on to RGB."""
    tint = [curves.exponential(F.col("q"), 0.0, c, n) for c, n in ((0.9, 1.2), (0.2, 1.2), (0.0, 1.0), (0.05, 1.0))]
    return _rounded(spark, sf_dir, colour.cmyk_to_rgb(*tint), "rgb")


@query(f"""SELECT l_orderkey, l_linenumber, round(1 - least(1, least(1, 0.8 * l_tax + 0.3 * q) + 0.1 * l_discount), 7) + 0.0 AS r, round(1 - least(1, least(1, 0.2 * l_tax + 0.5 * q) + 0.1 * l_discount), 7) + 0.0 AS g, round(1 - least(1, least(1, 0.4 * q) + 0.1 * l_discount), 7) + 0.0 AS b FROM {_Q}""")
def device_n(spark, sf_dir):
    """Three colorants, two of them with shares in the alternate's components."""
    mixed = [F.least(F.lit(1.0), F.col("t") * a + F.col("q") * b) for a, b in ((0.8, 0.3), (0.2, 0.5), (0.0, 0.4))]
    return _rounded(spark, sf_dir, colour.cmyk_to_rgb(*mixed, F.col("d") * 0.1), "rgb")


@query(f"""WITH y AS (SELECT *, -0.168736 * l_tax - 0.331264 * l_discount + 0.5 * q AS u, 0.5 * l_tax - 0.418688 * l_discount - 0.081312 * q AS v FROM {_Q})
    SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) < 1.1e-7 AND abs(l_discount - q) < 1.1e-7 AND abs(q - l_tax) < 1.1e-7 AS close, sqrt(u * u + v * v) < 0.02 AS similar FROM y""")
def colours_alike(spark, sf_dir):
    """Whether a colour is equal to its turned self, and whether its chroma is that of gray."""
    t, d, q = rgb()
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", colour.close((t, d, q), (d, q, t)).alias("close"), (colour.chroma_distance((t, d, q), (F.lit(0.0),) * 3) < colour.SIMILAR).alias("similar"))


@query("SELECT p_partkey, round(-1 + (p_size % 16) * (p_retailprice / 1000 + 1) / 15, 9) + 0.0 AS low, round(CASE WHEN p_size % 2 = 0 THEN p_size % 16 ELSE 15 - p_size % 16 END / 15.0, 9) + 0.0 AS plain FROM part")
def decode_table(spark, sf_dir):
    """What a sample of four bits stands for: between two ends of its own, and between 0 and 1 or, turned round, 1 and 0."""
    sample, even = F.col("p_size") % 16, F.col("p_size") % 2 == 0
    low = colour.decoded(sample, F.lit(-1.0), F.col("p_retailprice") / 1000, 4)
    plain = colour.decoded(sample, F.when(even, 0.0).otherwise(1.0), F.when(even, 1.0).otherwise(0.0), 4)
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(low, 9) + F.lit(0.0)).alias("low"), (F.round(plain, 9) + F.lit(0.0)).alias("plain"))


@query(f"""WITH g AS (SELECT *, pow(l_tax, 1.8) AS a, pow(l_discount, 2.0) AS b, pow(q, 2.2) AS c FROM {_Q}),
    x AS (SELECT *, 0.4497 * a + 0.3163 * b + 0.1845 * c AS x, 0.2446 * a + 0.672 * b + 0.0833 * c AS y, 0.0252 * a + 0.1412 * b + 0.9227 * c AS z FROM g)
    SELECT l_orderkey, l_linenumber, round(sqrt(greatest(0, (x * 3.2404542 - y * 1.5371385 - z * 0.4985314) / (3.2404542 - 1.5371385 - 0.4985314))), 7) + 0.0 AS r,
    round(sqrt(greatest(0, (-x * 0.9692660 + y * 1.8760108 + z * 0.0415560) / (-0.9692660 + 1.8760108 + 0.0415560))), 7) + 0.0 AS g, round(sqrt(greatest(0, (x * 0.0556434 - y * 0.2040259 + z * 1.0572252) / (0.0556434 - 0.2040259 + 1.0572252))), 7) + 0.0 AS b FROM x""")
def cal_rgb(spark, sf_dir):
    """Calibrated RGB by its gammas and its matrix."""
    return _rounded(spark, sf_dir, colour.cal_rgb(*rgb(), (1.8, 2.0, 2.2), (0.4497, 0.2446, 0.0252, 0.3163, 0.672, 0.1412, 0.1845, 0.0833, 0.9227)), "rgb")


@query("SELECT label, count(*) AS n, sum(CASE WHEN list_max(embedding) - list_min(embedding) > 0.5 THEN 1 ELSE 0 END) <= count(*) * 900 // 1000 AS gray FROM embeddings GROUP BY label")
def gray_verdict(spark, sf_dir):
    """Whether at most 900 per mille of the vectors are coloured: components further apart than a half."""
    e = F.col("embedding")
    coloured = F.count_if(F.array_max(e) - F.array_min(e) > 0.5)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), coloured.alias("c")).select("label", "n", (F.col("c") <= F.floor(F.col("n") * 900 / 1000)).alias("gray"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <= 0.05 AND l_discount <= 0.05 AND q <= 0.5 THEN 0.0 ELSE l_tax END AS r, CASE WHEN l_tax <= 0.05 AND l_discount <= 0.05 AND q <= 0.5 THEN 0.0 ELSE l_discount END AS g,
    CASE WHEN l_tax <= 0.05 AND l_discount <= 0.05 AND q <= 0.5 THEN 0.0 ELSE q END AS b FROM {_Q}""")
def threshold_pixels(spark, sf_dir):
    """A pixel all of whose components are at most the threshold's is background; others stay as they are."""
    t, d, q = rgb()
    low = (t <= 0.05) & (d <= 0.05) & (q <= 0.5)
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.when(low, 0.0).otherwise(x).alias(n) for x, n in zip((t, d, q), "rgb", strict=True)))


@query(f"SELECT l_orderkey, l_linenumber, round(0.299 * l_tax + 0.587 * l_discount + 0.114 * q, 7) + 0.0 AS gray, round(1 - pow(0.299 * l_tax + 0.587 * l_discount + 0.114 * q, 0.5), 7) + 0.0 AS shown FROM {_Q}")
def grayscale_transfer(spark, sf_dir):
    """Luminance, and a transfer function that inverts it with a gamma."""
    gray = colour.rgb_to_gray(*rgb())
    return _rounded(spark, sf_dir, [gray, 1 - F.pow(gray, F.lit(0.5))], ["gray", "shown"])


@query(f"""SELECT l_orderkey, l_linenumber, round(a + (b - a) * (ex - i), 7) + 0.0 AS y FROM (SELECT *, s[i + 1][j + 1] + (s[i + 1][least(j + 2, 3)] - s[i + 1][j + 1]) * (ey - j) AS a, s[least(i + 2, 2)][j + 1] + (s[least(i + 2, 2)][least(j + 2, 3)] - s[least(i + 2, 2)][j + 1]) * (ey - j) AS b FROM
    (SELECT *, CAST(floor(ex) AS INT) AS i, CAST(floor(ey) AS INT) AS j, [[0.0, 0.5, 1.0], [1.0, 0.2, 0.4]] AS s FROM (SELECT *, least(greatest(l_discount, 0), 0.1) / 0.1 AS ex, least(greatest(q, 0), 1) * 2 AS ey FROM {_Q})))""")
def sampled_function_2d(spark, sf_dir):
    """A table of samples of two inputs."""
    return _rounded(spark, sf_dir, [curves.sampled_2d(F.col("d"), F.col("q"), ((0.0, 0.1), (0.0, 1.0)), [[0.0, 0.5, 1.0], [1.0, 0.2, 0.4]])], ["y"])


@query(f"SELECT l_orderkey, l_linenumber, [round(pow(q, 2), 7), round(0.5 + 0.5 * q, 7), round(l_tax * q, 7)] AS ys FROM {_Q}")
def function_array(spark, sf_dir):
    """Several functions of the same inputs, as one vector."""
    q = F.col("q")
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array(*(F.round(y, 7) for y in (curves.exponential(q, 0.0, 1.0, 2.0), curves.exponential(q, 0.5, 1.0, 1.0), F.col("t") * q))).alias("ys"))


@query(f"SELECT l_orderkey, l_linenumber, round(2 * q - l_tax + 10, 7) AS x, round(q + 3 * l_tax - 5, 7) AS y, true AS back FROM {_Q}")
def matrix_transform(spark, sf_dir):
    """A point through two matrices multiplied, and back through the inverse."""
    m = matrix.multiply((1.0, 0.0, 0.0, 1.0, 3.0, -4.0), (2.0, 1.0, -1.0, 3.0, 0.0, 4.0))
    x, y = matrix.transform(m, F.col("q"), F.col("t"))
    u, v = matrix.transform(matrix.inverse(m), x, y)
    back = (F.abs(u - F.col("q")) < 1e-9) & (F.abs(v - F.col("t")) < 1e-9)
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(x, 7).alias("x"), F.round(y, 7).alias("y"), back.alias("back"))


@query("SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS BIGINT) AS to_end FROM customer")
def outline_siblings(spark, sf_dir):
    """Siblings of an outline are a linked list: how far each is from its end."""
    own = W.partitionBy("c_nationkey").orderBy("c_custkey")
    linked = table(spark, sf_dir, "customer").select("c_custkey", F.lead("c_custkey").over(own).alias("following"))
    return graphs.list_places(linked, "c_custkey", "following").select("c_custkey", "to_end")


@query("""SELECT c_custkey, coalesce(n.n_name, r.r_name) AS destination FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) n ON c_nationkey = n_nationkey LEFT JOIN region r ON c_nationkey = r_regionkey""")
def destination_resolution(spark, sf_dir):
    """Names looked up in the name tree, else in the older table, else null."""
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination"))
    older = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("c_nationkey"), F.col("r_name").alias("destination"))
    return lookups.first_found(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", [names, older], "destination").select("c_custkey", "destination")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size <= 25")
def resource_lookup(spark, sf_dir):
    """Operands of commands resolved to the resources with their names."""
    known = table(spark, sf_dir, "part").filter("p_size <= 25").select("p_partkey", "p_name")
    return table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def nested_images(spark, sf_dir):
    """The different images of a page, those in its forms included."""
    forms = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    inside = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    return forms.join(inside, "o_orderkey").select("o_custkey", "l_partkey").distinct()


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY source, text) AS kept_id FROM documents")
def dedup_within_page(spark, sf_dir):
    """Equal objects of one page are replaced by the first of them."""
    return first_equal(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source"])


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')")
def partial_xref(spark, sf_dir):
    """Only objects that are not written yet get ids."""
    written = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select(F.col("l_orderkey").alias("o_orderkey"))
    left = table(spark, sf_dir, "orders").select("o_orderkey").join(written, "o_orderkey", "left_anti")
    return ordering.number(left, ["o_orderkey"], "nth").select("o_orderkey", (F.col("nth") + 1).alias("id"))


@query("SELECT key, section, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS place FROM (SELECT p_partkey AS key, 'part' AS section FROM part UNION ALL SELECT -1 - s_suppkey, 'supplier' FROM supplier)")
def chunked_xref_merge(spark, sf_dir):
    """Tables of several sections merged into one, sorted by id and numbered."""
    both = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit("part").alias("section")).unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("key"), F.lit("supplier").alias("section")))
    return ordering.number(both, ["key"], "place").select("key", "section", "place")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey < (SELECT max(p_partkey) // 2 FROM part)")
def xref_trim(spark, sf_dir):
    """Entries beyond the table's size go."""
    parts = table(spark, sf_dir, "part")
    return parts.join(F.broadcast(parts.agg(F.floor(F.max("p_partkey") / 2).alias("size"))), F.col("p_partkey") < F.col("size")).select("p_partkey", "p_size")


@query("""SELECT c_custkey, count(l_linenumber) AS refs, count(DISTINCT o_orderkey) AS orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def object_graph_dump(spark, sf_dir):
    """Each object with its references, counted before they meet."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.coalesce("lines", F.lit(0))).alias("refs"), F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select("c_custkey", zero("refs"), zero("orders"), "first_order")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), reach(node) AS (SELECT 'r1' UNION SELECT dst FROM reach JOIN e ON src = node)
    SELECT node, count(src) AS refs FROM reach LEFT JOIN e ON dst = node AND src IN (SELECT node FROM reach) GROUP BY node""")
def recount_and_prune(spark, sf_dir):
    """What a root does not reach goes; references of what stays are counted anew."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, c: F.concat(F.lit(p), c)
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionAll(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return graphs.prune(nodes, edges, spark.createDataFrame([("r1",)], "node string"), "node")


@query("SELECT user_id, event_type AS key, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY user_id, event_type")
def log_key_counts(spark, sf_dir):
    """Log events counted by source and kind."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


@query("SELECT event_id, printf('%d: %s by user %d', event_id, event_type, user_id) AS message FROM events")
def log_messages(spark, sf_dir):
    """Log events as messages."""
    return table(spark, sf_dir, "events").select("event_id", F.format_string("%d: %s by user %d", "event_id", "event_type", "user_id").alias("message"))


@query("SELECT doc_id, upper(substr(md5(text), 1, 31)) || '0' AS decoded, CAST('0x' || substr(md5(text), 5, 2) AS INT) AS third, CAST(16 AS INT) AS size FROM documents")
def ascii_hex_decode(spark, sf_dir):
    """Hexadecimal digits with line ends in them, an end mark and what follows it, decoded; an odd last digit counts as followed by 0."""
    digest = F.md5(F.col("text").cast("binary"))
    written = F.concat(F.substring(digest, 1, 9), F.lit("\n \t"), F.upper(F.substring(digest, 10, 22)), F.lit("> ff"))
    decoded = text.ascii_hex_decoded(written)
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(decoded).alias("decoded"), F.conv(F.hex(F.substring(decoded, 3, 1)), 16, 10).cast("int").alias("third"), F.octet_length(decoded).alias("size"))


@query(None)
def crc(spark, sf_dir):
    """CRC-32 of each text; a test holds it against zlib's."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


_ANNOTATION = ("invisible", "hidden", "print", "no_zoom", "no_rotate", "no_view", "read_only", "locked", "toggle_no_view", "locked_contents")
#: The bits of permissions, from 1.
_PERMISSION = {"may_print": 3, "may_modify": 4, "may_copy": 5, "may_annotate": 6, "may_fill": 9, "may_extract": 10, "may_assemble": 11, "may_print_well": 12}


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderkey & {1 << i}) > 0 AS {n}" for i, n in enumerate(_ANNOTATION)) + ", " + ", ".join(f"(o_custkey & {1 << (b - 1)}) > 0 AS {n}" for n, b in _PERMISSION.items()) + " FROM orders")
def flag_bits(spark, sf_dir):
    """The ten flags of annotations and the eight permissions from their bits."""
    bit = lambda c, n: F.col(c).bitwiseAND(F.lit(1 << n)) > 0
    return table(spark, sf_dir, "orders").select("o_orderkey", *(bit("o_orderkey", i).alias(n) for i, n in enumerate(_ANNOTATION)), *(bit("o_custkey", b - 1).alias(n) for n, b in _PERMISSION.items()))


@query("SELECT p_size AS code, coalesce((SELECT max(s.p_name) FROM part s WHERE s.p_size = t.p_size AND s.p_partkey % 7 = 0), 'base' || p_size) AS name FROM (SELECT DISTINCT p_size FROM part) t")
def encoding_differences(spark, sf_dir):
    """A base encoding with some codes named otherwise."""
    parts = table(spark, sf_dir, "part")
    other = parts.filter("p_partkey % 7 = 0").groupBy("p_size").agg(F.max("p_name").alias("other"))
    return parts.select("p_size").distinct().join(other, "p_size", "left").select(F.col("p_size").alias("code"), F.coalesce("other", F.concat(F.lit("base"), "p_size")).alias("name"))


@query("SELECT a.n_nationkey AS from_code, min(b.s_suppkey) AS to_code FROM nation a LEFT JOIN supplier b ON a.n_nationkey = b.s_nationkey GROUP BY a.n_nationkey")
def encoding_cross_reference(spark, sf_dir):
    """Codes of one encoding to those of another that have the same name, the first of several; null if there is none. It is also the
    way back from characters to codes."""
    there = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("to_code"))
    return table(spark, sf_dir, "nation").join(there, "n_nationkey", "left").select(F.col("n_nationkey").alias("from_code"), "to_code")


@query("SELECT c_custkey, [ord(c_name[2 * i - 1]) * 256 + ord(c_name[2 * i]) FOR i IN range(1, length(c_name) // 2 + 1)] AS codes FROM customer")
def identity_codes(spark, sf_dir):
    """Two bytes make one code; a single last byte makes none."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.two_byte_codes(F.col("c_name")).alias("codes"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 14 THEN [500, 510, 520, 530, 540][p_size - 9] WHEN p_size BETWEEN 20 AND 30 THEN 750 ELSE 1000 END AS width FROM part")
def cid_widths(spark, sf_dir):
    """Widths of codes: lists from a first code on, ranges with one width, and a default for all others."""
    code = F.col("p_size")
    listed = F.element_at(F.lit([500, 510, 520, 530, 540]), code - 9)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(code.between(10, 14), listed).when(code.between(20, 30), 750).otherwise(1000).alias("width"))


@query("""WITH c AS (SELECT p_partkey, string_split(p_name, '') AS s FROM part),
    w AS (SELECT p_partkey, [(CASE s[i] WHEN 'i' THEN 222 WHEN 'm' THEN 833 WHEN ' ' THEN 278 ELSE 556 END + CASE s[i - 1] || s[i] WHEN 're' THEN -30 WHEN 'd ' THEN 15 ELSE 0 END) * 0.0108 + 0.09 + (CASE WHEN s[i] = ' ' THEN 0.45 ELSE 0 END) FOR i IN range(1, len(s) + 1)] AS a FROM c),
    t AS (SELECT p_partkey, a, [round(list_sum(a[1 : i]), 6) FOR i IN range(1, len(a) + 1)] AS upto FROM w)
    SELECT p_partkey, round(list_sum(a), 6) AS advance, CAST(len(list_filter(upto, lambda x: x <= 50)) AS INT) AS fits FROM t""")
def measure_line(spark, sf_dir):
    """The advance of a line of text with kerned pairs, and how many signs fit into a length."""
    m = text.measured(F.col("p_name"), {"i": 222, "m": 833, " ": 278}, 556, 12.0, 0.1, 0.5, 0.9, {"re": -30, "d ": 15}, 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.round("m.advance", 6).alias("advance"), "m.fits")


@query(None)
def wrap_fixed_width(spark, sf_dir):
    """Every text wrapped greedily at 60 signs; a test holds it against a plain loop."""
    return table(spark, sf_dir, "documents").select("doc_id", text.wrapped(F.regexp_replace("text", r"\s", " "), 60).alias("w")).select("doc_id", "w.*")


@query(r"SELECT doc_id, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10))) AS paragraphs FROM documents")
def paragraphs_double(spark, sf_dir):
    """Paragraphs that blank lines part."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"), True)).cast("long").alias("paragraphs"))


_RANGES = "SELECT user_id, event_id, event_type, epoch_us(ts) AS lo, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS hi FROM events WHERE event_type {}"


@query(f"""WITH a AS ({_RANGES.format("= 'view'")}), b AS ({_RANGES.format("= 'click'")}) SELECT a.event_id, b.event_id AS other, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi WHERE a.lo < a.hi AND b.lo < b.hi""")
def style_overlap(spark, sf_dir):
    """Where ranges of one style overlap those of another, and the part that both cover."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    ranges = lambda kind: table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("lo"), F.unix_micros(F.lead("ts").over(own).cast("timestamp")).alias("hi"))
    met = intervals.overlapping(ranges("view"), ranges("click"), ["user_id"])
    return met.select("event_id", F.col("r_event_id").alias("other"), F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"))
