"""The queries over the driver's tables, each with its DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour, curves, dates
from ..operators import graphs, images, joins, lookups, ordering, scans
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL that gives the same rows, or None where SQL cannot."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""SELECT lang, count(*) AS words, count(DISTINCT w) AS distinct_words, sum(length(w)) AS letters
    FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) GROUP BY lang""")
def words_per_lang(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    return words.groupBy("lang").agg(F.count("*").alias("words"), F.countDistinct("w").alias("distinct_words"), F.sum(F.length("w")).alias("letters"))


@query(r"""SELECT kind, count(*) AS runs, sum(length(run)) AS chars FROM (
    SELECT run, CASE WHEN run LIKE ' %' THEN 'space' WHEN run SIMILAR TO '[\t\n\r\v\f]+' THEN 'tab' ELSE 'word' END AS kind
    FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r\v\f]+| +|[\t\n\r\v\f]+')) AS run FROM documents)) GROUP BY kind""")
def word_runs_by_type(spark, sf_dir):
    """Texts cut into runs of words, blanks and other white space."""
    runs = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0B\f]+| +|[\t\n\r\x0B\f]+"), F.lit(0))).alias("run"))
    kind = F.when(F.col("run").startswith(" "), "space").when(F.col("run").rlike(r"^[\t\n\r\x0B\f]"), "tab").otherwise("word")
    return runs.groupBy(kind.alias("kind")).agg(F.count("*").alias("runs"), F.sum(F.length("run")).alias("chars"))


@query(r"""SELECT doc_id, CAST(p - 1 AS BIGINT) AS paragraph, length(part) AS chars FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
def paragraph_split(spark, sf_dir):
    """The paragraphs of each document in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "part")).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.length("part").alias("chars"))


@query(r"""SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '+00''00''' AS pdf_date, o_orderdate AS parsed FROM orders""")
def pdf_date_roundtrip(spark, sf_dir):
    """Dates written in the document format and read back."""
    written = table(spark, sf_dir, "orders").select("o_orderkey", dates.to_pdf_date(F.col("o_orderdate")).alias("pdf_date"))
    return written.withColumn("parsed", dates.parse_pdf_date(F.col("pdf_date"))["ts"])


@query("SELECT l_orderkey, l_linenumber, round(0.25 + (1.0 - 0.25) * pow(least(greatest(l_discount, 0.0), 1.0), 1.5), 9) AS y FROM lineitem")
def exp_function(spark, sf_dir):
    """Exponential interpolation (function type 2)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(curves.exponential(F.col("l_discount"), 0.25, 1.0, 1.5), 9).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 10 THEN x / 10 WHEN x < 30 THEN 1 - (x - 10) / 20 * 0.5 ELSE 0.5 + (x - 30) / 20 * 0.5 END, 9) AS y
    FROM (SELECT *, least(greatest(l_quantity, 0.0), 50.0) AS x FROM lineitem)""")
def stitch_function(spark, sf_dir):
    """Pieces of functions joined at bounds (function type 3)."""
    pieces = [lambda t: curves.exponential(t, 0.0, 1.0, 1.0), lambda t: curves.exponential(t, 1.0, 0.5, 1.0), lambda t: curves.exponential(t, 0.5, 1.0, 1.0)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(curves.stitched(F.col("l_quantity"), (0.0, 50.0), [10.0, 30.0], pieces), 9).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(s[i + 1] + (s[least(i + 2, 5)] - s[i + 1]) * (e - i), 9) AS y FROM (
    SELECT *, CAST(floor(e) AS INT) AS i, [0.0, 0.1, 0.5, 0.9, 1.0] AS s FROM (SELECT *, least(greatest(l_tax, 0.0), 0.08) / 0.08 * 4 AS e FROM lineitem))""")
def sampled_function_1d(spark, sf_dir):
    """A table of samples with linear interpolation (function type 0)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(curves.sampled(F.col("l_tax"), (0.0, 0.08), [0.0, 0.1, 0.5, 0.9, 1.0]), 9).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(1 - least(1.0, l_tax + k), 9) AS r, round(1 - least(1.0, l_discount + k), 9) AS g, round(1 - least(1.0, l_quantity / 50 + k), 9) AS b,
    round(0.299 * (1 - least(1.0, l_tax + k)) + 0.587 * (1 - least(1.0, l_discount + k)) + 0.114 * (1 - least(1.0, l_quantity / 50 + k)), 9) AS gray FROM (SELECT *, 0.1 AS k FROM lineitem)""")
def cmyk_to_rgb_gray(spark, sf_dir):
    """Device CMYK to RGB by the plain formula, and RGB to gray by the usual weights."""
    rgb = colour.cmyk_to_rgb(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 50, F.lit(0.1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(n) for c, n in zip((*rgb, colour.rgb_to_gray(*rgb)), "r g b gray".split(), strict=True)))


@query("""SELECT l_orderkey, l_linenumber, round(0.299 * l_tax + 0.587 * l_discount + 0.114 * q, 9) + 0.0 AS y, round(-0.168736 * l_tax - 0.331264 * l_discount + 0.5 * q, 9) + 0.0 AS cb,
    round(0.5 * l_tax - 0.418688 * l_discount - 0.081312 * q, 9) + 0.0 AS cr FROM (SELECT *, l_quantity / 50 AS q FROM lineitem)""")
def rgb_to_ycc(spark, sf_dir):
    ycc = colour.rgb_to_ycc(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *((F.round(c, 9) + F.lit(0.0)).alias(n) for c, n in zip(ycc, ("y", "cb", "cr"), strict=True)))


@query("SELECT v AS level, count(p_size) AS n FROM range(0, 64) r(v) LEFT JOIN part ON p_size = v GROUP BY v")
def histogram_dense(spark, sf_dir):
    """Counts of all levels, those that do not occur too."""
    return images.histogram(table(spark, sf_dir, "part"), "p_size", 64)


@query("""WITH h AS (SELECT p_brand AS g, p_size AS v, count(*) AS n FROM part GROUP BY 1, 2),
    c AS (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) AS w0, sum(n) OVER (PARTITION BY g) AS t, sum(n * v) OVER (PARTITION BY g ORDER BY v) AS s0, sum(n * v) OVER (PARTITION BY g) AS s FROM h)
    SELECT g AS p_brand, CAST(arg_max(v, (round(w0 * (t - w0) * pow(s0 / w0 - (s - s0) / (t - w0), 2), 6), -v)) AS INT) AS threshold FROM c WHERE t > w0 GROUP BY g""")
def otsu_threshold(spark, sf_dir):
    """For each brand the level that parts its sizes with the largest variance between both sides."""
    return images.otsu(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT label, count(*) AS n, sum(CASE WHEN greatest(abs(embedding[1] - embedding[2]), abs(embedding[2] - embedding[3])) <= 0.05 THEN 1 ELSE 0 END) AS gray FROM embeddings GROUP BY label")
def gray_test(spark, sf_dir):
    """How many triples have components so near each other that they are gray."""
    e = F.col("embedding")
    gray = F.greatest(F.abs(e[0] - e[1]), F.abs(e[1] - e[2])) <= 0.05
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(gray.cast("int")).alias("gray"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def xref_newest_wins(spark, sf_dir):
    """Of several entries of a key the newest section's holds."""
    return ordering.newest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT source, doc_id, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) - strlen(text) AS BIGINT) AS byte_offset FROM documents")
def xref_offsets(spark, sf_dir):
    """The byte offset of each object if they are written one after the other."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return ordering.offsets(docs, ["source"], ["doc_id"], "size", "byte_offset").select("source", "doc_id", "byte_offset")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 255 AS stream, (row_number() OVER (ORDER BY o_orderkey) - 1) % 255 AS place FROM orders")
def objstm_bucket(spark, sf_dir):
    """Objects put into object streams of 255, in order."""
    return ordering.number(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "nth").select("o_orderkey", F.floor(F.col("nth") / 255).alias("stream"), (F.col("nth") % 255).alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS new_id FROM part")
def renumber_ids(spark, sf_dir):
    """Ids without gaps, from 1."""
    return ordering.number(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "nth").select("p_partkey", (F.col("nth") + 1).alias("new_id"))


@query("SELECT p_partkey, count(l_orderkey) AS refs FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def ref_counts(spark, sf_dir):
    """Inbound references of each object."""
    return graphs.ref_counts(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").select("l_partkey"), "p_partkey", "l_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 300000)")
def prune_unreferenced(spark, sf_dir):
    """Objects that no reference of some kind leads to."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' OR o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def already_copied(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


_EDGES = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || n_nationkey, 'c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey"""


def _edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    up = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return up.unionAll(t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), reach(node, depth) AS (SELECT 'r1', 0 UNION SELECT dst, depth + 1 FROM reach JOIN e ON src = node) SELECT node, min(depth) AS depth FROM reach GROUP BY node""")
def reachable_from_root(spark, sf_dir):
    """What a root's references reach, and in how many steps."""
    return graphs.reachable(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"))


@query("""SELECT p_partkey, coalesce((SELECT arg_max(r.cid + p_size - r.lo, r.n) FROM (VALUES (1, 1, 20, 100), (2, 15, 30, 500), (3, 40, 45, 900)) r(n, lo, hi, cid) WHERE p_size BETWEEN r.lo AND r.hi), 0) AS cid FROM part""")
def cmap_range_lookup(spark, sf_dir):
    """Character codes through ranges of a map; a later range overrides an earlier one, no range gives 0."""
    return lookups.ranges(table(spark, sf_dir, "part"), "p_size", [(1, 20, 100), (15, 30, 500), (40, 45, 900)]).select("p_partkey", "cid")


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name BETWEEN (SELECT min(n_name) FROM nation WHERE n_regionkey = 1) AND (SELECT max(n_name) FROM nation WHERE n_regionkey = 1)""")
def name_tree_lookup(spark, sf_dir):
    """Names looked up in a tree: first by limits, then by equality."""
    nation = table(spark, sf_dir, "nation")
    limits = nation.filter("n_regionkey = 1").agg(F.min("n_name").alias("lo"), F.max("n_name").alias("hi"))
    inside = nation.join(F.broadcast(limits), (F.col("n_name") >= F.col("lo")) & (F.col("n_name") <= F.col("hi")))
    return table(spark, sf_dir, "customer").join(inside, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


def first_equal(docs, within: list[str]):
    """(doc_id, kept_id): the smallest doc_id of those with an equal text, null equal to null, and equal columns `within`."""
    key = F.struct(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"w{i}") for i, c in enumerate(within)), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"))
    told = docs.select("doc_id", key.alias("key"))
    first = told.groupBy("key").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n"))
    return joins.with_group(told, first, "key", "n").select("doc_id", "kept_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents")
def dedup_equivalent(spark, sf_dir):
    """Equal objects are replaced by the first of them. Texts count as equal by SHA-256 and length, so no text is shuffled."""
    return first_equal(table(spark, sf_dir, "documents").select("doc_id", "text"), [])


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def distinct_images(spark, sf_dir):
    """The different resources that each page uses."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query("""SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
    (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, run""")
def adjacent_equal_runs(spark, sf_dir):
    """Runs of equal values that follow each other, as width arrays are written."""
    return scans.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(r"""SELECT a, b, count(*) AS n FROM (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)) WHERE b IS NOT NULL GROUP BY a, b""")
def kerning_pairs(spark, sf_dir):
    """Pairs of neighbours and how often they occur."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    pairs = table(spark, sf_dir, "documents").select(words.alias("w")).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, 1 << 30).alias("b"))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS x FROM events")
def text_position_running(spark, sf_dir):
    """The position after each relative move."""
    return scans.running(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", "x").select("user_id", "event_id", F.round("x", 6).alias("x"))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS large, round(max(value), 6) AS top FROM events GROUP BY event_type")
def block_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.max("value"), 6).alias("top"))


@query("SELECT doc_id, hex(encode(text)) AS hex_text FROM documents")
def hex_encode(spark, sf_dir):
    """The hexadecimal filter, encoding."""
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(F.col("text").cast("binary")).alias("hex_text"))


@query("SELECT doc_id, base64(encode(text)) AS coded, text AS decoded FROM documents")
def base64_roundtrip(spark, sf_dir):
    """Encoding, without line ends, and decoding, which gives the bytes back."""
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("coded"), F.unbase64(coded).cast("string").alias("decoded"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


@query("SELECT conv_id, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def turn_order(spark, sf_dir):
    """Streams of one object joined in their order."""
    said = F.concat("role", F.lit(":"), F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", said.alias("s")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["s"]), "\n").alias("body"))
