from pyspark.sql import functions as F

from quire.functions.dates import parse_pdf_date
from quire.operators import graphs, intervals, lookups, ordering


def test_dates_with_missing_parts_and_offsets(spark):
    texts = ["D:2024", "D:20240102", "D:20240102030405+02'00'", "D:20240102030405-0130", "no date", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_pdf_date(F.col("t")).alias("d")).orderBy("i").selectExpr("date_format(d.ts, 'yyyy-MM-dd HH:mm:ss') AS ts", "d.precision AS p", "d.offset_min AS o").collect()
    assert [tuple(r) for r in got] == [("2024-01-01 00:00:00", "year", 0), ("2024-01-02 00:00:00", "day", 0), ("2024-01-02 01:04:05", "second", 120), ("2024-01-02 04:34:05", "second", -90), (None, None, None), (None, None, None)]


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = graphs.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert sorted((r.node, r.depth) for r in got) == [("a", 0), ("b", 1), ("c", 2)]


def test_number_is_gapless(spark):
    got = ordering.number(spark.range(500).select((F.col("id") * 7919 % 1009).alias("k")), ["k"], "nth").orderBy("k").collect()
    assert [r.nth for r in got] == list(range(500))


def test_long_range_lists_and_chains(spark):
    known = [(i * 3, i * 3 + 10, 1000 * i) for i in range(100)]
    got = lookups.ranges(spark.range(400).toDF("code"), "code", known).collect()
    for r in got:
        assert r.cid == next((first + r.code - lo for lo, hi, first in reversed(known) if lo <= r.code <= hi), 0)
    chain = spark.createDataFrame([(i, i + 1 if i < 149 else None) for i in range(150)] + [(500, 501), (501, 500)], "node long, following long")
    assert {r.node: r.to_end for r in graphs.list_places(chain, "node", "following").collect()} == {i: 149 - i for i in range(150)} | {500: None, 501: None}
    edges = spark.createDataFrame([(i, i + 1) for i in range(110)], "src long, dst long")
    assert max(r.depth for r in graphs.reachable(edges.filter("src >= 98"), spark.createDataFrame([(98,)], "node long")).collect()) == 12


def test_overlapping_intervals(spark):
    import random

    dice = random.Random(2)
    rows = [(i, dice.randrange(2), lo, lo + dice.randrange(0, 40)) for i in range(80) for lo in [dice.randrange(200)]]
    df = spark.createDataFrame(rows, "i int, k int, lo long, hi long")
    got = sorted((r.i, r.r_i) for r in intervals.overlapping(df, df, ["k"]).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])


def test_offsets_of_a_frequent_key(spark):
    rows = spark.range(1000).select((F.col("id") % 10 > 0).alias("k"), "id", (F.col("id") % 7).alias("size"))
    got = {r.id: r.at for r in ordering.offsets(rows, ["k"], ["id"], "size", "at").collect()}
    sums = {True: 0, False: 0}
    for i in range(1000):
        assert got[i] == sums[i % 10 > 0]
        sums[i % 10 > 0] += i % 7
