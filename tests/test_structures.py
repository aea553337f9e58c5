"""Scans, trees, structural equality, ranges, boxes and the stream writer against plain loops, with odd input and hot keys."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import equality, joins, ranges, scans, spatial, trees
from quire.streaming import writer


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in many partitions, so that what crosses them is met."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def brackets(spark):
    dice = random.Random(1)
    # one key has most of the rows, so its blocks span partitions; one opens only, one closes only
    rows = [("hot", i, dice.choice([1, -1, 1, -1, 0, None])) for i in range(900)] + [("deep", i, 1 if i < 100 else -1) for i in range(200)]
    rows += [("open", i, 1) for i in range(5)] + [("shut", i, -1) for i in range(5)] + [(None, 0, 1), (None, 1, 0), (None, 2, -1), ("one", 0, None)]
    return rows, spark.createDataFrame(rows, "g string, i long, s int").repartition(9)


def plain_blocks(rows):
    out, stacks = [], collections.defaultdict(list)
    for g, i, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if s == 1:
            stacks[g].append(i)
        elif s == -1 and stacks[g]:
            out.append((g, len(stacks[g]), stacks[g].pop(), i))
    return out


def test_balanced_blocks_across_partitions(brackets):
    rows, df = brackets
    want = plain_blocks(rows)
    got = [(r.g, r.level, r.begin.i, r.end.i) for r in scans.blocks(df, ["g"], ["i"], "s").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(r[1] for r in got) >= 100
    cover = lambda g, i: sum(a == g and b <= i <= e for a, _, b, e in want)
    left = [(r.g, r.i, r.s) for r in scans.without_blocks(df, ["g"], ["i"], "s").collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if not cover(r[0], r[1])], key=str)
    ends = {(g, x) for g, _, b, e in want for x in (b, e)}
    flat = [(r.g, r.i, r.level) for r in scans.flattened(df, ["g"], ["i"], "s").collect()]
    assert sorted(flat, key=str) == sorted([(g, i, cover(g, i)) for g, i, _ in rows if (g, i) not in ends], key=str)


def test_scans_carry_over_partitions(brackets, spark):
    rows, df = brackets
    total, last, run = collections.Counter(), {}, collections.Counter()
    want, known, runs = [], [], collections.Counter()
    before = {}
    for g, i, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total[g] += s or 0
        last[g] = s if s is not None else last.get(g)
        if g not in before or before[g] != s:
            run[g] += 1
        before[g] = s
        runs[g, run[g], s] += 1
        want.append((g, i, total[g]))
        known.append((g, i, last[g]))
    assert sorted(((r.g, r.i, r.t) for r in scans.running(df, ["g"], ["i"], "s", "t").collect()), key=str) == sorted(want, key=str)
    assert sorted(((r.g, r.i, r.t) for r in scans.last_known(df, ["g"], ["i"], "s", "t").collect()), key=str) == sorted(known, key=str)
    assert {(r.g, r.run, r.s): r.n for r in scans.runs(df, ["g"], ["i"], "s").collect()} == runs
    none = df.limit(0)
    assert not scans.blocks(none, ["g"], ["i"], "s").collect() and not scans.runs(none, ["g"], ["i"], "s").collect()


def plain_tree(rows):
    """(depth, total, place, inherited) by recursion, None at loops."""
    parent = {n: p for n, p, *_ in rows}
    parent = {n: p if p in parent and p != n else None for n, p in parent.items()}
    children = collections.defaultdict(list)
    for n, _, o, *_ in rows:
        children[parent[n]].append((o, n))
    value, out, place = {n: v for n, _, _, v in rows}, {}, 0
    stack = [(n, 0, None) for _, n in sorted(children[None], reverse=True)]
    order = []
    while stack:
        n, depth, near = stack.pop()
        near = value[n] if value[n] is not None else near
        out[n] = [depth, 1, place, near]
        order.append(n)
        place += 1
        stack += [(c, depth + 1, near) for _, c in sorted(children[n], reverse=True)]
    for n in reversed(order):
        if parent[n] is not None:
            out[parent[n]][1] += out[n][1]
    return out


def test_trees_of_any_depth_and_width(spark):
    dice = random.Random(2)
    rows = [(i, i - 1 if i else None, 0, "v" if i in (7, 4000) else None) for i in range(5000)]  # a chain
    rows += [(10_000 + i, 10_000 if i else None, -i, "w" if i == 3 else None) for i in range(3000)]  # a wide node
    rows += [(20_000 + i, 20_000 + dice.randrange(i) if i else None, dice.randrange(5), dice.choice(["x", None])) for i in range(500)]
    rows += [(30_000, 99_999, 1, None), (30_001, 30_001, 1, "self"), (40_000, 40_001, 0, "l"), (40_001, 40_000, 0, None), (40_002, 40_000, 0, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "node long, parent long, ord long, v string, one long")
    got = {r.node: [r.depth, r.total_one, r.place, r.near_v] for r in trees.in_order(df, "one", "place", ["v"]).collect()}
    want = plain_tree(rows)
    assert {n: r for n, r in got.items() if n < 40_000} == want
    assert {n for n, r in got.items() if r[0] is None and r[2] is None} == {40_000, 40_001, 40_002}


def test_places_of_leaves(spark):
    dice = random.Random(3)
    rows = [(i, dice.randrange(max(0, i - 6), i) if i else None, dice.randrange(3)) for i in range(120)]
    inner = {p for _, p, _ in rows}
    df = spark.createDataFrame([(*r, int(r[0] not in inner)) for r in rows], "node long, parent long, ord long, leaf long")
    places = {r.node: r.place for r in trees.in_order(df, "leaf", "place").filter("leaf = 1").collect()}
    assert sorted(places.values()) == list(range(len(places)))
    for n, p in list(places.items())[:3]:
        assert [r.node for r in trees.leaf_at(df, "leaf", p).collect()] == [n] and [r.place for r in trees.place_of(df, "leaf", n).collect()] == [p]
    assert not trees.leaf_at(df, "leaf", len(places)).collect() and not trees.place_of(df, "leaf", 999).collect() and not trees.upward(df.limit(0), ["leaf"]).collect()


def test_outline_counts(spark):
    dice = random.Random(4)
    rows = [(i, dice.randrange(i) if i else None, 0, dice.random() < 0.6) for i in range(300)]
    children, is_open = collections.defaultdict(list), {n: o for n, _, _, o in rows}
    for n, p, *_ in rows:
        children[p].append(n)
    seen = lambda n: sum(1 + (seen(c) if is_open[c] else 0) for c in children[n])
    df = spark.createDataFrame(rows, "node long, parent long, ord long, open boolean")
    assert {r.node: r.shown for r in trees.shown_counts(df, "open").collect()} == {n: seen(n) if is_open[n] else -seen(n) for n in is_open}


def plain_classes(nodes, edges):
    out = collections.defaultdict(list)
    for s, label, d in edges:
        out[s].append((label, d))
    cls = {n: repr(c) for n, c in nodes}
    while True:
        sign = {n: (cls[n], tuple(sorted((repr(label), cls.get(d, "")) for label, d in out[n]))) for n in cls}
        names = {s: repr(i) for i, s in enumerate(sorted(set(sign.values())))}
        new = {n: names[s] for n, s in sign.items()}
        if len(set(new.values())) == len(set(cls.values())):
            groups = collections.defaultdict(list)
            for n, c in new.items():
                groups[c].append(n)
            return {n: min(groups[c]) for n, c in new.items()}
        cls = new


@pytest.mark.parametrize("collide", [False, True])
def test_structural_equality_with_loops_and_hubs(spark, monkeypatch, collide):
    dice = random.Random(5)
    nodes = [(i, dice.choice(["a", "a", "b", None])) for i in range(160)]
    edges = [(dice.randrange(160), dice.choice(["x", "y", None]), dice.randrange(170)) for _ in range(150)]
    for a, b, c, d in ((200, 201, 202, 203), (210, 211, 212, 213)):  # two equal rings, and one that differs
        nodes += [(x, "ring") for x in (a, b, c, d)]
        edges += [(a, "n", b), (b, "n", c), (c, "n", d), (d, "n", a)]
    nodes += [(220 + i, "ring") for i in range(3)] + [(300, "hub"), (301, "hub"), (302, "hub")]
    edges += [(220, "n", 221), (221, "n", 222), (300, "h", 0)] + [(h, "h", i % 160) for h in (300, 301, 302) for i in range(700)]
    edges += [(301, "h", 0)]
    if collide:  # sums that never differ: only the references themselves part objects
        monkeypatch.setattr(equality, "_hash", lambda seed, *c: F.lit(0).cast("decimal(20,0)"))
    got = equality.structural_classes(spark.createDataFrame(nodes, "node long, content string"), spark.createDataFrame(edges, "src long, label string, dst long"))
    want = plain_classes(nodes, edges)
    assert {r.node: r["class"] for r in got.collect()} == want and want[213] == 200 and want[301] == 300 and want[302] == 302


def test_ranges_and_their_inverse(spark):
    dice = random.Random(6)
    known = [(g, n, lo, lo + dice.choice([0, 3, 60, 500]), dice.randint(0, 1000)) for g in "ab" for n, lo in enumerate(dice.randint(0, 300) for _ in range(50))]
    maps = spark.createDataFrame(known, "g string, nth long, lo long, hi long, first long")
    codes = [(i, "a" if i % 3 else dice.choice("bc"), dice.choice([None, *range(-5, 900)])) for i in range(900)]
    rows = spark.createDataFrame(codes, "id long, g string, code long")
    held = lambda g, x: [(n, f + x - lo) for a, n, lo, hi, f in known if a == g and x is not None and lo <= x <= hi]
    assert {r.id: r.cid for r in ranges.lookup(rows, maps, ["g"], "code", "cid").collect()} == {i: max(held(g, x), default=(0, 0))[1] for i, g, x in codes}
    back = lambda g, v: [(n, lo + v - f) for a, n, lo, hi, f in known if a == g and v is not None and f <= v <= f + hi - lo]
    assert {r.id: r.x for r in ranges.lookup(rows, ranges.reverse(maps, ["g"]), ["g"], "code", "x").collect()} == {i: min(back(g, v), default=(0, 0))[1] for i, g, v in codes}
    assert {r.cid for r in ranges.lookup(rows, maps.limit(0), ["g"], "code", "cid").collect()} == {0}


def test_points_in_boxes_and_polygons(spark):
    dice = random.Random(7)
    boxes = [(i, x, x + dice.choice([0.0, 1.0, 5.0, 300.0]), y, y + dice.choice([0.0, 2.0, 40.0])) for i in range(150) for x, y in [(dice.randint(-50, 50) * 1.0, dice.randint(-50, 50) * 1.0)]]
    boxes += [(900, 5.0, 4.0, 0.0, 1.0), (901, None, 4.0, 0.0, 1.0), (902, -1e6, 1e6, -1e6, 1e6)]
    points = [(i, dice.randint(-60, 60) * 1.0, dice.randint(-60, 60) * 1.0) for i in range(400)] + [(1000, None, 1.0)]
    b, p = spark.createDataFrame(boxes, "o long, x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame(points, "id long, x double, y double")
    holds = lambda x, y: [o for o, x0, x1, y0, y1 in boxes if None not in (x, x0) and x0 <= x <= x1 and y0 <= y <= y1]
    assert sorted((r.id, r.b_o) for r in spatial.boxes_at(p, b).collect()) == sorted((i, o) for i, x, y in points for o in holds(x, y))
    assert {r.id: r.o for r in spatial.topmost(p, b, ["id"], "o").collect()} == {i: max(holds(x, y), default=None) for i, x, y in points}
    corners = {n: [(dice.uniform(-60, 60), dice.uniform(-60, 60)) for _ in range(dice.randint(3, 7))] for n in range(12)}
    sides = [(n, *a, *c) for n, v in corners.items() for a, c in zip(v, v[1:] + v[:1], strict=True)]
    inside = lambda x, y, v: sum(((y < a[1]) != (y < c[1])) and x < a[0] + (y - a[1]) * (c[0] - a[0]) / (c[1] - a[1]) for a, c in zip(v, v[1:] + v[:1], strict=True)) % 2 == 1
    got = spatial.in_polygons(p, spark.createDataFrame(sides, "polygon long, ax double, ay double, bx double, by double"), ["id"])
    assert sorted((r.id, r.polygon) for r in got.collect()) == sorted((i, n) for i, x, y in points if x is not None for n, v in corners.items() if inside(x, y, v))


def test_groups_of_a_heavy_key(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    assert {(r.id, r.least) for r in joins.with_group(rows, groups, "k", "n").collect()} == {(i, 0 if i < 2000 else i) for i in range(3000)}


@pytest.mark.parametrize("files", [1, 3, 100])
def test_the_stream_writer_is_the_batch_whatever_the_cut(spark, tmp_path, files):
    dice = random.Random(8)
    parts = [[(i * 20 + k, dice.randint(0, 90)) for k in range(20)] for i in range(6)]
    parts[3] += parts[0][:5] + parts[3][:2]  # ids that come again
    source, folder = tmp_path / "in", f"file://{tmp_path}/out"

    def arrive(numbers):
        for n in numbers:
            spark.createDataFrame(parts[n], "id long, size long").coalesce(1).write.mode("append").parquet(f"file://{source}/p{n}")
            for f in (source / f"p{n}").iterdir():
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))

    def go():
        stream = spark.readStream.schema("id long, size long").option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"file://{source}")
        writer.write_stream(stream, folder, 10).awaitTermination()

    source.mkdir()
    arrive([0, 1, 2])
    go()
    go()  # nothing new
    arrive([3, 4, 5])
    go()
    want, at, sizes = {}, 10, {}
    for part in ([parts[0] + parts[1] + parts[2], parts[3] + parts[4] + parts[5]] if files == 100 else parts if files == 1 else [sum(parts[:3], []), sum(parts[3:], [])]):
        for i, s in sorted(part):
            sizes.setdefault(i, s)
    for i in sorted(sizes):
        want[i] = (sizes[i], at)
        at += sizes[i]
    assert {r.id: (r["size"], r.byte_offset) for r in writer.finish(spark, folder).collect()} == want


def test_a_repeated_micro_batch_writes_the_same(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, 5), (2, 6)], "id long, size long").coalesce(1).write.parquet(f"file://{source}/a")
    read = lambda: spark.readStream.schema("id long, size long").option("recursiveFileLookup", "true").parquet(f"file://{source}")
    writer.write_stream(read(), f"file://{folder}").awaitTermination()
    before = sorted(map(tuple, writer.finish(spark, f"file://{folder}").collect()))
    for f in (folder / "checkpoint" / "commits").glob("*0"):  # the batch wrote, and stopped before it was marked as done
        f.unlink()
    for f in (folder / "checkpoint" / "commits").glob(".*"):
        f.unlink()
    writer.write_stream(read(), f"file://{folder}").awaitTermination()
    assert sorted(map(tuple, writer.finish(spark, f"file://{folder}").collect())) == before == [(1, 5, 0, 0), (2, 6, 5, 0)]
    assert not writer.finish(spark, f"file://{tmp_path}/none").collect()


def test_a_hot_user_is_spread(spark):
    """The scans' windows never hold all rows of one key: their partitioning has the written partition in it."""
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") % 7).alias("s"))
    parts = scans.placed(df, ["g"], ["i"]).groupBy("quire_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2500


def test_patterns_across_partitions(spark):
    import re

    from quire.operators import patterns

    dice = random.Random(9)
    rows = [("hot", i, dice.choice("vvscccpe")) for i in range(1500)] + [("b", i, x) for i, x in enumerate("vvsccpp")] + [(None, 0, "v"), (None, 1, "c"), (None, 2, "p"), ("n", 0, None)]
    automaton = {(s, "v"): (1, True) for s in range(5)} | {(1, "s"): (2, False), (1, "c"): (3, False), (2, "c"): (3, False), (3, "c"): (3, False), (3, "p"): (4, False)}
    df = spark.createDataFrame(rows, "g string, i long, x string").repartition(8)
    want = []
    for g in ("hot", "b", None, "n"):
        text = "".join(x or "-" for a, _, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]))
        want += [(g, m.start(), m.end() - 1, m.end() - m.start()) for m in re.finditer("vs?c+p", text)]
    got = [(r.g, r.begin.i, r.end.i, r.n) for r in patterns.matches(df, ["g"], ["i"], "x", automaton, {4}).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20
    assert not patterns.matches(df.limit(0), ["g"], ["i"], "x", automaton, {4}).collect()


def test_tables_with_spans(spark):
    from quire.operators import layout

    cells = [("t", 0, 0, 1, 2, 3.0, 1.0, 2.0, 5.0), ("t", 1, 0, 1, 1, 1.0, None, 1.0, 4.0), ("t", 1, 1, 1, 1, 2.0, 1.0, 4.0, 0.0)]
    df = spark.createDataFrame(cells, "k string, row int, col int, row_span int, col_span int, top double, bottom double, left double, right double")
    got = {(r.side, r.row, r.col): (r.width, r.own_row, r.own_col) for r in layout.collapsed_borders(df, ["k"]).collect()}
    assert got[("h", 1, 0)] == (1.0, 0, 0) and got[("h", 1, 1)] == (2.0, 1, 1)  # of equal ones the cell above; the wider one
    assert got[("v", 1, 1)] == (4.0, 1, 0) and ("v", 0, 1) not in got and got[("h", 2, 0)] == (0.0, 1, 0)
    spans = [("t", 0, 1, 10.0), ("t", 0, 2, 50.0), ("t", 1, 2, 5.0), ("t", 2, 1, 7.0), ("t", 0, 1, None), ("u", 0, 3, 30.0), ("hot", 0, 1, 1.0)] + [("hot", 0, 1, float(i % 9)) for i in range(500)]
    ends = {(r.k, r.col): r.place for r in layout.column_ends(spark.createDataFrame(spans, "k string, col int, col_span int, least double"), ["k"]).collect()}
    assert ends == {("t", 0): 10.0, ("t", 1): 50.0, ("t", 2): 57.0, ("u", 0): 0.0, ("u", 1): 0.0, ("u", 2): 30.0, ("hot", 0): 8.0}


def test_inserted_rows_and_imported_graphs(spark):
    from quire.operators import graphs, ordering

    rows = spark.createDataFrame([("a", i) for i in range(5)] + [(None, 0)], "k string, i long")
    extra = spark.createDataFrame([("a", 100, 2), ("a", 90, 2), ("a", 80, 0), ("a", 70, 99), ("z", 60, 5)], "k string, i long, spot int")
    got = sorted(((r.k or "", r.place, r.i) for r in ordering.inserted(rows, extra, ["k"], "i", "spot", "place").collect()))
    assert got == [("", 0, 0), ("a", 0, 80), ("a", 1, 0), ("a", 2, 1), ("a", 3, 90), ("a", 4, 100), ("a", 5, 2), ("a", 6, 3), ("a", 7, 4), ("a", 8, 70), ("z", 0, 60)]
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "node long")
    edges = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "back", 1), (2, "gone", 77), (2, "old", 9), (9, "a", 5), (4, "a", 1)], "src long, label string, dst long")
    ids, links = graphs.imported(nodes, edges, spark.createDataFrame([(1,), (88,)], "node long"), 10, spark.createDataFrame([(9, 4)], "node long, new_id long"))
    assert {(r.node, r.new_id) for r in ids.collect()} == {(1, 11), (2, 12), (3, 13)}
    assert sorted(map(tuple, links.collect()), key=str) == sorted([(11, "a", 12), (12, "a", 13), (13, "back", 11), (12, "gone", None), (12, "old", 4)], key=str)


def test_intervals_of_very_unlike_lengths(spark):
    from quire.operators import intervals

    dice = random.Random(10)
    rows = [(i, lo, lo + dice.choice([1, 2, 10, 100_000, 10_000_000])) for i in range(120) for lo in [dice.randrange(-500, 500)]] + [(900, None, 3), (901, 5, 5)]
    df = spark.createDataFrame(rows, "i int, lo long, hi long").withColumn("k", F.lit(1))
    got = sorted((r.i, r.r_i) for r in intervals.overlapping(df, df, ["k"]).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if None not in (a[1], b[1]) and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2])


def test_linked_boxes(spark):
    from quire.operators import flow

    dice = random.Random(5)
    # one text holds nearly all words; one is shorter than its boxes, one longer, one has no box and one chain no text
    texts = {"hot": [dice.choice([1, 2, 3, 5, 8, 40, None, -3]) for _ in range(1500)], "short": [4, 4, 4], "long": [3] * 100, "lost": [1, 2]}
    chains = {"hot": [(b, 10 if b < 30 else 17 if b < 45 else 10, dice.choice([0, 1, 2, 9])) for b in range(60)] + [(60, 13, 1000)], "short": [(1, 9, 1), (2, 9, 5), (3, 2, 5)], "long": [(5, 7, 2), (7, 15, 1), (9, None, 4), (11, 7, 1)], "empty": [(1, 5, 5)]}
    words = [(k, i, w, "x") for k, t in texts.items() for i, w in enumerate(t)]
    dice.shuffle(words)
    want = []
    for k, chain in chains.items():
        at, sizes = 0, [max(0, w or 0) for w in texts.get(k, [])]
        for box, width, lines in chain:
            for line in range(lines if width is not None else 0):
                if at >= len(sizes):
                    break
                n, room = 1, sizes[at]
                while at + n < len(sizes) and room + 1 + sizes[at + n] <= width:
                    room, n = room + 1 + sizes[at + n], n + 1
                want.append((k, box, line, at, n))
                at += n
    df = spark.createDataFrame(words, "k string, i long, size long, line string").repartition(7)
    boxes = spark.createDataFrame([(k, *b) for k, c in chains.items() for b in c], "k string, box long, box_width long, lines long")
    got = [tuple(r) for r in flow.linked_boxes(df, boxes, ["k"], ["i"], "size", 1).select("k", "box", "line", "first", "words").collect()]
    assert sorted(got) == sorted(want) and len({r[1] for r in want if r[0] == "hot"}) > 40
    assert flow.linked_boxes(df.limit(0), boxes, ["k"], ["i"], "size", 1).isEmpty() and flow.linked_boxes(df, boxes.limit(0), ["k"], ["i"], "size", 1).isEmpty()


def test_rounds_over_linked_boxes_hold_few_rows(spark, monkeypatch):
    from quire.operators import flow

    dice = random.Random(6)
    texts = {k: [dice.choice([1, 2, 3, 9]) for _ in range(n)] for k, n in ((1, 4000), (2, 64), (3, 65))}
    # lines of many words, also of more than a block, and stretches that end within a block and at its end
    chains = {1: [(1, 12, 300), (2, 30, 1), (3, 500, 2), (4, 3, 40), (5, 12, 900)], 2: [(1, 2, 100)], 3: [(1, 1, 64), (2, 20, 3)]}
    want = []
    for k, chain in chains.items():
        at, sizes = 0, texts[k]
        for box, width, lines in chain:
            for line in range(lines):
                if at >= len(sizes):
                    break
                n, room = 1, sizes[at]
                while at + n < len(sizes) and room + 1 + sizes[at + n] <= width:
                    room, n = room + 1 + sizes[at + n], n + 1
                want.append((k, box, line, at, n))
                at += n
    words = spark.createDataFrame([(k, i, w) for k, t in texts.items() for i, w in enumerate(t)], "k long, i long, size long").repartition(3)
    boxes = spark.createDataFrame([(k, *b) for k, c in chains.items() for b in c], "k long, box long, box_width long, lines long")
    monkeypatch.setattr(flow, "BLOCK", 64, raising=False)
    written, cut = [], flow.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(flow, "cut", counted)
    got = [tuple(r) for r in flow.linked_boxes(words, boxes, ["k"], ["i"], "size", 1).select("k", "box", "line", "first", "words").collect()]
    assert sorted(got) == sorted(want)
    # the words, and the next line of each of them: no round writes them again
    assert sum(n >= 4000 for n in written) == 2


def plain_boxes(pixels, colours):
    """Boxes as lists of cells: the one that varies most is cut where the halves vary least."""
    cells = collections.defaultdict(list)
    for p in pixels:
        cells[tuple(c >> 1 for c in p)].append(p)
    spread = lambda some: sum(float(sum(q[c] for q in some)) ** 2 for c in range(3)) / len(some)
    within = lambda box: [q for cell in box for q in cells[cell]]
    boxes = [sorted(cells)]
    while len(boxes) < colours:
        varied = [(sum(c * c for q in within(b) for c in q) - spread(within(b)), -i) for i, b in enumerate(boxes) if len(b) > 1]
        if not varied or max(varied)[0] <= 0:
            break
        i = -max(varied)[1]
        cuts = [(spread(within([c for c in boxes[i] if c[a] <= at])) + spread(within([c for c in boxes[i] if c[a] > at])), -a, -at) for a in range(3) for at in sorted({c[a] for c in boxes[i]})[:-1]]
        _, a, at = max(cuts)
        a, at = -a, -at
        boxes.append([c for c in boxes[i] if c[a] > at])
        boxes[i] = [c for c in boxes[i] if c[a] <= at]
    return {cell: i for i, b in enumerate(boxes) for cell in b}


def test_coloured_boxes(spark):
    from quire.operators import images

    dice = random.Random(8)
    some = {"hot": [tuple(min(255, max(0, int(dice.gauss(m, 9)))) for m in dice.choice([(20, 200, 90), (120, 40, 240), (250, 250, 0)])) for _ in range(700)]}
    # ties on all axes, two cells only, one cell, one colour many times
    some |= {None: [(0, 0, 0), (0, 0, 200), (0, 200, 0), (200, 0, 0), (200, 200, 200)], "two": [(0, 0, 0), (9, 9, 9)] * 3, "one": [(4, 4, 4), (5, 5, 5)], "same": [(7, 8, 9)] * 20}
    rows = [(k, *p) for k, ps in some.items() for p in ps] + [("hot", None, 1, 2), ("gone", 1, 2, None)]
    df = spark.createDataFrame(rows, "k string, r int, g int, b int").repartition(5)
    found = images.coloured_boxes(df, ["k"], 6).collect()
    want = {(k, *cell): box for k, ps in some.items() for cell, box in plain_boxes(ps, 6).items()}
    assert {(r.k, r.cell_r, r.cell_g, r.cell_b): r.box for r in found} == want and len(found) == len(want)
    colours = {(r.k, r.box): (r.n, r.r, r.g, r.b) for r in images.palette(images.coloured_boxes(df, ["k"], 1), ["k"]).collect()}
    assert colours[("one", 0)] == (2, 4, 4, 4) and colours[("same", 0)] == (20, 7, 8, 9) and len(colours) == 5
    assert images.coloured_boxes(df.limit(0), ["k"], 4).isEmpty()


def test_codes_with_lengths_and_undefined_ranges(spark):
    shape = "len int, nth long, lo long, hi long, first long"
    known = spark.createDataFrame([(1, 1, 10, 20, 0), (1, 2, 15, 16, 500), (2, 3, 10, 10, 7)], shape)
    undefined = spark.createDataFrame([(1, 1, 0, 99, 3), (1, 2, 30, 40, 9)], shape)
    codes = spark.createDataFrame([(1, 10), (1, 12), (1, 15), (1, 16), (1, 21), (1, 35), (1, 100), (1, None), (2, 10), (2, 12), (3, 10)] + [(1, 35)] * 300, "len int, code long").repartition(6)
    got = {tuple(r) for r in ranges.coded(codes, known, undefined, ["len"], "code", "cid").collect()}
    assert got == {(1, 10, 0), (1, 12, 2), (1, 15, 500), (1, 16, 501), (1, 21, 3), (1, 35, 9), (1, 100, 0), (1, None, 0), (2, 10, 7), (2, 12, 0), (3, 10, 0)}
    assert ranges.coded(codes, known.limit(0), undefined.limit(0), ["len"], "code", "cid").filter("cid <> 0").isEmpty()


def test_topmost_makes_no_pairs(spark, monkeypatch):
    """Boxes that all lie on each other, some of one shape, and points that stand on borders: none of the pairs is made."""
    dice = random.Random(11)
    boxes = [(i, -dice.randint(1, 40) * 0.5, dice.randint(1, 40) * 0.5, -dice.randint(1, 9) * 1.0, dice.randint(1, 9) * 1.0) for i in range(400)] + [(900, 1.0, -1.0, 0.0, 1.0), (901, None, 1.0, 0.0, 1.0)]
    points = [(i, dice.choice([0.0, -0.0, 0.5, 3.0, -7.5, 19.9, 20.0, 20.1]), dice.choice([0.0, 9.0, -9.0, 8.5, 9.5])) for i in range(300)] + [(300, None, 1.0), (301, 1.0, None)]
    monkeypatch.setattr(spatial, "boxes_at", None)
    got = spatial.topmost(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(boxes, "o long, x0 double, x1 double, y0 double, y1 double"), ["id"], "o")
    holds = lambda x, y: [o for o, x0, x1, y0, y1 in boxes if None not in (x, y, x0) and x0 <= x <= x1 and y0 <= y <= y1]
    assert {r.id: r.o for r in got.collect()} == {i: max(holds(x, y), default=None) for i, x, y in points}


@pytest.mark.parametrize("most", [4, 1000])
def test_polygons_meet_points_once(spark, monkeypatch, most):
    """A point that comes twice is one; polygons of many sides are found too. Sides make no pairs with points where a polygon is small."""
    dice = random.Random(12)
    corners = {n: [(dice.uniform(-60, 60), dice.uniform(-60, 60)) for _ in range(3 + n % 4)] for n in range(12)}
    sides = [(n, *a, *c) for n, v in corners.items() for a, c in zip(v, v[1:] + v[:1], strict=True)]
    points = [(i, dice.uniform(-60, 60), dice.uniform(-60, 60)) for i in range(120)] * 2 + [(1000, None, 1.0)]
    monkeypatch.setattr(spatial, "SIDES", most)
    got = spatial.in_polygons(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(sides, "polygon long, ax double, ay double, bx double, by double"), ["id"])
    inside = lambda x, y, v: sum(((y < a[1]) != (y < c[1])) and x < a[0] + (y - a[1]) * (c[0] - a[0]) / (c[1] - a[1]) for a, c in zip(v, v[1:] + v[:1], strict=True)) % 2 == 1
    assert sorted((r.id, r.polygon) for r in got.collect()) == sorted({(i, n) for i, x, y in points if x is not None for n, v in corners.items() if inside(x, y, v)})


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """A partition of a scan holds a bounded number of rows, whatever the session's number of partitions; a key that spans many of them is carried on, and short ones between are not."""
    from quire.operators import parts

    monkeypatch.setattr(parts, "ROWS", 100)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 2 > 0, None).otherwise(F.col("id")).alias("g"), F.col("id").alias("i"), F.when(F.col("id") % 50 < 3, F.col("id")).alias("v"))
    assert scans.placed(df, ["g"], ["i"]).groupBy("quire_part").count().filter("count < 400").count() >= 25
    rows, want, total, last, before = sorted(((r.g, r.i, r.v) for r in df.collect()), key=lambda r: (r[0] or -1, r[1])), {}, collections.Counter(), {}, {}
    for g, i, v in rows:
        total[g] += v or 0
        last[g] = v if v is not None else last.get(g)
        want[i] = (total[g], last[g], before.get(g))
        before[g] = i
    found = scans.shifted(scans.last_known(scans.running(df, ["g"], ["i"], "v", "t"), ["g"], ["i"], "v", "l"), ["g"], ["i"], "i", "b")
    assert {r.i: (r.t, r.l, r.b) for r in found.collect()} == want


def test_lists_are_not_broadcast(spark, monkeypatch):
    from quire.operators import graphs

    plans, own = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df))
    rows = spark.createDataFrame([(i, i + 1 if i % 40 < 39 else None) for i in range(200)], "node long, following long")
    assert {r.node: r.to_end for r in graphs.list_places(rows, "node", "following").collect()} == {i: 39 - i % 40 for i in range(200)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_borders_in_partitions_that_grow_with_the_cells(spark, monkeypatch):
    from quire.operators import layout

    monkeypatch.setattr(layout, "ROWS", 2)
    df = spark.createDataFrame([("t", i, 0, 1, 1, 1.0 * i, 0.5, 2.0, 3.0) for i in range(40)], "k string, row int, col int, row_span int, col_span int, top double, bottom double, left double, right double")
    got = layout.collapsed_borders(df, ["k"])
    assert got.rdd.getNumPartitions() == 20 and got.count() == 41 + 80


def test_what_all_refer_to_is_broadcast(spark, monkeypatch):
    """References that repeat are counted before the rounds; targets meet them as heavy keys do. A reference to nothing or to null is one to nothing."""
    met, own = [], equality.with_group
    monkeypatch.setattr(equality, "with_group", lambda rows, groups, key, count: met.append(key) or own(rows, groups, key, count))
    nodes = [(i, "leaf" if i < 3 else "node") for i in range(60)]
    edges = [(i, "x", i % 3) for i in range(3, 60) for _ in range(1 + i % 2)] + [(3, "y", None), (6, "y", 999), (9, "y", None), (9, "y", 998)]
    got = equality.structural_classes(spark.createDataFrame(nodes, "node long, content string"), spark.createDataFrame(edges, "src long, label string, dst long"))
    assert {r.node: r["class"] for r in got.collect()} == plain_classes(nodes, edges) and "dst" in met


def test_only_references_to_what_got_a_new_class_are_looked_at_again(spark, monkeypatch):
    """The rounds by hashes end by themselves, over long chains and hubs too; a round leaves out references to what no longer changes."""
    met, own = [], equality.with_group
    monkeypatch.setattr(equality, "with_group", lambda rows, groups, key, count: (key == "dst" and met.append(groups.count())) or own(rows, groups, key, count))
    monkeypatch.setattr(equality, "_compared", lambda nodes, links: pytest.fail("hashes met"), raising=False)
    monkeypatch.setattr(equality, "SALTS", 4, raising=False)
    nodes = [(i, "leaf" if i < 10 else "middle" if i < 50 else "top") for i in range(80)]
    edges = [(i, "x", i % 7) for i in range(10, 50) for _ in range(1 + i % 2)] + [(i, "y", 10 + j) for i in range(50, 80) for j in range(i % 5, 40)]
    made = lambda n, e: equality.structural_classes(spark.createDataFrame(n, "node long, content string"), spark.createDataFrame(e, "src long, label string, dst long"))
    assert {r.node: r["class"] for r in made(nodes, edges).collect()} == plain_classes(nodes, edges)
    assert met == [47, 40, 47]  # all that is referred to, then the middle alone, and all once more to compare
    chains = [(i, "link") for i in range(24)]
    follows = [(i, "n", i + 1) for i in range(23) if i != 11] + [(11, "n", None), (23, "n", 99)]
    assert {r.node: r["class"] for r in made(chains, follows).collect()} == plain_classes(chains, follows) == {i: i % 12 for i in range(24)}


def test_hashes_that_sometimes_meet_are_found_out(spark, monkeypatch):
    taken, own = [], equality._compared
    monkeypatch.setattr(equality, "_compared", lambda nodes, links: taken.append(1) or own(nodes, links))
    monkeypatch.setattr(equality, "_hash", lambda seed, *c: F.when(F.xxhash64(*c) % 2 == 0, 1).otherwise(2).cast("long"))
    nodes = [(i, "leaf" if i < 20 else "node") for i in range(120)]
    edges = [(i, "x", i * i % 19 if i % 2 else i % 5) for i in range(20, 120)] + [(i, "y", i - 20) for i in range(40, 120)]
    nodes = [(i, f"{c}{i}" if i < 20 else c) for i, c in nodes]
    got = equality.structural_classes(spark.createDataFrame(nodes, "node long, content string"), spark.createDataFrame(edges, "src long, label string, dst long"))
    assert {r.node: r["class"] for r in got.collect()} == plain_classes(nodes, edges) and taken == [1]
