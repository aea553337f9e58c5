"""The operators on small tables with nulls, empty texts, ties, repeated rows, and against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import exact_dedup, graph, jaccard, mixing, near_vectors, packing, passages, quality, sharding, shared_words, suffixes, url_filter
from quire.llm.queries import tokenizer_path
from quire.llm.words import chunks, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long"
random.seed(5)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choice(WORDS) for _ in range(300))
TEXTS = [None, "", " \n", "Ab cd", "aB cd", "a", LONG, LONG, LONG.replace(" w1 ", " x ", 1), "É é", LONG + " tail", "x" * 900, "x" * 900 + "y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], (None, "z z z", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_differencing_is_balanced():
    sizes = np.random.default_rng(1).integers(1, 10_000, 2000)
    sums = np.zeros((2000, 7), np.int64)
    sums[:, 6] = sizes
    part = sharding.differencing(sums)[:, 6]
    loads = np.bincount(part, sizes, 7)
    assert loads.max() - loads.min() < 20


def test_sharding(docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == len(TEXTS) + 2 and not sharding.shard(none, 3).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r.doc_id in (6, 7)}) == 1
    assert {r.doc_id: r["size"] for r in rows}[0] == 8


def test_sharding_of_many_buckets(spark, monkeypatch):
    """Every column of the whole result, with a tree of partial partitions three levels high."""
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    dice = random.Random(12)
    texts = ["é" * dice.randint(0, 900) + str(i % 700) for i in range(1400)] + ["hot text " * 5] * 20 + [None] * 30 + [""] * 20
    data = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id")]
    rows = sharding.shard(spark.createDataFrame(data, "doc_id long, text string"), 5).collect()
    size, crc = (lambda t: len((t or "").encode()) + 8), (lambda t: zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == sorted(((i, size(t), crc(t)) for i, t in data), key=str)
    own, text, load, slots = collections.defaultdict(set), dict(data), collections.Counter(), collections.defaultdict(list)
    for r in rows:
        if r.doc_id not in (3, None):
            own[text[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(v) == 1 for v in own.values()) and set(load) == set(range(5))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) - min(load.values()) < 2000  # the sizes of one or two groups, of 1.3 million bytes; no group is larger than a share of its bucket


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: exact_dedup.F.unhex(exact_dedup.F.hex(exact_dedup.F.crc32(t.cast("binary")) % 2))])
def test_exact_dedup_also_with_colliding_digests(docs, digest):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    data = docs.collect()
    groups = collections.defaultdict(list)
    for r in data:
        groups[lower(r.text)].append(r.doc_id)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.exact_dedup(docs, digest).collect())
    best = lambda v: max((x for x in v if x is not None), default=None)
    assert got == sorted((str(r.doc_id), str(best(groups[lower(r.text)])), len(groups[lower(r.text)])) for r in data)


def test_exact_dedup_of_nothing(none):
    assert not exact_dedup.exact_dedup(none).collect()


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: exact_dedup.F.unhex(exact_dedup.F.hex(exact_dedup.F.octet_length(t) % 3))])
def test_exact_dedup_goes_on_from_call_to_call(spark, tmp_path, digest):
    chance, store = random.Random(5), str(tmp_path / "store")
    calls = [[(chance.choice([None, *range(40)]), chance.choice(["a", "A", "bb", "BB", "\u00c9", "\u00e9", None, "", "x" * 5000, "hot", "hot", "hot"])) for _ in range(n)] for n in (50, 0, 70)]
    lower, seen = (lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), collections.defaultdict(list)
    for data in calls:
        for i, t in data:
            seen[lower(t)].append(i)
        docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("place", exact_dedup.F.lit("other")).withColumn("body", exact_dedup.F.lit(1))
        rows = exact_dedup.exact_dedup(docs, digest, store).collect()
        best = {t: max((i for i in ids if i is not None), default=None) for t, ids in seen.items()}
        want = [(i, best[lower(t)], len(seen[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in data]
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    places = [r.place for r in spark.read.parquet(store + "/texts").select("place").collect()]
    assert len(set(places)) == len(places) == 120


def test_a_locator_leads_to_a_text_of_its_digest(spark, docs, tmp_path):
    texts, _ = exact_dedup.stored(docs, exact_dedup.sha256, str(tmp_path))
    state = exact_dedup.keyed_state(texts, str(tmp_path))
    found = state.join(texts.selectExpr("place", "digest AS there", "doc_id"), "place").collect()
    assert len(found) == state.count() and all(r.digest == r.there and r.doc_id == r.keep_id for r in found)


def test_url_rules(spark):
    rules = url_filter.make_rules(spark, [("com", "/a", "block"), ("x.com", "/ab", "allow")])
    urls = ["http://X.com/abc?q", "http://y.com/a#f", "http://com/b", None, "nothing", "http://xcom/a", "a://y.x.com/a"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.url_filter(pages, rules).collect())
    assert got == [(0, "x.com", "/abc", "x.com/ab", "allow")] * 2 + [(1, "y.com", "/a", "com/a", "block"), (2, "com", "/b", "", "allow"), (3, "", "", "", "allow"), (4, "", "", "", "allow"), (5, "xcom", "/a", "", "allow"), (6, "y.x.com", "/a", "com/a", "block")]
    assert url_filter.url_filter(pages, spark.createDataFrame([], url_filter.RULES)).count() == 8


def test_mix_meets_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert not mixing.mix(none).collect() and len(rows) == len(TEXTS) + 2
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == round(own[0].target) and all(r.taken <= 2 * r["size"] for r in own)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert mixing.take(docs).columns == docs.columns


def test_quality_learns(spark, none):
    good = [(i, " ".join(random.choice(WORDS) for _ in range(80)), "en", "s", 0, "", 0) for i in range(60)]
    bad = [(100 + i, "JUNK!! " * random.randint(5, 60), "en", "s", 0, "", 0) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (999, None, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 121 and all(got[i].predicted == (i < 100) for i in got if i != 999)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert quality.classify(none, labels).count() == 0 and {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("most", [500_000, 0])
def test_components_of_hubs_and_chains(spark, most):
    dice = random.Random(6)
    edges = [(500, x) for x in range(600, 900)] + [(x, x + 1) for x in range(100, 160)] + [(dice.randrange(1000, 1100), dice.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (600, 500)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        changed = False
        for a, b in edges:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
        if not changed:
            break
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
    assert got == {x: v for x, v in low.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert not graph.components(spark.createDataFrame([], "a long, b long"), most).collect()


def test_vectors_without_id_and_in_double_precision(spark, none):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_vectors(df.selectExpr("*", "1 AS cid", "2 AS copies", "3 AS block")).collect())
    assert got == [("2", 1, "2", True), ("3", 0, "3", True), ("None", 0, "None", True), ("None", 1, "2", False)]
    wide = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1e300, 1e299]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(wide).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    assert not near_vectors.near_vectors(df.limit(0)).collect()


def test_near_vectors_against_brute_force(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(40, 16))
    v = np.vstack([base, base[:30] + g.normal(size=(30, 16)) * 0.25, base[:5], base[:5] * 3]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0] * 4), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    low = np.arange(len(v))
    for _ in range(len(v)):
        low = np.array([min([low[i], *low[near[i]]]) for i in range(len(v))])
    for block in (4096, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows) and all(got[i] == (near[i].sum(), low[i]) for i in range(len(v)))
        assert all(got[i] == (0, i) for i in range(900, 906))


@pytest.mark.parametrize("block", [4096, 3])
def test_pairs_that_the_bounds_leave_open(spark, block):
    at = lambda cos: [float(cos), float(np.sqrt(1 - cos * cos)), 0.0]
    rows = [(0, [2.0, 0.0, 0.0]), *((i + 1, at(0.9 + d)) for i, d in enumerate((1e-9, -1e-9, 1e-4, -1e-4, 1e-3, -1e-3)))]
    rows += [(100 + i, [0.0, 0.0, 1.0]) for i in range(40)]  # copies beside them
    v = np.array([x for _, x in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df, block=block).collect()}
    assert got == {i: int(near[k].sum()) - 1 for k, (i, _) in enumerate(rows)} and got[0] == 3
    codes = near_vectors.quantise(near_vectors.units(v))
    assert any(len(r) for _, _, r, _ in near_vectors.bounded(codes, codes, 0.9, True))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [*TEXTS, "<|endoftext|> é ñ \u4e2d\u6587 \U0001f600  \n\n x's 12 ", "\u2028 a\u00a0b"]
    encode = packing.encoder(tokenizer_path())
    assert all(encode(x or "").tolist() == t.encode(x or "", add_special_tokens=False).ids for x in texts)
    for per_task in (20_000, 3):
        rows = packing.pack(docs, tokenizer_path(), capacity=64, per_task=per_task).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for v in by.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(v[-1]) <= 64
        assert sum(r.length for r in rows) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert not packing.pack(none, tokenizer_path()).collect()


def test_packing_of_null_ids_and_long_white_space(spark):
    from tokenizers import Tokenizer

    big = 1152921504606846977
    df = spark.createDataFrame([(big, "a b"), (None, "a b"), (7, " " * 1_000_000), (8, " ".join(["tail"] * 5000))], "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS bin", "3 AS offset")
    rows = packing.pack(df, tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in ((r.doc_id, r.text) for r in df.collect())}
    for i, ids in want.items():
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [x[0] for x in own] == list(range(len(own))) and sum(x[2] for x in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for _, a, n, crc in own) and all(n == 1024 for _, _, n, _ in own[1:])


def _best_fit_by_search(sizes, capacity):
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= size]
        at = min(fits, key=lambda i: (room[i], i)) if fits else len(room)
        room[at : at + 1] = [(room[at] if fits else capacity) - size]
    return len(room)


def test_best_fit_against_search_and_merged_bins(spark):
    dice = random.Random(8)
    for _ in range(20):
        sizes = [dice.randint(1, 64) for _ in range(dice.randint(0, 150))]
        where, offset = packing.best_fit(np.array(sizes, np.int64), 64)
        assert len(set(where.tolist())) == _best_fit_by_search(sizes, 64)
    df = spark.createDataFrame([(i, "a " * dice.randint(0, 40)) for i in range(400)], "doc_id long, text string")
    whole, split = ({r.sequence_id for r in packing.pack(df, tokenizer_path(), capacity=64, per_task=n).collect()} for n in (20_000, 25))
    assert len(split) <= 1.05 * len(whole) + 1


def test_passages(spark, none):
    shared = " ".join(_fresh(70, 90))
    docs = spark.createDataFrame([(1, " ".join([*_fresh(100, 91), shared, *_fresh(90, 92)])), (2, " ".join([shared, *_fresh(200, 93)])), (3, " ".join(_fresh(300, 94))), (4, None), (5, " ".join([*_fresh(120, 95), shared]))], "doc_id long, text string")
    rows = passages.near_passages(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 5} and len({r.component_id for r in rows}) == 1
    assert all(r.n_words >= 60 and r.similarity >= 0.8 for r in rows) and not passages.near_passages(none).collect()


def _check_passages(rows, texts):
    """Every row's similarity is the Jaccard index of what it reports, and no two rows of the same two documents report the same place twice."""
    gram = lambda doc, first, n: {tuple(w[i : i + 5]) for w in [texts[doc].split()[first : first + n]] for i in range(n - 4)}
    seen = collections.defaultdict(list)
    for r in rows:
        a, b = gram(r.doc_id, r.first_word, r.n_words), gram(r.near_doc_id, r.near_first_word, r.near_n_words)
        assert r.similarity == pytest.approx(len(a & b) / len(a | b), abs=1e-6) and r.similarity >= 0.8 and min(r.n_words, r.near_n_words) >= 50
        seen[r.doc_id, r.near_doc_id].append((r.first_word, r.first_word + r.n_words, r.near_first_word, r.near_first_word + r.near_n_words))
    for own in seen.values():
        assert not any(p is not q and p[0] < q[1] and q[0] < p[1] and p[2] < q[3] and q[2] < p[3] for p in own for q in own)
    return seen


@pytest.mark.parametrize("inserted", [0, 3, 6, 12])
def test_rows_of_passages_against_sets_of_shingles(spark, inserted):
    texts = {}
    for i in range(40):
        size = 50 + 12 * (i % 5)
        own = _fresh(size, 7000 + i)
        other = [*own[: size // 2], *_fresh(inserted, 7100 + i), *own[size // 2 :]]
        if i % 3 == 0:
            other[7] = "changed"
        texts |= {2 * i: " ".join([*_fresh(30 + i, 7200 + i), *own, *_fresh(25, 7300 + i)]), 2 * i + 1: " ".join([*_fresh(11, 7400 + i), *other, *_fresh(47, 7500 + i)])}
    texts |= {200: " ".join(_fresh(60, 1) * 4), 201: " ".join(_fresh(60, 1) * 2 + _fresh(30, 2)), 202: "x " * 400}
    rows = passages.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    seen = _check_passages(rows, texts)
    if not inserted:
        assert all((2 * i, 2 * i + 1) in seen and (2 * i + 1, 2 * i) in seen for i in range(40)) and all(len(v) == 1 for (a, b), v in seen.items() if a < 200)


def _test_tables():
    import pyarrow.parquet as pq

    return {i: t for i, t in zip(*(c.to_pylist() for c in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).columns), strict=True)}


def test_rows_of_passages_of_a_table(spark):
    texts = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t) for i, t in _test_tables().items()}
    rows = passages.near_passages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    _check_passages(rows, texts)
    grams = collections.defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    repeated = {i for ids in grams.values() if len(ids) > 1 for i in ids}
    assert repeated <= {r.doc_id for r in rows}


def _found(spark, texts):
    rows = passages.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    return {r.doc_id: r.component_id for r in rows}


def _fresh(n, seed):
    dice = random.Random(seed)
    return [f"v{dice.randrange(10**9)}" for _ in range(n)]


def _tokens(text):
    for _, _, data, bounds in chunks(pa.array([text])):
        hashed, _, _, wb = words(data, bounds)
        return shingles(hashed, wb, passages.SHINGLE)[0][: max(0, len(hashed) - passages.SHINGLE + 1)]
    return np.zeros(0, np.uint64)


def _nodes(t, seed):
    return passages.tree_nodes(t, np.ones(len(t), bool), np.zeros(len(t), np.int64), seed)[0]


def test_compact_windows_are_the_nodes_of_cartesian_trees():
    g = np.random.default_rng(1)
    for _ in range(60):
        sizes = g.integers(0, 120, int(g.integers(1, 5)))
        token, wb = g.integers(1, 1 << 62, sizes.sum()).astype(np.uint64), np.r_[0, np.cumsum(sizes)]
        row, whole, width = np.repeat(np.arange(len(sizes)), sizes), np.repeat(wb[1:], sizes) - np.arange(sizes.sum()) >= 5, int(g.integers(2, 20))
        rank = passages.mix(token ^ passages.SEEDS[0]) & ~np.uint64(0xFFFFFF) | np.arange(len(token), dtype=np.uint64)
        want = []
        for k in range(len(sizes)):
            for x in range(wb[k], max(wb[k], wb[k + 1] - 4)):
                i = j = x
                while i > wb[k] and rank[i - 1] > rank[x]:
                    i -= 1
                while j < wb[k + 1] - 5 and rank[j + 1] > rank[x]:
                    j += 1
                if j - i + 1 >= width:
                    want.append((x, i, j))
        assert list(zip(*(x.tolist() for x in passages.tree_nodes(token, whole, row, passages.SEEDS[0], width)))) == want


def test_agreement_of_windows():
    g = np.random.default_rng(4)
    fresh = lambda n: g.integers(1, 1 << 62, n).astype(np.uint64)
    at = lambda *x: [np.array([v]) for v in x]
    part = fresh(60)
    for lost, found in ((0, True), (5, True), (6, False), (12, False)):
        # tokens lost in the middle leave 46 - lost of every 46, unless a window lies beside them
        other = np.concatenate([part[:24], fresh(lost), part[24 + lost :]])[:46]
        a, b = np.concatenate([fresh(100), part[:46], fresh(100)]), np.concatenate([fresh(50), other, fresh(80)])
        c = 20
        sides = passages.near_tokens(a, *at(100 + c, 45, 45)), passages.near_tokens(b, *at(50 + c, 45, 45))
        ok, a0, a1, b0, b1, _, _, same = passages.agreement(*sides, *at(45, 45, 45, 45))
        assert bool(ok[0]) == found
        if found:
            assert (a0[0] + 100 + c, a1[0] + 100 + c, b0[0] + 50 + c, b1[0] + 50 + c) == (100, 146, 50, 96) and bool(same[0]) == (not lost)
        if not lost:  # a passage has to lie inside both windows
            assert passages.agreement(*sides, *at(c - 5, 45, 45, 45))[0][0] and not passages.agreement(*sides, *at(c - 6, 45, 45, 45))[0][0]


def test_windows_that_agree_may_agree():
    g = np.random.default_rng(9)
    base = g.integers(1, 1 << 62, 400).astype(np.uint64)
    rows, ends = [], []
    for _ in range(300):
        own, c = base.copy(), int(g.integers(60, 340))
        for _ in range(int(g.integers(0, 7))):
            at = int(g.integers(c - 50, c + 50))
            own = np.concatenate([own[:at], g.integers(1, 1 << 62, int(g.integers(0, 4))).astype(np.uint64), own[at + int(g.integers(0, 3)) :]])
        before, behind = int(g.integers(0, 46)), int(g.integers(0, 46))
        rows.append(passages.near_tokens(own, np.array([200]), np.array([before]), np.array([behind]))[0])
        ends.append((before, behind))
    near, (before, behind) = np.stack(rows), np.array(ends).T
    may, i = passages.may_agree(near, near), np.arange(300)
    found = 0
    for shift in range(1, 40):
        j = np.roll(i, shift)
        ok = passages.agreement(near, near[j], before, behind, before[j], behind[j])[0]
        found += ok.sum()
        assert may[i, j][ok].all()
    strange = passages.near_tokens(g.integers(1, 1 << 62, 400).astype(np.uint64), np.array([200]), np.array([45]), np.array([45]))
    assert found > 50 and not passages.may_agree(near, strange).any()


def test_near_passages_with_a_changed_word_are_found(spark):
    texts = {}
    for i in range(100):
        own = _fresh(60, 1000 + i)
        near = list(own)
        near[random.Random(i).randrange(60)] = "other"
        texts |= {2 * i: " ".join([*_fresh(80, 3000 + i), *own, *_fresh(50, 4000 + i)]), 2 * i + 1: " ".join([*_fresh(30, 5000 + i), *near, *_fresh(90, 6000 + i)])}
    found = _found(spark, texts)
    assert all(found[x] == x // 2 * 2 for x in found) and len(found) >= 0.95 * len(texts)  # one changed word of 50 leaves 0.8


def test_passages_in_lists_led_by_strays(spark):
    # many texts hold the minimal shingle of all windows of a passage that only two others share, and nothing else of it
    share = _fresh(50, 1)
    tokens = _tokens(" ".join(share))
    at = [int(_nodes(tokens, s)[0]) for s in passages.SEEDS]
    strays = {}
    for i in range(400):
        own = _fresh(300, 100 + i)
        for k, x in enumerate(at):
            own[50 + 90 * k : 55 + 90 * k] = share[x : x + 5]
        strays[i] = " ".join(own)
    docs = strays | {1000: " ".join(share), 1001: " ".join([*share, *_fresh(60, 2)])}
    assert _found(spark, docs) == {1000: 1000, 1001: 1000}


def test_windows_of_a_list_are_dealt_once_and_met_by_rare_tokens(spark, monkeypatch):
    # 400 texts share one shingle and nothing else: pairs and rows follow their number, not its square
    share, dealt, grouped = _fresh(50, 1), [], passages.grouped
    x = int(_nodes(_tokens(" ".join(share)), passages.SEEDS[0])[0])
    docs = {i: " ".join([*(own := _fresh(300, 100 + i))[:100], *share[x : x + 5], *own[100:]]) for i in range(400)} | {1000: " ".join(share), 1001: " ".join([*share, *_fresh(60, 2)])}

    def counted(rows, keys, work, schema):
        dealt.append((rows.count(), rows.select("value", "cid", "c").distinct().count()))
        return grouped(rows, keys, work, schema)

    monkeypatch.setattr(passages, "grouped", counted)
    assert _found(spark, docs) == {1000: 1000, 1001: 1000}
    assert dealt[0][0] == dealt[0][1] > 300
    # of the windows of a list that has some alike, those that may agree are all met, in parts of any size
    g = np.random.default_rng(3)
    near = g.integers(1, 1 << 32, (500, passages.SPAN), np.uint32)
    near[:, passages.REACH] = 7
    near[:, passages.REACH + 1 : passages.REACH + 9] = np.arange(1, 9)  # eight tokens are the list's
    for i in range(0, 120, 2):  # a few of the others are changed, and places shift
        near[i + 1] = np.roll(near[i], int(g.integers(-9, 10)))
        near[i + 1, g.integers(0, passages.SPAN, int(g.integers(0, 12)))] = 5
        near[i + 1, : int(g.integers(0, 40))] = 0
    i, j = np.divmod(np.arange(500 * 500), 500)
    want = {(a, b) for a, b, like in zip(i, j, passages.alike(near[i], near[j]), strict=True) if like}
    for met in (1 << 19, 50):
        monkeypatch.setattr(passages, "MET", met)
        pairs = [(a, b) for r, c in passages.met_windows(near, near) for a, b in zip(r, c, strict=True)]
        assert want <= set(pairs) and len(pairs) == len(set(pairs)) < 5000 and len(want) > 550


def test_passages_joined_over_windows(spark):
    long = _fresh(700, 31)
    rows = passages.near_passages(spark.createDataFrame([(1, " ".join(long)), (2, " ".join([*_fresh(40, 32), *long[100:650], *_fresh(40, 33)])), (2, " ".join(long[:20])), (3, "JUNK!! " * 300), (4, "JUNK!! " * 200)], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.first_word, r.n_words, r.near_doc_id, r.near_first_word, r.near_n_words, r.similarity) for r in rows if r.doc_id in (1, 2)}
    assert got == {1: (100, 550, 2, 40, 550, 1.0), 2: (40, 550, 1, 100, 550, 1.0)}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id > 2} == {3: 3, 4: 3}


def test_texts_without_doc_id_take_part(spark):
    a, b = _fresh(80, 21), _fresh(80, 22)
    both = spark.createDataFrame([(None, " ".join([*a, *b])), (1, " ".join(a)), (2, " ".join(b)), (3, " ".join(_fresh(90, 23)))], "doc_id long, text string")
    rows = passages.near_passages(both).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, 1), (1, 1), (2, 1)}
    assert {r.doc_id: r.n_removed > 400 for r in suffixes.repeated_spans(both).collect()} == {None: True, 1: True, 2: True, 3: False}


def test_sets_without_doc_id_link_others(spark):
    w = _fresh(152, 24)
    sets = spark.createDataFrame([(1, " ".join(w[:144])), (None, " ".join(w[4:148])), (2, " ".join(w[8:]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(sets).collect()} == {1: 1, None: None, 2: 1}


def test_direct_sorting():
    for trial in range(100):
        text = np.frombuffer(bytes(random.choice(b"\0a" if trial % 2 else b"ab\xff") for _ in range(random.randint(0, 200))), np.uint8)
        at = np.array(random.sample(range(len(text)), len(text) // 2), np.int64)
        ends = np.minimum(at + random.choice([1, 8, 9, 40]), len(text))
        string = {int(a): text[a:b].tobytes() for a, b in zip(at, ends)}
        assert [string[int(a)] for a in suffixes.sort_directly(text, at, ends)] == sorted(string.values())


def test_two_stage_sorting_finds_repeats():
    for trial in range(200):
        width = random.choice([3, 5, 8])
        regions = [bytes(random.choice(b"ab" if trial % 2 else b"abc") for _ in range(random.randint(width, 40))) for _ in range(random.randint(1, 8))]
        seen = collections.Counter(r[i : i + width] for r in regions for i in range(len(r) - width + 1))
        for r, marks in zip(regions, suffixes.repeats(regions, width)):
            assert list(marks) == [seen[r[i : i + width]] > 1 for i in range(len(r) - width + 1)]


def _repeated(bodies, width=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each body by brute force."""
    seen = collections.Counter(b[i : i + width] for b in bodies for i in range(len(b) - width + 1))
    for b in bodies:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                mask[i : i + width] = True
        yield len(b), int(mask.sum()), int((np.diff(np.r_[0, mask]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()


@pytest.mark.parametrize("most", [suffixes.MOST_REGIONS, 1, 0])
def test_repeated_bytes_against_brute_force(docs, none, most):
    data = docs.collect()
    want = list(_repeated([(r.text or "").encode() for r in data]))
    got = suffixes.repeated_spans(docs, most_regions=most).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)) == sorted(key((r.doc_id, *w)) for r, w in zip(data, want))
    assert all(r.has_repeats == (r.n_removed > 0) for r in got)
    assert not suffixes.repeated_spans(none).collect()


@pytest.mark.parametrize("most", [1024, 4, 0])
def test_frequent_passages_in_other_surroundings(spark, most):
    dice = random.Random(3)
    fresh = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    p, q, near = fresh(600), fresh(420), [fresh(30) for _ in range(4)]
    texts = [None, "", "\u00e9" * 500]
    for i in range(60):
        texts.append((fresh(dice.randint(0, 300)) + p + fresh(dice.randint(0, 300)), dice.choice(near) + p[: dice.randint(380, 600)] + dice.choice(near), fresh(50) + dice.choice(near) + q + dice.choice(near) + fresh(50), "x" * dice.randint(300, 900) + p[100:])[i % 4])
    texts.append(texts[4])
    want = list(_repeated([(t or "").encode() for t in texts]))
    got = suffixes.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_regions=most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("most", [8, 0])
def test_a_line_that_texts_repeat_many_times(spark, most):
    dice = random.Random(5)
    fresh = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    line = fresh(90) + "\n"
    texts = [fresh(dice.randint(0, 200)) + line * dice.randint(0, 40) + fresh(dice.randint(0, 200)) for _ in range(40)]
    texts += [line * 30, line * 30, fresh(1000), None]
    want = list(_repeated([(t or "").encode() for t in texts]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.repeated_spans(rows.repartition(3), most_regions=most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def _shared_places(texts, size=51):
    """How many places of each text begin `size` words that another text of the list has too, by brute force."""
    runs = [[tuple(w[i : i + size]) for i in range(len(w) - size + 1)] for w in ((t or "").split() for t in texts)]
    held = collections.Counter(run for own in runs for run in set(own))
    return [sum(held[run] > 1 for run in own) for own in runs]


def test_passages_under_400_bytes_that_texts_share(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    assert len(passage) < 400
    own = [" ".join(_fresh(80, 40 + i)) for i in range(5)]
    texts = [f"{own[0]} {passage} {own[1]}", passage.replace(" ", "\n"), f"{own[2]} {passage[:-4]}", f"{own[3]} {passage.upper()}", f"{own[4]} {own[4]}"]
    got = {r.doc_id: r for r in suffixes.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_shared for i in range(5)] == [1, 1, 0, 0, 0] == _shared_places(texts)
    assert [got[i].n_removed > 0 for i in range(5)] == [False, False, False, False, True]


def test_shared_passages_against_brute_force(spark):
    dice = random.Random(8)
    fresh = lambda n: [dice.choice("abcdefghij") + dice.choice("klm") for _ in range(n)]
    p, line = fresh(150), fresh(7)
    texts = [None, "", " ".join(fresh(50)), " ".join(line * 20), " ".join(fresh(10) + line * 30), "x " * 90, "x " * 60 + "y"]
    for i in range(60):
        a, edited = dice.randint(0, 90), list(p)
        for _ in range(dice.randint(0, 3)):
            edited[dice.randrange(150)] = "edit"
        texts.append(" ".join((fresh(dice.randint(0, 60)) + p[a : a + dice.randint(45, 60)] + fresh(20), edited, fresh(120))[i % 3]))
    texts += [texts[9], texts[9], texts[8], " ".join(line * 20)]
    ids = [*range(len(texts) - 2), 9, None]
    got = suffixes.repeated_spans(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(key((r.doc_id, r.n_bytes, r.n_shared)) for r in got) == sorted(key((i, len(t or ""), n)) for i, t, n in zip(ids, texts, _shared_places(texts), strict=True))
    assert 20 < sum(r.n_shared > 0 for r in got) < 60


@pytest.mark.parametrize("piece", [1 << 22, 64])
def test_regions_of_words(monkeypatch, piece):
    monkeypatch.setattr(shared_words, "PIECE", piece)
    dice = random.Random(2)
    texts = [" ".join(dice.choice("abc") for _ in range(n)) for n in (0, 8, 9, 10, 300, 50, 0, 200)]
    data, bounds = np.frombuffer("".join(f"{t} " for t in texts).encode(), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts)])
    (row, anchor, region, first, many), windows = shared_words.regions(data, bounds, 9, 3)
    assert np.bincount(row, many, 8).tolist() == [max(0, len(t.split()) - 8) for t in texts]
    every = "".join(f"{t} " for t in texts).split()
    of = {}  # equal windows have one anchor and one hash, equal regions one hash
    for a, r, f, m in zip(anchor, region, first, many, strict=True):
        assert of.setdefault(tuple(every[f : f + m + 8]), r) == r
        for i in range(f, f + m):
            assert of.setdefault(("window", *every[i : i + 9]), (a, windows[i])) == (a, windows[i])
    assert len({x[1] for k, x in of.items() if k[0] == "window"}) == sum(k[0] == "window" for k in of)


def test_compared_regions_keep_equal_strings_together():
    dice, width = random.Random(9), 30
    for _ in range(300):
        anchor = "GRAM"
        side = lambda n: "".join(dice.choice("ab") for _ in range(n))
        left, right = side(26), side(40)
        regions = []
        for _ in range(4):  # strings of 30 that hold the anchor
            own = (side(dice.randint(0, 10)) + left)[-26:] if dice.random() < 0.5 else side(20) + left[-6:]
            off = dice.randint(0, 26)
            tail = right[: dice.randint(0, 40)] + side(40)
            strings = dice.randint(1, off + 1)
            regions.append((off, (own[len(own) - off :] + anchor + tail)[: strings + width - 1].encode()))
        other_off, other = regions[0]
        string = lambda off, body, i: (off - i, body[i : i + width])
        has = {string(other_off, other, i) for i in range(len(other) - width + 1)}
        keys = {}
        for off, body in regions[1:]:
            both, parts = suffixes.compared(7, off, body, other_off, other, width)
            settled = set(range(*both)) if both else set()
            assert settled == {i for i in range(len(body) - width + 1) if string(off, body, i) in has}
            left_over = [i for _, a, b in parts for i in range(a, b)]
            assert sorted([*left_over, *settled]) == list(range(len(body) - width + 1))
            for key, a, b in parts:
                for i in range(a, b):
                    assert keys.setdefault(string(off, body, i), key) == key


def test_jaccard_against_brute_force(spark, none):
    base = [random.choice(WORDS) for _ in range(120)]
    texts = [None, "", "a b", "A b", "a b c d"]
    for _ in range(60):
        w = list(base)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = random.choice(WORDS)
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[6])], "doc_id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} - {()}
    low = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert {i: (len(s), low[i]) for i, s in sets.items()} == {i: v for i, v in got.items() if i is not None}
    assert not jaccard.jaccard_components(none).collect()


@pytest.mark.parametrize("step", [1, 3, 128])
@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_that_are_skipped_hold_no_links(monkeypatch, step, percent):
    """Clusters of sets that differ little, at large and in size, in both steps: components are those of all pairs."""
    monkeypatch.setattr(jaccard, "STEP", step)
    made, visited = jaccard._products, []

    def counted(parts, n, percent, skip):
        for x in made(parts, n, percent, skip):
            visited.append(1)
            yield x

    monkeypatch.setattr(jaccard, "_products", counted)
    for seed in range(12):
        chance = random.Random(seed)
        base = [f"v{chance.random()}" for _ in range(chance.choice([12, 60, 200]))]
        texts = set()
        for _ in range(25):
            own = list(base[: chance.choice([len(base), len(base), len(base) * 3 // 4])])
            for _ in range(chance.choice([0, 1, 2, 8])):
                own[chance.randrange(len(own))] = f"u{chance.randrange(40)}"
            texts.add(" ".join(own))
        texts = sorted(texts)
        sets = [s for _, _, data, bounds in chunks(pa.array(texts, pa.large_string())) for s in jaccard.token_sets(data, bounds, 1)]
        n, frequent = np.array([len(s) for s in sets]), np.sort(np.concatenate(sets).view(np.int64))[: seed * 9]
        want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= percent * (len(sets[a]) + len(sets[b]) - both)]

        def roots(*edges):
            forest = near_vectors.Forest(len(sets))
            for a, b in edges:
                forest.add(np.asarray(a, int), np.asarray(b, int))
            return forest.root.tolist()

        truth = roots(*(([a], [b]) for a, b in want))
        block = np.zeros(len(sets), np.int64)
        found = jaccard._cluster(1, percent)({"n": pa.array(n), "block": pa.array(block), "rep": pa.array(np.arange(len(sets))), "text": pa.array(texts)})
        assert roots(*([found] if found else [])) == truth
        batch = pa.RecordBatch.from_arrays([pa.array([b""] * len(sets)), pa.array(np.arange(len(sets))), pa.array(n), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "rep", "n", "tokens"])
        (out,) = jaccard._prefixes(frequent, percent, True)([batch])
        upper = pa.array([(np.asarray(t, np.int64) >> 32).astype(np.int32) for t in out.column(3).to_pylist()], pa.list_(pa.int32()))
        maybe = jaccard._near_prefixes(percent)({"n": pa.array(n), "block": pa.array(block), "rep": out.column(1), "tokens": upper, "light": out.column(4)})
        near = roots(*([maybe] if maybe else []))
        assert all(near[a] == near[b] for a, b in want)
    assert visited
