"""The stages of the pipeline, its whole result, and whole results of operators 4 and 5, against plain loops on a small table."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import mixing, quality
from quire.llm.queries import tokenizer_path
from quire.llm.words import chunks

#: The columns of documents, and more that bear names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, cid long, s int, i int, w int, taken int, size long, score double, component_id long"
MORE = (None, 7, 1, 2, 3, 4, 5, 0.5, 6)
DOC, TEXT, SOURCE = 0, 1, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BETWEEN = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
CAPACITY = 1024


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    bodies = [_prose(rng, rng.randint(30, 120)) for _ in range(30)]
    junk = [" ".join(rng.choice(["$$$", "CLICK!!!", "0000", "@@", "###"]) for _ in range(rng.randint(10, 80))) for _ in range(15)]
    near = [b.split(" ") for b in bodies[:6]]
    for words in near:
        words[len(words) // 2] = "changed"
    texts = [*bodies, *junk, *(" ".join(x) for x in near), bodies[7].upper(), bodies[8], None, "", " \t\n", "one", " two  words ", _prose(rng, 20_000), "É " + bodies[9]]
    sources = ["b", "Z", "é", "a", None]
    made = [(i, t, "en", sources[i % 5], len(t or ""), *MORE) for i, t in enumerate(texts)]
    unnamed = (None, _prose(rng, 50), None, None, None, *MORE)
    return [*made, made[3], made[3], unnamed, unnamed, (None,) * (5 + len(MORE))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    marks = [(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(30, 45)] + [(None, 1, 0), (3, None, None), (10**12, 0, 1), (4, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def model(spark, docs, folder):
    return quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def score(model, text):
    """Bin by bin: a value's bin is the number of edges that do not exceed it."""
    ((_, _, data, bounds),) = chunks(pa.array([text or ""], pa.large_string()))
    x = quality.features(data, bounds)[0]
    at = lambda edges, v: sum(1 for e in edges if e <= v)
    total = model["prior"] + sum(t[at(e, v)] for e, t, v in zip(model["edges"], model["tables"], x, strict=True))
    total += sum(t[at(model["coarse"][i], x[i])][at(model["coarse"][j], x[j])] for i, j, t in model["pairs"])
    return 1 / (1 + math.exp(-total))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def without_copies(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[TEXT])].append(r)
    return [max(g, key=lambda r: -1 if r[DOC] is None else r[DOC]) for g in groups.values()]


def one_of_each(rows, k=5, percent=80):
    sets = []
    for r in rows:
        words = WORD.findall(lower(r[TEXT]))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = collections.defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        if r[DOC] is not None:
            least[top(i)] = min(least[top(i)], r[DOC])
    return [r for i, r in enumerate(rows) if r[DOC] is None or r[DOC] == least[top(i)]]


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= over


def mixed(spark, rows):
    """(row, size, source_size, target, taken) of each row; the key of a doc_id is Spark's."""
    ids = spark.createDataFrame([(r[DOC],) for r in rows], "doc_id long").distinct()
    key = {r[0]: r[1] for r in ids.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED))).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[SOURCE]].append((key[r[DOC]], r[DOC] is not None, r[DOC] or 0, len(WORD.findall(r[TEXT] or "")), r))
    total = {s: sum(x[3] for x in g) for s, g in by.items()}
    goal, out = targets(total), []
    for s, group in by.items():
        budget = math.floor(goal[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for *_, size, r in sorted(group, key=lambda x: x[:4]):
            part = min(size, rest)
            rest -= part
            out.append((r, size, total[s], goal[s], epochs * size + part))
    return out


def taken_rows(spark, rows):
    most = collections.defaultdict(int)
    made = mixed(spark, rows)
    for r, size, _, _, taken in made:
        most[r[DOC], r[SOURCE], size] = max(taken, most[r[DOC], r[SOURCE], size])
    out = []
    for r, size, *_ in made:
        left = most[r[DOC], r[SOURCE], size]
        while left > 0:
            text = r[TEXT] if left >= size else "".join(BETWEEN.split(r[TEXT])[:left])
            out.append((r[DOC], text, *r[2:]))
            left -= size
    return out


def pieces(rows):
    tokenizer = Tokenizer.from_file(str(tokenizer_path()))
    for r in rows:
        ids = np.array([*tokenizer.encode(r[TEXT] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % CAPACITY + 1, len(ids), CAPACITY), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield r[DOC], n, a, b - a, zlib.crc32(ids[a:b].tobytes())


def best_fit(sizes):
    space = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, x in enumerate(space) if x >= size]
        if fits:
            space[min(fits, key=lambda i: space[i])] -= size
        else:
            space.append(CAPACITY - size)
    return len(space)


def same(df, expected):
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(map(tuple, expected))


def check_packing(found, rows):
    expected = list(pieces(rows))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == collections.Counter(expected)
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= CAPACITY
    assert len(by) <= best_fit([x[3] for x in expected])


def test_quality_stage(spark, docs, rows, folder, model):
    got = corpus_pipeline.quality_stage(spark, docs, folder)
    assert got.columns == docs.columns
    same(got, [r for r in rows if score(model, r[TEXT]) >= 0.5])
    said = {r.doc_id: r for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.doc_id is not None}
    for r in rows:
        if r[DOC] is not None:
            found = said[r[DOC]]
            assert abs(found.score - score(model, r[TEXT])) < 1e-9 and found.predicted == (found.score >= 0.5)
            assert found.held_out == (zlib.crc32(str(r[DOC]).encode()) % 3 == 1)


def test_exact_dedup_stage(spark, docs, rows, folder):
    got = corpus_pipeline.exact_dedup_stage(spark, docs, folder)
    assert got.columns == docs.columns
    same(got, without_copies(rows))


def test_near_dedup_stage(spark, docs, rows, folder):
    got = corpus_pipeline.near_dedup_stage(spark, docs, folder)
    assert got.columns == docs.columns
    kept = one_of_each(rows)
    assert len(kept) < len(rows)
    same(got, kept)


def test_mixing_stage(spark, docs, rows, folder):
    got = corpus_pipeline.mixing_stage(spark, docs, folder)
    assert got.columns == docs.columns
    same(got, taken_rows(spark, rows))


def test_mix_against_loops(spark, docs, rows):
    found = mixing.mix(docs).collect()
    expected = [(r[DOC], size, whole, round(goal, 6), taken) for r, size, whole, goal, taken in mixed(spark, rows)]
    assert collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found) == collections.Counter(expected)


def test_packing_stage(spark, docs, rows, folder):
    check_packing(corpus_pipeline.packing_stage(spark, docs, folder).collect(), rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_nothing(spark, folder, name, stage):
    got = stage(spark, spark.createDataFrame([], SCHEMA), folder)
    assert got.isEmpty() and (name == corpus_pipeline.STAGES[-1][0] or got.columns == [x.split()[0] for x in SCHEMA.split(", ")])


def test_pipeline(spark, rows, folder, model):
    left = [r for r in rows if score(model, r[TEXT]) >= 0.5]
    left = taken_rows(spark, one_of_each(without_copies(left)))
    assert left
    check_packing(corpus_pipeline.run(spark, folder).collect(), left)
