"""A quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time, boosted in turn over all features, add up to a lookup table for each feature;
the pairs of features that explain most of what is left get tables of two features in the same way. A document's score
is the sum of its bins' entries. Features are counts and shares over the whole text; language, source and id are none.
"""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, words

#: At most so many labelled rows are learned from, those with the smallest hash of doc_id.
MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, L2 = 60, 40, 0.2, 1.0

#: Byte classes; every byte is in one.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,), "stop": b".,;:'\"?-()", "bang": b"!", "bar": b"|", "high": range(128, 256)}
_CLASS = np.full(256, len(CLASSES), np.uint8)  # the last: other signs
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
FEATURES = ["bytes", "words", *(f"{c}_share" for c in (*CLASSES, "sign")), "word_length", "long_words", "distinct_words", "repeated_next", "repeated_two_on", "distinct_pairs", "commonest_word", "upper_words", "sign_words", "words_a_line", "distinct_lines"]


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text. An empty text has zeros."""
    m, kinds = len(bounds) - 1, len(CLASSES) + 1
    sizes = np.diff(bounds)
    counts = np.bincount(np.repeat(np.arange(m) * kinds, sizes) + _CLASS[data], minlength=m * kinds).reshape(m, kinds)
    hashed, start, end, wb = words(data, bounds)
    n = np.diff(wb)
    row = np.repeat(np.arange(m), n)
    some, length = np.maximum(n, 1), end - start
    per = lambda mask: np.bincount(row[mask], minlength=m) / some
    near = lambda k: np.concatenate([(hashed[k:] == hashed[:-k]) & (row[k:] == row[:-k]), np.zeros(min(k, len(row)), bool)]) if len(row) > k else np.zeros(len(row), bool)
    junk = np.add.accumulate(np.concatenate([[0], (_CLASS[data] == kinds - 1) | (data == 33)]))
    caps = np.add.accumulate(np.concatenate([[0], (data >= 65) & (data <= 90)]))
    distinct, pairs, common, lines = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
    for i in range(m):
        own = np.sort(hashed[wb[i] : wb[i + 1]])
        if len(own):
            ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            distinct[i], common[i] = len(ends), np.diff(ends, prepend=-1).max()
            two = hashed[wb[i] : wb[i + 1] - 1] * np.uint64(3) + hashed[wb[i] + 1 : wb[i + 1]]
            pairs[i] = len(np.unique(two)) / max(1, len(two)) if len(two) else 1
            split = data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n")
            lines[i] = len(set(split)) / len(split)
    out = [np.log1p(sizes), np.log1p(n), *(counts / np.maximum(sizes, 1)[:, None]).T, np.bincount(row, length, m) / some, per(length > 12), distinct / some, per(near(1)), per(near(2)), pairs, common / some, per((caps[end] - caps[start]) * 2 > length), per(junk[end] > junk[start]), np.log1p(n / (counts[:, 4] + 1)), lines]
    return np.nan_to_num(np.stack(out, axis=1))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of ordered bins and its gain; cut c parts bins below c from the rest."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + L2) + (g.sum() - a) ** 2 / (h.sum() - b + L2)
    c = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[c] - g.sum() ** 2 / (h.sum() + L2)), c + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most four leaves over ordered bins."""
    out = np.empty(len(g))
    gain, cut = _split(g, h)
    spans = [(0, cut), (cut, len(g))] if gain > 0 else [(0, len(g))]
    for lo, hi in spans:
        gain, cut = _split(g[lo:hi], h[lo:hi])
        for a, b in [(lo, lo + cut), (lo + cut, hi)] if gain > 0 and len(spans) > 1 else [(lo, hi)]:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a table into four leaves: its gain and the leaves' values."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda t: (t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = quarter(a), quarter(b)
    gain = sum(x**2 / (y + L2) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    v = [float(x[i, j] / (y[i, j] + L2)) for x, y in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - a[-1, -1] ** 2 / (b[-1, -1] + L2)), out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Learns the tables from features x and labels y (0 or 1). Without rows every score is one half."""
    if not len(y):
        return {"prior": 0.0, "edges": [], "tables": [], "pairs": []}
    share = np.clip(y.mean(), 0.01, 0.99)
    prior = float(np.log(share / (1 - share)))
    cuts = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(x.shape[1])]
    edges, coarse = cuts(BINS), cuts(PAIR_BINS)
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f_all = np.full(len(y), prior)

    def slopes():
        p = 1 / (1 + np.exp(-f_all))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])))
            tables[f] += step
            f_all += step[b]

    def table2(i, j, v):
        return np.bincount(wide[i] * (len(coarse[j]) + 1) + wide[j], v, (len(coarse[i]) + 1) * (len(coarse[j]) + 1)).reshape(len(coarse[i]) + 1, len(coarse[j]) + 1)

    g, h = slopes()
    gains = sorted(((-_quadrants(table2(i, j, g), table2(i, j, h))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            g, h = slopes()
            step = RATE * _quadrants(table2(i, j, g), table2(i, j, h))[1]
            t += step
            f_all += step[wide[i], wide[j]]
    return {"prior": prior, "edges": edges, "coarse": coarse, "tables": tables, "pairs": chosen}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model["prior"])
    for f, (e, t) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        total += t[np.searchsorted(e, x[:, f], "right")]
    for i, j, t in model["pairs"]:
        total += t[np.searchsorted(model["coarse"][i], x[:, i], "right"), np.searchsorted(model["coarse"][j], x[:, j], "right")]
    return 1 / (1 + np.exp(-total))


def _map(texts_at: int, names: list[str], more):
    """mapInArrow function: the columns before the text, then what more(features) makes of each row."""

    def over(batches):
        for batch in batches:
            made = [more(features(data, bounds)) for _, _, data, bounds in chunks(batch.column(texts_at))]
            if made:
                columns = [batch.column(i) for i in range(texts_at)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in zip(*made, strict=True) for c in [list(itertools.chain.from_iterable(c))])], names=names)

    return over


def remainder(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict:
    """The model, from at most `most` labelled rows outside the held-out third. Null labels and unknown doc_ids are passed over."""
    known = labels.filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")
    made = rows.mapInArrow(_map(2, ["doc_id", "quality", "x"], lambda x: [list(x)]), "doc_id long, quality int, x array<double>")
    found = made.orderBy("doc_id", "x").limit(most).toPandas()
    return fit(np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["quality"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Every document's quality: (doc_id, held_out, score, predicted).

    Null and empty texts are scored by their features, all zero. Without any label, scores are 0.5. held_out is false
    where doc_id is null. Repeated rows are scored alike.
    """
    model = learn(docs, labels, most)
    scored = docs.select("doc_id", "text").mapInArrow(_map(1, ["doc_id", "score"], lambda x: [score(model, x)]), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """docs without those that are predicted to be of low quality; columns and repeated rows stay."""
    model = learn(docs, labels, most)

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        parts = [score(model, features(data, bounds)) for _, _, data, bounds in chunks(pa.array(text, pa.large_string(), from_pandas=True))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(scores("text") >= 0.5)
