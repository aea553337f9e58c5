"""Phrases whose words stand together more often than their parts explain, found level by level.

Level k counts the phrases of k words whose first and last k - 1 words are both frequent. What is frequent at a level goes to
the tasks of the next one as a Bloom filter of bounded size: it never misses a frequent phrase, and what it lets through
wrongly cannot reach the least count itself, so results do not depend on it. Counts of a chunk are taken by word numbers,
not by hashes, and added up by Spark by the phrases' text. Scores come from joins of the level tables.
"""

import hashlib
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_groups, tasks
from .words import LOWER, chunks, mix, shingles, words

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = BREAKS.copy()
OUTSIDE[[0x20, 0x09]] = True
#: Bytes of text whose phrases are counted together before Spark adds them up.
CHUNK = 4 << 20
#: Bits of a filter: so many for each frequent phrase, and at most 2 ** MOST_BITS (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 27
COUNTS = "lang string, phrase string, f long"


def tokens(data: np.ndarray, bounds: np.ndarray):
    """(words of all rows as an Arrow array, each word's piece number, each row's bounds in words) of lower-cased bytes. Pieces of different rows
    have different numbers."""
    data = LOWER[data]
    inside = ~OUTSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = bounds[1:-1]
    at = at[(at > 0) & (at < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    wb = np.searchsorted(start, bounds)
    piece = np.cumsum(BREAKS[data])[start] + np.repeat(np.arange(len(bounds) - 1), np.diff(wb))
    body = pa.py_buffer(np.ascontiguousarray(data[inside]))
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(start), offsets, body), piece, wb


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of rows of words that blanks part, bounds of the rows)."""
    parts, ends = [], [np.zeros(1, np.int64)]
    for _, _, data, bounds in chunks(column):
        hashed, _, _, wb = words(data, bounds, lower=False)
        parts.append(hashed)
        ends.append(wb[1:] + ends[-1][-1])
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(ends)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _held(filter_: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the hashes."""
    mask = np.uint64(len(filter_) * 64 - 1)
    out = np.ones(len(hashed), bool)
    for place in (hashed & mask, (hashed >> np.uint64(32)) & mask):
        out &= (filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _count(k: int, filter_):
    """lang, text in; the phrases of k words of each chunk with their counts out. At level 1 a row without phrase counts all words of a lang."""

    def count(batches):
        for batch in batches:
            spoken = batch.column(0)
            for i, j, data, bounds in chunks(batch.column(1), CHUNK):
                word, piece, wb = tokens(data, bounds)
                if not len(word):
                    continue
                coded, langs = word.dictionary_encode(), spoken.slice(i, j - i).dictionary_encode()
                number, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                lang = np.repeat(langs.indices.to_numpy(), np.diff(wb)).astype(np.int64)
                names = langs.dictionary
                if k == 1:
                    yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(np.bincount(lang, minlength=len(names)).astype(np.int64))], names=["lang", "phrase", "f"])
                    at = np.arange(len(number))
                else:
                    own, _ = word_hashes(vocabulary)
                    tongue = np.array([lang_hash(x) for x in names.to_pylist()], np.uint64)
                    part, _ = shingles(own[number], wb, k - 1)
                    known = _held(filter_.value, mix(part ^ tongue[lang]))
                    whole = np.zeros(len(number), bool)
                    whole[: len(number) - k + 1] = (piece[: len(piece) - k + 1] == piece[k - 1 :]) & known[: len(known) - k + 1] & known[1 : len(known) - k + 2]
                    at = np.flatnonzero(whole)
                if not len(at):
                    continue
                key, room = lang[at], len(names)
                for x in range(k):
                    if room * len(vocabulary) >= 1 << 62:
                        distinct, key = np.unique(key, return_inverse=True)
                        room = len(distinct)
                    key, room = key * len(vocabulary) + number[at + x], room * len(vocabulary)
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                at = at[first]
                said = [vocabulary.take(pa.array(number[at + x])) for x in range(k)]
                phrase = pc.binary_join_element_wise(*said, pa.scalar(" ", pa.large_string())) if k > 1 else said[0]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[at])), phrase.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"])

    return count


def _places(mask: int):
    """lang, phrase in; the words of the filter that hold their bits, and these bits, out."""

    def places(batches):
        for batch in batches:
            hashed, wb = word_hashes(batch.column(1))
            size = np.diff(wb)
            whole = hashed[wb[:-1]]
            for x in range(1, int(size.max()) if len(size) else 0):  # all phrases of a level have the same number of words
                whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + hashed[wb[:-1] + x])
            coded = batch.column(0).dictionary_encode()
            tongue = np.array([lang_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)
            whole = mix(whole ^ tongue[coded.indices.to_numpy()])
            place = np.concatenate([whole & np.uint64(mask), (whole >> np.uint64(32)) & np.uint64(mask)])
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    return places


def _filter(frequent: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the frequent phrases of one level; its bits are set by an aggregation and at most 2 ** MOST_BITS reach the driver."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n - 1).bit_length()))
    found = frequent.select("lang", "phrase").mapInArrow(_places(bits - 1), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def levels(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) of all words, the frequent phrases (lang, phrase, f) of 1 to `longest` words)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total, out, filter_ = None, [], None
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_count(k, filter_), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found = cut(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()))
        if k == 1:
            total = found.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
        out.append(found.filter("phrase IS NOT NULL"))
        n = out[-1].count() if k < longest else 0
        if not n:
            break
        filter_ = docs.sparkSession.sparkContext.broadcast(_filter(out[-1], n))
    return total, out


def _parted(candidates: DataFrame) -> DataFrame:
    """Every cut of every candidate: (lang, phrase, a, k, first, rest)."""
    w, k = F.split("phrase", " "), F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)
    cuts = F.transform(k, lambda i: F.struct(i.alias("k"), F.array_join(F.slice(w, 1, i), " ").alias("first"), F.array_join(F.slice(w, i + 1, F.size(w)), " ").alias("rest")))
    return candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")


def _counted(cuts: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of their part; a part of very many candidates is joined by broadcast."""
    key = lambda phrase: F.concat(phrase, F.lit("\n"), "lang")  # noqa: E731  no phrase holds a line end
    keyed = cut(cuts.withColumn("part", key(part)))
    used = keyed.groupBy("part").agg(F.count("*").alias("uses"))
    groups = used.join(known.select(key("phrase").alias("part"), F.col("f").alias(name)), "part")
    return join_groups(keyed, groups, "part", "uses", max(1, keyed.count())).drop("part", "uses")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80) -> DataFrame:
    """The `top` phrases of each lang: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), parted at .,;:!? and line ends into pieces and these at blanks and tabs into words. A candidate is
    a phrase of 2 to `longest` words that occurs `least` times or more in its lang's pieces, overlaps included: a. Cut after some
    words its parts occur l and r times, and the lowest floor(2000000 * a / (l + r)) is its score, of equal ones that of the
    earliest cut. n is the number of words of the lang. A candidate goes if a longer candidate holds it and occurs at least `cover`
    percent as often. Order: score and a falling, phrase rising by its bytes. A null lang is `und`, a null text empty; repeated rows
    count each time, doc_ids are not read, and an empty table gives no row. Very long texts are counted whole.
    """
    total, found = levels(docs, least, longest)
    candidates = found[1] if len(found) > 1 else found[0].limit(0)
    for more in found[2:]:
        candidates = candidates.unionByName(more)
    known = found[0]
    for more in found[1:-1]:
        known = known.unionByName(more)
    cuts = _counted(_counted(_parted(candidates), known, "first", "l"), known, "rest", "r")
    exact = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) DIV CAST(l + r AS DECIMAL(20, 0))")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    w = F.split("phrase", " ")
    size = F.size(w)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    longer = candidates.filter(size > 2).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover))
    first = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # a lang's best of many parts, of fewer parts, and of all: no task sees more of a lang than a root of the parts has
    for parts in (tasks(docs), ceil(sqrt(tasks(docs))), 1):
        own = W.partitionBy("lang", *([F.pmod(F.xxhash64("phrase"), F.lit(parts))] if parts > 1 else [])).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        first = first.withColumn("rank", F.row_number().over(own).cast("long")).filter(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
