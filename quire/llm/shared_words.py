"""Passages of successive words that the text of another row holds too, whatever their length in bytes.

A window is PASSAGE successive words. Successive windows of a text with one anchor, the smallest hash of the GRAM words inside
them, make a region, so equal windows lie in regions of one anchor. Only anchors of two rows are looked at further. A region that two
rows hold is settled by that. Windows are only given out for anchors whose regions differ, once for each different region.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, having, join_groups
from .words import _power, chunks, minima, mix, words

PASSAGE, GRAM = 51, 8
#: Words of a long text that are looked at together, under 2 ** 24.
PIECE = 1 << 22
#: Stands for the other row of a text that several rows hold; no hash of a text does.
COPY = (1 << 63) - 1


def regions(data: np.ndarray, bounds: np.ndarray, size: int = PASSAGE, gram: int = GRAM):
    """((row, anchor, region, first window, number of windows) of each region, hash of the window from each word on)."""
    hashed, _, _, ends = words(data, bounds, lower=False)
    n = len(hashed)
    if n < size:
        return (np.zeros(0, np.int64),) * 5, np.zeros(0, np.int64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashed * up[:n], out=total[1:])
    between = lambda a, b: mix(((total[b] - total[a]) * down[a]) ^ ((b - a).astype(np.uint64) << np.uint64(40)))
    at = np.arange(n - gram + 1)
    grams, at = between(at, at + gram), at[: n - size + 1]
    windows = between(at, at + size).view(np.int64)
    parts = []
    for k in range(0, len(windows), PIECE):
        part = grams[k : k + PIECE + size - gram]
        low = minima((part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64), size - gram + 1)
        where, start = (low & np.uint64(0xFFFFFF)).astype(np.int64) + k, np.arange(len(low)) + k
        row = np.searchsorted(ends, start, "right") - 1
        inside = start + size <= ends[row + 1]
        where, start, row = where[inside], start[inside], row[inside]
        if len(where):
            new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (row[1:] != row[:-1])])
            first, last = start[new], start[np.r_[new[1:], len(where)] - 1]
            parts.append((row[new], grams[where[new]].view(np.int64), between(first, last + size).view(np.int64), first, last - first + 1))
    return (tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5), windows


def _region_rows(size: int, gram: int):
    def over(batches):
        for batch in batches:
            text = batch.column(0).to_numpy()
            for i, _, data, bounds in chunks(batch.column(1)):
                (row, anchor, region, _, many), _ = regions(data, bounds, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (text[i + row], anchor, region, many)], names=["text", "anchor", "region", "windows"])

    return over


def _window_rows(size: int, gram: int):
    """(window, region, text, other) of each window of the wanted regions; rows are text, body and the list of these (region, other)."""

    def over(batches):
        for batch in batches:
            text, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for i, j, data, bounds in chunks(batch.column(1)):
                (row, _, region, first, many), windows = regions(data, bounds, size, gram)
                part, out = np.searchsorted(row, np.arange(j - i + 1)), []
                for r, a, b in zip(range(i, j), part, part[1:], strict=False):
                    other = {w["region"]: w["other"] for w in wanted[r]}
                    for own, k in zip(*(x.tolist() for x in np.unique(region[a:b], return_index=True)), strict=True):
                        if own in other:
                            m = int(many[a + k])
                            out.append((windows[first[a + k] : first[a + k] + m], np.full(m, own), np.full(m, text[r]), np.full(m, other[own])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["window", "region", "text", "other"])

    return over


def shared_windows(docs: DataFrame, copies: DataFrame, size: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """How many windows of each text another row holds too: (text, n_shared), only texts that have any.

    docs are (text, body), where text is a number of the body that equal bodies share; copies are (text, copies) of all texts. Words are
    compared as they are written, white space between them is not. A window's places in one text count each.
    """
    made = cut(docs.select("text", "body").mapInArrow(_region_rows(size, gram), "text long, anchor long, region long, windows long"))
    total = max(1, made.count())
    several = copies.filter("copies > 1").select("text", F.lit(COPY).alias("copy"))
    made = made.join(several, "text", "left").withColumn("other", F.coalesce("copy", "text")).drop("copy")
    met = made.groupBy("anchor").agg(F.count("*").alias("places"), F.min("text").alias("low"), F.max("other").alias("high"))
    met = met.filter("low < high").select("anchor", "places")
    made = cut(join_groups(made, met, "anchor", "places", total).drop("places"))
    each = made.groupBy("anchor", "region")
    known = cut(each.agg(F.min("text").alias("text"), F.max("other").alias("other"), F.max("windows").alias("windows"), F.count("*").alias("places")))
    lone = F.col("text") == F.col("other")
    mixed = known.groupBy("anchor").agg(F.count("*").alias("regions"), F.max(lone).alias("open")).filter("regions > 1 AND open").select("anchor", "regions")
    wanted = cut(join_groups(known, mixed, "anchor", "regions", max(1, known.count())).groupBy("text").agg(F.collect_list(F.struct("region", "other")).alias("wanted")))
    bodies = having(docs, wanted.select("text"), "text").dropDuplicates(["text"]).join(wanted, "text")  # copies meet where they are read
    windows = cut(bodies.select("text", "body", "wanted").mapInArrow(_window_rows(size, gram), "window long, region long, text long, other long"))
    again = windows.groupBy("window").agg(F.count("*").alias("places"), F.min("text").alias("low"), F.max("other").alias("high")).filter("low < high").select("window", "places")
    found = join_groups(windows.filter(lone), again, "window", "places", max(1, windows.count())).groupBy("region").agg(F.count("*").alias("n"))
    whole = known.filter(~lone).select("region", "places", F.col("windows").alias("n"))
    some = cut(whole.unionByName(known.select("region", "places").join(found, "region")))
    shared = join_groups(made.select("text", "region"), some, "region", "places", total).groupBy("text").agg(F.sum("n").alias("n"))
    return cut(shared.join(copies, "text").select("text", F.expr("n div copies").alias("n_shared")))
