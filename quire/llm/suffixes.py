"""Removal of repeated byte strings by suffix arrays.

A string of WIDTH bytes is dealt to the task of its anchor, the smallest hash of the GRAM-byte strings inside it, so equal
strings meet and a suffix array is only needed among strings that share an anchor with others. A task sorts its strings
in two stages: directly those that are smaller than their successors, and all others by scans over the buckets of the
first byte, as each one's order follows from its successor's. Neighbours in the array with a common prefix of WIDTH
bytes are repeats.

Successive strings with one anchor make a region. Equal regions of a frequent anchor are settled by the task that reads them.
What is left of its regions is compared with one of them, byte by byte from the anchor on: strings inside what both have in
common are repeats. The others are dealt by where and with which byte they depart from it, until few enough meet for a
suffix array.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, having, join_groups
from .shared_words import shared_windows
from .words import _power, chunks, minima, mix

WIDTH, GRAM = 400, 64
#: Strings that one suffix array sorts; successive small groups share one.
STRINGS = 64_000
#: Regions of one anchor that a suffix array sorts; those of a more frequent one are dealt more finely first.
MOST_REGIONS = 1024
#: Texts whose spans a task holds before it gives them out.
MARKED_TEXTS = 50_000
#: Different regions of frequent anchors that a task holds, to settle equal ones where they are read.
HELD_REGIONS = 20_000
#: Bytes of a long text that are looked at together, under 2 ** 24.
PIECE = 1 << 22


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    n = len(data)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[1 : n + 1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def anchors(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(row, anchor, first start, last start) of each run of strings with the same anchor; starts count from the row's start."""
    parts = []
    piece = max(PIECE, 2 * width)
    for at in range(0, max(1, len(data) - width + 1), piece):
        part = data[at : at + piece + width - 1]
        if len(part) < width:
            continue
        hashed = _grams(part, gram)
        low = minima((hashed & ~np.uint64(0xFFFFFF)) | np.arange(len(hashed), dtype=np.uint64), width - gram + 1)
        start = np.arange(len(low)) + at
        row = np.searchsorted(bounds, start, "right") - 1
        inside = start + width <= bounds[row + 1]
        where, start, row = (low[inside] & np.uint64(0xFFFFFF)).astype(np.int64), start[inside], row[inside]
        if len(where):
            new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (row[1:] != row[:-1])])
            last = np.r_[new[1:], len(where)] - 1
            parts.append((row[new], hashed[where[new]].view(np.int64), start[new] - bounds[row[new]], start[last] - bounds[row[last]]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def sort_directly(text: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The starts `at` in the order of the bytes from each on to its end; what ends sooner goes before what it begins.

    Eight bytes are compared at once, and only starts that agree so far are looked at further, so no string is copied.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(text) + 1]
    mask = np.array([0, *(((1 << 8 * r) - 1) << 8 * (8 - r) for r in range(1, 9))], np.uint64)
    size = ends - at
    order = np.argsort(size, kind="stable")
    at, size = at[order], size[order]
    slots, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, int(size.max(initial=0)), 8):
        key = word[np.minimum(at[slots] + depth, len(text))] & mask[np.clip(size[slots] - depth, 0, 8)]
        inside = group[1:] == group[:-1]
        mixed = np.zeros(int(group.max(initial=0)) + 1, bool)
        mixed[group[1:][inside & (key[1:] != key[:-1])]] = True
        some = mixed[group]
        if some.any():
            by, own = np.lexsort((key[some], group[some])), slots[some]
            at[own], size[own], key[some] = at[own][by], size[own][by], key[some][by]
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | ~inside])
        tied = np.bincount(group)[group] > 1
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
    return at


def two_stage(text: np.ndarray, spans: list[tuple[int, int]], width: int) -> np.ndarray:
    """The starts in `spans` (first, end of the starts; each followed by width - 1 more bytes) in the order of the `width` bytes from them on."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=256)).astype(np.int8)
    # equal bytes go as the next unequal ones do
    nxt = np.where(step != 0, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    rises = step[nxt] > 0
    rise_at = np.flatnonzero(rises)
    member, first = np.zeros(n, bool), np.zeros(n + 1, bool)
    wanted = np.zeros(n, bool)
    for a, b in spans:
        k = np.searchsorted(rise_at, b - 1)
        stop = b + width - 1
        end = int(rise_at[k]) + 1 if k < len(rise_at) else n + 1  # on to one that is sorted directly
        if end > stop:  # none until the text ends: its last run of one byte is
            run = np.flatnonzero(text[a:stop] != text[stop - 1])
            end = stop
            rises[a + (run[-1] + 1 if len(run) else 0) : stop] = True
        member[a:end] = True
        wanted[a:b] = True
        first[a] = True
    direct = np.flatnonzero(member & rises)
    ends = np.empty(n, np.int32)
    for a, b in spans:
        ends[a : min(n, b + width - 1)] = b + width - 1
    direct = sort_directly(text, direct, np.minimum(direct + width, ends[direct]))
    own = text[direct]
    order = np.argsort(own, kind="stable")
    direct, own = direct[order], own[order]
    cuts = np.searchsorted(own, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    follows = member & ~first[:n]  # the byte before is of the same span
    for c in range(256):
        waves = [np.concatenate(pending[c])] if pending[c] else []
        while waves and len(waves[-1]):  # runs of one byte
            x = waves[-1]
            x = x[follows[x]] - 1
            waves.append(x[text[x] == c])
        bucket = np.concatenate([*waves, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        x = bucket[follows[bucket]] - 1
        x = x[(text[x] > c) & ~rises[x]]
        if len(x):
            by = np.argsort(text[x], kind="stable")
            x = x[by]
            new = np.flatnonzero(np.r_[True, text[x][1:] != text[x][:-1]])
            for a, b in zip(new, [*new[1:], len(x)], strict=True):
                pending[text[x[a]]].append(x[a:b])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeats(regions: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each region, which of its strings of `width` bytes stand elsewhere in these regions too; equal regions are sorted once."""
    seen: dict[bytes, int] = {}
    count: list[int] = []
    kind = []
    for r in regions:
        i = seen.setdefault(r, len(count))
        if i == len(count):
            count.append(0)
        count[i] += 1
        kind.append(i)
    text = np.frombuffer(b"".join(seen), np.uint8)
    starts = np.cumsum([0, *map(len, seen)])
    order = two_stage(text, [(int(a), int(b) - width + 1) for a, b in zip(starts[:-1], starts[1:], strict=True)], width)
    body = text.tobytes()
    again = np.zeros(len(text), bool)
    at = order.tolist()
    same = np.fromiter((body[a : a + width] == body[b : b + width] for a, b in zip(at, at[1:])), bool, max(0, len(at) - 1))
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return [np.ones(len(r) - width + 1, bool) if count[i] > 1 else again[starts[i] : starts[i + 1] - width + 1] for r, i in zip(regions, kind, strict=True)]


def covered(mask: np.ndarray, at: int, width: int) -> list[tuple[int, int]]:
    """The byte spans that the marked starts cover."""
    hit = np.flatnonzero(mask)
    if not len(hit):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(hit) > width])
    return [(at + int(hit[a]), at + int(hit[b - 1]) + width) for a, b in zip(new, [*new[1:], len(hit)], strict=True)]


def _anchor_rows(width: int, gram: int):
    def over(batches):
        for batch in batches:
            size, lists = [], ([], [], [])
            for i, j, data, bounds in chunks(batch.column(2)):
                row, *found = anchors(data, bounds, width, gram)
                part = np.searchsorted(row, np.arange(j - i + 1))
                size.extend(np.diff(bounds).tolist())
                for out, x in zip(lists, found, strict=True):
                    out.extend(x[a:b] for a, b in zip(part, part[1:]))
            columns = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))) for x, t in zip(lists, (np.int64, np.int32, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), *columns], names=["doc_id", "sha", "n_bytes", "anchor", "first", "last"])

    return over


REGION_NAMES, REGION_TYPES = ["key", "tk", "first", "off", "body"], (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
REGION = "key long, tk binary, first int, off int, body binary"


def _region_rows(width: int):
    """(anchor, tk, first, 0, body) of each hit of a text; rows are tk, text and the list of hits."""

    def over(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for tk, text, hits in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                body, tk = (text.as_py() or "").encode(), tk.as_py()
                for h in hits:
                    part = body[h["first"] : h["last"] + width]
                    for x, v in zip(out, (h["anchor"], tk, h["first"], 0, part), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, REGION_TYPES, strict=True)], names=REGION_NAMES)

    return over


MARKED_NAMES, MARKED_TYPES = [*REGION_NAMES, "lo", "hi"], (*REGION_TYPES, pa.int64(), pa.int64())
MARKED = f"{REGION}, lo long, hi long"


def _given(columns):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, MARKED_TYPES, strict=True)], names=MARKED_NAMES)


def _given_marks(marks: dict):
    """Rows of the repeated spans of each text, joined as far as they came to this task."""
    spans = [(tk, a, b) for tk, own in marks.items() for a, b in merged(own)]
    none = [None] * len(spans)
    return _given([none, [x[0] for x in spans], none, none, none, [x[1] for x in spans], [x[2] for x in spans]])


def _distinct_region_rows(width: int, gram: int):
    """Like _region_rows, but regions of a task that are equal byte by byte are settled there: each one's bytes are a span (tk, lo, hi),
    and only the first goes on as a region, to be compared with those of other tasks. off is how far the anchor lies
    behind the region's start."""

    def over(batches):
        seen: dict[tuple[int, bytes], tuple] = {}
        marks: dict[bytes, set] = {}
        for batch in batches:
            out = tuple([] for _ in MARKED_NAMES)
            for tk, text, hits in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                body, tk = (text.as_py() or "").encode(), tk.as_py()
                for h in hits:
                    at = (tk, h["first"], h["last"] + width)
                    part = body[at[1] : at[2]]
                    other = seen.setdefault((h["anchor"], part), at)
                    if other is not at:
                        for there, a, b in (other, at):
                            marks.setdefault(there, set()).add((a, b))
                        continue
                    for x, v in zip(out, (h["anchor"], tk, h["first"], _place(part, width, gram), part, None, None), strict=True):
                        x.append(v)
                    if len(seen) >= HELD_REGIONS:
                        seen = {}
                if len(marks) > MARKED_TEXTS:
                    yield _given_marks(marks)
                    marks = {}
            yield _given(out)
        yield _given_marks(marks)

    return over


def _place(body: bytes, width: int, gram: int) -> int:
    """Where the anchor of the first string of a region lies."""
    hashed = _grams(np.frombuffer(body, np.uint8, width), gram)
    return int(np.argmin((hashed & ~np.uint64(0xFFFFFF)) | np.arange(len(hashed), dtype=np.uint64)))


def _common(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if a[:n] != b[:n] else ()
    return int(differ[0]) if len(differ) else n


def compared(key: int, off: int, body: bytes, other_off: int, other: bytes, width: int):
    """What a region's comparison with another one of its key settles and leaves: ((first, end) of the strings that both have or None,
    [(key, first, end) of the others that depart before the anchor, and behind it]). Strings count from the region's start.

    A string lies o bytes before the anchor. Equal strings of two regions depart from the third at the same place with the
    same byte, so they get the same key.
    """
    strings = len(body) - width + 1
    left, right = _common(body[:off][::-1], other[:other_off][::-1]), _common(body[off:], other[other_off:])
    # by o: from off - strings + 1 to off
    low, high = off - strings + 1, off
    both = max(low, width - right), min(high, left)
    parts = []
    for kind, a, b, at in (("before", max(low, left + 1), high, off - left - 1), ("behind", low, min(high, left, width - right - 1), off + right)):
        if a <= b:
            made = hashlib.blake2b(b"%d %s %d %d" % (key, kind.encode(), at - off, body[at]), digest_size=8).digest()
            parts.append((int.from_bytes(made, "little", signed=True), off - b, off - a + 1))
    return ((off - both[1], off - both[0] + 1) if both[0] <= both[1] else None), parts


def _compared_rows(width: int):
    """Rows (key, tk, first, off, body, other) against the region `other` of their key: what is left of them as regions, and
    spans (tk, lo, hi) of repeated bytes, also of the other's text."""

    def over(batches):
        marks: dict[bytes, set] = {}
        for batch in batches:
            out = tuple([] for _ in MARKED_NAMES)
            for key, tk, first, off, body, other in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (tk, first) == (other["tk"], other["first"]):
                    continue  # whatever it has in common with another one is found there
                both, parts = compared(key, off, body, other["off"], other["body"], width)
                rows = [(k, tk, first + a, off - a, body[a : b + width - 1], None, None) for k, a, b in parts]
                if both:
                    a, b = both
                    there = other["first"] + a - off + other["off"]
                    marks.setdefault(tk, set()).add((first + a, first + b + width - 1))
                    marks.setdefault(other["tk"], set()).add((there, there + b - a + width - 1))
                for row in rows:
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
            yield _given(out)
            if len(marks) > MARKED_TEXTS:
                yield _given_marks(marks)
                marks = {}
        yield _given_marks(marks)

    return over


def _sorted(regions: DataFrame, width: int) -> DataFrame:
    """The spans (tk, lo, hi) of repeated bytes among regions whose keys are not frequent."""
    dealt = regions.select("key", "tk", "first", "body").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_sorted_groups(width), "tk binary, lo long, hi long")


def _frequent(found: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """The spans (tk, lo, hi) of repeated bytes among the regions of frequent anchors; rows are tk, text and the list of hits.

    Equal regions are settled where they are read, so of a line that a text repeats many times few are shuffled. In each round a key's regions are compared with one of them, taken by hash, which is settled by that; keys of what is
    left that have no more than `most` regions go to suffix arrays. Strings of a key have one more byte in common after
    each round, so rounds end.
    """
    made, spans = cut(found.mapInArrow(_distinct_region_rows(width, gram), MARKED)), []
    while True:
        spans.append(made.filter("lo IS NOT NULL").select("tk", "lo", "hi").distinct())
        now = made.filter("lo IS NULL").select(*REGION_NAMES)
        total = max(1, now.count())
        other = F.min_by(F.struct("tk", "first", "off", "body"), F.xxhash64("tk", "first")).alias("other")
        keys = cut(now.groupBy("key").agg(F.count("*").alias("regions"), other).filter("regions > 1"))
        few, many = keys.filter(F.col("regions") <= most).drop("other"), keys.filter(F.col("regions") > most)
        spans.append(_sorted(join_groups(now, few, "key", "regions", total), width))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, spans)
        met = join_groups(now, many, "key", "regions", total).select(*REGION_NAMES, "other")
        made = cut(met.mapInArrow(_compared_rows(width), MARKED))


def _sorted_groups(width: int):
    """Regions (key, tk, first, body) sorted by key in, spans (tk, lo, hi) of repeated bytes out."""

    def made(held):
        if not held:
            return None
        spans = [(tk, a, b) for (_, tk, at, _), m in zip(held, repeats([h[3] for h in held], width), strict=True) for a, b in covered(m, at, width)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*spans, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["tk", "lo", "hi"]) if spans else None

    def over(batches):
        held, strings, last = [], 0, None
        for batch in batches:
            for anchor, tk, at, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if strings >= STRINGS and anchor != last:
                    if (got := made(held)) is not None:
                        yield got
                    held, strings = [], 0
                held.append((anchor, tk, at, body))
                strings, last = strings + len(body) - width + 1, anchor
        if (got := made(held)) is not None:
            yield got

    return over


def _removed():
    """What is left of each text (tk, text, spans): (tk, n_removed, n_spans, kept_sha256, spans)."""

    def over(batches):
        for batch in batches:
            out = []
            for tk, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body, runs = (text or "").encode(), merged((s["lo"], s["hi"]) for s in spans)
                kept = hashlib.sha256()
                for (_, a), (b, _) in zip([(0, 0), *runs], [*runs, (len(body), 0)], strict=True):
                    kept.update(body[a:b])
                out.append({"tk": tk, "n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": kept.hexdigest(), "runs": [{"lo": a, "hi": b} for a, b in runs]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("tk", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]))

    return over


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_regions: int = MOST_REGIONS) -> DataFrame:
    """Every document with its repeated bytes: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats, n_shared, runs).

    A byte is repeated if a string of `width` bytes that covers it starts anywhere else too, in another or the same
    document; strings are judged on the input. Null counts as empty; texts under `width` bytes keep all. A text that
    stands in two rows, also of one doc_id, is repeated as a whole. runs are the removed spans (lo, hi) in bytes; has_repeats
    tells whether there are any, so whether anything of the document goes. n_shared is the number of places from which on 51
    successive words stand in the text of another row too: passages that may have too few bytes to be removed.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), body.alias("text"))
    short = F.substring("sha", 1, 16)  # the key of a text
    rows = cut(keyed.mapInArrow(_anchor_rows(width, gram), "doc_id long, sha binary, n_bytes long, anchor array<long>, first array<int>, last array<int>")).withColumn("tk", short)
    keyed = keyed.withColumn("tk", short)
    total = rows.count()
    classes = cut(rows.groupBy("tk").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first(F.arrays_zip("anchor", "first", "last")).alias("strings")))
    runs = classes.select("tk", F.explode("strings").alias("s")).select("tk", "s.*")
    met = runs.groupBy("anchor").agg(F.count("*").alias("regions")).filter("regions > 1")
    hits = cut(join_groups(runs, met, "anchor", "regions", max(1, total)).groupBy("tk").agg(F.collect_list(F.struct("anchor", "first", "last", "regions")).alias("hits")))
    texts = having(keyed, hits.select("tk"), "tk")
    found = texts.select("tk", "text").dropDuplicates(["tk"]).join(hits, "tk")  # copies meet where they are read
    some = lambda which: found.select("tk", "text", F.filter("hits", which).alias("hits")).filter(F.size("hits") > 0)
    spans = _sorted(some(lambda h: h["regions"] <= most_regions).mapInArrow(_region_rows(width), REGION), width)
    if not met.filter(F.col("regions") > most_regions).isEmpty():
        spans = spans.unionByName(_frequent(some(lambda h: h["regions"] > most_regions), width, gram, most_regions))
    each = cut(spans.groupBy("tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    again = having(keyed, each.select("tk"), "tk").select("tk", "text").dropDuplicates(["tk"]).join(each, "tk")
    left = cut(again.select("tk", "text", "spans").mapInArrow(_removed(), "tk binary, n_removed long, n_spans long, kept_sha256 string, runs array<struct<lo:long,hi:long>>"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    zero, number = F.lit(0).cast("long"), F.xxhash64("tk")
    shared = shared_windows(keyed.select(number.alias("text"), F.col("text").alias("body")), classes.select(number.alias("text"), "copies"))
    known = classes.select("tk", "copies", "n_bytes", number.alias("number")).join(left, "tk", "left").join(shared.withColumnRenamed("text", "number"), "number", "left").select(
        "tk", "copies",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("some"),
        F.coalesce("n_shared", zero).alias("n_shared"),
        F.when(whole, F.array(F.struct(zero.alias("lo"), F.col("n_bytes").alias("hi")))).otherwise(F.coalesce("runs", F.array().cast("array<struct<lo:long,hi:long>>"))).alias("runs"),
    )
    out = join_groups(rows.select("doc_id", "n_bytes", "sha", "tk"), known, "tk", "copies", max(1, total))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("some", F.lower(F.hex("sha"))).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), "n_shared", "runs")
