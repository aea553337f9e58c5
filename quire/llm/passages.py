"""Near-duplicate passages by compact windows.

Tokens are 5-word shingles. Under each of several hash functions, a text's Cartesian tree by token hash has a node for each
token that is the smallest of its surroundings; a node that spans at least WIDTH tokens is a compact window (l, c, r):
every subsequence inside l to r that holds c has c's hash as its min-hash. Windows of different texts with the same hash
are joined, and what both spans hold on the same side of c is compared token by token. What agrees are intervals of two
texts; those that overlap, across windows and hash functions, are joined to passages.

Each window is compared with the first of its list. Windows that do not agree with it are compared with all others of the
list that share enough tokens beside their centre, unless they lie in a passage and in a component with it already. These are found by the rarest
of the tokens, so windows with nothing in common but the hash are not paired; only lists of more than BLOCK windows are cut into blocks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NAMELESS, cut, grouped, having, join_groups, nameless
from .graph import components
from .words import chunks, minima, mix, shingles, words

SHINGLE, PASSAGE_WORDS, PERCENT = 5, 50, 80
#: Tokens of the shortest passage.
WIDTH = PASSAGE_WORDS - SHINGLE + 1
SEEDS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))
#: Words by which tokens may shift between c and their place in the other window.
SHIFT = 8
#: Tokens that WIDTH successive ones must have in common with the other window.
NEED = -(-2 * PERCENT * WIDTH // (100 + PERCENT))
#: Tokens of a window that are compared: passages of WIDTH that hold c lie within REACH of it.
REACH = WIDTH - 1
SPAN = 2 * REACH + 1
#: Windows of a list that one task compares with as many others.
BLOCK = 4096
#: Pairs of windows that are compared at once.
PAIRS = 4096
#: Pairs of windows that a rare token may bring together at once.
MET = 1 << 19
#: Pairs up to which windows are compared without looking for rare tokens.
FEW = 128


def tree_nodes(tokens: np.ndarray, whole: np.ndarray, row: np.ndarray, seed: np.uint64, width: int = WIDTH):
    """(c, l, r) of the nodes of the Cartesian trees by hash that span `width` tokens or more. row: each token's text; whole: tokens
    that lie in one text. Windows never cross texts. Of a run of one token, only the first and the last node stay."""
    none = np.zeros(0, np.int64)
    if len(tokens) < width:
        return none, none, none
    low = np.uint64(0xFFFFFF)
    ranked = (mix(tokens ^ seed) & ~low) | np.arange(len(tokens), dtype=np.uint64)
    inside = np.cumsum(np.r_[0, whole])
    at = (minima(ranked, width) & low).astype(np.int64)[inside[width:] - inside[:-width] == width]
    if not len(at):
        return none, none, none
    at = at[np.r_[True, at[1:] != at[:-1]]]
    # the next smaller token of such a node is such a node itself, so the others need not be looked at
    first = np.searchsorted(row, row[at], "left")
    last = first + inside[np.searchsorted(row, row[at], "right")] - inside[first]  # whole tokens come first in a text
    left, right = first.tolist(), (last - 1).tolist()
    places, ranks, texts = at.tolist(), ranked[at].tolist(), row[at].tolist()
    stack: list[int] = []
    for i, c in enumerate(places):
        if stack and texts[stack[-1]] != texts[i]:
            stack = []
        while stack and ranks[stack[-1]] > ranks[i]:
            right[stack.pop()] = c - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    c, left, right = at, np.array(left), np.array(right)
    run = np.r_[False, (c[1:] == c[:-1] + 1) & (tokens[c[1:]] == tokens[c[:-1]])]
    ends = ~(run & np.r_[run[1:], False])
    return c[ends], left[ends], right[ends]


def _signature(tokens: np.ndarray, i: int) -> np.ndarray:
    """Hash i of the tokens; its two lowest bits are i."""
    return ((mix(tokens ^ SEEDS[i]) & ~np.uint64(3)) | np.uint64(i)).view(np.int64)


def _windows(batches):
    """doc_id, cid, text in; doc_id, cid, number of words and the windows out: signature, c, and how far l and r lie from c, REACH at most."""
    for batch in batches:
        n, lists = [], ([], [], [], [])
        for i, j, data, bounds in chunks(batch.column(2)):
            hashed, _, _, wb = words(data, bounds)
            tokens, whole = shingles(hashed, wb, SHINGLE)
            row = np.repeat(np.arange(j - i), np.diff(wb))
            found = [tree_nodes(tokens, whole, row, s) for s in SEEDS]
            c, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            value = np.concatenate([_signature(tokens[x[0]], i) for i, x in enumerate(found)])
            order = np.argsort(c, kind="stable")
            c, value, left, right = c[order], value[order], left[order], right[order]
            part = np.searchsorted(c, wb)
            n.extend(np.diff(wb).tolist())
            made = value, (c - np.repeat(wb[:-1], np.diff(part))).astype(np.int32), np.minimum(c - left, REACH).astype(np.int32), np.minimum(right - c, REACH).astype(np.int32)
            for out, x in zip(lists, made, strict=True):
                out.extend(x[a:b] for a, b in zip(part, part[1:]))
        columns = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in zip(lists, (np.int64, np.int32, np.int32, np.int32), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *columns], names=["doc_id", "cid", "n_words", "value", "c", "before", "behind"])


def near_tokens(tokens: np.ndarray, c: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The tokens of windows as rows of SPAN 32-bit hashes, c in the middle; 0 outside of the window."""
    short = (tokens >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    place = np.arange(-REACH, REACH + 1)
    inside = (place >= -before[:, None]) & (place <= behind[:, None])
    return np.where(inside, short[np.clip(c[:, None] + place, 0, len(short) - 1)], np.uint32(0))


def _entries(batches):
    """cid, text and a list of windows (value, c, before, behind, df, leads) in; a row for each, with its tokens, out."""
    for batch in batches:
        out = tuple([] for _ in ENTRY_NAMES)
        own = batch.column(2)
        fields = [own.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(6)]
        ends = own.value_lengths().to_numpy().cumsum()
        cids = batch.column(0).to_numpy()
        row = 0
        for i, j, data, bounds in chunks(batch.column(1)):
            hashed, _, _, wb = words(data, bounds)
            tokens, _ = shingles(hashed, wb, SHINGLE)
            for k in range(i, j):
                a, b = (ends[k - 1] if k else 0), ends[k]
                value, c, before, behind, df, leads = (f[a:b] for f in fields)
                near = near_tokens(tokens[wb[k - i] : wb[k - i + 1]], c, before, behind)
                for x, v in zip(out, (value, np.full(b - a, cids[k]), c, before, behind, df, leads, near), strict=True):
                    x.append(v)
                row += b - a
        if row:
            *plain, near = (np.concatenate(x) for x in out)
            size = 4 * SPAN
            packed = pa.Array.from_buffers(pa.binary(), len(near), [None, pa.py_buffer((np.arange(len(near) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(near))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in plain), packed], names=ENTRY_NAMES)


ENTRY_NAMES = ["value", "cid", "c", "before", "behind", "df", "leads", "near"]
ENTRY = "value long, cid long, c int, before int, behind int, df long, leads boolean, near binary"


def _near(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SPAN)


def agreement(a: np.ndarray, b: np.ndarray, a_before, a_behind, b_before, b_behind):
    """For pairs of windows, row by row: (whether they agree, first and end of what agrees in a and in b, where the best WIDTH tokens of a
    and of b begin, whether what agrees is the same on both sides). Places count from c.

    They agree if WIDTH successive tokens of each that hold c have NEED or more in common with the other's, SHIFT or fewer places
    from where they would stand. What agrees begins and ends with tokens in common.
    """
    hit = [np.zeros(a.shape, bool), np.zeros(b.shape, bool)]
    for s in range(-SHIFT, SHIFT + 1):
        x, y = slice(max(0, -s), SPAN - max(0, s)), slice(max(0, s), SPAN - max(0, -s))
        same = (a[:, x] == b[:, y]) & (a[:, x] != 0)
        hit[0][:, x] |= same
        hit[1][:, y] |= same
    start, place = np.arange(REACH + 1), np.arange(SPAN)
    ok, found, best = np.ones(len(a), bool), [], []
    for h, before, behind in ((hit[0], a_before, a_behind), (hit[1], b_before, b_behind)):
        total = np.concatenate([np.zeros((len(a), 1), np.int16), np.cumsum(h, axis=1, dtype=np.int16)], axis=1)
        count = total[:, WIDTH:] - total[:, :-WIDTH]
        count = np.where((start >= REACH - before[:, None]) & (start <= behind[:, None]), count, 0)
        good = count >= NEED
        ok &= good.any(axis=1)
        first, end = good.argmax(axis=1), REACH - good[:, ::-1].argmax(axis=1) + WIDTH
        inside = h & (place >= first[:, None]) & (place < end[:, None])
        first, end = inside.argmax(axis=1), SPAN - inside[:, ::-1].argmax(axis=1)
        found += [first - REACH, end - REACH]
        best.append(count.argmax(axis=1) - REACH)
    a0, a1, b0, b1 = found
    there = np.clip(place + (b0 - a0)[:, None], 0, SPAN - 1)
    apart = (a != np.take_along_axis(b, there, axis=1)) & (place >= (a0 + REACH)[:, None]) & (place < (a1 + REACH)[:, None])
    return ok, *found, *best, (a1 - a0 == b1 - b0) & ~apart.any(axis=1)


SPAN_NAMES = ["a0", "a1", "b0", "b1", "a_best", "b_best", "same"]
SPANS = "leader long, cid long, a0 long, a1 long, b0 long, b1 long, a_best long, b_best long, same boolean"


def _placed(found, a, b) -> list:
    """What agreement() finds, counted from the texts' first tokens; a and b are the places of c."""
    return [x + y for x, y in zip(found[:6], (a, a, b, b, a, b), strict=True)] + [found[6]]


def _against_leader(batches):
    """Windows beside the leading window of their list in: spans of those that agree out, and (value, cid, c) of those that do not."""
    for batch in batches:
        g = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        n = {k: g[k].to_numpy() for k in ("value", "cid", "c", "before", "behind", "l_cid", "l_c", "l_before", "l_behind")}
        ok, *found = agreement(_near(g["l_near"]), _near(g["near"]), n["l_before"], n["l_behind"], n["before"], n["behind"])
        columns = [n["value"], n["c"].astype(np.int64), n["l_cid"], n["cid"], *_placed(found, n["l_c"], n["c"])]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(ok)], names=["value", "c", "leader", "cid", *SPAN_NAMES, "ok"])


#: Tokens next to c on one side that lie in any WIDTH successive ones that hold c and reach at least as far to that side as to the other.
BESIDE = (WIDTH - 1) // 2


#: Of these, how many must be among the other window's on that side, SHIFT places around.
SHARED = BESIDE - (WIDTH - NEED)
SIDES = ((REACH - BESIDE, REACH), (REACH + 1, REACH + 1 + BESIDE))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of a may agree with the same row of b: of the BESIDE tokens on one side of a's c SHARED or more are among b's on that side, SHIFT places around."""
    out = np.zeros(len(a), bool)
    for lo, hi in SIDES:
        own, there = a[:, lo:hi], b[:, lo - SHIFT : hi + SHIFT]
        out |= ((own[:, :, None] == there[:, None, :]).any(axis=2) & (own != 0)).sum(axis=1) >= SHARED
    return out


def _rarest(own: np.ndarray, there: np.ndarray):
    """For one side: (row of own, first, end) and rows of there, so that rows of there from first to end hold one of the rarest tokens of that row of own. Of the n tokens of a row
    n - SHARED may be missing, so one of any n - SHARED + 1 is held by each row that may agree."""
    r, c = np.nonzero(there)
    token = there[r, c]
    order = np.lexsort((r, token))
    token, r = token[order], r[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (r[1:] != r[:-1])][: len(r)]
    token, r = token[keep], r[keep]
    first, end = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
    held = np.where(own != 0, end - first, np.iinfo(np.int64).max)
    some = np.flatnonzero(((held > 0) & (own != 0)).sum(axis=1) >= SHARED)
    by = np.argsort(held[some], axis=1, kind="stable")[:, : BESIDE - SHARED + 1]
    used = np.arange(by.shape[1]) < ((own[some] != 0).sum(axis=1) - SHARED + 1)[:, None]
    row, at = np.repeat(some, by.shape[1])[used.ravel()], by.ravel()[used.ravel()]
    return row, first[row, at], end[row, at], r


def met_windows(a: np.ndarray, b: np.ndarray):
    """Pairs (rows of a, rows of b) in order, in parts of about MET: all that may agree, and others that share a rare token."""
    if len(a) * len(b) <= FEW:
        yield np.divmod(np.arange(len(a) * len(b)), len(b))
        return
    sides = [_rarest(a[:, lo:hi], b[:, lo - SHIFT : hi + SHIFT]) for lo, hi in SIDES]
    cost = sum(np.bincount(row, end - first, len(a)) for row, first, end, _ in sides)
    part = (np.cumsum(cost) // MET).astype(np.int64)
    for k in np.unique(part[cost > 0]):
        codes = []
        for row, first, end, there in sides:
            mine = part[row] == k
            size = end[mine] - first[mine]
            at = np.arange(size.sum()) + np.repeat(first[mine] - np.cumsum(size) + size, size)
            codes.append(np.repeat(row[mine], size) * len(b) + there[at])
        code = np.unique(np.concatenate(codes))
        yield code // len(b), code % len(b)


def may_agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of a and each of b may agree."""
    out = np.zeros((len(a), len(b)), bool)
    for i, j in met_windows(a, b):
        out[i, j] = alike(a[i], b[j])
    return out


def _in_blocks(g):
    """Open windows of a list (side 0, or 2 for those of both sides) against a block of all its windows (side 1): spans of a forest of those that agree."""
    side, cid, label, c = (g[k].to_numpy() for k in ("side", "cid", "label", "c"))
    before, behind = g["before"].to_numpy(), g["behind"].to_numpy()
    order = np.lexsort((c, cid))  # whatever the order in which rows arrive, the forest is the same
    x, y = order[side[order] != 1], order[side[order] != 0]
    if not len(x) or not len(y):
        return None
    near = _near(g["near"])
    root, out = np.arange(len(x) + len(y)), []

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = int(root[k])
        return k

    for i, j in met_windows(near[x], near[y]):
        some = (label[x[i]] != label[y[j]]) & (cid[x[i]] != cid[y[j]])
        i, j = i[some], j[some]
        for k in range(0, len(i), PAIRS):
            q, p = i[k : k + PAIRS], j[k : k + PAIRS]
            while (root[root] != root).any():
                root[:] = root[root]
            apart = root[q] != root[p + len(x)]  # those that are connected add nothing to the forest
            q, p = q[apart], p[apart]
            may = alike(near[x[q]], near[y[p]])
            q, p = q[may], p[may]
            if not len(q):
                continue
            s, t = x[q], y[p]
            ok, *found = agreement(near[t], near[s], before[t], behind[t], before[s], behind[s])
            found = _placed(found, c[t], c[s])
            for m in np.flatnonzero(ok).tolist():
                a, b = top(int(p[m]) + len(x)), top(int(q[m]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((cid[t[m]], cid[s[m]], *(v[m] for v in found)))
    return tuple(np.array(v) for v in zip(*out, strict=True)) if out else None


def islands(spans: DataFrame) -> DataFrame:
    """Spans of the same two texts (leader, cid) that lie within 2 * WIDTH tokens of each other in the leader's, as one row: (leader, cid, island,
    a0, a1, b0, b1, same, spans). same: all of them are the same on both sides, lie on one diagonal and leave no gap."""
    own = W.partitionBy("leader", "cid").orderBy("a0", "a1", "b0", "b1")
    reached = F.max("a1").over(own.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("reached", reached).withColumn("new", (F.coalesce("reached", F.lit(-3 * WIDTH)) + 2 * WIDTH < F.col("a0")).cast("int"))
    marked = marked.withColumn("whole", (F.col("new") == 1) | (F.col("a0") <= F.col("reached")))
    marked = marked.withColumn("island", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    slope = F.col("b0") - F.col("a0")
    return marked.groupBy("leader", "cid", "island").agg(
        *(F.min(x).alias(x) for x in ("a0", "b0")), *(F.max(x).alias(x) for x in ("a1", "b1")),
        (F.min("same") & F.min("whole") & (F.min(slope) == F.max(slope))).alias("same"), F.collect_list(F.struct("a0", "a1", "b0", "b1", "a_best", "b_best")).alias("spans"),
    )


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _grown(first: int, end: int, best: int, size: int) -> tuple[int, int]:
    """A span of WIDTH tokens or more: a shorter one becomes its best WIDTH tokens."""
    if end - first >= WIDTH:
        return first, end
    first = max(0, min(best, size - WIDTH))
    return first, min(size, first + WIDTH)


def passages_of(spans: list[tuple], a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """(a0, a1, b0, b1, similarity) of the passages that spans (a0, a1, b0, b1, a_best, b_best) make up: those that overlap on both sides
    are one passage if its Jaccard index is PERCENT or more; else each of them is one. The longest comes first, and none overlaps another on
    both sides.
    a and b: the tokens of both texts, as far as they are known; places count from their first."""
    made: list[tuple[list, list[tuple]]] = []
    for span in sorted(spans):
        for box, parts in reversed(made):
            if span[0] <= box[1] and box[0] <= span[1] and span[2] <= box[3] + SHIFT and box[2] <= span[3] + SHIFT:
                box[:] = [min(box[0], span[0]), max(box[1], span[1]), min(box[2], span[2]), max(box[3], span[3])]
                parts.append(span)
                break
        else:
            made.append((list(span[:4]), [span]))
    done: list[tuple] = []
    for box, parts in sorted(made, key=lambda m: (m[0][0] - m[0][1], m)):
        best = max(parts, key=lambda p: (min(p[1] - p[0], p[3] - p[2]), p))
        for span in [(*box, *best[4:]), *sorted(parts, key=lambda p: (p[0] - p[1], p))]:
            (a0, a1), (b0, b1) = _grown(span[0], span[1], span[4], len(a)), _grown(span[2], span[3], span[5], len(b))
            if any(a0 < q[1] and q[0] < a1 and b0 < q[3] and q[2] < b1 for q in done):
                continue
            like = jaccard(a[a0:a1], b[b0:b1])
            if 100 * like >= PERCENT:
                done.append((a0, a1, b0, b1, like))
    return done


#: Tokens that are fetched together for the spans that are not the same on both sides.
PIECE = 64


def _pieces(batches):
    """cid, text and the numbers of pieces of PIECE tokens in; a row for each piece that is not empty out."""
    for batch in batches:
        cids, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        rows = ([], [], [])
        for i, j, data, bounds in chunks(batch.column(1)):
            hashed, _, _, wb = words(data, bounds)
            tokens, whole = shingles(hashed, wb, SHINGLE)
            for k in range(i, j):
                own = (tokens[wb[k - i] : wb[k - i + 1]][whole[wb[k - i] : wb[k - i + 1]]] >> np.uint64(32)).astype(np.uint32)
                for x in wanted[k]:
                    if len(part := own[PIECE * x : PIECE * x + PIECE]):
                        for out, v in zip(rows, (cids[k], x, part.tobytes()), strict=True):
                            out.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["cid", "piece", "tokens"])


def _judged(batches):
    """leader, cid, spans and pieces (side, piece, tokens) of islands in; their passages out."""
    for batch in batches:
        rows = []
        for leader, cid, spans, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sides, starts = [], []
            for side in (0, 1):
                own = sorted((p["piece"], p["tokens"]) for p in pieces if p["side"] == side)
                starts.append(PIECE * own[0][0] if own else 0)
                sides.append(np.frombuffer(b"".join(t for _, t in own), np.uint32))
            p, q = starts
            for a0, a1, b0, b1, like in passages_of([(s["a0"] - p, s["a1"] - p, s["b0"] - q, s["b1"] - q, s["a_best"] - p, s["b_best"] - q) for s in spans], *sides):
                rows.append((leader, cid, a0 + p, a1 + p, b0 + q, b1 + q, like))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=PASSAGE_NAMES)


PASSAGE_NAMES = ["leader", "cid", "a0", "a1", "b0", "b1", "similarity"]


def verified_passages(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages (PASSAGE_NAMES) that the spans make up. What is the same on both sides needs no further look; of the others, the tokens
    around them are fetched in pieces from the texts (cid, text), and similarity is the Jaccard index of what is reported."""
    found = cut(islands(spans))
    long = F.col("a1") - F.col("a0") >= WIDTH
    sure = found.filter(F.col("same") & long).select("leader", "cid", "a0", "a1", "b0", "b1", F.lit(1.0).alias("similarity"))
    odd = found.filter(~(F.col("same") & long))
    piece = lambda lo, hi: F.sequence(F.floor(F.greatest(F.col(lo) - WIDTH, F.lit(0)) / PIECE), F.floor((F.col(hi) + WIDTH) / PIECE))
    side = lambda n, cid, lo, hi: F.transform(piece(lo, hi), lambda p: F.struct(F.lit(n).alias("side"), F.struct(F.col(cid).alias("cid"), p.alias("piece")).alias("at")))
    asked = cut(odd.select("leader", "cid", "island", F.explode(F.concat(side(0, "leader", "a0", "a1"), side(1, "cid", "b0", "b1"))).alias("w")).select("leader", "cid", "island", "w.*"))
    used = cut(asked.groupBy("at").agg(F.count("*").alias("uses")))
    wanted = used.groupBy("at.cid").agg(F.collect_list("at.piece").alias("pieces"))
    body = having(texts, wanted.select("cid"), "cid").dropDuplicates(["cid"]).join(wanted, "cid").select("cid", "text", "pieces")
    tokens = body.mapInArrow(_pieces, "cid long, piece long, tokens binary").select(F.struct("cid", "piece").alias("at"), "tokens").join(used, "at")
    held = join_groups(asked, cut(tokens), "at", "uses", max(1, asked.count()))
    held = held.groupBy("leader", "cid", "island").agg(F.collect_list(F.struct("side", F.col("at.piece").alias("piece"), "tokens")).alias("pieces"))
    judged = odd.select("leader", "cid", "island", "spans").join(held, ["leader", "cid", "island"]).select("leader", "cid", "spans", "pieces")
    return sure.unionByName(judged.mapInArrow(_judged, "leader long, cid long, a0 long, a1 long, b0 long, b1 long, similarity double"))


def _left(entries: DataFrame, open_: DataFrame, verified: DataFrame, total: int) -> DataFrame:
    """Spans of the open windows (value, cid, c, leader) with others of their lists. Those that lie in a passage and in a component
    with the list's leader are settled."""
    linked = cut(components(verified.select(F.col("leader").alias("a"), F.col("cid").alias("b"))).select(F.col("id").alias("cid"), "component"))
    sides = verified.select("cid", F.col("b0").alias("lo"), F.col("b1").alias("hi")).unionByName(verified.select(F.col("leader").alias("cid"), F.col("a0").alias("lo"), F.col("a1").alias("hi"))).distinct()
    own = W.partitionBy("cid").orderBy("lo", "hi")
    islands = sides.withColumn("new", (F.coalesce(F.max("hi").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) < F.col("lo")).cast("int")).withColumn("island", F.sum("new").over(own))
    islands = islands.groupBy("cid", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("cid").agg(F.collect_list(F.struct("lo", "hi")).alias("inside"))
    inside = F.coalesce(F.exists("inside", lambda x: (x["lo"] <= F.col("c")) & (F.col("c") < x["hi"])), F.lit(False))
    # a window in no passage has a label of its own
    known = entries.select("value", "cid", "c").join(open_.select("value").distinct(), "value", "left_semi").join(islands, "cid", "left").join(linked, "cid", "left")
    known = known.select("value", "cid", "c", F.when(inside, F.col("component")).otherwise(F.xxhash64("cid", "c", F.lit(7))).alias("label"))
    led = open_.join(linked.toDF("leader", "led"), "leader", "left").select("value", "cid", "c", "led", F.lit(True).alias("asked"))
    known = known.join(led, ["value", "cid", "c"], "left").withColumn("open", F.coalesce(F.col("asked") & (F.col("led").isNull() | (F.col("label") != F.col("led"))), F.lit(False)))
    known = cut(known.select("value", "cid", "c", "label", "open"))
    lists = known.groupBy("value").agg(F.count("*").alias("df"), F.count_if("open").alias("opened")).filter("opened > 0")
    lists = cut(lists.withColumn("opens", F.ceil(F.col("opened") / BLOCK).cast("int")).withColumn("blocks", F.ceil(F.col("df") / BLOCK).cast("int")))
    body = having(entries, lists.select("value"), "value").select("value", "cid", "c", "before", "behind", "near")
    every = join_groups(known, lists.select("value", "df", "opens", "blocks"), "value", "df", total)
    mark, zero, each = F.xxhash64("cid", "c"), F.lit(0), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a list of one block is dealt once; of others every window meets the blocks of open ones, and open ones those of all
    beside = F.transform(each("opens"), lambda o: F.struct(F.lit(1).alias("side"), F.pmod(mark, "blocks").cast("int").alias("block"), o.alias("opening")))
    own = F.transform(each("blocks"), lambda b: F.struct(zero.alias("side"), b.alias("block"), F.pmod(mark, "opens").cast("int").alias("opening")))
    once = F.array(F.struct(F.when(F.col("open"), 2).otherwise(1).alias("side"), zero.alias("block"), zero.alias("opening")))
    places = F.when(F.col("blocks") == 1, once).when(F.col("open"), F.concat(beside, own)).otherwise(beside)
    dealt = every.select("value", "cid", "c", "label", F.explode(places).alias("at")).select("value", "cid", "c", "label", "at.*").join(body, ["value", "cid", "c"])
    return cut(grouped(dealt, ["value", "opening", "block"], _in_blocks, SPANS))


def near_passages(docs: DataFrame) -> DataFrame:
    """The near-duplicate passages of all documents: (doc_id, first_word, n_words, near_doc_id, near_first_word, near_n_words,
    similarity, component_id).

    A row is a passage of at least PASSAGE_WORDS words of a document that another document has too: the Jaccard index of the sets of
    5-word shingles of both passages is PERCENT percent or more, and is their similarity. A document without such a passage has no row; one whose whole text, of
    that length, stands in other rows too has a row for it. component_id is the smallest doc_id that passages connect. Null and
    short texts have none; texts are told apart by a 64-bit digest. Rows with the same doc_id are one document. A text without
    doc_id takes part and links others; doc_ids lie under NAMELESS. An empty table gives no row; other columns are not read.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(F.sha2(body.cast("binary"), 256)).alias("cid"), body.alias("text"))
    listed = cut(keyed.mapInArrow(_windows, "doc_id long, cid long, n_words long, value array<long>, c array<int>, before array<int>, behind array<int>"))
    total = max(1, listed.count())
    rows = listed.select("doc_id", "cid", "n_words")
    classes = cut(rows.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min(F.coalesce("doc_id", nameless(F.col("cid")))).alias("vertex"), F.max("doc_id").alias("other"), F.count("*").alias("copies"), F.first("n_words").alias("n_words")))
    one = listed.filter(F.size("value") > 0).groupBy("cid").agg(F.first(F.arrays_zip("value", "c", "before", "behind")).alias("own"))
    windows = cut(one.select("cid", F.explode("own").alias("w")).select("cid", "w.*"))
    n_windows = max(1, windows.count())
    leaders = cut(windows.groupBy("value").agg(F.min(F.struct("cid", "c")).alias("first"), F.max("cid").alias("most"), F.count("*").alias("df")).filter("first.cid <> most").select("value", F.col("first.cid").alias("l_cid"), F.col("first.c").alias("l_c"), "df"))
    leads = (F.col("cid") == F.col("l_cid")) & (F.col("c") == F.col("l_c"))
    met = join_groups(windows, leaders, "value", "df", n_windows).withColumn("leads", leads)
    wanted = cut(met.groupBy("cid").agg(F.collect_list(F.struct("value", "c", "before", "behind", "df", "leads")).alias("own")))
    texts = having(keyed, wanted.select("cid"), "cid").select("cid", "text").dropDuplicates(["cid"])  # copies meet where they are read
    entries = cut(texts.join(wanted, "cid").select("cid", "text", "own").mapInArrow(_entries, ENTRY))
    first = entries.filter("leads").select("value", "df", *(F.col(x).alias(f"l_{x}") for x in ("cid", "c", "before", "behind", "near")))
    beside = join_groups(entries.filter("NOT leads").drop("df", "leads"), first, "value", "df", n_windows).filter("cid <> l_cid").drop("df")
    said = cut(beside.mapInArrow(_against_leader, f"value long, c long, {SPANS}, ok boolean"))
    verified = said.filter("ok").select("leader", "cid", *SPAN_NAMES)
    open_ = said.filter("NOT ok").select("value", "cid", F.col("c").cast("int").alias("c"), "leader")
    if not open_.isEmpty():
        verified = verified.unionByName(_left(entries, open_, verified, n_windows))
    verified = cut(verified_passages(verified, keyed.select("cid", "text")))
    plus = SHINGLE - 1
    name = classes.select("cid", "rep")
    there = verified.select("cid", F.col("b0").alias("first_word"), (F.col("b1") - F.col("b0") + plus).alias("n_words"), F.col("leader").alias("near"), F.col("a0").alias("near_first_word"), (F.col("a1") - F.col("a0") + plus).alias("near_n_words"), "similarity")
    # of a leader's passages that overlap, the longest stands for all
    ranges = verified.groupBy("leader", "a0", "a1").agg(F.min(F.struct(F.col("cid").alias("near"), F.col("b0").alias("near_first_word"), (F.col("b1") - F.col("b0") + plus).alias("near_n_words"), "similarity")).alias("w"))
    own = W.partitionBy("leader").orderBy("a0", "a1")
    ranges = ranges.withColumn("new", (F.coalesce(F.max("a1").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) < F.col("a0")).cast("int")).withColumn("island", F.sum("new").over(own))
    here = ranges.groupBy(F.col("leader").alias("cid"), "island").agg(F.max(F.struct((F.col("a1") - F.col("a0")).alias("size"), (-F.col("a0")).alias("at"), "a0", "a1", "w")).alias("r"))
    here = here.select("cid", F.col("r.a0").alias("first_word"), (F.col("r.a1") - F.col("r.a0") + plus).alias("n_words"), "r.w.*")
    spans = there.unionByName(here).filter(F.col("n_words") >= PASSAGE_WORDS)
    spans = spans.join(name.toDF("near", "near_doc_id"), "near").select("cid", F.struct("first_word", "n_words", "near_doc_id", "near_first_word", "near_n_words", "similarity").alias("s"))
    zero = F.lit(0).cast("long")
    whole = classes.filter((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE_WORDS)).select("cid", F.struct(zero.alias("first_word"), "n_words", F.col("rep").alias("near_doc_id"), zero.alias("near_first_word"), F.col("n_words").alias("near_n_words"), F.lit(1.0).alias("similarity")).alias("s"))
    listed = cut(spans.unionByName(whole).groupBy("cid").agg(F.collect_list("s").alias("spans")))
    vertex = classes.select("cid", "vertex")
    edges = verified.select("leader", "cid").distinct().join(vertex.toDF("leader", "a"), "leader").join(vertex.toDF("cid", "b"), "cid").select("a", "b")
    found = components(edges).withColumnRenamed("id", "vertex").withColumn("component", F.when(F.col("component") < NAMELESS, F.col("component")))
    known = classes.select("cid", "rep", "vertex", "other", "copies").join(listed, "cid").join(found, "vertex", "left")
    out = join_groups(rows.select("doc_id", "cid"), known, "cid", "copies", total).select("doc_id", "other", F.coalesce("component", "rep").alias("component_id"), F.explode("spans").alias("s"))
    near = F.when(F.col("s.near_doc_id") == F.col("doc_id"), F.col("other")).otherwise(F.col("s.near_doc_id"))
    return out.select("doc_id", "s.first_word", "s.n_words", near.alias("near_doc_id"), "s.near_first_word", "s.near_n_words", "s.similarity", "component_id")
