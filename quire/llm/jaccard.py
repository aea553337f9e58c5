"""Exact Jaccard join of shingle sets, with skipping by the relations between sets.

Documents with equal sets are one class. A class is listed under the tokens of its prefix, long enough that linked sets
share not one of them but many. The first class of a token's list leads it, and all lists that a class leads form its
cluster, so every pair that shares a prefix token meets in a cluster. There, classes are sorted by size and each list is cut
into blocks, whose heads say how much of a set is left at most from that token's position on; pairs of blocks are skipped by
size, by these positions and by the number of tokens they share. For what remains, the answers of one set, its overlaps with
all others, are computed first. Another set's answers lie within its differences from that set of these: bounds that
settle many pairs; the others' overlaps are derived from these answers by the differing tokens alone. Pairs that are
connected already are skipped.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NAMELESS, cut, grouped, having, join_groups, list_arrays, nameless
from .graph import components
from .near_vectors import Forest
from .words import chunks, mix, shingles, words

#: A token is frequent if more than this many prefixes hold it and more than this share of all; under 1 / FREQUENT_SHARE tokens are.
FREQUENT, FREQUENT_SHARE = 32, 1 / 131_072
#: Classes of a block of a cluster; larger clusters are dealt to pairs of blocks.
BLOCK = 1024
#: Classes of a block of lists, at most, that is skipped or compared at once.
STEP = 128
#: Cells of an incidence matrix that are held at once.
CELLS = 1 << 22


def token_sets(data, bounds, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; those of fewer words have their whole sequence as one."""
    hashed, _, _, wb = words(data, bounds)
    made, whole = shingles(hashed, wb, k)
    for i in range(len(wb) - 1):
        a, b = wb[i], wb[i + 1]
        if b - a >= k:
            yield np.unique(made[a:b][whole[a:b]])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for h in hashed[a:b]:
                one = mix((one ^ h) * np.uint64(0xD6E8FEB86659FD93))
            yield one
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n, percent: int):
    """Tokens of a set of n that any set with that similarity must share one of, in any one order of all tokens."""
    return n - -(-percent * n // 100) + 1


def shared_length(n, percent: int):
    """Tokens that linked sets of at least n tokens share if prefixes are longer by one less than that."""
    return prefix_length(n, percent) // 2 + 1


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def _sketch(k: int, percent: int):
    """doc_id, size and digest of the set, and its smallest tokens: the prefix and, against frequent ones, half as many more."""

    def over(batches):
        for batch in batches:
            n, digest, tokens = [], [], []
            for _, _, data, bounds in chunks(batch.column(1)):
                for s in token_sets(data, bounds, k):
                    p = prefix_length(len(s), percent) + shared_length(len(s), percent)
                    n.append(len(s))
                    digest.append(_digest(s))
                    tokens.append(s[: p + p // 4 + 16].view(np.int64) if len(s) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "tokens"])

    return over


def _sets(k: int):
    def over(batches):
        for batch in batches:
            made = [s.view(np.int64) for _, _, data, bounds in chunks(batch.column(1)) for s in token_sets(data, bounds, k)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s.view(np.uint64)) for s in made], pa.binary()), pa.array(made, pa.list_(pa.int64()))], names=["digest", "tokens"])

    return over


def _prefixes(frequent: np.ndarray, percent: int, whole: bool):
    """The prefix of each class in the order that has the frequent tokens last. Of a sketch that shows too few of the others
    no prefix is known: null. whole: the tokens are the whole set."""

    def over(batches):
        for batch in batches:
            sets = batch.column(batch.schema.get_field_index("tokens"))
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            often = np.isin(flat, frequent)
            ends = np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))
            out, light = [], []
            for a, b, n in zip([0, *ends[:-1]], ends, batch.column(batch.schema.get_field_index("n")).to_pylist(), strict=True):
                s, late, p = flat[a:b], often[a:b], prefix_length(n, percent) + shared_length(n, percent) - 1
                rare = s[~late]
                light.append(min(len(rare), p))
                out.append(rare[:p] if len(rare) >= p else np.concatenate([rare, s[late]])[:p] if whole or len(s) == n else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("digest", "rep", "n")), pa.array(out, pa.list_(pa.int64())), pa.array(light, pa.int64())], names=["digest", "rep", "n", "tokens", "light"])

    return over


def _near_prefixes(percent: int):
    """Which classes of a cluster have prefixes that agree so far that the sets can still link, as a forest (a, b).

    Linked sets differ in few tokens altogether, so in few up to the place where the shorter of both prefixes ends. Tokens
    come as their upper 32 bits, the frequent ones last; where two coincide, a pair may pass that need not, but none fails.
    """

    def work(g):
        n, part = g["n"].to_numpy(), g["block"].to_numpy()
        sets, reps, m = list_arrays(g["tokens"]), g["rep"].to_numpy(), len(n)
        order = np.argsort(n, kind="stable")
        n, part, reps, sets = n[order], part[order], reps[order], [sets[i] for i in order]
        sizes = np.array([len(s) for s in sets])
        rows = np.repeat(np.arange(m), sizes)
        light = g["light"].to_numpy()[order]
        late = (np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) >= np.repeat(light, sizes)
        names, at = np.unique(np.concatenate(sets).astype(np.uint32).astype(np.int64) + (late.astype(np.int64) << 32), return_inverse=True)
        ends = np.cumsum(sizes)
        places = [at[a:b] for a, b in zip(ends - sizes, ends, strict=True)]  # rising, as tokens are in that order
        last = np.where(sizes < n, [p[-1] if len(p) else -1 for p in places], len(names))  # a whole set has no end
        need = np.array([shared_length(int(x), percent) for x in n])
        forest = Forest(m)
        parts = [_Sparse(rows, at, m)]
        step = _step(parts)
        heads = _heads(rows, at, np.repeat(n + np.cumsum(sizes) - sizes, sizes) - np.arange(len(rows)), m, step)

        def skipped(top, low):
            if len(np.unique(forest.root[np.r_[top, low]])) == 1:
                return True
            # with the first token that two sets share, they can share at most what is left of the shorter rest
            (ours, mine), (theirs, other) = heads[top.start // step], heads[low.start // step]
            common, i, j = np.intersect1d(ours, theirs, assume_unique=True, return_indices=True)
            fewest = -(-percent * (n[top].min() + n[low].min()) // (100 + percent))
            return len(common) + 1 < min(need[top].min(), need[low].min()) or not len(common) or np.minimum(mine[i], other[j]).max() < fewest

        for top, low, both in _products(parts, n, percent, skipped):
            r, c = np.nonzero((both + 1 >= np.minimum(need[top, None], need[None, low])) & (np.arange(m)[top, None] < np.arange(m)[None, low]) & (n[top, None] * 100 >= percent * n[None, low]))
            shared, r, c = both[r, c], r + top.start, c + low.start
            within = np.empty(len(c), np.int64)  # tokens of c up to the end of r's prefix
            for j in np.unique(c):
                of = c == j
                within[of] = np.searchsorted(places[j], last[r[of]], "left")
            back = last[r] > last[c]
            inside = np.where(back, 0, sizes[r] + within)
            for i in np.unique(r[back]):
                of = back & (r == i)
                inside[of] = sizes[c[of]] + np.searchsorted(places[i], last[c[of]], "left")
            total = n[r] + n[c]
            can = inside - 2 * (shared + 1) <= total - 2 * -(-percent * total // (100 + percent))
            forest.add(r[can], c[can])
        other = forest.root != np.arange(m)
        return (reps[other], reps[forest.root[other]]) if other.any() else None

    return work


def _step(parts) -> int:
    return max(1, min(STEP, CELLS // max(1, sum(p.shape[1] for p in parts))))


def _heads(rows, at, left, m: int, step: int):
    """For each block of sets the tokens they hold and, of each token, the most that is left of a set from it on (left, of each entry)."""
    block = rows // step
    order = np.lexsort((at, block))
    block, at, left = block[order], at[order], left[order]
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (at[1:] != at[:-1])][: len(at)])
    most = np.maximum.reduceat(left, first) if len(first) else left
    bounds = np.searchsorted(block[first], np.arange(-(-m // step) + 1))
    return [(at[first[a:b]], most[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _products(parts, n, percent: int, skip):
    """(rows, columns, summed products) of blocks of sets that are sorted by size; blocks too far apart in size are not visited."""
    m, step = len(n), _step(parts)
    for i in range(0, m, step):
        top = slice(i, min(i + step, m))
        for j in range(i, m, step):
            low = slice(j, min(j + step, m))
            if n[top].max() * 100 < percent * n[low].min():
                break
            if not skip(top, low):
                yield top, low, sum(p.product(top, low) for p in parts)


def _cluster(k: int, percent: int):
    """The links among a cluster's sets, or between two blocks of it, as a forest (a, b)."""

    def work(g):
        n, part = g["n"].to_numpy(), g["block"].to_numpy()
        sets = [x.view(np.int64) for _, _, data, bounds in chunks(pa.array(g["text"].to_pylist(), pa.large_string())) for x in token_sets(data, bounds, k)]
        sets, reps, m = [np.sort(x) for x in sets], g["rep"].to_numpy(), len(n)
        order = np.lexsort((reps, n))
        n, part, reps, sets = n[order], part[order], reps[order], [sets[i] for i in order]
        cross = len(np.unique(part)) > 1
        forest = Forest(m)
        if m == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if 100 * both >= percent * (n[0] + n[1] - both):
                forest.add(np.array([0]), np.array([1]))
        elif m > 2:
            # the first class's tokens, and the others by how they differ from it
            names, at = np.unique(np.concatenate(sets), return_inverse=True)
            rows = np.repeat(np.arange(m), n)
            base = sets[int(np.argmin(reps))]
            lead = np.zeros(len(names), bool)
            lead[np.searchsorted(names, base)] = True
            held = np.bincount(rows[lead[at]], minlength=m)
            if held.sum() * 2 < len(base) * m:  # it tells little of them
                base, lead, held = base[:0], np.zeros(len(names), bool), np.zeros(m, np.int64)
            gone, extra = len(base) - held, n - held  # held: the answers of the leader L, |L & y| for every y

            def link(top, low, both):
                return 100 * both >= percent * (n[top, None] + n[None, low] - both)

            def pairs(top, low):
                of = np.arange(m)[top, None] < np.arange(m)[None, low]
                return of & (part[top, None] != part[None, low]) if cross else of

            def settled(top, low):
                if len(np.unique(forest.root[np.r_[top, low]])) == 1:
                    return True
                # |L & y| - |L - x| <= |x & y|, and x and y share no more of L than either holds and no more beside it than either has
                of = pairs(top, low)
                sure = of & link(top, low, held[None, low] - gone[top, None])
                r, c = np.nonzero(sure)
                forest.add(r + top.start, c + low.start)
                most = np.minimum(held[top, None], held[None, low]) + np.minimum(extra[top, None], extra[None, low])
                return not (of & ~sure & link(top, low, most) & (forest.root[top, None] != forest.root[None, low])).any()

            for top, low, both in _products(_differences(rows, at, lead, m), n, percent, settled):
                # |x & y| = |L & y| - |(L - x) & y| + |(x - L) & y|, where |(L - x) & y| = |L - x| - |(L - x) & (L - y)| and (x - L) & y = (x - L) & (y - L)
                both = held[None, low] - gone[top, None] + both
                r, c = np.nonzero(link(top, low, both) & pairs(top, low))
                forest.add(r + top.start, c + low.start)
        other = forest.root != np.arange(m)
        return (reps[other], reps[forest.root[other]]) if other.any() else None

    return work


class _Sparse:
    """A 0/1 matrix by its rows' columns; only columns that two rows share count for products."""

    def __init__(self, rows, columns, m):
        names, at, count = np.unique(columns, return_inverse=True, return_counts=True)
        shared = count[at] > 1
        self.names, at = np.unique(at[shared], return_inverse=True)
        self.rows, self.at = rows[shared], at
        order = np.argsort(self.rows, kind="stable")
        self.rows, self.at = self.rows[order], self.at[order]
        self.bounds = np.searchsorted(self.rows, np.arange(m + 1))
        self.shape = (m, len(self.names))

    def dense(self, part: slice) -> np.ndarray:
        a, b = self.bounds[part.start], self.bounds[part.stop]
        out = np.zeros((part.stop - part.start, self.shape[1]), np.float32)
        out[self.rows[a:b] - part.start, self.at[a:b]] = 1
        return out

    def product(self, top: slice, low: slice) -> np.ndarray:
        return np.rint(self.dense(top) @ self.dense(low).T).astype(np.int64) if self.shape[1] else np.zeros((top.stop - top.start, low.stop - low.start), np.int64)


def _differences(rows, at, lead, m):
    """Matrices of what each set has besides the leader's tokens, and of what it lacks of them."""
    out = ~lead[at]
    extra = _Sparse(rows[out], at[out], m)
    ids = np.flatnonzero(lead)
    has = np.zeros((m, len(ids)), bool)
    inside = lead[at]
    has[rows[inside], np.searchsorted(ids, at[inside])] = True
    r, c = np.nonzero(~has)
    return [extra, _Sparse(r, ids[c], m)]


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Every document's set and component: (doc_id, n_shingles, component_id).

    Words are runs of non-white-space after lower-casing A-Z. Documents link when 100 * intersection >= percent * union of
    their sets of k-word shingles; texts of fewer words have one shingle, null and blank texts none and no link. The
    component is the smallest doc_id that links reach. Rows with the same doc_id are one vertex. A null doc_id takes part and
    has its own null as component; doc_ids lie under NAMELESS. Shingles are 64-bit hashes.
    """
    sketches = cut(docs.select("doc_id", "text").mapInArrow(_sketch(k, percent), "doc_id long, n_shingles long, digest binary, tokens array<long>"))
    rows = sketches.count()
    empty = sketches.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    classes = sketches.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.coalesce("doc_id", nameless(F.col("digest")))).alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = cut(classes)

    # the prefixes in the order of the hashes, frequent tokens moved to the end
    size = prefix_column(F.col("n"), percent)
    counts = classes.select(F.explode(F.slice("tokens", F.lit(1), size.cast("int"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    listed = classes.agg(F.sum(size)).first()[0] or 0
    often = counts.filter(F.col("df") > max(FREQUENT, listed * FREQUENT_SHARE)).select("token")
    frequent = np.sort(often.toPandas()["token"].to_numpy(np.int64))  # under 1 / FREQUENT_SHARE of them
    kind = "digest binary, rep long, n long, tokens array<long>, light long"
    shown = cut(classes.mapInArrow(_prefixes(frequent, percent, False), kind))
    lacking = shown.filter("tokens IS NULL").select("digest", "rep", "n")
    late = cut(_full_sets(docs, lacking, k).mapInArrow(_prefixes(frequent, percent, True), kind))
    index = shown.filter("tokens IS NOT NULL").unionByName(late)

    # a list's first class leads it
    listed_all = index.select("rep", F.explode("tokens").alias("token"))
    late_token = F.broadcast(often.withColumn("often", F.lit(True)))
    few = W.partitionBy("token")  # of a token that is not frequent
    rare = listed_all.join(late_token, "token", "left_anti").select("rep", F.min("rep").over(few).alias("leader"), F.count("*").over(few).alias("df")).filter("df > 1")
    many = listed_all.join(late_token, "token", "left_semi")
    leaders = many.groupBy("token").agg(F.min("rep").alias("leader"), F.count("*").alias("df")).filter("df > 1")
    many = join_groups(many, leaders, "token", "df", max(1, listed)).select("rep", "leader", "df")
    shared = cut(rare.unionByName(many).groupBy("leader", "rep").agg(F.count("*").alias("tokens_led")))

    # A class that links shares with its partner as many prefix tokens as the smallest set it can link with asks for. If each
    # of both leaves lists with less than half of these, they still meet in one; so a class leaves its shortest lists, as
    # many as that allows, and takes part at all only if it has that many tokens in lists.
    own = W.partitionBy("rep")  # as many rows as a prefix has tokens, at most
    least = F.floor(prefix_column(F.ceil(F.col("n") * percent / 100), percent) / 2) + 1
    held = shared.withColumn("held", F.sum("tokens_led").over(own)).withColumn("upto", F.sum("tokens_led").over(own.orderBy("tokens_led", "leader").rowsBetween(W.unboundedPreceding, 0)))
    able = held.join(index.select("rep", "n").distinct(), "rep").filter((F.col("held") >= least) & (F.col("upto") > F.floor((least - 1) / 2)))
    members = cut(able.select("leader", "rep"))
    upper = F.transform("tokens", lambda x: F.shiftright(x, 32).cast("int")).alias("tokens")
    maybe = cut(grouped(_deal(members, index.select("rep", "n", upper, "light"), listed), ["leader", "lo", "hi"], _near_prefixes(percent), "a long, b long"))
    near = cut(components(maybe).select(F.col("component").alias("leader"), F.col("id").alias("rep")))  # each class once
    texts = _texts(docs, classes.join(near.select("rep").distinct(), "rep", "left_semi").select("digest", "rep", "n"), k)
    edges = cut(grouped(_deal(near, texts, listed), ["leader", "lo", "hi"], _cluster(k, percent), "a long, b long"))
    found = components(edges).withColumnRenamed("id", "rep")
    named = classes.select("digest", "rep", "copies").join(found, "rep", "left").select("digest", "rep", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = join_groups(sketches.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest"), named, "digest", "copies", max(1, rows)).select("doc_id", "n_shingles", F.when(F.col("rep") < NAMELESS, F.col("component_id")).alias("component_id"))
    return out.unionByName(empty)


def _deal(members: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """The classes (rep and more columns) of each cluster (leader, rep), those of a large one by pairs of blocks (lo, hi)."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("members")).filter("members > 1")
    dealt = join_groups(members, sizes, "leader", "members", max(1, total)).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leader", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep")
    return dealt.join(sets, "rep")


def prefix_column(n, percent: int):
    return n - F.ceil(n * percent / 100) + 1


def _standing(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (doc_id, text) among which are the texts of the wanted classes: those of their reps, and those without doc_id."""
    rows = docs.select("doc_id", "text")
    return having(rows, wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").unionByName(rows.filter("doc_id IS NULL"))


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(digest, rep, n, tokens) of the wanted classes (digest, rep, n), from the texts of the rows that stand for them."""
    texts = _standing(docs, wanted)
    made = texts.mapInArrow(_sets(k), "digest binary, tokens array<long>")
    return made.join(wanted, "digest").groupBy("digest", "rep", "n").agg(F.first("tokens").alias("tokens"))


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, n, text) of the wanted classes (digest, rep, n)."""

    def over(batches):
        for batch in batches:
            made = [_digest(x) for _, _, data, bounds in chunks(batch.column(0)) for x in token_sets(data, bounds, k)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(0)], names=["digest", "text"])

    texts = _standing(docs, wanted).select("text").mapInArrow(over, "digest binary, text string")
    return texts.join(wanted, "digest").dropDuplicates(["digest"]).select("rep", "n", "text")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the rows with its smallest doc_id. Columns stay; rows without doc_id stay."""
    gone = jaccard_components(docs, k, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
