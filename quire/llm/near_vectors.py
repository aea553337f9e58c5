"""Near-duplicate vectors by quantised tiles.

Vectors are quantised once and dealt to blocks, and each pair of blocks is one tile, to which only the int8 vectors go. All their
products are taken there; with each vector's own quantisation error they bound every cosine from both sides. Pairs that surely reach
the threshold are counted; of pairs that may reach it, the tile names the vectors, which are fetched in full precision, float or double, and
only such pairs are computed again in double precision. Tiles return counts of links and forests of them, not the pairs.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups
from .graph import components

#: Vectors a block; a tile's products take the square of it, in strips of STRIP rows.
BLOCK = 4096
STRIP = 512
#: Dimensions that a single-precision product of int8 values holds exactly: 1024 * 127 * 127 < 2 ** 24.
EXACT_DIMS = 1024
#: More than what single-precision rounding of the scaled products can amount to.
SLACK = 1e-5


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes from -127 to 127, scale, norm of the quantisation error) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    return codes.astype(np.int8), scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, as floats."""
    parts = [a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T for i in range(0, a.shape[1], EXACT_DIMS)]
    return parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)


def bounded(a: tuple, b: tuple, threshold: float, one: bool):
    """For strips of rows of a: (rows of a, rows of b) of the pairs that surely reach the threshold, and of those that may. a and b: codes, scales and errors
    of unit vectors. one: they are the same vectors, and none is a pair with itself."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    widest = 1 + ea.max() if len(ea) else 1
    for i in range(0, len(qa), STRIP):
        near = _product(qa[i : i + STRIP], qb)
        near *= sa[i : i + STRIP, None].astype(near.dtype)
        near *= sb[None, :].astype(near.dtype)
        # |u.v - u'.v'| <= |u'| * error of v + error of u, and u' is at most 1 + error of u long; first with the widest u', so that few pairs are looked at one by one
        r, c = np.nonzero(near >= (threshold - 2 * SLACK - ea[i : i + STRIP, None]).astype(near.dtype) - (eb * widest).astype(near.dtype)[None, :])
        cos, r = near[r, c].astype(np.float64), r + i
        if one:
            r, c, cos = r[r != c], c[r != c], cos[r != c]
        error = (1 + ea[r]) * eb[c] + ea[r] + SLACK
        sure, maybe = cos - error >= threshold, (cos - error < threshold) & (cos + error >= threshold)
        yield r[sure], c[sure], r[maybe], c[maybe]


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Forest:
    """Components of the vertices 0 to n - 1; edges come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        while True:
            a, b = self.root[r], self.root[c]
            open_ = a != b
            if not open_.any():
                return
            r, c, a, b = r[open_], c[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    codes, scale, error = quantise(units(np.stack(pdf["embedding"].to_numpy())))
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "cids": [pdf["cid"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()]})


class _Links:
    """Counts of links and their forest, of the vectors of one or two blocks."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, shift: int):
        self.ids, self.copies, self.shift = ids, copies, shift
        self.count, self.forest = np.zeros(len(ids), np.int64), Forest(len(ids))

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        """r: rows of the first block; c: rows of the second or, within one block, of the same, where each pair comes twice."""
        c = c + self.shift
        self.count += np.bincount(r, self.copies[c], len(self.ids)).astype(np.int64)
        if self.shift:
            self.count += np.bincount(c, self.copies[r], len(self.ids)).astype(np.int64)
        self.forest.add(r, c)

    def found(self, open_: np.ndarray) -> pd.DataFrame:
        has = (self.count > 0) | open_
        return pd.DataFrame({"cid": self.ids[has], "links": self.count[has], "root": self.ids[self.forest.root][has], "open": open_[has]})


def _tile(threshold: float):
    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        pdf = pdf.sort_values("block")
        sides = [(np.frombuffer(c, np.int8).reshape(-1, int(pdf["dim"].iloc[0])), np.frombuffer(s, np.float64), np.frombuffer(e, np.float64)) for c, s, e in zip(pdf["codes"], pdf["scale"], pdf["error"], strict=True)]
        cids = [np.frombuffer(x, np.int64) for x in pdf["cids"]]
        shift = len(cids[0]) if len(cids) == 2 else 0
        links = _Links(np.concatenate(cids), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["copies"]]), shift)
        open_ = np.zeros(len(links.ids), bool)
        if lo == hi or shift:  # else the other block has no vector of this length
            for r, c, maybe, with_ in bounded(sides[0], sides[-1], threshold, not shift):
                links.add(r, c)
                open_[maybe] = True
                open_[with_ + shift] = True
        return links.found(open_).assign(dim=pdf["dim"].iloc[0], lo=lo, hi=hi)[TILE_NAMES]

    return tile


TILE_NAMES = ["dim", "lo", "hi", "cid", "links", "root", "open"]
TILE = "dim int, lo int, hi int, cid long, links long, root long, open boolean"


def _exact(threshold: float):
    """The vectors of a tile that stayed open, in full precision: the links among their pairs that may reach the threshold."""

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "cid"])
        one = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        full, first = units(np.stack(pdf["embedding"].to_numpy())), (pdf["block"] == pdf["lo"]).to_numpy()
        shift = 0 if one else int(first.sum())
        a, b = (full, full) if one else (full[:shift], full[shift:])
        links = _Links(pdf["cid"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), shift)
        if len(a) and len(b):
            for _, _, r, c in bounded(quantise(a), quantise(b), threshold, one):
                reached = np.concatenate([np.einsum("ij,ij->i", a[r[k : k + 65536]], b[c[k : k + 65536]]) >= threshold for k in range(0, len(r), 65536)] or [np.zeros(0, bool)])
                links.add(r[reached], c[reached])
        return links.found(np.zeros(len(links.ids), bool))[["cid", "links", "root"]]

    return exact


def near_vectors(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Every vector's links and component: (vec_id, n_links, component_id, kept).

    Two vectors link if their cosine, in double precision, is at least the threshold. Vectors that are null, empty or zero, or
    that hold null or non-finite components, link with nothing; vectors of different length do not link with each other.
    Equal vectors are compared once. Rows with the same vec_id are vectors of their own. A vector without vec_id takes part
    and connects others; component_id is the smallest vec_id in a component, null where no vector of it has one, and kept
    tells whether it is the row's own, also null. An empty table gives an empty result; other columns are not read.
    """
    value = F.col("embedding").cast("array<double>")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    stored = "array<float>" if "float" in vectors.schema["embedding"].dataType.simpleString() else "array<double>"
    rows = cut(vectors.select("vec_id", F.when(fit, F.col("embedding").cast(stored)).alias("embedding")).withColumn("vkey", F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256))))
    classes = rows.filter("vkey IS NOT NULL").groupBy("vkey").agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # the numbers hold once they are written
    n = classes.count()
    blocks = max(1, -(-n // block))
    dealt = classes.select("cid", "embedding", "copies", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vkey"), F.lit(blocks)).cast("int").alias("block"))
    packed = cut(dealt.groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, cids binary, copies binary, codes binary, scale binary, error binary"))
    tiles = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    seen = cut(tiles.drop("other").groupBy("dim", "lo", "hi").applyInPandas(_tile(threshold), TILE))
    again = seen.filter("open").select("lo", "hi", "cid").join(dealt, "cid")
    met = cut(seen.filter("links > 0").select("cid", "links", "root").unionByName(again.groupBy("dim", "lo", "hi").applyInPandas(_exact(threshold), "cid long, links long, root long")))
    linked = met.groupBy("cid").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    known = cut(classes.select("vkey", "cid", "rep", "copies").join(linked, "cid", "left").join(found, "cid", "left").select("vkey", "rep", "copies", "links", F.coalesce("component", "cid").alias("component")))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes"))
    named = join_groups(known, least, "component", "classes", max(1, n)).select("vkey", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = join_groups(rows.filter("vkey IS NOT NULL").select("vec_id", "vkey"), named, "vkey", "copies", max(1, rows.count())).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vkey IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
