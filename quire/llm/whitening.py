"""Whitening of embeddings from an exact integer scatter.

Entries become integers. Tasks subtract a shift from them and add up sums and cross-products without rounding; these leave a
task as digits of base 2 ** 32, which Spark adds up without overflow. n * XtX - SSt is then an exact matrix of integers on the
driver, as large as the vectors' length squared whatever the number of rows, and only it is converted to doubles and
decomposed. Each component is taken from the exact matrix without the components before it, so that a component keeps its
precision beside a much larger one.
"""

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
WIDTHS = tuple(np.dtype(x) for x in ("<i1", "<i2", "<i4", "<i8"))
DIGIT = 32
#: Rows whose products are added in doubles, and bits of the parts of larger entries: 2 ** 12 * 2 ** (2 * 20) is exact.
STRIP, LIMB = 4096, 20
#: A component with less than this share of the first one's variance is none: it is what rounding leaves of a variance of 0.
NOTHING = 1e-26
LONGEST_LONG = 1 << 63


def pack(x: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds them all, after its number: equal vectors have equal bytes."""
    for i, kind in enumerate(WIDTHS):
        if not len(x) or -(1 << (8 * kind.itemsize - 1)) <= int(x.min()) and int(x.max()) < 1 << (8 * kind.itemsize - 1):
            return bytes([i]) + x.astype(kind).tobytes()
    raise ValueError("entries are 64-bit integers")


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(packed), dim), np.int64)
    for i, x in enumerate(packed):
        out[i] = np.frombuffer(x, WIDTHS[x[0]], offset=1)
    return out


def _integers(batches):
    """vec_id, embedding in; vec_id, length and packed integers of the vectors that take part out."""
    for batch in batches:
        column = batch.column(1)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = SCALE * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        fits = np.isfinite(flat) & (np.abs(np.where(np.isfinite(flat), flat, 0)) < float(LONGEST_LONG))
        x = np.floor(np.where(fits, flat, 0)).astype(np.int64)
        ends = size.cumsum()
        keep = [i for i in range(len(size)) if size[i] and fits[ends[i] - size[i] : ends[i]].all()]
        rows = [pack(x[ends[i] - size[i] : ends[i]]) for i in keep]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(size[keep].astype(np.int32)), pa.array(rows, pa.binary())], names=["vec_id", "dim", "x"])


def products(y: np.ndarray) -> np.ndarray:
    """The exact matrix of the products of y's columns, as Python integers. y: int64 or Python integers."""
    most = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), STRIP):
        part = y[i : i + STRIP]
        if 2 * most.bit_length() + STRIP.bit_length() <= 53:
            f = part.astype(np.float64)
            total += (f.T @ f).astype(np.int64).astype(object)
            continue
        limbs, sign, rest = [], np.where(part < 0, -1, 1), np.abs(part.astype(object))
        while rest.any():
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64) * sign)
            rest = rest >> LIMB
        for a, p in enumerate(limbs):
            for b, q in enumerate(limbs):
                total += (p.T @ q).astype(np.int64).astype(object) << (LIMB * (a + b))
    return total


def _less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift without overflow."""
    small = max(int(np.abs(x // 2).max(initial=0)), int(np.abs(shift // 2).max(initial=0))) < 1 << 60
    return x - shift if small else x.astype(object) - shift.astype(object)


def _digits(i, j, values):
    """Integers as rows (i, j, digit's place, digit), digits of base 2 ** DIGIT with the integer's sign."""
    values = np.array(values, object)
    sign, rest, place = np.where(values < 0, -1, 1), np.abs(values), 0
    while True:
        digit = ((rest & ((1 << DIGIT) - 1)) * sign).astype(np.int64)
        has = digit != 0 if place else np.ones(len(digit), bool)
        yield i[has], j[has], np.full(has.sum(), place), digit[has]
        rest, place = rest >> DIGIT, place + 1
        if not rest.any():
            return


def _scatter(dim: int, shift: np.ndarray):
    """Packed vectors in; digits of their number (-1, -1), shifted sums (-1, j) and products (i, j), i <= j, out, once a task."""

    def scatter(batches):
        n, sums, total = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            y = _less(unpack(batch.column(0).to_pylist(), dim), shift)
            n, sums, total = n + len(y), sums + y.astype(object).sum(axis=0), total + products(y)
        if n:
            i, j = np.triu_indices(dim)
            none = np.full(dim + 1, -1)
            for made in (*_digits(none, np.r_[-1, np.arange(dim)], [n, *sums.tolist()]), *_digits(i, j, total[i, j].tolist())):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(made, (np.int32, np.int32, np.int32, np.int64), strict=True)], names=["i", "j", "place", "digit"])

    return scatter


def exact_scatter(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, n * XtX - SSt) of the packed vectors `x`, exactly, as Python integers."""
    first = fit.agg(F.min("x")).first()[0]
    shift = unpack([bytes(first)], dim)[0]
    rows = fit.select("x").mapInArrow(_scatter(dim, shift), "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).toArrow().to_pydict()
    n, sums, total = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for i, j, place, digit in zip(*(rows[c] for c in ("i", "j", "place", "digit")), strict=True):
        value = digit << (DIGIT * place)
        if j < 0:
            n += value
        elif i < 0:
            sums[j] += value
        else:
            total[i, j] += value
            if i != j:
                total[j, i] += value
    return n, sums + shift.astype(object) * n, n * total - np.outer(sums, sums)


def components(n: int, scatter: np.ndarray, most: int) -> list[tuple[float, np.ndarray, float]]:
    """(variance, unit vector, share of the trace) of the first components of scatter / n ** 2. Variances and shares are taken from the exact matrix."""
    trace = int(sum(scatter[i, i] for i in range(len(scatter))))
    left, scale, out = scatter, n * n, []
    for _ in range(min(most, len(scatter))):
        _, vectors = np.linalg.eigh(np.array([[v / scale for v in row] for row in left.tolist()]))
        q = vectors[:, -1]
        q = q * (1 if q[np.abs(q).argmax()] > 0 else -1)
        whole = np.array([int(v) for v in np.rint(q * 2.0**60).tolist()], object)
        size = int(whole @ whole)
        if int(whole @ left @ whole) / (size * scale) <= (NOTHING * out[0][0] if out else 0):
            break
        share = int(whole @ scatter @ whole)
        out.append((share / (size * n * n), q, share / (size * trace)))
        image = left @ whole
        left = size * size * left - size * (np.outer(whole, image) + np.outer(image, whole)) + int(whole @ image) * np.outer(whole, whole)
        scale *= size * size
    return sorted(out, key=lambda c: -c[0])


def _whiten(dim: int, n: int, sums: np.ndarray, found: list):
    """(n * x - S, whitened) of packed vectors; the first are exact, int64 or Python integers."""
    basis = np.stack([q / sqrt(e) for e, q, _ in found], axis=1)
    most = max(abs(int(s)) for s in sums)

    def whiten(packed: list[bytes]):
        x = unpack(packed, dim)
        small = n * (int(np.abs(x // 2).max(initial=0)) * 2 + 2) + most < 1 << 62
        far = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
        return far, (far.astype(np.float64) / n) @ basis

    return whiten


def _deviation(far: np.ndarray) -> list:
    """Exact sums of squares; null where they are no 64-bit integer."""
    most = max(abs(int(far.min())), abs(int(far.max()))) if far.size else 0
    if most * most * far.shape[1] < LONGEST_LONG:
        return (far.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [int(v) if v < LONGEST_LONG else None for v in (far.astype(object) ** 2).sum(axis=1)]


def whitened(vectors: DataFrame, most: int = 4) -> DataFrame:
    """Every vector's whitened components: (vec_id, component, n, deviation, whitened, explained, identity_error).

    A vector's entries become x = floor(SCALE * entry). The mean and the covariance (divisor n) are those of the n distinct
    x-vectors. whitened is x less the mean, along the component's unit vector, over the root of its variance; explained is its share
    of all variance; deviation is the sum of (n * x - S) ** 2, null beyond 64 bits; identity_error is the largest entry of the
    whitened vectors' measured covariance less the identity. A row goes whose vector is null or empty, holds null, non-finite or
    entries beyond 64-bit integers, or is not as long as most (of equally frequent lengths the longest). Components without variance
    give no row, so one distinct vector gives none, as does an empty table. Rows with the same or no vec_id each have their own
    result; other columns are not read.
    """
    rows = cut(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_integers, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, dim int, x binary"))
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    common = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    nothing = vectors.sparkSession.createDataFrame([], f"{schema}, identity_error double")
    if common is None:
        return nothing
    dim = common["dim"]
    rows = rows.filter(F.col("dim") == dim).select("vec_id", "x")
    fit = cut(rows.select("x").distinct())
    n, sums, scatter = exact_scatter(fit, dim)
    found = components(n, scatter, most) if any(scatter[i, i] for i in range(dim)) else []
    if not found:
        return nothing
    whiten, k = _whiten(dim, n, sums, found), len(found)

    def spread(batches):
        w = [whiten(b.column(0).to_pylist())[1] for b in batches if b.num_rows]
        if w:
            w = np.concatenate(w)
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(k, -1), i].astype(np.int32)), pa.array(np.r_[np.arange(k), j].astype(np.int32)), pa.array(np.r_[w.sum(axis=0), (w.T @ w)[i, j]])], names=["i", "j", "s"])

    seen = {(r.i, r.j): r.s / n for r in fit.mapInArrow(spread, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    error = max(abs(v - seen[-1, i] * seen[-1, j] - (i == j)) for (i, j), v in seen.items() if i >= 0)

    def out(batches):
        for batch in batches:
            if batch.num_rows:
                far, w = whiten(batch.column(1).to_pylist())
                at = np.repeat(np.arange(len(w)), k)
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(at), n)), pa.array(_deviation(far), pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile([share for _, _, share in found], len(w)))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(out, schema).withColumn("identity_error", F.lit(float(error)))
