"""Functions of one number as column expressions: sampled, exponential and stitched."""

from pyspark.sql import functions as F


def clip(x, lo: float, hi: float):
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def exponential(x, c0: float, c1: float, n: float, domain=(0.0, 1.0)):
    return F.lit(c0) + F.lit(c1 - c0) * F.pow(clip(x, *domain), F.lit(n))


def stitched(x, domain, bounds: list[float], pieces: list, encode=None):
    """Each piece is a function of a column from 0 to 1, or from encode's pair for it."""
    x = clip(x, *domain)
    ends = [domain[0], *bounds, domain[1]]
    out = None
    for i in range(len(pieces) - 1, -1, -1):
        lo, hi = ends[i], ends[i + 1]
        e0, e1 = encode[i] if encode else (0.0, 1.0)
        value = pieces[i](F.lit(e0) + (x - lo) * F.lit((e1 - e0) / (hi - lo) if hi > lo else 0.0))
        out = value if out is None else F.when(x < hi, value).otherwise(out)
    return out


def sampled(x, domain, samples: list[float]):
    """Linear interpolation between evenly spaced samples."""
    e = (clip(x, *domain) - domain[0]) / (domain[1] - domain[0]) * (len(samples) - 1)
    i = F.floor(e).cast("int")
    known = F.array(*map(F.lit, samples))
    low, high = F.element_at(known, i + 1), F.element_at(known, F.least(i + 2, F.lit(len(samples))))
    return low + (high - low) * (e - i)


def sampled_2d(x, y, domains, samples: list[list[float]]):
    """A table of samples of two inputs (a row for each x) with interpolation between the four nearest."""
    place = lambda v, domain, n: (clip(v, *domain) - domain[0]) / (domain[1] - domain[0]) * (n - 1)
    known, rows, columns = F.lit(samples), len(samples), len(samples[0])
    ex, ey = place(x, domains[0], rows), place(y, domains[1], columns)
    i, j = F.floor(ex).cast("int"), F.floor(ey).cast("int")
    at = lambda p, q: F.element_at(F.element_at(known, F.least(i + p, F.lit(rows))), F.least(j + q, F.lit(columns)))
    low = at(1, 1) + (at(1, 2) - at(1, 1)) * (ey - j)
    high = at(2, 1) + (at(2, 2) - at(2, 1)) * (ey - j)
    return low + (high - low) * (ex - i)
