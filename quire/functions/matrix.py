"""Affine matrices (a, b, c, d, e, f) as column expressions: x' = a x + c y + e, y' = b x + d y + f."""


def transform(m, x, y):
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def multiply(m, n):
    """First m, then n."""
    (a, b), (c, d), (e, f) = (transform((*n[:4], 0.0, 0.0), *m[i : i + 2]) for i in (0, 2, 4))
    return a, b, c, d, e + n[4], f + n[5]


def inverse(m):
    a, b, c, d, e, f = m
    det = a * d - b * c
    return d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det
