"""Phrase mining, whitening and archives against brute force, with odd input."""

import collections
import gzip
import hashlib
import base64
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import arc, collocations, whitening

DOCS = "doc_id long, text string, lang string, f long, phrase string, n long, at long"
VECTORS = "vec_id long, embedding array<double>, x binary, dim int, n long"
PAGES = "page_id long, url string, html string, record string, payload binary, n long"


def plain_collocations(rows, least, longest, top, cover):
    """By definition, with loops."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        kept.sort()
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -score) for n, (score, a, p, left, right) in enumerate(kept[:top])]
    return sorted(out)


def test_collocations_against_loops(spark):
    dice = random.Random(3)
    vocabulary = ["a", "B", "c", "dé", "e", " x", "1", "f\x1cg"]
    rows = []
    for i in range(120):
        text = "".join(dice.choice(vocabulary) + dice.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(dice.randint(0, 60)))
        rows.append((i, text, dice.choice(["en", "en", "de", None, "und", ""]), 1, "clash", 2, 3))
    rows += [(1000, None, "en", 0, "", 0, 0), (1001, "", None, 0, "", 0, 0), (1002, " .,\n ", "xx", 0, "", 0, 0), (1003, "a a a " * 3000, "long", 0, "", 0, 0), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    for least, longest, top, cover in ((8, 4, 2000, 80), (3, 4, 7, 50), (2, 2, 100, 80), (5, 3, 50, 100)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top, cover).collect())
        assert got == plain_collocations(rows, least, longest, top, cover)


def test_collocations_of_nothing(spark):
    assert not collocations.collocations(spark.createDataFrame([], DOCS)).collect()
    assert not collocations.collocations(spark.createDataFrame([(1, "one two", "en", 0, "", 0, 0)], DOCS)).collect()


def test_a_saturated_filter_changes_nothing(spark, monkeypatch):
    dice = random.Random(4)
    rows = [(i, " ".join(f"w{int(dice.paretovariate(1)) % 300}" for _ in range(200)), "en", 0, "", 0, 0) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    want = plain_collocations(rows, 4, 4, 500, 80)
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 4, 4, 500, 80).collect()) == want and len(want) > 50


def covariance(x):
    n, dim = len(x), len(x[0])
    mean = [Fraction(sum(r[j] for r in x), n) for j in range(dim)]
    far = [[v - m for v, m in zip(r, mean, strict=True)] for r in x]
    return [[sum(r[i] * r[j] for r in far) / n for j in range(dim)] for i in range(dim)]


def check_whitening(spark, rows, vectors=True):
    """Every column against definitions in exact arithmetic and NumPy."""
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    fit = {}
    for r in rows:
        v = r[1]
        if v and all(c is not None and np.isfinite(c) for c in v):
            fit.setdefault(tuple(int(np.floor(256 * c)) for c in v), []).append(r[0])
    length = collections.Counter(len(x) for x, ids in fit.items() for _ in ids)
    dim = max(length, key=lambda k: (length[k], k))
    fit = {x: ids for x, ids in fit.items() if len(x) == dim}
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(dim)]
    exact = covariance(list(fit))
    trace = float(sum(exact[i][i] for i in range(dim)))
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got) == sorted((i is None, i, k + 1) for ids in fit.values() for i in ids for k in range(4))
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x, ids in fit.items() for i in ids}
    assert all(r.n == n and r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got)
    share = {r.component: r.explained for r in got}
    own = {(r.vec_id, r.component): r.whitened for r in got}
    centred = {x: np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums, strict=True)]) for x in fit}
    w = np.array([[own[fit[x][0], k + 1] for k in range(4)] for x in fit])
    assert np.abs(w.T @ w / n - np.eye(4)).max() < 1e-6 and all(0 <= r.identity_error < 1e-6 for r in got)
    far = np.array(list(centred.values()))
    for k in range(4 if vectors else 0):
        # the unit vector follows from the whitened values: Vq = e q
        q = far.T @ w[:, k] / n / np.sqrt(share[k + 1] * trace)
        assert abs(np.linalg.norm(q) - 1) < 1e-6
        image = [float(sum(v * Fraction(float(c)) for v, c in zip(row, q, strict=True))) for row in exact]
        assert np.linalg.norm(np.array(image) - share[k + 1] * trace * q) < 1e-6 * share[1] * trace
    return share, exact


def test_whitening_by_definition(spark):
    g = np.random.default_rng(1)
    rows = [(i, (g.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 1000).tolist(), b"clash", 0, 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], b"", 0, 0) for i in range(150)]  # a third is one vector
    rows += [(900, None, None, 0, 0), (901, [], None, 0, 0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, 0, 0), (903, [float("nan")] * 6, None, 0, 0), (904, [float("inf")] * 6, None, 0, 0), (905, [1.0, 2.0], None, 0, 0), (907, [1e300] * 5 + [float("-inf")], None, 0, 0)]
    share, exact = check_whitening(spark, rows)
    e = np.linalg.eigvalsh(np.array(exact, float))[::-1]
    assert np.allclose([share[k + 1] for k in range(4)], e[:4] / e.sum(), rtol=1e-9)


def test_whitening_of_very_unlike_variances(spark):
    g = np.random.default_rng(2)
    rows = [(i, (g.normal(size=5) * [1e10, 1e5, 30, 1, 0.01]).tolist(), b"", 0, 0) for i in range(200)]
    # the whitened values of a component lose what the largest variance leaves of a double, so no unit vector follows from them
    share, exact = check_whitening(spark, rows, vectors=False)
    d = [float(exact[i][i]) for i in range(5)]
    assert share[4] < 1e-15 and all(share[k + 1] * sum(d) <= sum(d[k:]) * 1.001 for k in range(4))


def test_whitening_without_variance(spark):
    frame = lambda *v: spark.createDataFrame([(i, x, None, 0, 0) for i, x in enumerate(v)], VECTORS)
    assert not whitening.whitened(frame()).collect() and not whitening.whitened(frame([1.0, 2.0], [1.0, 2.0], None)).collect()
    line = whitening.whitened(frame([0.0, 0.0], [1.0, 1.0], [3.0, 3.0])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1) and len(line) == 3


def test_exact_products_of_large_entries():
    g = np.random.default_rng(5)
    for y in (g.integers(-300, 300, (5000, 3)), g.integers(-(1 << 51), 1 << 51, (70, 4)), np.array([[-(1 << 63), (1 << 63) - 1], [5, -7]]), np.array([[3 << 70, -1], [1, 2 << 66]], object)):
        want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(y.shape[1])] for i in range(y.shape[1])]
        assert whitening.products(y).tolist() == want
    values = [0, 1, -1, (1 << 32) - 1, -(1 << 32), 12345678901234567890123, -98765432109876543210]
    back = collections.Counter()
    for i, _, place, digit in whitening._digits(np.arange(7), np.arange(7), values):
        for a, p, d in zip(i.tolist(), place.tolist(), digit.tolist(), strict=True):
            back[a] += d << (32 * p)
    assert [back[i] for i in range(7)] == values
    for x in ([], [1, -128], [300, 2], [1 << 20], [-(1 << 63), (1 << 63) - 1]):
        assert whitening.unpack([whitening.pack(np.array(x, np.int64))], len(x)).tolist() == [x]


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def plain_archive(rows, least=0):
    first, out = {}, []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= least:
            key = (page is None, page)
            first[body] = min(first.get(body, key), key)
    used = set()
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        new = len(body) < least or body not in used
        used.add(body)
        out.append((page, len(body), digest(body), "response" if new else "revisit", None if new else first[body][1]))
    return sorted(out, key=str)


ODD = [
    (5, "http://a/b c", "<p>é</p>", "clash", b"", 1), (3, "http://a", "<p>é</p>", "", b"", 1), (4, None, None, "", b"", 1), (9, "", "", "", b"", 1), (None, "http://n", "x\r\n\r\nWARC/1.1\r\n\r\ny", "", b"", 1),
    (7, "http://m\nm", "x\r\n\r\nWARC/1.1\r\n\r\ny", "", b"", 1), (7, "http://m", "x\r\n\r\nWARC/1.1\r\n\r\ny", "", b"", 1), (8, "http://l", "long " * 300_000, "", b"", 1), (10, "http://q", "\n\nfiledesc://x 1 2 3 4\n\n", "", b"", 1), (11, "http://q", "P", "", b"", 1), (12, "http://q", "p", "", b"", 1),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_keep_every_page(spark, least):
    rows = ODD + [(100 + i, f"http://hot/{i}", "hot page", "", b"", 1) for i in range(60)]
    got = arc.archive(spark.createDataFrame(rows, PAGES).repartition(5), least).collect()
    assert all(r.intact for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain_archive(rows, least)


def test_archives_of_nothing(spark):
    assert not arc.archive(spark.createDataFrame([], PAGES)).collect()


def test_both_versions_are_parsed_by_their_fields():
    doc = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\x00body"
    block = f"1 0 other\n{arc.FIELDS[1]}\n".encode()
    one = b"filedesc://old.arc 1.2.3.4 19970102030405 text/plain %d\n" % len(block) + block
    v1 = one + b"\nhttp://x/a b 1.2.3.4 1997 text/html %d\n" % len(doc) + doc + b"\njunk line\n\ndns:x 1.2.3.4 19970102030405 text/dns 3\nabc\n"
    found = list(arc.arc_records(v1))
    assert [f["url"] for f, _, _ in found] == ["filedesc://old.arc", "http://x/a b", "dns:x"] and found[1][1] == doc and found[2][1] == b"abc" and {v for _, _, v in found} == {1}
    block = (f"2 0 quire\n{arc.FIELDS[2]}\n").encode()
    v2 = b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc %d\n" % len(block) + block + b"\nhttp://y 5.6.7.8 20010203040506 text/html 404 - - 17 new.arc %d\n" % (len(doc) + 9) + doc
    for content in (v2, gzip.compress(v2[:150]) + gzip.compress(v2[150:])):
        found = list(arc.arc_records(content))
        assert [(f["url"], f["archive-date"], f.get("result-code")) for f, _, _ in found][1] == ("http://y", "20010203040506", "404") and found[1][1] == doc and found[1][2] == 2
    assert arc.warc_date("1997") == "1997-01-01T00:00:00Z" and arc.warc_date("20010230000000") == arc.warc_date("x") == "2000-01-01T00:00:00Z"


def test_conversion_of_foreign_archives(spark, tmp_path):
    arcs, warcs = tmp_path / "arcs", tmp_path / "warcs"
    arcs.mkdir()
    block = f"1 0 other\n{arc.FIELDS[1]}\n".encode()
    doc = b"HTTP/1.0 200 OK\nX: y\n\n\xff\xfe\r\n\r\n\x00"
    (arcs / "a.arc").write_bytes(b"filedesc://a.arc 0.0.0.0 19990101000000 text/plain %d\n" % len(block) + block + b"\nhttp://x/1 1.2.3.4 19990506070809 text/html %d\n" % len(doc) + doc + b"\nhttp://x/2 1.2.3.4 19990506070810 text/html %d\n" % len(doc) + doc + b"\nftp://f 1.2.3.4 19990506070811 image/gif 3\n\x01\x02\x03\nhttp://cut 1.2.3.4 19990506070811 text/html 99\nHTTP")
    arc.convert(spark, f"file://{arcs}", f"file://{warcs}")
    records = [r for p in warcs.glob("*.gz") for r in arc.warc_records(p.read_bytes())]
    by = {h.get("warc-target-uri", h["warc-type"]): (h, b) for h, b in records}
    assert sorted(h["warc-type"] for h, _ in records) == ["resource", "resource", "response", "revisit", "warcinfo"] and len({h["warc-record-id"] for h, _ in records}) == 5
    kept, again = (by["http://x/1"], by["http://x/2"]) if by["http://x/1"][0]["warc-type"] == "response" else (by["http://x/2"], by["http://x/1"])
    assert kept[1] == doc and again[1] == doc[: doc.index(b"\xff")] and again[0]["warc-refers-to"] == kept[0]["warc-record-id"] and again[0]["warc-payload-digest"] == kept[0]["warc-payload-digest"] == f"sha1:{digest(doc[doc.index(b'\xff') :])}"
    assert kept[0]["warc-date"].startswith("1999-05-06T07:08") and kept[0]["warc-ip-address"] == "1.2.3.4" and by["ftp://f"][1] == b"\x01\x02\x03" and by["ftp://f"][0]["content-type"] == "image/gif"
    assert by["http://cut"][0]["warc-truncated"] == "length" and b"a.arc, version 1" in by["warcinfo"][1]
    assert {r.intact for r in arc.read_warc(spark, f"file://{warcs}").collect()} == {True}
