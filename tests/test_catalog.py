"""Every query of the catalogue against its SQL in DuckDB."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire.plans import documents, structures  # noqa: F401  they add queries
from quire.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return ",".join(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(df, columns):
    return sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_crc_and_wrapping_against_plain_loops(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.crc32 for r in QUERIES["crc"](spark, SF).collect()} == {i: zlib.crc32(t.encode()) for i, t in docs.items()}
    got = {r.doc_id: (r.lines, r.longest, r.last) for r in QUERIES["wrap_fixed_width"](spark, SF).collect()}
    for i, t in docs.items():
        lines = [""] if t.split() else []
        for word in re.sub(r"[ \t\n\x0b\f\r]", " ", t).split(" "):
            if word and lines[-1] and len(lines[-1]) + 1 + len(word) <= 60:
                lines[-1] += " " + word
            elif word:
                lines += [word[k : k + 60] for k in range(0, len(word), 60)]
        lines = [x for x in lines if x]
        assert got[i] == (len(lines), max(map(len, lines), default=0), len(lines[-1]) if lines else 0), i
