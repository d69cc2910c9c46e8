"""Where the test tables are, and results of both engines in one form."""

from __future__ import annotations

import math
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """Values of both engines in one form; floats to nine digits."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace(" 00:00:00", "")
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if isinstance(v, int) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([[plain(r[k]) for k in order] for r in rows], key=repr)


def same(spark_df, con, sql):
    """Both results, as sorted columns and rows."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    out = con.execute(sql)
    want = rows_of([c[0] for c in out.description], out.fetchall())
    return got, want
