"""Every core query against its SQL, and the layout of the package."""

import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from foliolens.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(str([round(v, 6) if isinstance(v, float) else v for v in (r[k] for k in order)]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in registry.oracle_sql():
        r = duck.execute(registry.oracle_sql()[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(cols, r.fetchall())


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "foliolens").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"foliolens\.llm|from \.+llm|import llm", p.read_text()), p
