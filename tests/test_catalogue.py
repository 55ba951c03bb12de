"""The core's queries against their SQL, over the smallest given tables where they are at hand."""

import math
from pathlib import Path

import duckdb
import pytest

from quarrylight.plans import catalogue

DATA = Path("/root/testdata/sf0.01")
CHOSEN = "q_vector_topk q_search_boosted q_search_multi q_discover_first_wins q_ownership q_overview q_type_groups q_name_status q_dirty_changed q_reverted q_patch_index q_config_merge".split()


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)


def test_every_query_is_listed_once():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 39
