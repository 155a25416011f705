"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from tandemlake.plans import catalog, desk  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables here")
QUICK = ["static_hedge_half_life", "rolling_hedge", "dominant_instrument", "session_grid", "session_bars", "multiple_testing", "walk_forward_folds", "ou_scores", "capped_weights", "pair_round_trips", "pair_signals", "book_band", "kalman_continued", "stitched_signals", "history_z", "breaker_audit", "netted_book", "session_book_c", "forward_targets", "testing_over_all", "partial_adjustment", "trade_edge"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None or (isinstance(a, float) and math.isnan(a))) == (b is None or (isinstance(b, float) and math.isnan(b))) and (a is None or b is None or math.isnan(a) or abs(a - b) <= 1e-4 * max(1, abs(a)))
    return str(a) == str(b)


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    rel = db.execute(catalog.SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    text = lambda r: tuple(f"{round(v, 3) + 0.0:.3f}" if isinstance(v, float) else str(v) for v in r)
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    want = sorted([tuple(plain(r[columns.index(c)]) for c in order) for r in rel.fetchall()], key=text)
    got = sorted([tuple(r[c] for c in order) for r in df.collect()], key=text)
    assert len(got) == len(want) and all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
