import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tandemlake.functions.expr import market_impact
from tandemlake.operators import ledger as L
from tandemlake.operators import signals as G

DAY = dt.date(2021, 3, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def test_transitions():
    rule = G.SignalRule(cooldown=2, max_hold=4)
    zs = [0, 2.1, 1.0, 0.4, -3, -3, -3, -4.5, None, 2.5, 5, 4.5, 3, 3, 3, 3, 3]
    state, got = G.SignalState(), []
    for z in zs:
        pos, *_, entry, leave, stop = G.step(state, rule, z, 100.0, 50.0, 1.0)
        got.append((pos, entry, leave, stop))
    flat = (0, False, False, False)
    assert got[:5] == [flat, (-1, True, False, False), (-1, False, False, False), (0, False, True, False), flat]
    assert got[5] == (1, True, False, False) and got[7] == (0, False, False, True)  # a stop is no exit
    assert got[8] == flat  # a bad bar leaves the cooldown as it is
    assert got[9] == flat and got[10] == flat and got[12] == (-1, True, False, False)
    assert got[15] == (0, False, True, False)  # held for the most bars


def test_executed_signals_and_replay(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=200) * 2
    rows = [("p", d, float(v), 100.0 + i % 7, 50.0, 1.2) for i, (d, v) in enumerate(zip(days(200), z))]
    rule = G.SignalRule(exec_lag=2, cooldown=1)
    got = G.generate_signals(spark.createDataFrame(rows, "pair string, ts date, z double, P1 double, P2 double, beta double"), ["pair"], rule).orderBy("ts").collect()
    want = list(G.replay(((r[2], r[3], r[4], r[5]) for r in rows), rule))
    assert [(r.pos, r.n1, r.n2, r.entry, r.exit, r.stop) for r in got] == want
    assert any(r.pos for r in got) and not got[0].pos and not got[1].pos


def test_bang_bang_table_and_fold(spark):
    table = [(0, -1.3, True, 1), (0, 1.3, True, -1), (0, 1.2, True, 0), (1, -0.6, True, 1), (1, -0.4, True, 0), (1, 2.0, True, 0), (-1, 0.8, True, -1), (-1, 0.7, True, 0), (-1, -2.0, True, 0), (1, -2.0, False, 0), (0, None, True, 0), (-1, math.nan, True, 0)]
    assert all(G.bang_bang(s, x, ok) == want for s, x, ok, want in table)
    rng = np.random.default_rng(2)
    rows = [(k, d, float(x), bool(x < 2.5)) for k in "ab" for d, x in zip(days(120), rng.normal(size=120) * 1.5)]
    got = {(r.k, r.ts): r.state for r in G.fold_bang_bang(spark.createDataFrame(rows, "k string, ts date, s double, model_ok boolean"), ["k"], "ts").collect()}
    for k in "ab":
        state = 0
        for kk, d, x, ok in rows:
            if kk == k:
                state = G.bang_bang(state, x, ok)
                assert got[k, d] == state
    with pytest.raises(ValueError):
        G.bang_bang(2, 0.0, True)


def test_impact_of_the_published_example(spark):
    (r,) = spark.range(1).select(market_impact(F.lit(1000.0), F.lit(50.0), F.lit(500_000.0), F.lit(3000.0)).alias("x")).collect()
    assert round(r.x, 2) == 93.91


def book(spark, reset, **kw):
    p1, p2 = [100.0, 102.0, 101.0, 103.0, 104.0, 100.0], [50.0, 51.0, 50.0, 52.0, 51.0, 49.0]
    pos = [0, 1, 1, 0, -1, -1]
    rows = [("p", d, a, b, s, 2.0, 1000.0, 0.0, 0.5 if i == 2 else 0.0) for i, (d, a, b, s) in enumerate(zip(days(6), p1, p2, pos))]
    df = spark.createDataFrame(rows, "pair string, ts date, P1 double, P2 double, pos int, beta double, target double, D1 double, D2 double")
    return L.book(df, ["pair"], reset, cost_bps=(10.0, 20.0), borrow_bps=252.0, **kw).orderBy("ts").collect()


def test_book_by_hand(spark):
    r = book(spark, "daily")
    assert [x.n1 for x in r] == pytest.approx([0, 5, 1000 / 204, 0, -1000 / 207, -1000 / 206])
    assert [x.n2 for x in r] == pytest.approx([0, -10, -2000 / 204, 0, 2000 / 207, 2000 / 206])
    assert r[1].pnl_price == pytest.approx(5 * 2 - 10 * 1) and r[1].cost == pytest.approx((10 * 5 * 102 + 20 * 10 * 51) / 1e4)
    assert r[1].borrow == pytest.approx(510 * 0.0252 / 252) and r[2].dividends == pytest.approx(-2000 / 204 * 0.5)
    assert [x.trade_id for x in r] == [0, 1, 1, 0, 2, 2] and [x.entry for x in r] == [False, True, False, False, True, False]
    frozen = book(spark, "frozen")
    assert [x.n1 for x in frozen] == pytest.approx([0, 5, 5, 0, -1000 / 207, -1000 / 207])
    assert [x.n1 for x in book(spark, "band", band=0.0)] == pytest.approx([x.n1 for x in r])
    assert [x.n1 for x in book(spark, "band", band=9.0)] == pytest.approx([x.n1 for x in frozen])


def ledger(spark, n1, price=(100.0, 50.0), **kw):
    n = len(n1)
    p = spark.createDataFrame([("p", d, price[0], price[1]) for d in days(n)], "pair string, ts date, P1 double, P2 double")
    s = spark.createDataFrame([("p", d, float(a), float(-2 * a), 0.0) for d, a in zip(days(n), n1)], "pair string, ts date, n1 double, n2 double, z double")
    c = L.Costs(cost_bps=10, borrow_bps=50, **kw)
    led = L.daily_ledger(p, s, ["pair"], c)
    return led, L.round_trips(led, ["pair"]), c


@pytest.mark.parametrize("path", [[0, 1, 1, 0, 0], [0, 1, -1, -1, 0], [1, 0, -1, 0, 1, 0], [0, 1, 1, -1, 1, 0, 0]])
def test_trips_reconcile_with_the_ledger_on_flat_prices(spark, path):
    led, trips, c = ledger(spark, [100 * x for x in path])
    rows = trips.collect()
    assert sum(r.cost for r in rows) == pytest.approx(led.agg(F.sum("cost")).first()[0])
    assert sum(r.bars for r in rows) == sum(1 for x in path if x)
    (s,) = L.summary(led, trips, ["pair"], c).collect()
    assert s.n_trades == len(rows) and s.net_pnl == pytest.approx(sum(r.pnl_net for r in rows))


def test_open_trade_is_dropped_and_alignment_is_checked(spark):
    led, trips, _ = ledger(spark, [0, 100, 100])
    assert trips.count() == 0
    p = led.select("pair", "ts", "P1", "P2")
    L.check_alignment(p, led, ["pair"])
    with pytest.raises(ValueError):
        L.check_alignment(p.where(F.col("ts") > DAY), led, ["pair"])
    with pytest.raises(ValueError):
        L.check_alignment(p.unionAll(p), led, ["pair"])
    with pytest.raises(ValueError):
        L.Costs(capital_base=-1)


def test_halts_by_z(spark):
    z = [0, 5, 2, 2, 2, 0.5, 2, 0, None, 5, 0]
    df = spark.createDataFrame([("p", d, None if v is None else float(v)) for d, v in zip(days(11), z)], "pair string, ts date, z double")
    flags = lambda b: [r.halted for r in L.z_halts(df, ["pair"], b).orderBy("ts").collect()]
    assert flags(L.Breaker(z_halt=4, cooldown=1)) == [False, True, True, False, False, False, False, False, False, True, True]
    assert flags(L.Breaker(z_halt=4, cooldown=1, z_reentry=1.0)) == [False, True, True, True, True, False, False, False, False, True, True]


def test_spread_accounting_identity(spark):
    rng = np.random.default_rng(4)
    rows = [("p", d, *map(float, rng.normal(size=5)), float(rng.integers(-1, 2))) for d in days(40)]
    df = spark.createDataFrame(rows, "pair string, ts date, y1 double, y2 double, w1 double, w2 double, c double, signal double")
    v = L.decompose_spread(df, ["pair"]).orderBy("ts").collect()
    for a, b in zip(v, v[1:]):
        assert b.book == pytest.approx(a.signal * (b.spread - a.spread))
        assert b.revaluation == pytest.approx(a.signal * ((b.w1 - a.w1) * b.y1 + (b.w2 - a.w2) * b.y2 - (b.c - a.c)))
    assert v[0].book == v[0].tradable == 0
