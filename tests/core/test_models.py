import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tandemlake.operators import models as M
from tandemlake.operators import network as N


def test_published_critical_values():
    for n, table in ((1, {-3.43: 0.01, -2.862: 0.05, -2.567: 0.10}), (2, {-3.896: 0.01, -3.336: 0.05, -3.044: 0.10})):
        for stat, p in table.items():
            assert abs(M.mackinnon_p(stat, n) - p) < 0.001


def test_unit_root_tests_have_size_and_power():
    rng = np.random.default_rng(1)
    walks = [np.cumsum(rng.normal(size=250)) for _ in range(150)]
    assert 0.01 <= np.mean([M.mackinnon_p(M.adf(w)[0]) < 0.05 for w in walks]) <= 0.12
    assert np.mean([M.kpss(w)[1] <= 0.05 for w in walks[:60]]) > 0.8
    ar = []
    for _ in range(40):
        x = np.zeros(250)
        for t in range(1, 250):
            x[t] = 0.5 * x[t - 1] + rng.normal()
        ar.append(x)
    assert np.mean([M.mackinnon_p(M.adf(x)[0]) < 0.05 for x in ar]) > 0.95
    assert np.mean([M.kpss(x)[1] > 0.05 for x in ar]) > 0.8


def test_cointegration_tests():
    rng = np.random.default_rng(2)
    none, some = [], []
    for _ in range(60):
        x = np.cumsum(rng.normal(size=300))
        none.append(M.dual_gate(np.cumsum(rng.normal(size=300)), x))
        some.append(M.dual_gate(2 * x + rng.normal(size=300), x))
    assert np.mean([r[1] < 0.05 for r in none]) < 0.17 and np.mean([r[3] for r in none]) < 0.2
    assert np.mean([r[1] < 0.05 and r[3] for r in some]) > 0.9
    x = np.cumsum(rng.normal(size=100))
    assert M.engle_granger(3 * x + 1, x) == (-math.inf, 0.0)
    assert M.dual_gate(x[:40], x[:40])[::2] == (0.0, 0.0)


def test_screen(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=200)) + 100
    series = {"A": x, "B": 2 * x + rng.normal(size=200), "C": np.cumsum(rng.normal(size=200)) + 100, "D": x[:150]}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p)) for k, v in series.items() for i, p in enumerate(v)]
    got = {(r.t1, r.t2): r for r in M.screen(spark.createDataFrame(rows, "ticker string, d date, px double"), partitions=2).collect()}
    assert len(got) == 6 and got["A", "B"].verdict == "pass"
    assert got["A", "D"].eg_t == 0.0 and got["A", "D"].eg_p is None and got["A", "D"].verdict == "fail"


def pairs(spark, n=120, seed=4):
    rng = np.random.default_rng(seed)
    x = 50 + np.cumsum(rng.normal(size=n))
    y = 3 + 1.5 * x + rng.normal(size=n) * 0.3
    return spark.createDataFrame([("p", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "pair string, d date, P1 double, P2 double")


def test_continued_filter_equals_the_uninterrupted_one(spark):
    p = pairs(spark)
    whole = M.fit_kalman(p, ["pair"], "d").toPandas().sort_values("d")
    cut = dt.date(2020, 3, 1)
    first = M.fit_kalman(p.where(F.col("d") < cut), ["pair"], "d")
    rest = M.continue_kalman(p.where(F.col("d") >= cut), first, ["pair"], "d").toPandas().sort_values("d")
    tail = whole[whole["d"] >= cut]
    assert np.allclose(rest[["alpha", "beta", "resid"]], tail[["alpha", "beta", "resid"]])
    assert abs(whole["beta"].iloc[-1] - 1.5) < 0.1
    assert M.fit_kalman(p.limit(4), ["pair"], "d").count() == 0


def test_filter_against_the_plain_formulas_and_em():
    rng = np.random.default_rng(5)
    x = rng.normal(size=80) + 10
    y = 2 * x + rng.normal(size=80)
    h = M.Hedge(np.eye(2) * 1e-3, 0.5, np.zeros(2), np.eye(2) * 10)
    states, _ = M.kalman_filter(y, x, M.Hedge(h.q, h.r, h.mean, h.cov))
    m, p = np.zeros(2), np.eye(2) * 10
    for t in range(80):
        if t:
            p = p + h.q
        obs = np.array([[x[t], 1.0]])
        s = obs @ p @ obs.T + h.r
        k = p @ obs.T @ np.linalg.inv(s)
        m, p = m + (k @ (y[t] - obs @ m)).ravel(), p - k @ obs @ p
        assert np.allclose(states[t], m)

    def loglik(h):
        total, hh = 0.0, M.Hedge(h.q, h.r, h.mean, h.cov)
        for t in range(80):
            if t:
                hh.advance()
            o = np.array([x[t], 1.0])
            s, v = o @ hh.cov @ o + hh.r, y[t] - o @ hh.mean
            total -= 0.5 * (math.log(2 * math.pi * s) + v * v / s)
            hh.update(y[t], x[t])
        return total

    steps = [loglik(M.kalman_em(y, x, h, k)) for k in range(4)]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:]))


def test_time_varying_model_recovers_theta():
    y, x = M.simulate_tv(400, 0.3, 0.0, seed=1)
    fit = M.fit_tv(y, x)
    assert abs(fit.params[3] - 0.3) < 0.25 and fit.t_theta < -3
    assert M.verdict(0.5, 0.01, 0.9, True).hedge == "none"
    assert M.verdict(0.01, 0.5, 0.3, True).hedge == "static"
    assert M.verdict(0.01, 0.01, 0.3, True).hedge == "dynamic"
    assert M.verdict(0.01, 0.01, -0.3, True).hedge == "static"
    assert M.verdict(math.nan, 0.01, 0.3, True).verdict == "undecided"
    with pytest.raises(ValueError):
        M.fit_tv(y[:10], x[:10])


def test_hedge_gate(spark):
    y, x = M.simulate_tv(60, 0.2, 0.0, seed=3)
    rows = [("a", i, float(p), float(q)) for i, (p, q) in enumerate(zip(y, x))]
    (r,) = M.hedge_gate(spark.createDataFrame(rows, "pair string, t int, P1 double, P2 double"), ["pair"], "t", draws=4).collect()
    assert r.hedge in ("none", "static", "dynamic")


# ------------------------------------------------------------------ graphs


def test_planarity():
    k5 = [(i, j) for i in range(5) for j in range(i)]
    k33 = [(i, j) for i in range(3) for j in range(3, 6)]
    grid = [(5 * r + c, 5 * r + c + 1) for r in range(5) for c in range(4)] + [(5 * r + c, 5 * r + c + 5) for r in range(4) for c in range(5)]
    assert not N.is_planar(5, k5) and not N.is_planar(6, k33) and N.is_planar(25, grid) and N.is_planar(5, k5[1:])
    assert not N.is_planar(8, [(a, 6) if b == 0 else (b, a) for a, b in k5] + [(0, 6), (6, 7)])
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    assert not N.is_planar(10, petersen)
    rng = np.random.default_rng(1)
    for _ in range(20):  # triangulated graphs are planar, with one more edge they are not
        w = rng.uniform(size=(12, 12))
        edges = [e[:2] for e in N.tmfg((w + w.T) / 2)]
        assert len({tuple(sorted(e)) for e in edges}) == 30 and N.is_planar(12, edges)
        order = rng.permutation(12)
        some = [(int(order[u]), int(order[v])) for u, v in edges if rng.uniform() < 0.8]
        assert N.is_planar(12, some)


def test_maximal_planar_graph():
    rng = np.random.default_rng(2)
    w = rng.uniform(size=(15, 15))
    w = (w + w.T) / 2
    edges = N.pmfg(w)
    assert len(edges) == 39 and N.is_planar(15, [e[:2] for e in edges])
    assert sum(e[2] for e in edges) >= sum(e[2] for e in N.tmfg(w)) * 0.95


def test_star_centrality():
    names = ["C", "O1", "O2", "O3", "O4", "O5", "P"]
    edges = [(0, k, 1.0) for k in range(1, 6)] + [(5, 6, 1.0)]
    xy = N.centrality(7, edges)
    assert xy["X"].idxmin() == 0 and xy.loc[0, "X"] == 0 and xy.loc[6, "XY"] >= xy.loc[5, "XY"] - 1
    between, ecc, close = N.distances(7, edges, False)
    assert ecc.tolist() == [2, 3, 3, 3, 3, 2, 3] and between[0] > between[5] > 0 == between[1] and abs(close[0] - 6 / 7) < 1e-12
    apart = N.centrality(9, edges)
    assert apart.loc[8, "XY"] == 2.0 and len(names) == 7
    with pytest.raises(ValueError):
        N.centrality(1, [])


def test_graphs_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(f, f"n{i}", f"n{j}", float(rng.uniform())) for f in ("a", "b") for i in range(9) for j in range(i)]
    df = spark.createDataFrame(rows, "f string, i string, j string, w double")
    graph = N.filtered_graphs(df, "f")
    assert graph.groupBy("f").count().collect()[0]["count"] == 21
    roles = N.node_roles(graph, "f").toPandas()
    assert isinstance(roles, pd.DataFrame) and len(roles) == 18 and {"central", "peripheral"} <= set(roles["role"])


def test_many_fits_at_once_are_the_single_ones():
    y, x = M.simulate_tv(60, 0.6, 0.1, seed=5)
    draws = np.array(M.bootstrap_draws(y, x, {"theta": 1.0}, 3, 1))
    p, se, ok = M.fit_tv_many(draws, x)
    for i, d in enumerate(draws):
        one = M.fit_tv(d, x)
        assert ok[i] == one.converged and np.allclose(p[i], one.params, atol=1e-5) and np.allclose(se[i], one.se, rtol=1e-3, equal_nan=True)
        assert M.tv_loglik_many(p[[i]], draws[[i]].T, x)[0] == pytest.approx(M.tv_loglik(p[i], d, x)[0])
