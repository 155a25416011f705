"""Unit-root and cointegration tests, Kalman hedges, time-varying cointegration: NumPy kernels and the grouped operators on them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import benjamini_hochberg

# ------------------------------------------------------------------ fixed values, from the published tables
#: MacKinnon's surfaces by deterministic part and number of series: switch, lower and upper bound, small-p and large-p polynomials.
MACKINNON = {
    ("n", 1): (-1.04, -19.04, math.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    ("n", 2): (-1.53, -19.62, 1.51, (1.9129, 1.3857, 0.035322), (1.5578, 0.8558, -0.2083, -0.033549)),
    ("c", 1): (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    ("c", 2): (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
    ("ct", 1): (-2.89, -16.18, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
    ("ct", 2): (-3.19, -21.15, 0.63, (3.6646, 1.5419, 0.036448), (2.85, 0.5272, -0.36622, -0.051695)),
}
#: Two series, by order of the deterministic part: 90, 95 and 99 % for rank 0 and 1.
JOHANSEN_TRACE = {-1: ((10.4741, 12.3212, 16.3640), (2.9762, 4.1296, 6.9406)), 0: ((13.4294, 15.4943, 19.9349), (2.7055, 3.8415, 6.6349)), 1: ((16.1619, 18.3985, 23.1485), (2.7055, 3.8415, 6.6349))}
JOHANSEN_MAXEIG = {-1: ((9.4748, 11.2246, 15.0923), (2.9762, 4.1296, 6.9406)), 0: ((12.2971, 14.2639, 18.5200), (2.7055, 3.8415, 6.6349)), 1: ((15.0006, 17.1481, 21.7465), (2.7055, 3.8415, 6.6349))}
#: 10, 5, 2.5 and 1 %.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def mackinnon_p(stat: float, n: int = 1, trend: str = "c") -> float:
    switch, low, high, small, large = MACKINNON[trend, n]
    if stat <= low:
        return 0.0
    if stat >= high:
        return 1.0
    return NormalDist().cdf(sum(c * stat**i for i, c in enumerate(small if stat <= switch else large)))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, float(e @ e)


def adf(x: np.ndarray, constant: bool = True, max_lag: int | None = None, autolag: bool = True) -> tuple[float, int]:
    """Dickey-Fuller t on the level and the lags used; the lag has the least AIC on the sample that all lags share."""
    x = np.asarray(x, float)
    n = len(x)
    trend = int(constant)
    if max_lag is None:
        max_lag = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - trend - 1))
    d = np.diff(x)

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(d))
        cols = [x[rows]] + [d[rows - i] for i in range(1, lags + 1)] + [np.ones(len(rows))] * trend
        return d[rows], np.column_stack(cols)

    lag = max_lag
    if autolag:
        y, full = design(max_lag, max_lag)
        # one QR decomposition serves all lags: with the constants and the level first, lag k adds a column
        q = np.linalg.qr(np.column_stack([full[:, max_lag + 1 :], full[:, : max_lag + 1]]))[0]
        ssr = y @ y - np.cumsum((q.T @ y) ** 2)[trend:]
        aic = len(y) * np.log(np.maximum(ssr, 1e-300) / len(y)) + 2 * (np.arange(max_lag + 1) + 1 + trend)
        lag = int(np.argmin(aic))
    y, z = design(lag, lag)
    b, ssr = _ols(y, z)
    var = ssr / (len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)[0, 0]
    return (b[0] / math.sqrt(var) if var > 0 else -math.inf), lag


#: A residual of no more than this share of the variation counts as a perfect fit.
PERFECT = 100 * np.finfo(float).eps ** 0.5


def engle_granger(y: np.ndarray, x: np.ndarray, max_lag: int | None = None, autolag: bool = True, trend: str = "c") -> tuple[float, float]:
    """t and p of no cointegration, from the residual of y on x and the trend (n, c or ct); a near-perfect fit counts as minus infinity."""
    n = len(x)
    z = np.column_stack([x, *([np.ones(n)] if trend != "n" else []), *([np.arange(1.0, n + 1)] if trend == "ct" else [])])
    b, ssr = _ols(y, z)
    if ssr <= PERFECT * ((y - (y.mean() if trend != "n" else 0)) ** 2).sum():
        return -math.inf, 0.0
    t, _ = adf(y - z @ b, constant=False, max_lag=max_lag, autolag=autolag)
    return t, mackinnon_p(t, 2, trend)


def johansen(x: np.ndarray, lags: int = 1, det_order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Trace and largest-eigenvalue statistics by rank, with `lags` lagged differences and a constant (det_order 0), a linear trend (1) or neither (-1)."""
    if det_order == 1:
        t = np.column_stack([np.linspace(-1, 1, len(x)), np.ones(len(x))])
        x = x - t @ np.linalg.lstsq(t, x, rcond=None)[0]
    elif not det_order:
        x = x - x.mean(axis=0)
    d = np.diff(x, axis=0)
    rows = np.arange(lags, len(d))
    z = np.column_stack([d[rows - i] for i in range(1, lags + 1)]) if lags else np.empty((len(rows), 0))
    demean = lambda m: m - m.mean(axis=0) if m.shape[1] and det_order > -1 else m
    z, r0, rk = demean(z), demean(d[rows]), demean(x[1 : len(x) - lags] if lags else x[:-1])
    if z.shape[1]:
        r0, rk = (m - z @ np.linalg.lstsq(z, m, rcond=None)[0] for m in (r0, rk))
    n = len(rk)
    skk, sk0, s00 = rk.T @ rk / n, rk.T @ r0 / n, r0.T @ r0 / n
    lam = np.linalg.eigvals(np.linalg.solve(skk, sk0 @ np.linalg.solve(s00, sk0.T))).real
    logs = np.log1p(-np.clip(np.sort(lam)[::-1], 0, 1 - 1e-15))
    return -n * np.cumsum(logs[::-1])[::-1], -n * logs


def kpss(x: np.ndarray, trend: str = "c") -> tuple[float, float]:
    """KPSS statistic with automatic bandwidth, and its p, between 0.01 and 0.10."""
    x = np.asarray(x, float)
    n = len(x)
    e = x - x.mean() if trend == "c" else x - np.polyval(np.polyfit(np.arange(n), x, 1), np.arange(n))
    s0, s1 = (e @ e) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        prod = e[i:] @ e[:-i] / (n / 2)
        s0, s1 = s0 + prod, s1 + i * prod
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    s = e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))
    stat = (np.cumsum(e) ** 2).sum() / n**2 / (s / n) if s > 0 else 0.0
    crit = KPSS_CRITICAL[trend]
    return float(stat), float(np.interp(stat, crit, (0.10, 0.05, 0.025, 0.01)))


@dataclass(frozen=True)
class Gate:
    """How a pair is tested: both gates, or one of them (method eg or johansen)."""

    alpha_eg: float = 0.05
    alpha_joh: float = 0.05
    trend: str = "c"
    max_lag: int | None = None
    autolag: bool = True
    det_order: int = 0
    lag_diffs: int = 1
    stat: str = "trace"
    method: str = "both"

    def __post_init__(self):
        if self.trend not in ("n", "c", "ct") or self.det_order not in (-1, 0, 1) or self.stat not in ("trace", "maxeig") or self.method not in ("both", "eg", "johansen"):
            raise ValueError("trend must be n, c or ct, det_order -1, 0 or 1, stat trace or maxeig, method both, eg or johansen")


def critical_column(alpha: float) -> int:
    return 2 if alpha <= 0.01 else 1 if alpha <= 0.05 else 0 if alpha <= 0.10 else 1


def dual_gate(y: np.ndarray, x: np.ndarray, gate: Gate = Gate()) -> tuple[float, float, float, bool]:
    """Engle-Granger t and p, Johansen's statistic and whether it passes; fewer than 50 rows give (0, NaN, 0) and pass nothing."""
    if len(y) < 50:
        return 0.0, math.nan, 0.0, False
    t, p, value, passes = 0.0, math.nan, 0.0, False
    if gate.method != "johansen":
        t, p = engle_granger(y, x, gate.max_lag, gate.autolag, gate.trend)
    if gate.method != "eg":
        try:
            trace, top = johansen(np.column_stack([y, x]), gate.lag_diffs, gate.det_order)
        except np.linalg.LinAlgError:
            return t, p, math.nan, False
        value, table = (trace[0], JOHANSEN_TRACE) if gate.stat == "trace" else (top[0], JOHANSEN_MAXEIG)
        passes = value > table[gate.det_order][0][critical_column(gate.alpha_joh)]
    return t, p, float(value), bool(passes)


def pair_tests(bars: DataFrame, gate: Gate = Gate(), price: str = "px", ts: str = "d", group: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Every pair t1 < t2 (of each group: a formation's window) through the gate: t1, t2, eg_t, eg_p, joh_stat, joh_pass.

    Both legs must have the first and the last day of their group's bars and 50 days in common. Each ticker is packed to one row
    (dates and prices); pairs of packed rows are dealt over the tasks, so a series crosses the network once for each of its
    pairs and never row by row.
    """
    group = group or []
    ok = bars.where(F.col(price).isNotNull()).withColumn("_t", F.unix_date(F.col(ts).cast("date")))
    packed = ok.groupBy(*group, "ticker").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col(price).cast("double").alias("p")))).alias("s"))
    packed = packed.select(*group, "ticker", F.col("s.t").alias("t"), F.col("s.p").alias("p"))
    ends = bars.groupBy(*group).agg(F.min(F.unix_date(F.col(ts).cast("date"))).alias("lo"), F.max(F.unix_date(F.col(ts).cast("date"))).alias("hi"))
    a = packed.select(*group, *(F.col(c).alias(f"{c}1") for c in ("ticker", "t", "p")))
    b = packed.select(*(F.col(c).alias(f"_{c}") for c in group), *(F.col(c).alias(f"{c}2") for c in ("ticker", "t", "p")))
    on = F.col("ticker1") < F.col("ticker2")
    for c in group:
        on &= F.col(c) == F.col(f"_{c}")
    pairs = a.join(b, on).drop(*(f"_{c}" for c in group))
    pairs = pairs.join(ends, group) if group else pairs.crossJoin(F.broadcast(ends))  # one row
    n = partitions or 2 * bars.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.select(*group, "ticker1", "ticker2", "t1", "p1", "t2", "p2", "lo", "hi").repartition(n, *group, "ticker1", "ticker2")
    k = len(group)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t1, p1, t2, p2, lo, hi in zip(*(c.to_pylist() for c in batch.columns[k + 2 :])):
                t1, t2 = np.array(t1), np.array(t2)
                whole = t1[0] == t2[0] == lo and t1[-1] == t2[-1] == hi
                _, i, j = np.intersect1d(t1, t2, assume_unique=True, return_indices=True)
                out.append(dual_gate(np.array(p1)[i], np.array(p2)[j], gate) if whole else (0.0, math.nan, 0.0, False))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            clean = [[None if isinstance(v, float) and math.isnan(v) else v for v in c] for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 2], *(pa.array(c, t) for c, t in zip(clean, kinds))], [*group, "t1", "t2", "eg_t", "eg_p", "joh_stat", "joh_pass"])

    kinds = "".join(f"{c} {bars.schema[c].dataType.simpleString()}, " for c in group)
    return pairs.mapInArrow(work, f"{kinds}t1 string, t2 string, eg_t double, eg_p double, joh_stat double, joh_pass boolean")


def screen(bars: DataFrame, gate: Gate = Gate(), fdr: bool = True, fdr_alpha: float | None = None, price: str = "px", ts: str = "d", group: list[str] | None = None, only_pass: bool = False, sort_by: str | None = None, partitions: int | None = None) -> DataFrame:
    """Every pair through both tests: group, t1, t2, eg_t, eg_p, eg_p_fdr, eg_pass, joh_stat, joh_pass, verdict.

    The raw gate is below alpha, the adjusted one (within each group) at most fdr_alpha. only_pass leaves the pairs that pass both;
    sort_by (eg_p, which means the adjusted one under fdr, eg_t, joh_stat or any other column) orders them, see screen_order().
    """
    alpha = gate.alpha_eg if fdr_alpha is None else fdr_alpha
    tests = pair_tests(bars, gate, price, ts, group, partitions)
    if fdr:
        out = benjamini_hochberg(tests, "eg_p", alpha, group).withColumnRenamed("p_adj", "eg_p_fdr").withColumn("eg_pass", F.col("reject")).drop("reject")
    else:
        out = tests.withColumn("eg_p_fdr", F.col("eg_p")).withColumn("eg_pass", F.coalesce(F.col("eg_p") < gate.alpha_eg, F.lit(False)))
    out = out.withColumn("verdict", F.when(F.col("eg_pass") & F.col("joh_pass"), "pass").otherwise("fail"))
    out = out.where("verdict = 'pass'") if only_pass else out
    return screen_order(out, sort_by, fdr) if sort_by else out


def screen_order(screen: DataFrame, sort_by: str = "eg_p", fdr: bool = True) -> DataFrame:
    """Passes first, then by p from the least or by a statistic from the largest; any other column on its own from the least. Ties go by pair."""
    by = "eg_p_fdr" if sort_by == "eg_p" and fdr else sort_by
    if by in ("eg_p", "eg_p_fdr"):
        order = [F.desc("verdict"), F.asc_nulls_last(by)]
    elif by in ("eg_t", "joh_stat"):
        order = [F.desc("verdict"), F.desc_nulls_last(by)]
    else:
        order = [F.asc_nulls_last(by)]
    return screen.orderBy(*order, "t1", "t2")


def score_table(bars: DataFrame, method: str = "eg", gate: Gate | None = None, **more) -> DataFrame:
    """The matrices of scores and p-values of one test as a table: t1, t2, score, p (null for johansen), passes; the rest of a matrix is zero and null."""
    gate = replace(gate or Gate(), method=method)
    out = pair_tests(bars, gate, **more)
    if method == "eg":
        return out.select("t1", "t2", F.col("eg_t").alias("score"), F.col("eg_p").alias("p"), F.coalesce(F.col("eg_p") < gate.alpha_eg, F.lit(False)).alias("passes"))
    return out.select("t1", "t2", F.col("joh_stat").alias("score"), F.lit(None).cast("double").alias("p"), F.col("joh_pass").alias("passes"))


def stationarity(spreads: DataFrame, keys: list[str], ts: str, x: str = "resid", alpha: float = 0.05) -> DataFrame:
    """keys, adf_stat, adf_p, kpss_stat, kpss_p, verdict (stationary, non-stationary or inconclusive) of each spread."""
    kinds = ", ".join(f"{k} {spreads.schema[k].dataType.simpleString()}" for k in keys)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(ts)[x].dropna().to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys}
        if len(v) < 20 or np.ptp(v) == 0:
            return pd.DataFrame([{**row, "adf_stat": None, "adf_p": None, "kpss_stat": None, "kpss_p": None, "verdict": "inconclusive"}])
        t, _ = adf(v)
        p, (s, q) = mackinnon_p(t), kpss(v)
        verdict = "stationary" if p < alpha <= q else "non-stationary" if p >= alpha > q else "inconclusive"
        return pd.DataFrame([{**row, "adf_stat": t, "adf_p": p, "kpss_stat": s, "kpss_p": q, "verdict": verdict}])

    return spreads.select(*keys, ts, x).groupBy(*keys).applyInPandas(work, f"{kinds}, adf_stat double, adf_p double, kpss_stat double, kpss_p double, verdict string")


# ------------------------------------------------------------------ Kalman hedge


@dataclass
class Hedge:
    """A random-walk hedge: state (beta, alpha), its covariance (3 numbers), noise of state and observation."""

    q: np.ndarray = field(default_factory=lambda: np.eye(2) * 1e-5)
    r: float = 1e-2
    mean: np.ndarray = field(default_factory=lambda: np.zeros(2))
    cov: np.ndarray = field(default_factory=lambda: np.eye(2) * 1e6)

    def update(self, y: float, x: float) -> tuple[float, float]:
        """The measurement of one bar; the filtered (beta, alpha)."""
        b, a, p, c, d = _measure(*self.mean, self.cov[0, 0], self.cov[0, 1], self.cov[1, 1], y, x, self.r)
        self.mean, self.cov = np.array([b, a]), np.array([[p, c], [c, d]])
        return b, a

    def advance(self) -> None:
        self.cov = self.cov + self.q


def _measure(b: float, a: float, p: float, c: float, d: float, y: float, x: float, r: float) -> tuple[float, float, float, float, float]:
    """State (b, a) with covariance (p, c; c, d) after y = b x + a + noise: plain numbers, since a bar is a handful of products."""
    u, v = p * x + c, c * x + d
    s = x * u + v + r
    g, h, e = u / s, v / s, y - (x * b + a)
    return b + g * e, a + h * e, p - g * u, c - g * v, d - h * v


def kalman_filter(y: np.ndarray, x: np.ndarray, h: Hedge, continued: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Filtered states and covariances; h ends as the posterior of the last bar. A continued filter advances before its first bar."""
    b, a = map(float, h.mean)
    p, c, d = float(h.cov[0, 0]), float(h.cov[0, 1]), float(h.cov[1, 1])
    qp, qc, qd, r = float(h.q[0, 0]), float(h.q[0, 1]), float(h.q[1, 1]), float(h.r)
    out = []
    for i, (yi, xi) in enumerate(zip(np.asarray(y, float).tolist(), np.asarray(x, float).tolist())):
        if i or continued:
            p, c, d = p + qp, c + qc, d + qd
        b, a, p, c, d = _measure(b, a, p, c, d, yi, xi, r)
        out.append((b, a, p, c, d))
    table = np.array(out).reshape(-1, 5)
    if out:
        h.mean, h.cov = np.array([b, a]), np.array([[p, c], [c, d]])
    return table[:, :2].copy(), table[:, [2, 3, 3, 4]].reshape(-1, 2, 2)


def kalman_em(y: np.ndarray, x: np.ndarray, h: Hedge, rounds: int, keep_prior: bool = False) -> Hedge:
    """Noise covariances (and, unless kept, the prior) by expectation maximisation: smoothed states with lag-one covariances."""
    q, r, m0, p0 = h.q, h.r, h.mean, h.cov
    n = len(y)
    obs = np.column_stack([x, np.ones(n)])
    for _ in range(rounds):
        means, covs = kalman_filter(y, x, Hedge(q, r, m0, p0))
        sm, sp, lag = means.copy(), [None] * n, [None] * n
        sp[-1] = covs[-1]
        for t in range(n - 2, -1, -1):
            ahead = covs[t] + q
            g = np.linalg.solve(ahead, covs[t]).T
            sm[t] = means[t] + g @ (sm[t + 1] - means[t])
            sp[t] = covs[t] + g @ (sp[t + 1] - ahead) @ g.T
            lag[t + 1] = sp[t + 1] @ g.T
        r = max(float(np.mean([(y[t] - obs[t] @ sm[t]) ** 2 + obs[t] @ sp[t] @ obs[t] for t in range(n)])), 1e-12)
        q = sum(np.outer(sm[t] - sm[t - 1], sm[t] - sm[t - 1]) + sp[t] + sp[t - 1] - lag[t] - lag[t].T for t in range(1, n)) / (n - 1)
        q = (q + q.T) / 2
        if not keep_prior:
            m0, p0 = sm[0], sp[0]
    return Hedge(q, r, m0, p0)


def smooth(y: np.ndarray, x: np.ndarray, h: Hedge) -> np.ndarray:
    """Smoothed states: they look ahead and must not feed signals."""
    means, covs = kalman_filter(y, x, Hedge(h.q, h.r, h.mean, h.cov))
    for t in range(len(y) - 2, -1, -1):
        g = np.linalg.solve(covs[t] + h.q, covs[t]).T
        means[t] = means[t] + g @ (means[t + 1] - means[t])
    return means


STATE = "alpha double, beta double, y_hat double, resid double"
PARAMS = "q array<double>, r double, mean array<double>, cov array<double>"


def fit_kalman(pairs: DataFrame, keys: list[str], ts: str, q: float = 1e-5, r: float = 1e-2, init_cov: float = 1e6, em_rounds: int = 0, mode: str = "filter", keep_prior: bool = False, full_span: bool = False) -> DataFrame:
    """pairs (keys, ts, P1, P2) -> keys, ts, alpha, beta, y_hat, resid, and on the last bar of each pair its parameters. Fewer than 5 bars give nothing.

    keep_prior: expectation maximisation estimates the noises alone, not the prior. full_span: only pairs that have the first and
    the last bar of all pairs.
    """
    if full_span:
        ends = pairs.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        mine = pairs.dropna(subset=["P1", "P2"]).groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).join(F.broadcast(ends), (F.col("_a") == F.col("_lo")) & (F.col("_b") == F.col("_hi")))
        pairs = pairs.join(mine.select(*keys), keys, "left_semi")
    if min(q, r, init_cov) <= 0 or not all(map(math.isfinite, (q, r, init_cov))):
        raise ValueError("q, r and init_cov must be positive and finite")
    if mode not in ("filter", "smooth"):
        raise ValueError("mode must be filter or smooth")
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    schema = ", ".join(f"{c} {kind(c)}" for c in (*keys, ts)) + f", {STATE}, {PARAMS}"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(ts, kind="stable")
        columns = [*keys, ts, "alpha", "beta", "y_hat", "resid", "q", "r", "mean", "cov"]
        if len(pdf) < 5:
            return pd.DataFrame(columns=columns)
        y, x = pdf["P1"].to_numpy(float), pdf["P2"].to_numpy(float)
        h = Hedge(np.eye(2) * q, r, np.zeros(2), np.eye(2) * init_cov)
        h = kalman_em(y, x, h, em_rounds, keep_prior) if em_rounds else h
        states = smooth(y, x, h) if mode == "smooth" else None
        filtered, _ = kalman_filter(y, x, h)
        return _states(pdf, keys, ts, filtered if states is None else states, y, x, h)[columns]

    return pairs.select(*keys, ts, "P1", "P2").groupBy(*keys).applyInPandas(work, schema)


def _states(pdf: pd.DataFrame, keys: list[str], ts: str, s: np.ndarray, y: np.ndarray, x: np.ndarray, h: Hedge) -> pd.DataFrame:
    hat = s[:, 1] + s[:, 0] * x
    out = pdf[[*keys, ts]].assign(alpha=s[:, 1], beta=s[:, 0], y_hat=hat, resid=y - hat)
    last = [None] * (len(pdf) - 1)
    return out.assign(q=[*last, h.q.ravel().tolist()], r=[*last, float(h.r)], mean=[*last, h.mean.tolist()], cov=[*last, h.cov.ravel().tolist()])


def continue_kalman(pairs: DataFrame, params: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """New bars filtered on from frozen parameters (keys, q, r, mean, cov): the posterior advances once before the first bar."""
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    schema = ", ".join(f"{c} {kind(c)}" for c in (*keys, ts)) + f", {STATE}, {PARAMS}"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        one = pdf.iloc[0]
        h = Hedge(np.array(one["q"]).reshape(2, 2), float(one["r"]), np.array(one["mean"]), np.array(one["cov"]).reshape(2, 2))
        y, x = pdf["P1"].to_numpy(float), pdf["P2"].to_numpy(float)
        states, _ = kalman_filter(y, x, h, continued=True)
        return _states(pdf, keys, ts, states, y, x, h)

    joined = pairs.select(*keys, ts, "P1", "P2").dropna().join(params.where("r is not null").select(*keys, "q", "r", "mean", "cov"), keys)
    return joined.groupBy(*keys).applyInPandas(work, schema)


def coerce_state(state: object) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, covariance) of a state that is given as a pair, as a mapping with mean and cov, as six numbers (mean, then the covariance
    by rows), or as None (a diffuse prior)."""
    if state is None:
        return None
    if isinstance(state, dict):
        if not {"mean", "cov"} <= set(state):
            raise ValueError("a state needs mean and cov")
        state = (state["mean"], state["cov"])
    if isinstance(state, np.ndarray) and state.shape == (6,):
        state = (state[:2], state[2:])
    if not isinstance(state, (tuple, list)) or len(state) != 2:
        raise ValueError("a state is a pair of mean and covariance")
    mean, cov = np.asarray(state[0], float).ravel(), np.asarray(state[1], float)
    if mean.shape != (2,) or cov.size != 4 or not (np.isfinite(mean).all() and np.isfinite(cov).all()):
        raise ValueError("the mean has two finite numbers, the covariance four")
    return mean, cov.reshape(2, 2)


def filter_on_new(y: np.ndarray, x: np.ndarray, q: np.ndarray, r: float, state: object = None, init_cov: float = 1e6) -> tuple[np.ndarray, Hedge]:
    """Filtered (beta, alpha) of new bars from frozen noises. A given state is the posterior of the bar before and advances first; none is
    diffuse and doesn't. Fewer than 5 bars are refused."""
    if len(y) < 5:
        raise ValueError("need 5 bars or more")
    known = coerce_state(state)
    mean, cov = known or (np.zeros(2), np.eye(2) * init_cov)
    h = Hedge(np.asarray(q, float).reshape(2, 2), float(r), mean, cov)
    return kalman_filter(np.asarray(y, float), np.asarray(x, float), h, continued=known is not None)[0], h


def kalman_ahead(y: np.ndarray, x: np.ndarray, train: int, alpha: float = 1e-5, momentum: bool = False, alpha_speed: float = 1e-6) -> np.ndarray:
    """One-step-ahead (intercept, slope) of y on x by bar, from what was before the bar: a random walk, or with momentum a slope that
    drifts by a third state. The prior is the least-squares fit of the first `train` bars, noises are shares of its residual's."""
    y0, x0 = y[:train], x[:train]
    slope = float((x0 - x0.mean()) @ (y0 - y0.mean()) / ((x0 - x0.mean()) ** 2).sum())
    const = float((y0 - slope * x0).mean())
    noise, var_x = float((y0 - const - slope * x0).var(ddof=1)), float(x0.var(ddof=1))
    scale = np.array([noise, noise / var_x, noise / var_x])
    m = 3 if momentum else 2
    move = np.eye(m)
    if momentum:
        move[1, 2] = 1
    state = np.array([const, slope, 0.0])[:m]
    cov = np.zeros((m, m)) if momentum else np.diag(scale[:2] / train)
    q = np.diag(np.array([alpha, alpha, alpha_speed])[:m] * scale[:m])
    out = np.empty((len(y), 2))
    for t in range(len(y)):
        state, cov = move @ state, move @ cov @ move.T + q
        out[t] = state[:2]
        h = np.array([1.0, x[t], 0.0])[:m]
        ph = cov @ h
        gain = ph / (h @ ph + noise)
        state, cov = state + gain * (y[t] - h @ state), cov - np.outer(gain, ph)
    return out


def fit_kalman_ahead(pairs: DataFrame, keys: list[str], ts: str, train: int, momentum: bool = False, alpha: float = 1e-5, alpha_speed: float = 1e-6) -> DataFrame:
    """pairs (keys, ts, P1, P2) -> keys, ts, mu, gamma known before each bar; pairs with no more than `train` bars give nothing."""
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    schema = ", ".join(f"{c} {kind(c)}" for c in (*keys, ts)) + ", mu double, gamma double"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(ts, kind="stable")
        if len(pdf) <= train:
            return pd.DataFrame(columns=[*keys, ts, "mu", "gamma"])
        got = kalman_ahead(pdf["P1"].to_numpy(float), pdf["P2"].to_numpy(float), train, alpha, momentum, alpha_speed)
        return pdf[[*keys, ts]].assign(mu=got[:, 0], gamma=got[:, 1])

    return pairs.select(*keys, ts, "P1", "P2").groupBy(*keys).applyInPandas(work, schema)


# ------------------------------------------------------------------ time-varying cointegration


def tv_loglik(p: np.ndarray, y: np.ndarray, x: np.ndarray, beta_var: float = 1e6) -> tuple[float, np.ndarray]:
    """Log-likelihood of y = alpha + beta_t x + w_t, beta_t = mu + T beta_t-1 + eta, w_t = theta w_t-1 + eps; and the predicted states."""
    alpha, mu, t, theta, s_eta, s_eps = p
    b, w, pbb, pbw, pww, total = 0.0, 0.0, beta_var, 0.0, 0.0, 0.0
    out = np.empty((len(y), 2))
    for i in range(len(y)):
        out[i] = b, w
        xi = x[i]
        s = xi * xi * pbb + 2 * xi * pbw + pww
        v = y[i] - alpha - xi * b - w
        if s > 1e-12:
            total -= 0.5 * (math.log(2 * math.pi * s) + v * v / s)
            kb, kw = (xi * pbb + pbw) / s, (xi * pbw + pww) / s
            b, w = b + kb * v, w + kw * v
            pbb, pbw, pww = pbb - kb * kb * s, pbw - kb * kw * s, pww - kw * kw * s
        b, w = mu + t * b, theta * w
        pbb, pbw, pww = t * t * pbb + s_eta * s_eta, t * theta * pbw, theta * theta * pww + s_eps * s_eps
    return total, out


@dataclass
class TVFit:
    params: np.ndarray
    se: np.ndarray
    loglik: float
    converged: bool
    predicted: np.ndarray

    @property
    def t_theta(self) -> float:
        return (self.params[3] - 1) / self.se[3]

    @property
    def t_sigma(self) -> float:
        return abs(self.params[4]) / self.se[4]


def fit_tv(y: np.ndarray, x: np.ndarray, fixed: dict[str, float] | None = None, max_iter: int = 200) -> TVFit:
    """Maximum likelihood by a quasi-Newton search with numerical gradients; T is kept in (0, 1). Standard errors from the Hessian."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    if len(y) != len(x) or len(y) < 20 or not (np.isfinite(y).all() and np.isfinite(x).all()):
        raise ValueError("need two finite series of the same length, 20 or more")
    names = ("alpha", "mu", "T", "theta", "sigma_eta", "sigma_eps")
    (slope, const), ssr = _ols(y, np.column_stack([x, np.ones(len(x))]))
    start = np.array([const, 0.1 * slope, math.log(9), 0.9, 0.05 * abs(slope) + 1e-3, math.sqrt(ssr / len(y))])
    held = {names.index(k): v for k, v in (fixed or {}).items()}
    free = [i for i in range(6) if i not in held]

    def full(u: np.ndarray) -> np.ndarray:
        p = start.copy()
        p[free] = u
        p[2] = 1 / (1 + math.exp(-max(-30, min(30, p[2]))))
        for i, v in held.items():
            p[i] = v
        return p

    def cost(u: np.ndarray) -> float:
        value = -tv_loglik(full(u), y, x)[0]
        return value if math.isfinite(value) else 1e12

    def gradient(u: np.ndarray) -> np.ndarray:
        step = 1e-5 * np.maximum(1, np.abs(u))
        return np.array([(cost(u + e) - cost(u - e)) / (2 * h) for h, e in zip(step, np.diag(step))])

    u, inv = start[free], np.eye(len(free))
    value, g, converged = cost(u), gradient(u), False
    for _ in range(max_iter):
        d = -inv @ g
        if d @ g >= 0:
            inv, d = np.eye(len(free)), -g
        step = 1.0
        while step > 1e-10 and cost(u + step * d) > value + 1e-4 * step * (g @ d):
            step /= 2
        new = u + step * d
        new_value = cost(new)
        if step <= 1e-10 or value - new_value < 1e-9 * max(1, abs(value)):
            converged = np.abs(g).max() < 1e-2 * max(1, abs(value)) or step > 1e-10
            break
        new_g = gradient(new)
        s, z = new - u, new_g - g
        if s @ z > 1e-12:
            rho = 1 / (s @ z)
            m = np.eye(len(free)) - rho * np.outer(s, z)
            inv = m @ inv @ m.T + rho * np.outer(s, s)
        u, value, g = new, new_value, new_g
    p = full(u)
    direct = lambda v: -tv_loglik(np.where(np.isin(np.arange(6), free), v, p), y, x)[0]
    step = 1e-4 * np.maximum(1e-1, np.abs(p))
    hess = np.zeros((6, 6))
    for i in free:
        for j in free:
            a, b = np.eye(6)[i] * step[i], np.eye(6)[j] * step[j]
            hess[i, j] = (direct(p + a + b) - direct(p + a - b) - direct(p - a + b) + direct(p - a - b)) / (4 * step[i] * step[j])
    se = np.full(6, math.nan)
    try:
        var = np.diag(np.linalg.inv(hess[np.ix_(free, free)]))
        se[free] = np.where(var > 0, np.sqrt(np.abs(var)), math.nan)
    except np.linalg.LinAlgError:
        pass
    loglik, predicted = tv_loglik(p, y, x)
    return TVFit(p, se, loglik, bool(converged), predicted)


def tv_loglik_many(p: np.ndarray, y: np.ndarray, x: np.ndarray, beta_var: float = 1e6) -> np.ndarray:
    """tv_loglik() of many parameter rows p (m by 6), each with its own column of y (n by m), side by side."""
    alpha, mu, t, theta, s_eta, s_eps = (np.ascontiguousarray(c) for c in p.T)
    m = len(p)
    b, w, pbb, pbw, pww, total = np.zeros(m), np.zeros(m), np.full(m, beta_var), np.zeros(m), np.zeros(m), np.zeros(m)
    tt, th, hh, ee, ss = t * t, t * theta, theta * theta, s_eta * s_eta, s_eps * s_eps
    for i, xi in enumerate(x.tolist()):
        u, z = xi * pbb + pbw, xi * pbw + pww
        s = xi * u + z
        v = y[i] - alpha - xi * b - w
        low = s <= 1e-12
        if low.any():
            safe = np.where(low, 1.0, s)
            total -= np.where(low, 0.0, 0.5 * (np.log(2 * math.pi * safe) + v * v / safe))
            kb, kw = np.where(low, 0.0, u / safe), np.where(low, 0.0, z / safe)
        else:
            total -= 0.5 * (np.log(2 * math.pi * s) + v * v / s)
            kb, kw = u / s, z / s
        b, w = mu + t * (b + kb * v), theta * (w + kw * v)
        pbb, pbw, pww = tt * (pbb - kb * u) + ee, th * (pbw - kb * z), hh * (pww - kw * z) + ss
    return total


def fit_tv_many(y: np.ndarray, x: np.ndarray, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fit_tv() of many series (m by n) on one x at once: parameters, standard errors (m by 6 each) and whether each converged."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    m, n = y.shape
    design = np.column_stack([x, np.ones(n)])
    coef = np.linalg.lstsq(design, y.T, rcond=None)[0]
    ssr = ((y.T - design @ coef) ** 2).sum(axis=0)
    slope, const = coef
    u = np.column_stack([const, 0.1 * slope, np.full(m, math.log(9)), np.full(m, 0.9), 0.05 * np.abs(slope) + 1e-3, np.sqrt(ssr / n)])

    def full(u: np.ndarray) -> np.ndarray:
        p = u.copy()
        p[:, 2] = 1 / (1 + np.exp(-np.clip(u[:, 2], -30, 30)))
        return p

    def cost(u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            value = -tv_loglik_many(full(u), np.ascontiguousarray(y[rows].T), x)
        return np.where(np.isfinite(value), value, 1e12)

    def gradient(u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        h = 1e-5 * np.maximum(1, np.abs(u))
        moves = h[:, None, :] * np.eye(6)[None]
        both = np.concatenate([u[:, None, :] + moves, u[:, None, :] - moves], axis=1)
        c = cost(both.reshape(-1, 6), np.repeat(rows, 12)).reshape(-1, 2, 6)
        return (c[:, 0] - c[:, 1]) / (2 * h)

    everyone = np.arange(m)
    inv, value, g = np.tile(np.eye(6), (m, 1, 1)), cost(u, everyone), gradient(u, everyone)
    converged, active = np.zeros(m, bool), everyone
    for _ in range(max_iter):
        if not len(active):
            break
        ua, ga, va = u[active], g[active], value[active]
        d = -np.einsum("aij,aj->ai", inv[active], ga)
        up = (d * ga).sum(axis=1) >= 0
        inv[active[up]], d[up] = np.eye(6), -ga[up]
        gain, step, new_value, wait = (d * ga).sum(axis=1), np.ones(len(active)), np.empty(len(active)), np.arange(len(active))
        while len(wait):
            new_value[wait] = cost(ua[wait] + step[wait, None] * d[wait], active[wait])
            wait = wait[(new_value[wait] > va[wait] + 1e-4 * step[wait] * gain[wait]) & (step[wait] > 1e-10)]
            step[wait] /= 2
        new = ua + step[:, None] * d
        end = (step <= 1e-10) | (va - new_value < 1e-9 * np.maximum(1, np.abs(va)))
        converged[active[end]] = ((np.abs(ga).max(axis=1) < 1e-2 * np.maximum(1, np.abs(va))) | (step > 1e-10))[end]
        go = ~end
        active, new = active[go], new[go]
        if not len(active):
            break
        new_g = gradient(new, active)
        s, z = new - u[active], new_g - g[active]
        sz = (s * z).sum(axis=1)
        fine = sz > 1e-12
        if fine.any():
            rho, s, z, who = 1 / sz[fine], s[fine], z[fine], active[fine]
            k = np.eye(6) - rho[:, None, None] * s[:, :, None] * z[:, None, :]
            inv[who] = k @ inv[who] @ k.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        u[active], value[active], g[active] = new, new_value[go], new_g
    p = full(u)
    h = 1e-4 * np.maximum(1e-1, np.abs(p))
    signs = np.array([(1, 1), (1, -1), (-1, 1), (-1, -1)])
    hess = np.empty((m, 6, 6))
    for i in range(6):
        for j in range(i, 6):
            points = np.repeat(p[:, None, :], 4, axis=1)
            points[:, :, i] += signs[:, 0] * h[:, i, None]
            points[:, :, j] += signs[:, 1] * h[:, j, None]
            with np.errstate(all="ignore"):
                f = -tv_loglik_many(points.reshape(-1, 6), np.ascontiguousarray(np.repeat(y, 4, axis=0).T), x).reshape(-1, 4)
            hess[:, i, j] = hess[:, j, i] = (f[:, 0] - f[:, 1] - f[:, 2] + f[:, 3]) / (4 * h[:, i] * h[:, j])
    se = np.full((m, 6), math.nan)
    for i in range(m):
        try:
            var = np.diag(np.linalg.inv(hess[i]))
        except np.linalg.LinAlgError:
            continue
        se[i] = np.where(var > 0, np.sqrt(np.abs(var)), math.nan)
    return p, se, converged


def bootstrap_draws(y: np.ndarray, x: np.ndarray, null: dict[str, float], n: int, seed: int = 0) -> list[np.ndarray]:
    """Series under the null: the restricted fit's beta path, and its centred innovations drawn again."""
    fit = fit_tv(y, x, null)
    theta, w = fit.params[3], fit.predicted[:, 1]
    eps = w[1:] - theta * w[:-1]
    eps = eps - eps.mean()
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        e, path, v = rng.choice(eps, len(y)), np.empty(len(y)), 0.0
        for t in range(len(y)):
            v = theta * v + e[t]
            path[t] = v
        out.append(fit.params[0] + x * fit.predicted[:, 0] + path)
    return out


@dataclass(frozen=True)
class HedgeVerdict:
    hedge: str
    verdict: str
    p_theta: float
    p_sigma: float
    theta: float
    plausible: bool
    converged: bool


def verdict(p_theta: float, p_sigma: float, theta: float, converged: bool, level: float = 0.05) -> HedgeVerdict:
    """none without cointegration, dynamic only where the coefficient is shown to move and the fit is plausible, else static."""
    plausible = 0 < theta < 1
    if not converged or math.isnan(p_theta):
        return HedgeVerdict("static", "undecided", p_theta, p_sigma, theta, plausible and converged, converged)
    if p_theta >= level:
        return HedgeVerdict("none", "no cointegration", p_theta, p_sigma, theta, plausible, converged)
    moves = not math.isnan(p_sigma) and p_sigma < level
    return HedgeVerdict("dynamic" if moves and plausible else "static", "time-varying" if moves else "fixed", p_theta, p_sigma, theta, plausible, converged)


#: Draws that are fitted together.
DRAW_BLOCK = 100


def hedge_gate(pairs: DataFrame, keys: list[str], ts: str, draws: int = 199, seed: int = 0, level: float = 0.05) -> DataFrame:
    """pairs (keys, ts, P1, P2) -> keys, hedge, verdict, p_theta, p_sigma, theta.

    Each draw is a row of its own, dealt out by pair, test and block of draws; the refits of a block run side by side in one
    vectorised search, so that the full number of draws is affordable for every pair that a screen leaves.
    """
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def prepare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(ts)
        y, x = pdf["P1"].to_numpy(float), pdf["P2"].to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys}
        rows = [{**row, "test": "theta", "draw": -1, "y": y.tolist(), "x": x.tolist()}]
        for test, null in (("theta", {"theta": 1.0}), ("sigma", {"sigma_eta": 0.0})):
            rows += [{**row, "test": test, "draw": i, "y": s.tolist(), "x": x.tolist()} for i, s in enumerate(bootstrap_draws(y, x, null, draws, seed))]
        return pd.DataFrame(rows)

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        p, se, ok = fit_tv_many(np.array(pdf["y"].tolist()), np.array(pdf["x"].iloc[0]))
        with np.errstate(all="ignore"):
            return pdf[[*keys, "test", "draw"]].assign(t_theta=(p[:, 3] - 1) / se[:, 3], t_sigma=np.abs(p[:, 4]) / se[:, 4], theta=p[:, 3], ok=ok)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["draw"] < 0].iloc[0]
        theta, sigma = (pdf[(pdf["draw"] >= 0) & (pdf["test"] == n)][f"t_{n}"].dropna() for n in ("theta", "sigma"))
        p_theta = float((theta <= own["t_theta"]).mean()) if len(theta) and math.isfinite(own["t_theta"]) else math.nan
        p_sigma = float((sigma >= own["t_sigma"]).mean()) if len(sigma) and math.isfinite(own["t_sigma"]) else math.nan
        v = verdict(p_theta, p_sigma, float(own["theta"]), bool(own["ok"]), level)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "hedge": v.hedge, "verdict": v.verdict, "p_theta": v.p_theta, "p_sigma": v.p_sigma, "theta": v.theta}])

    drawn = pairs.select(*keys, ts, "P1", "P2").groupBy(*keys).applyInPandas(prepare, f"{kinds}, test string, draw int, y array<double>, x array<double>")
    block = F.floor((F.col("draw") + 1) / DRAW_BLOCK).alias("block")
    fits = drawn.groupBy(*keys, "test", block).applyInPandas(refit, f"{kinds}, test string, draw int, t_theta double, t_sigma double, theta double, ok boolean")
    return fits.groupBy(*keys).applyInPandas(judge, f"{kinds}, hedge string, verdict string, p_theta double, p_sigma double, theta double")


def simulate_tv(n: int, theta: float, sigma_eta: float, t: float = 0.7, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A pair (y, x) from the model, x a random walk."""
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.standard_normal(n))
    mu = 1 / (1 - t)
    b, w, y = mu / (1 - t), 0.0, np.empty(n)
    for i in range(n):
        b = mu + t * b + sigma_eta * rng.standard_normal()
        w = theta * w + rng.standard_normal()
        y[i] = x[i] * b + w
    return y, x
