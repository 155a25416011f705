"""Portfolios: correlations, weights, scaled instruments, costs, cross-sections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import before, clip, full, median, midrank, ratio, rows


#: Series by block: a task correlates the series of two blocks by matrix products.
BLOCK = 128


def pairwise_correlation(series: DataFrame, key: str, ts: str, x: str, least: int = 30, method: str = "pearson") -> DataFrame:
    """series (key, ts, x) -> i, j (i < j), n, corr over the common ts; null below `least` and where a side doesn't vary.

    Pearson: each series is packed to one row, and pairs of blocks of series meet; what is sent is a series for each block, never a row
    for each pair and ts. Spearman ranks within each pair's overlap, so there pairs meet by ts.
    """
    ok = series.where(F.col(x).isNotNull() & ~F.isnan(x))
    if method == "spearman":
        a = ok.select(F.col(key).alias("i"), ts, F.col(x).alias("xi"))
        b = ok.select(F.col(key).alias("j"), ts, F.col(x).alias("xj"))
        part = Window.partitionBy("i", "j")
        both = a.join(b, ts).where("i < j")
        both = both.withColumns({"ri": midrank(part, "xi", "i", "j"), "rj": midrank(part, "xj", "i", "j")}).withColumns({"xi": F.col("ri"), "xj": F.col("rj")})
        out = both.groupBy("i", "j").agg(F.count("*").alias("n"), F.corr("xi", "xj").alias("corr"))
        return out.withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))
    return _correlated(ok, key, ts, x).select("i", "j", "n", F.when(F.col("n") >= least, F.col("corr")).alias("corr"))


def _correlated(ok: DataFrame, key: str, ts: str, x: str) -> DataFrame:
    """i, j (i < j), n, corr, and sd_i, sd_j over the common ts."""
    days = ok.select(ts).distinct().select(ts, (F.row_number().over(Window.orderBy(ts)) - 1).alias("_t"))  # the calendar: a row for each ts
    packed = ok.join(F.broadcast(days), ts).groupBy(F.col(key).alias("name")).agg(F.collect_list("_t").alias("t"), F.collect_list(F.col(x).cast("double")).alias("x"))
    names = packed.count()
    blocks = max(1, -(-names // BLOCK))
    packed = packed.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    meet = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = packed.select("*", meet.alias("_o")).select("name", "t", "x", "_b", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name").reset_index(drop=True)
        size = max(int(t[-1]) if len(t) else 0 for t in (np.sort(t) for t in pdf["t"])) + 1
        v, has = np.zeros((len(pdf), size)), np.zeros((len(pdf), size))
        for row, (t, values) in enumerate(zip(pdf["t"], pdf["x"])):
            v[row, t], has[row, t] = values, 1.0
        v -= has * (v.sum(axis=1) / has.sum(axis=1))[:, None]  # about zero, where products lose least
        n, s, q, c = has @ has.T, v @ has.T, (v * v) @ has.T, v @ v.T
        with np.errstate(divide="ignore", invalid="ignore"):
            cov, var = c - s * s.T / n, q - s * s / n
            corr = cov / np.sqrt(var * var.T)
            sd = np.sqrt(np.maximum(var, 0) / (n - 1))
        flat = (var <= 1e-14 * q) | (var.T <= 1e-14 * q.T)
        p, q_, b = pdf["_p"].iloc[0], pdf["_q"].iloc[0], pdf["_b"].to_numpy()
        ours = np.triu(np.ones_like(n, bool), 1) & (n > 0) & ((b[:, None] != b[None, :]) | (p == q_))
        i, j = np.nonzero(ours)
        name = pdf["name"].to_numpy()
        out = pd.DataFrame({"i": name[i], "j": name[j], "n": n[i, j].astype(np.int64), "corr": np.where(flat[i, j], np.nan, corr[i, j]), "sd_i": sd[i, j], "sd_j": sd.T[i, j]})
        return out

    got = sent.groupBy("_p", "_q").applyInPandas(work, "i string, j string, n long, corr double, sd_i double, sd_j double")
    return got.select("i", "j", "n", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("corr", "sd_i", "sd_j")))


def diversification(corr: Column) -> Column:
    """One over the mean absolute correlation of the pairs, as an aggregate; infinite where it is zero."""
    m = F.avg(F.abs(corr))
    return F.when(m > 0, 1 / m).when(m == 0, float("inf"))


def spread_returns(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """df (keys, ts, P1, P2, beta) plus r: the change of P1 - beta P2 for each dollar of gross exposure a bar before."""
    w = Window.partitionBy(*keys).orderBy(ts)
    b = F.lag("beta").over(w)
    move = F.col("P1") - F.lag("P1").over(w) - b * (F.col("P2") - F.lag("P2").over(w))
    return df.withColumn("r", ratio(move, F.lag("P1").over(w) + F.abs(b) * F.lag("P2").over(w)))


def position_weights(df: DataFrame, keys: list[str], method: str = "inv_vol", max_weight: float | None = None) -> DataFrame:
    """df (keys, ts, r) -> weights by inverse variance, inverse deviation or equal, capped by filling up (the vector has a row for each pair)."""
    var = df.groupBy(*keys).agg(F.var_samp("r").alias("v"))
    raw = {"equal": F.lit(1.0), "inv_var": ratio(F.lit(1.0), "v"), "inv_vol": ratio(F.lit(1.0), F.sqrt("v"))}[method]
    some = var.withColumn("_w", raw).where("_w is not null")
    out = some.crossJoin(F.broadcast(some.agg(F.sum("_w").alias("_all")))).withColumn("weight", F.col("_w") / F.col("_all")).drop("_w", "_all")
    return capped(out, keys, max_weight) if max_weight is not None else out


def suggested_weights(df: DataFrame, keys: list[str], ts: str, method: str = "inv_vol", max_weight: float = 0.4, risk: str = "per_dollar", cap: str = "iterative") -> DataFrame:
    """df (keys, ts, P1, P2, beta, resid) -> keys, resid_var (of the residual's changes), var_per_dollar (null under price_units), inv_var_weight (before the
    cap), weight, suggested_capital_pct. A pair without a positive variance has weight zero.

    risk: the spread's return for each dollar (per_dollar), or the change of its residual (price_units). cap: fill up under max_weight (at least an equal
    share), or one_pass, which cuts and scales once and can end above it.
    """
    if method not in ("inv_var", "inv_vol", "equal") or risk not in ("per_dollar", "price_units") or cap not in ("iterative", "one_pass") or not 0 < max_weight <= 1:
        raise ValueError("method must be inv_var, inv_vol or equal, risk per_dollar or price_units, cap iterative or one_pass, max_weight in (0, 1]")
    w = Window.partitionBy(*keys).orderBy(ts)
    known = df.where(F.col("resid").isNotNull())
    v = known.withColumn("_e", F.col("resid") - F.lag("resid").over(w)).groupBy(*keys).agg(F.var_samp("_e").alias("resid_var"))
    if risk == "per_dollar":
        v = v.join(spread_returns(df, keys, ts).groupBy(*keys).agg(F.var_samp("r").alias("var_per_dollar")), keys)
    else:
        v = v.withColumn("var_per_dollar", F.lit(None).cast("double"))
    var = F.col("var_per_dollar" if risk == "per_dollar" else "resid_var")
    raw = {"equal": F.lit(1.0), "inv_var": 1 / var, "inv_vol": 1 / F.sqrt(var)}[method]
    v = v.withColumn("_w", F.when(var > 0, raw).otherwise(0.0))
    v = v.crossJoin(F.broadcast(v.agg(F.sum("_w").alias("_all")))).withColumn("inv_var_weight", F.coalesce(ratio("_w", "_all"), F.lit(0.0))).drop("_w", "_all")
    if cap == "iterative":
        some = capped(v.where("inv_var_weight > 0").withColumn("weight", F.col("inv_var_weight")), keys, max_weight)
        out = some.unionByName(v.where("inv_var_weight <= 0").withColumn("weight", F.lit(0.0)))
    else:
        cut = v.withColumn("_c", F.least("inv_var_weight", F.lit(float(max_weight))))
        out = cut.crossJoin(F.broadcast(cut.agg(F.sum("_c").alias("_s")))).withColumn("weight", F.coalesce(ratio("_c", "_s"), F.lit(0.0))).drop("_c", "_s")
    return out.withColumn("suggested_capital_pct", 100 * F.col("weight"))


def capped(df: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Weights (that sum to 1) under a cap, the rest filled up in proportion: with weights in falling order, the first m are at the cap, for the
    least m that keeps the others below it. A cap below an equal share gives equal weights.

    Fewer than one over the cap can be at it, so only so many of the largest weights are ordered; the others keep their proportions.
    """
    n = F.broadcast(df.agg(F.count("*").alias("_n"), F.sum("weight").alias("_all")))
    most = int(1 / cap) + 2
    order = Window.orderBy(F.desc("weight"), *keys)  # of the largest weights alone
    top = df.orderBy(F.desc("weight"), *keys).limit(most).crossJoin(n).withColumns({"_c": F.greatest(F.lit(float(cap)), 1 / F.col("_n")), "_i": F.row_number().over(order)})
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    grown = F.col("weight") * (1 - (F.col("_i") - 1) * F.col("_c")) / (F.col("_all") - before)
    top = top.withColumns({"_before": before, "_fits": grown <= F.col("_c") + 1e-12})
    rule = top.agg(F.min(F.when(F.col("_fits"), F.struct("_i", "_before"))).alias("_m"), F.first("_c").alias("_c"))
    first = top.join(F.broadcast(rule.select("_m")), F.col("_m").isNull() | (F.col("_i") < F.col("_m._i"))).select(*keys, F.lit(True).alias("_at_cap"))
    out = df.crossJoin(F.broadcast(rule)).crossJoin(n).join(F.broadcast(first), keys, "left")  # fewer than one over the cap
    rest = F.col("weight") * (1 - (F.col("_m._i") - 1) * F.col("_c")) / (F.col("_all") - F.col("_m._before"))
    equal = F.lit(cap) * F.col("_n") <= 1
    new = F.when(equal, 1 / F.col("_n")).when(F.col("_at_cap"), F.col("_c")).otherwise(rest)
    return out.withColumn("weight", new).drop("_m", "_c", "_n", "_all", "_at_cap")


def leg_split(pairs: DataFrame) -> DataFrame:
    """Weights that share each ticker's unit among the pairs it is a leg of."""
    legs = pairs.select("t1", "t2", F.explode(F.array("t1", "t2")).alias("leg"))
    n = legs.groupBy("leg").agg(F.count("*").alias("n"))
    w = legs.join(n, "leg").groupBy("t1", "t2").agg(F.avg(1 / F.col("n")).alias("_w"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("_w").alias("_all")))).withColumn("weight", F.col("_w") / F.col("_all")).drop("_w", "_all")


def risk_parity(cov: np.ndarray, tol: float = 1e-5, rounds: int = 10_000) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent on half the variance less the mean log weight."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        part = x * (cov @ x)
        if np.abs(part / part.mean() - 1).max() < tol:
            return x / x.sum()
    raise ArithmeticError("risk contributions did not settle")


def risk_parity_by(edges: DataFrame, group: str) -> DataFrame:
    """edges (group, i, j, cov), both directions and the diagonal -> group, i, weight; a group's matrix is one task's."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1)
        return pd.DataFrame({group: pdf[group].iloc[0], "i": m.index, "weight": risk_parity(m.to_numpy(float))})

    return edges.select(group, "i", "j", "cov").groupBy(group).applyInPandas(work, f"{group} {edges.schema[group].dataType.simpleString()}, i string, weight double")


def scaled_instruments(returns: DataFrame, key: str, ts: str, r: str, high: float = 0.95, scale: float = 1.15, twin: float = 0.98, near: float = 0.15) -> DataFrame:
    """For each series its most correlated partner, beta, and kind: scaled, duplicate or none."""
    c = _correlated(returns.where(F.col(r).isNotNull() & ~F.isnan(r)), key, ts, r).where("corr is not null")
    both = c.select("i", "j", F.col("corr").alias("rho"), ratio("sd_i", "sd_j").alias("s")).unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("corr").alias("rho"), ratio("sd_j", "sd_i").alias("s")))
    top = both.groupBy("i").agg(F.min_by(F.struct("j", "rho", "s"), F.struct(-F.abs("rho"), "j")).alias("x"))
    beta = F.col("x.rho") * F.col("x.s")
    kind = F.when((F.abs("x.rho") >= high) & (F.abs(beta) >= scale), "scaled").when((F.abs("x.rho") >= twin) & (F.abs(beta - 1) < near), "duplicate").otherwise("none")
    return top.select("i", F.col("x.j").alias("partner"), F.col("x.rho").alias("rho"), beta.alias("beta"), kind.alias("kind"))


def detect_scaled(returns: DataFrame, key: str, ts: str, r: str, include_duplicates: bool = False, **limits: float) -> DataFrame:
    """The names of series that are scaled (or duplicates) of another."""
    kinds = ("scaled", "duplicate") if include_duplicates else ("scaled",)
    return scaled_instruments(returns, key, ts, r, **limits).where(F.col("kind").isin(*kinds)).select(F.col("i").alias(key))


def pair_costs(pairs: DataFrame, cells: DataFrame, fallback: float) -> DataFrame:
    """pairs (t1, t2, formation, w1, w2), cells (formation, ticker, bps) -> bps by notional of the legs that were measured, else the fallback."""
    c = lambda n: cells.select("formation", F.col("ticker").alias(f"t{n}"), F.col("bps").alias(f"b{n}"))
    df = pairs.join(c(1), ["formation", "t1"], "left").join(c(2), ["formation", "t2"], "left")
    both = (F.col("w1") * F.col("b1") + F.col("w2") * F.col("b2")) / (F.col("w1") + F.col("w2"))
    return df.withColumn("bps", F.when(F.col("b1").isNotNull() & F.col("b2").isNotNull(), both).otherwise(F.coalesce("b1", "b2", F.lit(float(fallback)))))


def sector_etf(stocks: DataFrame, etfs: DataFrame, ts: str, least: int = 200) -> DataFrame:
    """stocks (name, ts, r), etfs (etf, ts, f) -> name, etf of the highest squared correlation over `least` common days (ties: first by name)."""
    both = stocks.join(etfs, ts).groupBy("name", "etf").agg(F.corr("r", "f").alias("rho"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("rho").isNotNull())
    return both.withColumn("r2", F.col("rho") * F.col("rho")).groupBy("name").agg(F.min_by(F.struct("etf", "r2"), F.struct(-F.col("r2"), "etf")).alias("x")).select("name", "x.etf", "x.r2")


def etf_residuals(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """df (keys, r, f) plus beta, intercept (a), resid and r2 of the regression of r on f by keys; null where f or r doesn't vary.

    weight: the trading-time factor by which both sides and the constant are scaled: least squares with its square as weight, the residual
    and r2 being those of the scaled regression.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    ok = F.col("r").isNotNull() & F.col("f").isNotNull() & w.isNotNull()
    w2 = F.when(ok, w * w)
    mean = df.groupBy(*keys).agg(F.sum(w2).alias("_w"), (F.sum(w2 * F.col("f")) / F.sum(w2)).alias("_x"), (F.sum(w2 * F.col("r")) / F.sum(w2)).alias("_y"))
    df = df.join(mean, keys)
    xc, yc = F.col("f") - F.col("_x"), F.col("r") - F.col("_y")
    fit = df.groupBy(*keys).agg(F.sum(w2 * xc * xc).alias("_xx"), F.sum(w2 * xc * yc).alias("_xy"), F.var_pop(F.when(ok, w * F.col("r"))).alias("_vy"))
    df = df.join(fit, keys).withColumn("beta", F.when(F.col("_xx") > 1e-18, F.col("_xy") / F.col("_xx"))).withColumn("a", F.col("_y") - F.col("beta") * F.col("_x"))
    df = df.withColumn("resid", w * (F.col("r") - F.col("a") - F.col("beta") * F.col("f")))
    r2 = df.groupBy(*keys).agg(F.when(F.first("_vy") > 1e-18, 1 - F.var_pop("resid") / F.first("_vy")).alias("r2"))
    return df.drop("_w", "_x", "_y", "_xx", "_xy", "_vy").join(r2, keys)


def ou_fit(df: DataFrame, keys: list[str], ts: str, x: str = "resid", days: float = 252.0) -> DataFrame:
    """Mean reversion of the summed residual by keys: a, b, kappa, m, sigma, sigma_eq, s_raw, x_last, model_ok; null where the fit is unusable."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("_x", F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_x0", F.lag("_x").over(w))
    g = df.groupBy(*keys).agg(
        F.regr_slope("_x", "_x0").alias("b"), F.regr_intercept("_x", "_x0").alias("a"), F.regr_count("_x", "_x0").alias("n"),
        F.regr_syy("_x", "_x0").alias("yy"), F.regr_sxy("_x", "_x0").alias("xy"), F.regr_sxx("_x", "_x0").alias("xx"), F.max_by("_x", ts).alias("x_last"),
    )
    var = (F.col("yy") - F.col("b") * F.col("xy")) / F.greatest(F.col("n") - 2, F.lit(1))
    g = g.where("xx > 1e-18 and b > 0 and b < 1").withColumn("_v", F.greatest(var, F.lit(0.0)))
    g = g.withColumns({"kappa": -F.log(clip("b", 1e-9, 0.999999)) * days, "m": F.col("a") / (1 - F.col("b")), "sigma_eq": F.sqrt(F.col("_v") / (1 - F.col("b") * F.col("b")))})
    g = g.where("sigma_eq > 1e-12").withColumns({"sigma": F.sqrt(F.col("_v") * 2 * F.col("kappa") / (1 - F.col("b") * F.col("b"))), "s_raw": (F.col("x_last") - F.col("m")) / F.col("sigma_eq")})
    good = g.select(*keys, "a", "b", "kappa", "m", "sigma", "sigma_eq", "s_raw", "x_last", (F.col("kappa") > days / 30).alias("model_ok"))
    return df.select(*keys).distinct().join(good, keys, "left").withColumn("model_ok", F.coalesce("model_ok", F.lit(False)))


def s_score(fit: DataFrame, by: list[str], center: bool = True) -> DataFrame:
    shift = F.avg("m").over(Window.partitionBy(*by)) if center else F.lit(0.0)
    return fit.withColumn("s", (F.col("x_last") - (F.col("m") - shift)) / F.col("sigma_eq"))


def positions_from_state(df: DataFrame, notional: float = 1.0) -> DataFrame:
    """df (name, state, beta, etf) -> legs: each stock's, and the netted one of each ETF. Stocks without beta or ETF have none."""
    ok = df.where("state <> 0 and beta is not null and etf is not null")
    stocks = ok.select(F.col("name").alias("leg"), (F.col("state") * notional).cast("double").alias("notional"))
    etfs = ok.groupBy(F.col("etf").alias("leg")).agg(F.sum(-F.col("state") * F.col("beta") * notional).alias("notional"))
    return stocks.unionByName(etfs)


def trading_time(df: DataFrame, keys: list[str], ts: str, window: int = 10, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """df (keys, ts, volume) plus factor: mean volume of the window before over today's, bounded; null for no volume."""
    f = before(Window.partitionBy(*keys).orderBy(ts), window)
    return df.withColumn("factor", clip(full(ratio(F.avg("volume").over(f), "volume"), "volume", f, window), low, high))


def cross_z(df: DataFrame, by: list[str], x: str, bound: float = 3.0, least_scale: float = 1e-9) -> DataFrame:
    """df plus z: robust score across the names of a day, bounded; null where the scale vanishes."""
    part = Window.partitionBy(*by)
    df = df.withColumn("_m", median(x, part)).withColumn("_s", 1.4826 * median(F.abs(F.col(x) - F.col("_m")), part))
    return df.withColumn("z", F.when(F.col("_s") > least_scale, clip((F.col(x) - F.col("_m")) / F.col("_s"), -bound, bound))).drop("_m", "_s")


def information(df: DataFrame, day: str, alpha: str, target: str, least: int = 30) -> DataFrame:
    """Daily cross-sectional correlations of alpha and target: their mean, t, share above zero and number."""
    ic = df.groupBy(day).agg(F.corr(alpha, target).alias("ic"), F.count(F.col(alpha) * F.col(target)).alias("n")).where(F.col("n") > least)
    return ic.agg(F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("ic"))).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count("ic").alias("days"))


def desk_panel(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """df (keys, ts, close, volume, r) plus momentum of a month and of a year less a month, abnormal volume, nearness to the high, largest return."""
    w = Window.partitionBy(*keys).orderBy(ts)
    f = lambda n: rows(w, n)
    skip = w.rowsBetween(-251, -21)
    return df.withColumns(
        {
            "mom1m": full(F.sum("r").over(f(21)), "r", f(21), 21),
            "mom12_1": F.when(F.count("r").over(skip) >= 231, F.sum("r").over(skip)),
            "vol_abn": full(ratio("volume", median("volume", f(20))), "volume", f(20), 20),
            "high52": full(F.col("close") / F.max("close").over(f(252)), "close", f(252), 252),
            "max21": full(F.max("r").over(f(21)), "r", f(21), 21),
        }
    )


def eigenportfolios(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors of the correlation over deviations, with unit gross (rows), and their eigenvalues."""
    sd = r.std(axis=0, ddof=1)
    value, vector = np.linalg.eigh(np.corrcoef(r.T))
    w = (vector[:, ::-1][:, :k] / sd[:, None]).T
    w *= np.where(w.sum(axis=1, keepdims=True) < 0, -1, 1)
    return w / np.abs(w).sum(axis=1, keepdims=True), value[::-1][:k]


def eigenportfolios_by(df: DataFrame, group: str, name: str, ts: str, r: str, k: int = 5) -> DataFrame:
    """df (group, name, ts, r) -> group, factor, name, weight, eigenvalue over the names that have every ts of the group."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=ts, columns=name, values=r).dropna(axis=1)
        if m.shape[1] < 2 or len(m) < 3:
            return pd.DataFrame({group: [], "factor": [], "name": [], "weight": [], "eigenvalue": []})
        w, v = eigenportfolios(m.to_numpy(), min(k, m.shape[1]))
        return pd.DataFrame([(pdf[group].iloc[0], i, c, w[i, j], v[i]) for i in range(len(w)) for j, c in enumerate(m.columns)], columns=[group, "factor", "name", "weight", "eigenvalue"])

    return df.select(group, name, ts, r).groupBy(group).applyInPandas(work, f"{group} {df.schema[group].dataType.simpleString()}, factor int, name string, weight double, eigenvalue double")


def neutralize(w: np.ndarray, loadings: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """w less its projection on the loadings and a constant, scaled to unit gross."""
    b = np.column_stack([loadings, np.ones(len(w))])
    w = w - b @ np.linalg.solve(b.T @ b + ridge * np.eye(b.shape[1]), b.T @ w)
    gross = np.abs(w).sum()
    return w / gross if gross > 1e-12 else w * 0


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk to a multiple of the identity, and the intensity."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / p)
    rho = b2 / d2 if d2 else 0.0
    return rho * mu * np.eye(p) + (1 - rho) * s, rho


def partial_adjustment(df: DataFrame, group: str, ts: str, phi: float, cost_bps: float) -> DataFrame:
    """df (group, ts, name, target, r: return of the session after) -> group, ts, gross, turnover, pnl: weights move a share phi to the
    target each day and are scaled back to its gross. The vector of weights is the state, so a book is one task's."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        target = pdf.pivot_table(index=ts, columns="name", values="target").fillna(0.0).sort_index()
        r = pdf.pivot_table(index=ts, columns="name", values="r").reindex_like(target).fillna(0.0)
        w, out = np.zeros(target.shape[1]), []
        for day, t, x in zip(target.index, target.to_numpy(), r.to_numpy()):
            new = w + phi * (t - w)
            gross = np.abs(new).sum()
            new = new * (np.abs(t).sum() / gross) if gross > 1e-12 else new
            moved = np.abs(new - w).sum()
            out.append((pdf[group].iloc[0], day, np.abs(new).sum(), moved, new @ x - moved * cost_bps / 1e4))
            w = new
        return pd.DataFrame(out, columns=[group, ts, "gross", "turnover", "pnl"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.select(group, ts, "name", "target", "r").groupBy(group).applyInPandas(work, f"{group} {kind(group)}, {ts} {kind(ts)}, gross double, turnover double, pnl double")
