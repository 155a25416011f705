"""Statistics of series as windows and aggregates: hedges, half-lives, stability, microstructure, multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import before, full, ratio, rows


def pair_series(bars: DataFrame, price: str = "px", ts: str = "d", pairs: DataFrame | None = None) -> DataFrame:
    """Bars (ticker, ts, price) -> t1, t2, ts, P1, P2 for all pairs t1 < t2 (or those given), aligned on ts.

    The list of pairs is made of tickers, not of rows: series meet by equi-joins on (ticker, ts).
    """
    if pairs is None:
        t = bars.select("ticker").distinct()
        pairs = t.select(F.col("ticker").alias("t1")).join(t.select(F.col("ticker").alias("t2")), F.col("t1") < F.col("t2"))
    a = bars.select(F.col("ticker").alias("t1"), F.col(ts), F.col(price).alias("P1"))
    b = bars.select(F.col("ticker").alias("t2"), F.col(ts), F.col(price).alias("P2"))
    return pairs.select("t1", "t2").join(a, "t1").join(b, ["t2", ts]).select("t1", "t2", ts, "P1", "P2")


def static_hedge(pairs: DataFrame, keys: list[str] = ["t1", "t2"], y: str = "P1", x: str = "P2") -> DataFrame:
    return pairs.groupBy(*keys).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.count("*").alias("n"))


def with_residual(pairs: DataFrame, hedge: DataFrame, keys: list[str] = ["t1", "t2"]) -> DataFrame:
    return pairs.join(hedge.select(*keys, "alpha", "beta"), keys).withColumn("resid", F.col("P1") - F.col("alpha") - F.col("beta") * F.col("P2"))


def rolling_hedge(pairs: DataFrame, n: int, keys: list[str] = ["t1", "t2"], ts: str = "d") -> DataFrame:
    """pairs plus beta and alpha of the n bars before, and the residual: nothing of the present bar is in its own hedge."""
    f = before(Window.partitionBy(*keys).orderBy(ts), n)
    beta = F.when(F.count("P1").over(f) >= n, ratio(F.covar_samp("P1", "P2").over(f), F.var_samp("P2").over(f)))
    df = pairs.withColumn("beta", beta).withColumn("alpha", F.avg("P1").over(f) - F.col("beta") * F.avg("P2").over(f))
    return df.withColumn("resid", F.col("P1") - F.col("alpha") - F.col("beta") * F.col("P2"))


def refit_every(df: DataFrame, columns: list[str], k: int, keys: list[str], ts: str) -> DataFrame:
    """Keep each k-th estimate and carry it forward (the first ones backward)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    for c in columns:
        seen = F.when(F.col("_i") % k == 0, F.col(c))
        ahead = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(c, F.coalesce(ahead, F.first(F.col(c), True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    return df.drop("_i")


def half_life(df: DataFrame, x: str, keys: list[str], ts: str, least: int = 20) -> DataFrame:
    """AR(1) slope on neighbouring values and -ln 2 / ln b, where there are `least` values and 0 < b < 1."""
    lagged = df.where(F.col(x).isNotNull()).withColumn("_x0", F.lag(x).over(Window.partitionBy(*keys).orderBy(ts)))
    out = lagged.groupBy(*keys).agg(F.regr_slope(F.col(x), F.col("_x0")).alias("ar1"), F.count(x).alias("n"))
    ok = (F.col("n") >= least) & (F.col("ar1") > 0) & (F.col("ar1") < 1)
    return out.withColumn("half_life", F.when(ok, -F.log(F.lit(2.0)) / F.log("ar1")))


def half_life_window(hl: Column, low: int = 30, high: int = 252) -> Column:
    return F.coalesce(F.floor(F.least(F.greatest(3 * hl, F.lit(float(low))), F.lit(float(high)))), F.lit(low)).cast("int")


def hedged_sharpe(df: DataFrame, keys: list[str], ts: str, periods: float = 252.0, log_returns: bool = True, lag_beta: bool = True, least: int = 30) -> DataFrame:
    """df (keys, ts, P1, P2, beta): Sharpe of r1 - beta r2, the hedge known a bar before."""
    w = Window.partitionBy(*keys).orderBy(ts)
    r = lambda c: F.log(F.col(c) / F.lag(c).over(w)) if log_returns else F.col(c) / F.lag(c).over(w) - 1
    b = F.lag("beta").over(w) if lag_beta else F.col("beta")
    out = df.withColumn("_r", r("P1") - b * r("P2")).groupBy(*keys).agg(F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s"), F.count("_r").alias("n"))
    return out.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("s") > 0), F.col("m") / F.col("s") * periods**0.5).alias("sharpe"))


def resid_proxy(df: DataFrame, keys: list[str], ts: str, periods: float = 252.0) -> DataFrame:
    d = F.col("resid") - F.lag("resid").over(Window.partitionBy(*keys).orderBy(ts))
    out = df.withColumn("_d", d).groupBy(*keys).agg(F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"), F.stddev_samp("resid").alias("resid_sigma"))
    return out.select(*keys, "resid_sigma", F.when(F.col("s") > 0, F.col("m") / F.col("s") * periods**0.5).alias("proxy_sharpe"))


# ------------------------------------------------------------------ stability of hedges


def cusum(df: DataFrame, keys: list[str], ts: str, beta: str = "beta", alpha: float = 0.05) -> DataFrame:
    """Largest absolute sum of centred betas over sigma root T, against the critical value for alpha."""
    critical = {0.10: 1.22, 0.05: 1.36, 0.01: 1.63}[alpha]
    part = Window.partitionBy(*keys)
    run = part.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    df = df.where(F.col(beta).isNotNull()).withColumn("_c", F.col(beta) - F.avg(beta).over(part))
    df = df.withColumn("_s", F.abs(F.sum("_c").over(run)))
    out = df.groupBy(*keys).agg(F.max("_s").alias("top"), F.stddev_samp(beta).alias("sd"), F.count("*").alias("n"))
    stat = F.when(F.col("sd") > 0, F.col("top") / F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return out.select(*keys, "n", stat.alias("cusum_stat"), (stat <= critical).alias("cusum_stable"))


def beta_drift(df: DataFrame, keys: list[str], ts: str, beta: str = "beta", window: int = 63, threshold: float = 2.0) -> DataFrame:
    """Rolling over global deviation of beta: its largest and last value, and whether the threshold is kept."""
    part = Window.partitionBy(*keys)
    f = rows(part.orderBy(ts), window)
    sd = full(F.stddev_samp(beta).over(f), beta, f, max(2, window // 2))
    df = df.where(F.col(beta).isNotNull()).withColumn("_d", ratio(sd, F.stddev_samp(beta).over(part)))
    out = df.groupBy(*keys).agg(F.max("_d").alias("max_drift"), F.max_by("_d", ts).alias("last_drift"))
    return out.withColumn("drift_stable", F.coalesce(F.col("max_drift") <= threshold, F.lit(True)))


def hedge_stability(df: DataFrame, keys: list[str], ts: str, least: int = 30, window: int = 63) -> DataFrame:
    both = cusum(df, keys, ts).join(beta_drift(df, keys, ts, window=window), keys).where(F.col("n") >= least)
    return both.withColumn("stable", F.col("cusum_stable") & F.col("drift_stable")).orderBy("stable", F.desc("cusum_stat"))


# ------------------------------------------------------------------ microstructure


def sampled(df: DataFrame, keys: list[str], ts: str, every: list[int]) -> DataFrame:
    """Each k-th bar from the start of each group of keys, for each k in every."""
    df = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1)
    return df.withColumn("k", F.explode(F.array(*map(F.lit, every)))).where(F.col("_i") % F.col("k") == 0).drop("_i")


def roll_spread(df: DataFrame, keys: list[str], session: str, ts: str, price: str = "px", every: int = 1, as_bps: bool = True, least: int = 30, signed: bool = False) -> DataFrame:
    """Roll's spread from the lag covariance of price changes within sessions, pooled by keys on a common sample."""
    by = [*keys, session]
    w = Window.partitionBy(*by).orderBy(ts)
    df = sampled(df, by, ts, [every]).withColumn("_d", F.col(price) - F.lag(price).over(w))
    df = df.withColumn("_d0", F.lag("_d").over(w))
    out = df.groupBy(*keys).agg(F.covar_pop("_d", "_d0").alias("c"), F.count(F.col("_d") * F.col("_d0")).alias("n"), F.avg(price).alias("m"))
    root = 2 * F.sqrt(F.abs("c"))
    spread = F.when(F.col("c") < 0, root).otherwise(-root if signed else F.lit(None).cast("double"))
    spread = spread / F.col("m") * 1e4 if as_bps else spread
    return out.select(*keys, "n", F.when(F.col("n") >= least, spread).alias("roll"))


def variance_signature(df: DataFrame, keys: list[str], session: str, ts: str, every: list[int], price: str = "px") -> DataFrame:
    """Mean over sessions of realized variance by sampling interval."""
    by = [*keys, session]
    df = sampled(df, by, ts, every)
    w = Window.partitionBy(*by, "k").orderBy(ts)
    df = df.withColumn("_r", F.log(F.col(price) / F.lag(price).over(w)))
    return df.groupBy(*by, "k").agg(F.sum(F.col("_r") * F.col("_r")).alias("rv")).groupBy(*keys, "k").agg(F.avg("rv").alias("variance"), F.count("rv").alias("sessions"))


def epps(df: DataFrame, keys: list[str], session: str, ts: str, every: list[int]) -> DataFrame:
    """Correlation of the two legs' log returns by sampling interval."""
    by = [*keys, session]
    df = sampled(df, by, ts, every)
    w = Window.partitionBy(*by, "k").orderBy(ts)
    r = lambda c: F.log(F.col(c) / F.lag(c).over(w))
    return df.withColumns({"_a": r("P1"), "_b": r("P2")}).groupBy(*keys, "k").agg(F.corr("_a", "_b").alias("correlation"), F.count(F.col("_a") * F.col("_b")).alias("n"))


def autocorr(df: DataFrame, keys: list[str], session: str, ts: str, every: list[int], price: str = "px") -> DataFrame:
    by = [*keys, session]
    df = sampled(df, by, ts, every)
    w = Window.partitionBy(*by, "k").orderBy(ts)
    df = df.withColumn("_d", F.log(F.col(price) / F.lag(price).over(w)))
    df = df.withColumn("_d0", F.lag("_d").over(w))
    return df.groupBy(*keys, "k").agg(F.corr("_d", "_d0").alias("autocorrelation"), F.count(F.col("_d") * F.col("_d0")).alias("n"))


def half_life_by_interval(df: DataFrame, keys: list[str], session: str, ts: str, x: str, every: list[int]) -> DataFrame:
    """keys, k, half_life in bars of df: AR(1) of each k-th bar of the sessions, k times its half-life; null where it doesn't revert."""
    s = sampled(df, [*keys, session], ts, every)
    return half_life(s, x, [*keys, "k"], ts).select(*keys, "k", (F.col("half_life") * F.col("k")).alias("half_life"))


# ------------------------------------------------------------------ multiple testing

RANGES = 64


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05, group: list[str] | None = None) -> DataFrame:
    """df plus p_adj and reject: the step-up rule within each group (a screen's formation). A null p is not counted and never rejects.

    Ranks are by value with ties alike, which leaves the adjusted values as they are. Without a group the distinct values are
    dealt into ranges, and only a count and a minimum of each range meet: no task sees all rows.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    values = df.where(ok).groupBy(*(group or []), p).agg(F.count("*").alias("_n"))
    if group:
        order = Window.partitionBy(*group).orderBy(p)
        rank = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        values = values.withColumn("_q", F.col(p) * F.sum("_n").over(Window.partitionBy(*group)) / rank)
        values = values.withColumn("_adj", F.min("_q").over(order.rowsBetween(0, Window.unboundedFollowing)))
    else:
        cuts = values.agg(F.percentile_approx(p, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(10_000)).alias("_cuts"))
        values = values.crossJoin(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(p)))).drop("_cuts")
        ranges = Window.orderBy("_r")  # a row for each range
        counts = values.groupBy("_r").agg(F.sum("_n").alias("_c"))
        counts = counts.select("_r", F.coalesce(F.sum("_c").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
        order = Window.partitionBy("_r").orderBy(p)
        values = values.join(F.broadcast(counts), "_r").withColumn("_q", F.col(p) * F.col("_all") / (F.col("_before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))))
        least = values.groupBy("_r").agg(F.min("_q").alias("_m")).select("_r", F.min("_m").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
        values = values.join(F.broadcast(least), "_r").withColumn("_adj", F.least(F.min("_q").over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("_later")))
    out = df.join(values.select(*(group or []), p, "_adj"), [*(group or []), p], "left")
    out = out.withColumn("p_adj", F.when(ok, F.least(F.greatest("_adj", F.lit(0.0)), F.lit(1.0))).otherwise(1.0))
    return out.withColumn("reject", ok & (F.col("p_adj") <= alpha)).select(*df.columns, "p_adj", "reject")


def holm(df: DataFrame, p: str = "p", group: list[str] | None = None) -> DataFrame:
    part = Window.partitionBy(*(group or []))
    order = part.orderBy(F.asc(p), *(c for c in df.columns if c not in (p, *(group or []))))
    step = F.col(p) * (F.count("*").over(part) - F.row_number().over(order) + 1)
    return df.withColumn("_s", step).withColumn("p_holm", F.least(F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_s")


def storey_pi0(p: str = "p", lam: float = 0.5) -> Column:
    """Share of true nulls, as an aggregate."""
    return F.count_if(F.col(p) > lam) / (F.count(p) * (1 - lam))
