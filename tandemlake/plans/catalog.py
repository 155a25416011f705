"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import ledger as L
from ..operators import models as M
from ..operators import network as N
from ..operators import portfolio as P
from ..operators import signals as G
from ..operators import stats as S
from ..operators import study as Y
from ..operators import validation as V
from ..sources import lake as K
from . import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PAIR = ["t1", "t2"]


def query(sql: str | None = None, dates: str = ""):
    """Register a query, and the SQL that gives the same rows. Dates leave both as text, which compares alike everywhere."""
    days = dates.split()

    def add(f: Callable) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({d: F.date_format(d, "yyyy-MM-dd") for d in days}) if days else df

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in days)}) FROM ({sql})" if days else sql
        return run

    return add


def r6(*columns: str, n: int = 6) -> list:
    return [F.round(c, n).alias(c) for c in columns]


def order(*keys: str, ts: str = "d"):
    return Window.partitionBy(*keys).orderBy(ts)


# ------------------------------------------------------------------ hedges and half-lives


@query(f"""WITH {W.RESID}, x AS (SELECT t1, t2, resid, lag(resid) OVER (PARTITION BY t1, t2 ORDER BY d) AS x0 FROM resid),
h AS (SELECT t1, t2, regr_slope(resid, x0) AS ar1, count(resid) AS n FROM x GROUP BY ALL)
SELECT t1, t2, alpha, beta, round(ar1, 6) AS ar1, round(CASE WHEN n >= 20 AND ar1 > 0 AND ar1 < 1 THEN -ln(2) / ln(ar1) END, 4) AS half_life FROM h JOIN hedge USING (t1, t2)""")
def static_hedge_half_life(spark, sf):
    e = W.resid(spark, sf)
    h = S.half_life(e, "resid", PAIR, "d")
    return e.groupBy(*PAIR).agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta")).join(h, PAIR).select(*PAIR, "alpha", "beta", *r6("ar1"), F.round("half_life", 4).alias("half_life"))


@query(f"""WITH {W.PAIRS}, f AS (SELECT *, covar_samp(P1, P2) OVER w / nullif(var_samp(P2) OVER w, 0) AS b, avg(P1) OVER w AS a1, avg(P2) OVER w AS a2, count(P1) OVER w AS n
  FROM pairs WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
SELECT t1, t2, d, round(b, 5) AS beta, round(a1 - b * a2, 2) AS alpha, round(P1 - (a1 - b * a2) - b * P2, 2) AS resid FROM f WHERE n >= 52""", dates="d")
def rolling_hedge(spark, sf):
    return S.rolling_hedge(W.pairs(spark, sf), 52).where("beta is not null").select(*PAIR, "d", *r6("beta", n=5), *r6("alpha", "resid", n=2))


@query(f"""WITH {W.RESID}, x AS (SELECT t1, t2, ln(P1 / lag(P1) OVER w) - lag(beta) OVER w * ln(P2 / lag(P2) OVER w) AS r, resid - lag(resid) OVER w AS e, resid FROM resid WINDOW w AS (PARTITION BY t1, t2 ORDER BY d))
SELECT t1, t2, round(CASE WHEN count(r) >= 30 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 6) AS sharpe, round(CASE WHEN stddev_samp(e) > 0 THEN avg(e) / stddev_samp(e) * sqrt(252) END, 6) AS proxy_sharpe, round(stddev_samp(resid), 3) AS resid_sigma FROM x GROUP BY ALL""")
def hedged_and_proxy_sharpe(spark, sf):
    e = W.resid(spark, sf)
    return S.hedged_sharpe(e, PAIR, "d").join(S.resid_proxy(e, PAIR, "d"), PAIR).select(*PAIR, *r6("sharpe", "proxy_sharpe"), *r6("resid_sigma", n=3))


@query(f"""WITH {W.PAIRS}, f AS (SELECT *, covar_samp(P1, P2) OVER w / nullif(var_samp(P2) OVER w, 0) AS b, count(P1) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
g AS (SELECT t1, t2, d, round(b, 6) AS beta FROM f WHERE n >= 52),
c AS (SELECT *, beta - avg(beta) OVER (PARTITION BY t1, t2) AS c, stddev_samp(beta) OVER (PARTITION BY t1, t2) AS gs,
  CASE WHEN count(beta) OVER w >= 31 THEN stddev_samp(beta) OVER w END AS rs FROM g WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS 62 PRECEDING)),
s AS (SELECT *, abs(sum(c) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING)) AS s, rs / nullif(gs, 0) AS dr FROM c),
o AS (SELECT t1, t2, count(*) AS n, CASE WHEN stddev_samp(beta) > 0 THEN max(s) / stddev_samp(beta) / sqrt(count(*)) ELSE 0 END AS stat, max(dr) AS md FROM s GROUP BY ALL)
SELECT t1, t2, n, round(stat, 5) AS cusum_stat, round(md, 5) AS max_drift, stat <= 1.36 AND coalesce(md <= 2, true) AS stable FROM o WHERE n >= 30""")
def hedge_stability(spark, sf):
    g = S.rolling_hedge(W.pairs(spark, sf), 52).where("beta is not null").select(*PAIR, "d", *r6("beta"))
    return S.hedge_stability(g, PAIR, "d").select(*PAIR, "n", *r6("cusum_stat", "max_drift", n=5), "stable")


@query(f"""WITH {W.RESID}, z AS (SELECT t1, t2, d, resid, avg(resid) OVER p AS m, stddev_pop(resid) OVER p AS s, quantile_cont(resid, 0.5) OVER p AS md FROM resid WINDOW p AS (PARTITION BY t1, t2)),
a AS (SELECT *, quantile_cont(abs(resid - md), 0.5) OVER (PARTITION BY t1, t2) AS mad FROM z)
SELECT t1, t2, d, round(CASE WHEN s > 0 THEN (resid - m) / s ELSE 0 END, 5) AS z, round(CASE WHEN mad > 0 THEN 0.6745 * (resid - md) / mad ELSE 0 END, 5) AS robust_z FROM a""", dates="d")
def whole_series_z(spark, sf):
    part = Window.partitionBy(*PAIR)
    e = W.resid(spark, sf).withColumn("md", X.median("resid", part)).withColumn("mad", X.median(F.abs(F.col("resid") - F.col("md")), part))
    robust = F.when(F.col("mad") > 0, 0.6745 * (F.col("resid") - F.col("md")) / F.col("mad")).otherwise(0.0)
    return e.select(*PAIR, "d", F.round(X.zscore("resid", part), 5).alias("z"), F.round(robust, 5).alias("robust_z"))


@query(f"WITH {W.Z} SELECT t1, t2, d, z FROM zs", dates="d")
def rolling_z(spark, sf):
    return W.zs(spark, sf).select(*PAIR, "d", "z")


@query(f"""WITH {W.RETURNS}, a AS (SELECT *, CASE WHEN count(px) OVER w >= 13 THEN quantile_cont(px, 0.5) OVER w END AS md FROM r WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 12 PRECEDING)),
b AS (SELECT *, abs(px - md) AS dev FROM a), c AS (SELECT *, CASE WHEN count(dev) OVER w >= 13 THEN quantile_cont(dev, 0.5) OVER w * 1.4826 END AS mad FROM b WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 12 PRECEDING))
SELECT ticker, d, round(CASE WHEN mad > 0 THEN (px - md) / mad END, 5) AS z FROM c""", dates="d")
def robust_rolling_z(spark, sf):
    return G.robust_rolling_z(W.returns(spark, sf), "px", ["ticker"], "d", 13).select("ticker", "d", *r6("z", n=5))


# ------------------------------------------------------------------ signals, ledgers, books

SIGNALS = f"""{W.Z}, s AS (SELECT t1, t2, d, P1, P2, beta, z, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM zs),
fold AS (
  SELECT t1, t2, i, pos, hold, cool, CASE WHEN pos <> 0 THEN pos * 10000.0 / (P1 + abs(beta) * P2) ELSE 0.0 END AS n1, beta, CAST(NOT bad AND pos <> 0 AND was = 0 AS BOOLEAN) AS entry, false AS leave, false AS stop
  FROM (SELECT *, CASE WHEN bad THEN 0 WHEN z <= -1.5 AND z > -4 THEN 1 WHEN z >= 1.5 AND z < 4 THEN -1 ELSE 0 END AS pos, CASE WHEN NOT bad AND abs(z) >= 1.5 AND abs(z) < 4 THEN 1 ELSE 0 END AS hold, 0 AS cool, 0 AS was
    FROM (SELECT *, z IS NULL AS bad FROM s WHERE i = 1))
  UNION ALL
  SELECT t1, t2, i, pos, CASE WHEN pos = 0 THEN 0 WHEN was = 0 THEN 1 ELSE h + 1 END, CASE WHEN NOT bad AND pos = 0 AND was <> 0 THEN 2 ELSE c END,
    CASE WHEN pos <> 0 THEN pos * 10000.0 / (P1 + abs(beta) * P2) ELSE 0.0 END, beta, NOT bad AND pos <> 0 AND was = 0, NOT bad AND pos = 0 AND was <> 0 AND NOT stopped, NOT bad AND stopped
  FROM (SELECT *, CASE WHEN bad THEN 0
      WHEN was = 0 AND c = 0 AND z <= -1.5 AND z > -4 THEN 1 WHEN was = 0 AND c = 0 AND z >= 1.5 AND z < 4 THEN -1 WHEN was = 0 THEN 0
      WHEN abs(z) <= 0.5 THEN 0 WHEN stopped THEN 0 WHEN h + 1 >= 12 THEN 0 ELSE was END AS pos
    FROM (SELECT s.*, s.z IS NULL AS bad, fold.pos AS was, fold.hold AS h, CASE WHEN s.z IS NULL THEN fold.cool ELSE greatest(fold.cool - 1, 0) END AS c,
        coalesce((fold.pos = 1 AND s.z <= -4) OR (fold.pos = -1 AND s.z >= 4), false) AS stopped
      FROM fold JOIN s ON s.t1 = fold.t1 AND s.t2 = fold.t2 AND s.i = fold.i + 1)))
, sig AS (SELECT s.t1, s.t2, s.d, s.P1, s.P2, s.beta, s.z, coalesce(lag(pos) OVER w, 0) AS pos, round(coalesce(lag(n1) OVER w, 0), 9) AS n1, round(coalesce(lag(-f.beta * n1) OVER w, 0), 9) AS n2,
  coalesce(lag(entry) OVER w, false) AS entry, coalesce(lag(leave) OVER w, false) AS leave, coalesce(lag(stop) OVER w, false) AS stop
  FROM s JOIN fold f USING (t1, t2, i) WINDOW w AS (PARTITION BY s.t1, s.t2 ORDER BY s.d))"""
RULE = G.SignalRule(z_entry=1.5, z_exit=0.5, z_stop=4.0, max_hold=12, cooldown=2, exec_lag=1)
COSTS = L.Costs(cost_bps=5, fee_1=0.001, fee_2=0.002, borrow_bps=50, adv_1=50_000.0, adv_2=80_000.0, impact_window=26, periods_per_year=52)


def _signals(spark, sf):
    s = G.generate_signals(W.zs(spark, sf), PAIR, RULE, ts="d")
    return s.withColumns({c: F.round(c, 9) for c in ("n1", "n2")})


@query(f"WITH RECURSIVE {SIGNALS} SELECT t1, t2, d, z, pos, n1, n2, entry, leave AS exit, stop FROM sig", dates="d")
def pair_signals(spark, sf):
    return _signals(spark, sf).select(*PAIR, "d", "z", "pos", "n1", "n2", "entry", "exit", "stop")


LEDGER = f"""{SIGNALS}, l0 AS (SELECT *, coalesce(lag(n1) OVER w, 0) AS m1, coalesce(lag(n2) OVER w, 0) AS m2, coalesce(P1 - lag(P1) OVER w, 0) AS dP1, coalesce(P2 - lag(P2) OVER w, 0) AS dP2,
  coalesce(ln(P1 / lag(P1) OVER w), 0) AS r1, coalesce(ln(P2 / lag(P2) OVER w), 0) AS r2 FROM sig WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)),
l1 AS (SELECT *, n1 - m1 AS dn1, n2 - m2 AS dn2,
  CASE WHEN m1 * n1 >= 0 THEN greatest(0, abs(m1) - abs(n1)) ELSE abs(m1) END * P1 + CASE WHEN m2 * n2 >= 0 THEN greatest(0, abs(m2) - abs(n2)) ELSE abs(m2) END * P2 AS close_notional,
  CASE WHEN m1 * n1 >= 0 THEN greatest(0, abs(n1) - abs(m1)) ELSE abs(n1) END * P1 + CASE WHEN m2 * n2 >= 0 THEN greatest(0, abs(n2) - abs(m2)) ELSE abs(n2) END * P2 AS open_notional,
  coalesce(CASE WHEN count(r1) OVER w >= 5 THEN stddev_samp(r1) OVER w END, stddev_samp(r1) OVER p) AS v1, coalesce(CASE WHEN count(r2) OVER w >= 5 THEN stddev_samp(r2) OVER w END, stddev_samp(r2) OVER p) AS v2
  FROM l0 WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS 25 PRECEDING), p AS (PARTITION BY t1, t2)),
l2 AS (SELECT *, n1 * dP1 + n2 * dP2 AS pnl_gross, abs(dn1) * P1 + abs(dn2) * P2 AS traded, abs(n1) * P1 + abs(n2) * P2 AS gross_exposure, n1 * P1 + n2 * P2 AS net_exposure,
  coalesce(0.14 * v1 * sqrt(52) * P1 * sqrt(abs(dn1) / 50000) * abs(dn1), 0) + coalesce(0.14 * v2 * sqrt(52) * P2 * sqrt(abs(dn2) / 80000) * abs(dn2), 0) AS impact_cost,
  (greatest(-n1, 0) * P1 + greatest(-n2, 0) * P2) * 0.005 / 252 AS borrow, CAST(n1 <> 0 OR n2 <> 0 AS INTEGER) AS in_pos, CAST(CASE WHEN n1 <> 0 THEN sign(n1) ELSE sign(n2) END AS INTEGER) AS side FROM l1),
l3 AS (SELECT *, 0.0005 * traded + 0.001 * abs(dn1) + 0.002 * abs(dn2) + impact_cost AS trade_cost, coalesce(quantile_cont(CASE WHEN in_pos = 1 THEN gross_exposure END, 0.5) OVER p, quantile_cont(gross_exposure, 0.5) OVER p) AS cb FROM l2 WINDOW p AS (PARTITION BY t1, t2)),
l4 AS (SELECT *, trade_cost + borrow AS cost, pnl_gross - trade_cost - borrow AS pnl_net, CASE WHEN cb > 0 THEN cb ELSE 1 END AS capital_base, coalesce(trade_cost * close_notional / nullif(close_notional + open_notional, 0), 0) AS close_cost FROM l3),
l5 AS (SELECT *, sum(pnl_net) OVER w AS equity, capital_base + sum(pnl_net) OVER w AS portfolio, pnl_net / capital_base AS ret_net, traded / capital_base AS turnover FROM l4 WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING)),
led AS (SELECT *, portfolio - max(portfolio) OVER w AS drawdown, portfolio / max(portfolio) OVER w - 1 AS drawdown_pct FROM l5 WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING))"""


def _ledger(spark, sf):
    s = _signals(spark, sf)
    return L.daily_ledger(W.pairs(spark, sf), s, PAIR, COSTS, ts="d")


@query(f"""WITH RECURSIVE {LEDGER} SELECT t1, t2, d, in_pos, round(pnl_gross, 2) AS pnl_gross, round(cost, 2) AS cost, round(impact_cost, 2) AS impact_cost, round(pnl_net, 2) AS pnl_net, round(equity, 2) AS equity,
round(gross_exposure, 2) AS gross_exposure, round(net_exposure, 2) AS net_exposure, round(turnover, 6) AS turnover, round(drawdown, 2) AS drawdown, round(drawdown_pct, 6) AS drawdown_pct FROM led""", dates="d")
def pair_ledger(spark, sf):
    return _ledger(spark, sf).select(*PAIR, "d", "in_pos", *r6("pnl_gross", "cost", "impact_cost", "pnl_net", "equity", "gross_exposure", "net_exposure", "drawdown", n=2), *r6("turnover", "drawdown_pct"))


TRIPS = f"""{LEDGER}, e0 AS (SELECT *, coalesce(lag(in_pos) OVER w, 0) AS was, lag(side) OVER w AS side0 FROM led WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)),
e1 AS (SELECT *, (in_pos = 1 AND was = 0) OR (in_pos = 1 AND was = 1 AND side <> side0) AS enters, (in_pos = 0 AND was = 1) OR (in_pos = 1 AND was = 1 AND side <> side0) AS leaves FROM e0),
starts AS (SELECT t1, t2, d AS entry FROM e1 WHERE enters), ends AS (SELECT t1, t2, d AS exit_ FROM e1 WHERE leaves),
mates AS (SELECT t1, t2, entry, min(exit_) AS exit_ FROM starts JOIN ends USING (t1, t2) WHERE exit_ > entry GROUP BY ALL),
trips AS (SELECT m.t1, m.t2, m.entry, m.exit_ AS exit, any_value(f.side) AS side, count(*) AS bars, sum(e.pnl_gross) AS pnl_gross, sum(e.trade_cost) - any_value(f.close_cost) + any_value(x.close_cost) + sum(e.borrow) AS cost,
    sum(e.turnover) + any_value(x.close_notional) / any_value(f.capital_base) AS turnover
  FROM mates m JOIN e1 e ON e.t1 = m.t1 AND e.t2 = m.t2 AND e.d >= m.entry AND e.d < m.exit_ JOIN e1 f ON f.t1 = m.t1 AND f.t2 = m.t2 AND f.d = m.entry JOIN e1 x ON x.t1 = m.t1 AND x.t2 = m.t2 AND x.d = m.exit_ GROUP BY m.t1, m.t2, m.entry, m.exit_)"""


@query(f"""WITH RECURSIVE {TRIPS} SELECT t1, t2, entry, exit, side, bars, round(pnl_gross, 2) AS pnl_gross, round(cost, 2) AS cost, round(pnl_gross - cost, 2) AS pnl_net, round(turnover, 6) AS turnover FROM trips""", dates="entry exit")
def pair_round_trips(spark, sf):
    return L.round_trips(_ledger(spark, sf), PAIR, "d").select(*PAIR, "entry", "exit", "side", "bars", *r6("pnl_gross", "cost", "pnl_net", n=2), *r6("turnover"))


@query(f"""WITH RECURSIVE {TRIPS}, a AS (SELECT t1, t2, count(*) AS bars, sum(pnl_net) AS net_pnl, product(1 + ret_net) ** (52.0 / count(*)) - 1 AS ann_return, avg(ret_net) / nullif(stddev_pop(ret_net), 0) * sqrt(52) AS sharpe,
  avg(ret_net) / nullif(stddev_pop(least(ret_net, 0)), 0) * sqrt(52) AS sortino, -min(drawdown) AS max_drawdown, sum(turnover) * 52 / count(*) AS turnover_annualized FROM led GROUP BY ALL),
b AS (SELECT t1, t2, count(*) AS n_trades, avg(CAST(pnl_gross - cost > 0 AS DOUBLE)) AS hit_rate, avg(bars) AS avg_hold_bars, median(bars) AS med_hold_bars FROM trips GROUP BY ALL)
SELECT t1, t2, bars, round(net_pnl, 2) AS net_pnl, round(ann_return, 6) AS ann_return, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 2) AS max_drawdown, round(turnover_annualized, 2) AS turnover_annualized,
coalesce(n_trades, 0) AS n_trades, round(hit_rate, 6) AS hit_rate, round(avg_hold_bars, 6) AS avg_hold_bars, med_hold_bars FROM a LEFT JOIN b USING (t1, t2)""")
def pair_summary(spark, sf):
    led = _ledger(spark, sf)
    out = L.summary(led, L.round_trips(led, PAIR, "d"), PAIR, COSTS, "d")
    return out.select(*PAIR, "bars", *r6("net_pnl", "max_drawdown", "turnover_annualized", n=2), *r6("ann_return", "sharpe", "sortino", "hit_rate", "avg_hold_bars"), "n_trades", "med_hold_bars")


@query(f"""WITH RECURSIVE {LEDGER}, p AS (SELECT d, sum(pnl_net) AS pnl, CAST(sum(in_pos) AS BIGINT) AS active, sum(gross_exposure) AS deployed FROM led GROUP BY d),
q AS (SELECT *, sum(pnl) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM p)
SELECT d, active, round(pnl, 2) AS pnl, round(pnl / nullif(deployed, 0), 8) AS ret, round(cum - max(cum) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 2) AS drawdown FROM q""", dates="d")
def portfolio_by_session(spark, sf):
    p = _ledger(spark, sf).groupBy("d").agg(F.sum("pnl_net").alias("pnl"), F.sum("in_pos").alias("active"), F.sum("gross_exposure").alias("deployed"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # a row for each session
    q = p.withColumn("cum", F.sum("pnl").over(w))
    return q.select("d", "active", F.round("pnl", 2).alias("pnl"), F.round(X.ratio("pnl", "deployed"), 8).alias("ret"), F.round(F.col("cum") - F.max("cum").over(w), 2).alias("drawdown"))


BOOK = f"""{SIGNALS}, k AS (SELECT *, lag(P1) OVER w AS q1, lag(P2) OVER w AS q2, lag(beta) OVER w AS b0, coalesce(lag(pos) OVER w, 0) AS was FROM sig WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)),
k1 AS (SELECT t1, t2, d, P1, P2, pos, pos <> 0 AND pos <> was AS entry, CASE WHEN pos <> 0 THEN pos * 10000.0 / (q1 + abs(b0) * q2) ELSE 0 END AS n1, b0 FROM k),
k2 AS (SELECT *, CASE WHEN pos <> 0 THEN -b0 * n1 ELSE 0 END AS n2, sum(CAST(entry AS INTEGER)) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING) AS id FROM k1)"""
BOOK_OUT = """, k3 AS (SELECT *, n1 - coalesce(lag(n1) OVER w, 0) AS dn1, n2 - coalesce(lag(n2) OVER w, 0) AS dn2, n1 * coalesce(P1 - lag(P1) OVER w, 0) + n2 * coalesce(P2 - lag(P2) OVER w, 0) AS pnl_price FROM {src} WINDOW w AS (PARTITION BY t1, t2 ORDER BY d))
SELECT t1, t2, d, round(pnl_price, 2) AS pnl_price, round((10 * abs(dn1) * P1 + 20 * abs(dn2) * P2) / 1e4, 2) AS cost, round((greatest(-n1, 0) * P1 + greatest(-n2, 0) * P2) * 0.005 / 252, 2) AS borrow, round(abs(n1) * P1 + abs(n2) * P2, 2) AS gross_notional, CAST(CASE WHEN pos <> 0 THEN id ELSE 0 END AS INTEGER) AS trade_id FROM k3"""


def _book(spark, sf, reset, band=0.1):
    s = _signals(spark, sf).select(*PAIR, "d", "pos").join(W.resid(spark, sf).select(*PAIR, "d", "P1", "P2", "beta"), [*PAIR, "d"]).withColumn("target", F.lit(10000.0))
    out = L.book(s, PAIR, reset, band, (10.0, 20.0), ts="d")
    return out.select(*PAIR, "d", *r6("pnl_price", "cost", "borrow", "gross_notional", n=2), "trade_id")


@query(f"WITH RECURSIVE {BOOK} {BOOK_OUT.format(src='k2')}", dates="d")
def book_daily(spark, sf):
    return _book(spark, sf, "daily")


@query(f"""WITH RECURSIVE {BOOK}, fz AS (SELECT * EXCLUDE (n1, n2), CASE WHEN pos <> 0 THEN first_value(n1) OVER w ELSE 0 END AS n1, CASE WHEN pos <> 0 THEN first_value(n2) OVER w ELSE 0 END AS n2
FROM k2 WINDOW w AS (PARTITION BY t1, t2, id, pos ORDER BY d)) {BOOK_OUT.format(src='fz')}""", dates="d")
def book_frozen(spark, sf):
    return _book(spark, sf, "frozen")


@query(f"WITH RECURSIVE {BOOK} {BOOK_OUT.format(src='k2')}", dates="d")
def book_band_of_zero(spark, sf):
    """A band of zero sizes anew on every bar, as the daily book does."""
    return _book(spark, sf, "band", 0.0)


BAND = f"""{BOOK}, kb AS (SELECT *, row_number() OVER w AS i, coalesce(lag(pos) OVER w, 0) = pos AS held FROM k2 WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)),
bb AS (SELECT t1, t2, i, P1, P2, n1, n2 FROM kb WHERE i = 1
  UNION ALL SELECT t1, t2, i, P1, P2, CASE WHEN keeps THEN m1 ELSE n1 END, CASE WHEN keeps THEN m2 ELSE n2 END
  FROM (SELECT kb.*, bb.n1 AS m1, bb.n2 AS m2, kb.pos <> 0 AND kb.held AND abs(abs(bb.n1) * bb.P1 + abs(bb.n2) * bb.P2 - 10000) <= 0.1 * 10000 AS keeps
    FROM bb JOIN kb ON kb.t1 = bb.t1 AND kb.t2 = bb.t2 AND kb.i = bb.i + 1)),
bs AS (SELECT kb.* EXCLUDE (n1, n2), bb.n1, bb.n2 FROM kb JOIN bb USING (t1, t2, i))"""


@query(f"WITH RECURSIVE {BAND} {BOOK_OUT.format(src='bs')}", dates="d")
def book_band(spark, sf):
    return _book(spark, sf, "band", 0.1)


@query(f"""WITH RECURSIVE {SIGNALS}, t AS (SELECT *, coalesce(abs(z) > 2.5, false) AS trig FROM sig), h AS (SELECT *, max(CAST(trig AS INTEGER)) OVER (PARTITION BY t1, t2 ORDER BY d ROWS 3 PRECEDING) = 1 AS h0, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM t),
ext AS (SELECT t1, t2, i, h0 AS halted FROM h WHERE i = 1 UNION ALL SELECT h.t1, h.t2, h.i, h.h0 OR (ext.halted AND coalesce(abs(h.z) >= 1.0, false)) FROM ext JOIN h ON h.t1 = ext.t1 AND h.t2 = ext.t2 AND h.i = ext.i + 1)
SELECT t1, t2, d, halted, CASE WHEN halted THEN 0 ELSE pos END AS pos, round(CASE WHEN halted THEN 0 ELSE n1 END, 6) AS n1 FROM h JOIN ext USING (t1, t2, i)""", dates="d")
def breaker_by_z(spark, sf):
    s = _signals(spark, sf)
    halted = L.z_halts(s.select(*PAIR, "d", "z"), PAIR, L.Breaker(z_halt=2.5, cooldown=3, z_reentry=1.0), "d")
    return L.patched(s, halted, PAIR, "d").select(*PAIR, "d", "halted", "pos", *r6("n1"))


@query(f"""WITH RECURSIVE {LEDGER}, t AS (SELECT *, CAST((equity - max(equity) OVER w) / 10000.0 < -0.02 AS INTEGER) AS trip FROM led WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS 25 PRECEDING)),
h AS (SELECT *, max(trip) OVER (PARTITION BY t1, t2 ORDER BY d ROWS 7 PRECEDING) = 1 AS halted FROM t),
g AS (SELECT *, CAST(halted AND NOT coalesce(lag(halted) OVER w, false) AS INTEGER) AS starts FROM h WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)), r AS (SELECT *, sum(starts) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT t1, t2, min(d) AS first, max(d) AS last, count(*) AS bars FROM r WHERE halted GROUP BY t1, t2, run""", dates="first last")
def breaker_by_drawdown(spark, sf):
    h = L.drawdown_halts(_ledger(spark, sf), PAIR, L.Breaker(max_drawdown_pct=0.02, drawdown_window=26, halt_bars=8, capital_base=10_000), "d")
    return L.spans(h, PAIR, "halted", "d")


@query(f"""WITH RECURSIVE {SIGNALS}, x AS (SELECT t1, t2, d, ln(P1) AS y1, ln(P2) AS y2, 1.0 AS w1, -beta AS w2, 0.0 AS c, pos AS signal FROM sig),
y AS (SELECT *, w1 * y1 + w2 * y2 - c AS spread FROM x), v AS (SELECT *, coalesce(lag(signal) OVER w * (spread - lag(spread) OVER w), 0) AS book, coalesce(lag(signal) OVER w * (lag(w1) OVER w * (y1 - lag(y1) OVER w) + lag(w2) OVER w * (y2 - lag(y2) OVER w)), 0) AS tradable,
coalesce(abs(signal * w1 - lag(signal * w1) OVER w), 0) AS a, coalesce(abs(signal * w2 - lag(signal * w2) OVER w), 0) AS b FROM y WINDOW w AS (PARTITION BY t1, t2 ORDER BY d))
SELECT t1, t2, round(sum(book), 6) AS book, round(sum(tradable), 6) AS tradable, round(sum(book - tradable), 6) AS revaluation, round(sum(a * 5 + b * 7) / 1e4, 8) AS fees FROM v GROUP BY ALL""")
def spread_accounting(spark, sf):
    s = _signals(spark, sf).select(*PAIR, "d", F.col("pos").alias("signal")).join(W.resid(spark, sf), [*PAIR, "d"])
    x = s.select(*PAIR, "d", F.log("P1").alias("y1"), F.log("P2").alias("y2"), F.lit(1.0).alias("w1"), (-F.col("beta")).alias("w2"), F.lit(0.0).alias("c"), "signal")
    v = L.turnover_and_fees(L.decompose_spread(x, PAIR, "d"), PAIR, (5.0, 7.0), "d")
    return v.groupBy(*PAIR).agg(*(F.round(F.sum(c), 6).alias(c) for c in ("book", "tradable", "revaluation")), F.round(F.sum("fees"), 8).alias("fees"))


@query(f"""WITH RECURSIVE {W.Z}, s AS (SELECT t1, t2, d, z AS s, z IS NOT NULL AND abs(z) < 3 AS ok, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM zs),
f AS (SELECT t1, t2, i, CASE WHEN NOT ok THEN 0 WHEN s < -1.25 THEN 1 WHEN s > 1.25 THEN -1 ELSE 0 END AS state FROM s WHERE i = 1
  UNION ALL SELECT s.t1, s.t2, s.i, CASE WHEN NOT s.ok THEN 0 WHEN f.state = 0 AND s.s < -1.25 THEN 1 WHEN f.state = 0 AND s.s > 1.25 THEN -1 WHEN f.state = 1 AND s.s > -0.5 THEN 0 WHEN f.state = -1 AND s.s < 0.75 THEN 0 ELSE f.state END
  FROM f JOIN s ON s.t1 = f.t1 AND s.t2 = f.t2 AND s.i = f.i + 1)
SELECT t1, t2, d, state FROM f JOIN s USING (t1, t2, i)""", dates="d")
def bang_bang(spark, sf):
    z = W.zs(spark, sf).select(*PAIR, "d", F.col("z").alias("s"), F.coalesce(F.abs("z") < 3, F.lit(False)).alias("model_ok"))
    return G.fold_bang_bang(z, PAIR, "d")


# ------------------------------------------------------------------ lake, liquidity, sessions


@query(f"""WITH {W.bars_sql('week', 'p_brand AS ticker, p_type AS id', 'b')}, t AS (SELECT ticker, id, sum(dollar_volume) AS dv FROM b GROUP BY ALL), k AS (SELECT ticker, id, row_number() OVER (PARTITION BY ticker ORDER BY dv DESC, id) AS n FROM t)
SELECT b.ticker, b.id, b.d, px, volume FROM b JOIN k ON k.ticker = b.ticker AND k.id = b.id AND n = 1""", dates="d")
def dominant_instrument(spark, sf):
    kept, _ = K.dominant(W.bars(spark, sf, by=("ticker", "id")))
    return kept.select("ticker", "id", "d", "px", "volume")


@query(f"""WITH {W.bars_sql('week', 'p_brand AS ticker, p_type AS id', 'b')}, t AS (SELECT ticker, id, sum(dollar_volume) AS dv FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dv DESC, id) AS n FROM t)
SELECT x.ticker, y.id AS kept, x.id AS dropped, round(x.dv, 2) AS dropped_dollar_volume FROM k x JOIN k y ON x.ticker = y.ticker AND y.n = 1 WHERE x.n > 1""")
def instrument_collisions(spark, sf):
    _, lost = K.dominant(W.bars(spark, sf, by=("ticker", "id")))
    return lost.select("ticker", "kept", "dropped", F.round("dropped_dollar_volume", 2).alias("dropped_dollar_volume"))


@query(f"""WITH {W.BARS}, f AS (SELECT *, 1 - 0.0005 * (row_number() OVER (PARTITION BY ticker ORDER BY d DESC) // 13) AS f FROM bars)
SELECT ticker, d, round(greatest(coalesce((1 - lag(f) OVER w / f) * lag(px) OVER w, 0), 0), 6) AS dividend FROM f WINDOW w AS (PARTITION BY ticker ORDER BY d)""", dates="d")
def recovered_dividends(spark, sf):
    f = W.bars(spark, sf).withColumn("f", 1 - 0.0005 * F.floor(F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d"))) / 13))
    return f.select("ticker", "d", F.round(K.recover_dividends(f, ["ticker"], "px", "f", "d"), 6).alias("dividend"))


@query(f"""WITH {W.DAILY}, o AS (SELECT d, row_number() OVER (ORDER BY d) AS o FROM (SELECT DISTINCT d FROM bars)), x AS (SELECT bars.*, o, CASE WHEN o - lag(o) OVER w = 1 THEN px / lag(px) OVER w END AS r FROM bars JOIN o USING (d) WINDOW w AS (PARTITION BY ticker ORDER BY d)),
s AS (SELECT ticker, median(px) AS mp, median(dollar_volume) AS mdv, stddev_samp(ln(r)) * sqrt(252) AS vol, count(px) / (SELECT count(*) FROM o) AS cov, max(abs(r - 1)) AS mr FROM x GROUP BY ticker),
e AS (SELECT *, coalesce(mp >= 5 AND mdv >= 1e4 AND vol >= 0.05 AND cov >= 0.3 AND mr <= 4, false) AS ok FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY mdv DESC, ticker) AS n FROM e)
SELECT ticker, round(mp, 6) AS median_price, round(mdv, 4) AS median_dollar_volume, round(vol, 6) AS ann_vol, round(cov, 6) AS coverage, round(mr, 6) AS max_abs_return, ok AND n <= 10 AS eligible FROM k""")
def liquidity_screen(spark, sf):
    b = W.bars(spark, sf, "day").withColumnRenamed("px", "close")
    s = K.liquidity_screen(b, min_dollar_volume=1e4, min_coverage=0.3, max_abs_return=4.0, top_n=10, ts="d")
    return s.select("ticker", *r6("median_price", "ann_vol", "coverage", "max_abs_return"), *r6("median_dollar_volume", n=4), "eligible")


@query("""WITH y AS (SELECT unnest(range(1990, 2031)) AS y), f AS (SELECT y, make_date(y, 11, 1) AS n1 FROM y), t AS (SELECT y, n1 + CAST((11 - isodow(n1)) % 7 AS INTEGER) + 22 AS friday FROM f),
d AS (SELECT friday AS day FROM t UNION ALL SELECT make_date(y, 7, 3) FROM y WHERE isodow(make_date(y, 7, 3)) <= 4 UNION ALL SELECT make_date(y, 12, 24) FROM y WHERE isodow(make_date(y, 12, 24)) <= 4) SELECT CAST(day AS DATE) AS day FROM d""", dates="day")
def early_close_calendar(spark, sf):
    return K.early_closes(spark, "1990-01-01", "2030-12-31")


def _grid(spark, sf):
    return K.session_grid(W.ticks(spark, sf), tz=None, order="ingest")


@query(f"WITH {W.GRID} SELECT ticker, session, minute, close, volume, traded FROM grid", dates="session")
def session_grid(spark, sf):
    return _grid(spark, sf).select("ticker", "session", "minute", "close", "volume", "traded")


@query(f"""WITH {W.GRID} SELECT ticker, session, CAST(floor(minute / 5) AS INTEGER) AS bucket, arg_max(close, minute) FILTER (close IS NOT NULL) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(traded) AS BIGINT) AS n_traded FROM grid GROUP BY ALL""", dates="session")
def five_minute_bars(spark, sf):
    return K.k_minute(_grid(spark, sf), 5)


#: Roll's spread from the minutes with a print of their own, each mean over its own values.
SESSIONS = f"""{W.GRID}, c AS (SELECT ticker, session, minute, print, print - lag(print) OVER (PARTITION BY ticker, session ORDER BY minute) AS d1 FROM grid WHERE print IS NOT NULL),
c2 AS (SELECT *, lag(d1) OVER (PARTITION BY ticker, session ORDER BY minute) AS d0 FROM c),
ro AS (SELECT ticker, session, CASE WHEN avg(d1 * d0) - avg(d1) * avg(d0) < 0 AND count(d1 * d0) >= 30 THEN 2 * sqrt(-(avg(d1 * d0) - avg(d1) * avg(d0))) / avg(print) * 1e4 END AS roll FROM c2 GROUP BY ALL),
sb AS (SELECT ticker, session, arg_min(print, minute) FILTER (print IS NOT NULL) AS open, arg_max(close, minute) FILTER (close IS NOT NULL) AS close, CAST(sum(volume) AS BIGINT) AS volume, sum(coalesce(print * volume, 0)) AS dollar_volume,
  CAST(sum(traded) AS BIGINT) AS n_traded, count(*) AS n_bars, any_value(roll) AS roll FROM grid LEFT JOIN ro USING (ticker, session) GROUP BY ALL)"""


@query(f"WITH {SESSIONS} SELECT ticker, session, open, close, volume, round(dollar_volume, 4) AS dollar_volume, n_traded, n_bars, round(roll, 4) AS roll_spread_bps FROM sb WHERE close IS NOT NULL", dates="session")
def session_bars(spark, sf):
    return K.session_bars(_grid(spark, sf)).select("ticker", "session", "open", "close", "volume", *r6("dollar_volume", "roll_spread_bps", n=4), "n_traded", "n_bars")


@query(f"""WITH {SESSIONS} SELECT ticker, count(*) AS n_sessions, min(session) AS first, max(session) AS last, round(median(n_traded / n_bars), 6) AS median_traded_share, round(median(dollar_volume), 4) AS median_dollar_volume, round(median(roll), 4) AS median_roll_bps FROM sb WHERE close IS NOT NULL GROUP BY ticker""", dates="first last")
def session_summary(spark, sf):
    return K.summarize_sessions(K.session_bars(_grid(spark, sf))).select("ticker", "n_sessions", "first", "last", *r6("median_traded_share"), *r6("median_dollar_volume", "median_roll_bps", n=4))


@query(f"""WITH {W.TICKS}, t AS (SELECT ticker, ts, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts DESC) <= 2 AS flat FROM (SELECT DISTINCT ticker, ts FROM ticks))
SELECT ticker, CAST(ts AS DATE) AS session, count(*) AS bars, count(*) FILTER (flat) AS flat, count(*) FILTER (flat OR hour(ts) * 60 + minute(ts) >= 900) AS blocked FROM t GROUP BY ALL""", dates="session")
def session_masks(spark, sf):
    t = G.session_masks(W.ticks(spark, sf).select("ticker", "ts").distinct(), ["ticker"], "ts", 2, True, 900)
    return t.groupBy("ticker", F.to_date("ts").alias("session")).agg(F.count("*").alias("bars"), F.count_if("force_flat").alias("flat"), F.count_if("block_entry").alias("blocked"))


@query("""WITH a AS (SELECT DISTINCT upper(trim(p_brand)) AS t FROM part WHERE p_size < 20), b AS (SELECT DISTINCT upper(trim(p_brand)) AS t FROM part WHERE p_retailprice > 1000 AND p_brand > 'Brand#2'),
u AS (SELECT t FROM a UNION SELECT t FROM b), i AS (SELECT t FROM a INTERSECT SELECT t FROM b), d AS (SELECT t FROM a EXCEPT SELECT t FROM b)
SELECT 'union' AS op, t AS ticker FROM u UNION ALL SELECT 'intersection', t FROM i UNION ALL SELECT 'difference', t FROM d""")
def combined_tickers(spark, sf):
    part = W.table(spark, sf, "part")
    a, b = K.clean_tickers(part.where("p_size < 20"), "p_brand"), K.clean_tickers(part.where("p_retailprice > 1000 and p_brand > 'Brand#2'"), "p_brand")
    parts = [K.combine_tickers([a, b], op).select(F.lit(op).alias("op"), "ticker") for op in ("union", "intersection", "difference")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ microstructure on ticks


def _ticks(spark, sf):
    return W.ticks(spark, sf).withColumn("session", F.to_date("ts")).groupBy("ticker", "session", "ts").agg(F.max_by("close", "ingest").alias("px"))


TICK = f"{W.TICKS}, tk AS (SELECT ticker, CAST(ts AS DATE) AS session, ts, arg_max(close, event_id) AS px FROM ticks GROUP BY ALL), si AS (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY ts) - 1 AS i FROM tk), sk AS (SELECT si.*, k FROM si, (SELECT unnest([1, 2, 5]) AS k) WHERE i % k = 0)"


@query(f"""WITH {TICK}, a AS (SELECT *, px - lag(px) OVER w AS d FROM sk WHERE k = 1 WINDOW w AS (PARTITION BY ticker, session ORDER BY ts)), b AS (SELECT *, lag(d) OVER (PARTITION BY ticker, session ORDER BY ts) AS d0 FROM a),
c AS (SELECT ticker, covar_pop(d, d0) AS c, count(d * d0) AS n, avg(px) AS m FROM b GROUP BY ticker)
SELECT ticker, n, round(CASE WHEN n >= 30 THEN CASE WHEN c < 0 THEN 2 * sqrt(-c) ELSE -2 * sqrt(c) END / m * 1e4 END, 4) AS roll FROM c""")
def roll_spread(spark, sf):
    return S.roll_spread(_ticks(spark, sf), ["ticker"], "session", "ts", signed=True).select("ticker", "n", F.round("roll", 4).alias("roll"))


@query(f"""WITH {TICK}, a AS (SELECT *, ln(px / lag(px) OVER w) AS r FROM sk WINDOW w AS (PARTITION BY ticker, session, k ORDER BY ts)), v AS (SELECT ticker, session, k, sum(r * r) AS rv FROM a GROUP BY ALL)
SELECT ticker, k, round(avg(rv), 6) AS variance, count(rv) AS sessions FROM v GROUP BY ALL""")
def variance_signature(spark, sf):
    return S.variance_signature(_ticks(spark, sf), ["ticker"], "session", "ts", [1, 2, 5]).select("ticker", "k", *r6("variance"), "sessions")


@query(f"""WITH {TICK}, a AS (SELECT *, ln(px / lag(px) OVER w) AS r FROM sk WINDOW w AS (PARTITION BY ticker, session, k ORDER BY ts)), b AS (SELECT *, lag(r) OVER (PARTITION BY ticker, session, k ORDER BY ts) AS r0 FROM a)
SELECT ticker, k, round(corr(r, r0), 6) AS autocorrelation, count(r * r0) AS n FROM b GROUP BY ALL""")
def autocorrelation(spark, sf):
    return S.autocorr(_ticks(spark, sf), ["ticker"], "session", "ts", [1, 2, 5]).select("ticker", "k", *r6("autocorrelation"), "n")


@query(f"""WITH {W.PAIRS}, si AS (SELECT *, year(d) AS y, row_number() OVER (PARTITION BY t1, t2, year(d) ORDER BY d) - 1 AS i FROM pairs), sk AS (SELECT si.*, k FROM si, (SELECT unnest([1, 4]) AS k) WHERE i % k = 0),
a AS (SELECT t1, t2, k, ln(P1 / lag(P1) OVER w) AS a, ln(P2 / lag(P2) OVER w) AS b FROM sk WINDOW w AS (PARTITION BY t1, t2, y, k ORDER BY d)) SELECT t1, t2, k, round(corr(a, b), 6) AS correlation, count(a * b) AS n FROM a GROUP BY ALL""")
def epps_correlation(spark, sf):
    return S.epps(W.pairs(spark, sf).withColumn("y", F.year("d")), PAIR, "y", "d", [1, 4]).select(*PAIR, "k", *r6("correlation"), "n")


# ------------------------------------------------------------------ portfolio and cross-section


@query(f"""WITH {W.RETURNS}, c AS (SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, corr(a.r, b.r) AS c FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL)
SELECT i, j, n, round(CASE WHEN n >= 30 THEN c END, 6) AS corr FROM c""")
def return_correlations(spark, sf):
    return P.pairwise_correlation(W.returns(spark, sf), "ticker", "d", "r").select("i", "j", "n", *r6("corr"))


@query(f"""WITH {W.RETURNS}, o AS (SELECT a.ticker AS i, b.ticker AS j, a.r AS x, b.r AS y FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
k AS (SELECT i, j, rank() OVER (PARTITION BY i, j ORDER BY x) + (count(*) OVER (PARTITION BY i, j, x) - 1) / 2 AS x, rank() OVER (PARTITION BY i, j ORDER BY y) + (count(*) OVER (PARTITION BY i, j, y) - 1) / 2 AS y FROM o)
SELECT i, j, count(*) AS n, round(corr(x, y), 6) AS corr FROM k GROUP BY ALL HAVING count(*) >= 30""")
def rank_correlations(spark, sf):
    return P.pairwise_correlation(W.returns(spark, sf), "ticker", "d", "r", method="spearman").where("corr is not null").select("i", "j", "n", *r6("corr"))


@query(f"WITH {W.RETURNS}, c AS (SELECT corr(a.r, b.r) AS c FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker GROUP BY a.ticker, b.ticker) SELECT round(1 / avg(abs(c)), 6) AS score FROM c")
def diversification_score(spark, sf):
    return P.pairwise_correlation(W.returns(spark, sf), "ticker", "d", "r").agg(F.round(P.diversification(F.col("corr")), 6).alias("score"))


SPREADS = f"{W.RESID}, sr AS (SELECT *, (P1 - lag(P1) OVER w - lag(beta) OVER w * (P2 - lag(P2) OVER w)) / (lag(P1) OVER w + abs(lag(beta) OVER w) * lag(P2) OVER w) AS r FROM resid WINDOW w AS (PARTITION BY t1, t2 ORDER BY d))"


@query(f"""WITH {SPREADS}, v AS (SELECT t1, t2, var_samp(r) AS v FROM sr GROUP BY ALL) SELECT t1, t2, round((1 / v) / sum(1 / v) OVER (), 9) AS inv_var, round((1 / sqrt(v)) / sum(1 / sqrt(v)) OVER (), 9) AS inv_vol, round(1.0 / count(*) OVER (), 9) AS equal FROM v""")
def position_weights(spark, sf):
    r = P.spread_returns(W.resid(spark, sf), PAIR, "d")
    out = [P.position_weights(r, PAIR, m).select(*PAIR, F.round("weight", 9).alias(m)) for m in ("inv_var", "inv_vol", "equal")]
    return out[0].join(out[1], PAIR).join(out[2], PAIR)


@query(f"""WITH {W.RETURNS}, w0 AS (SELECT ticker, power(stddev_samp(r), 4) AS q FROM r GROUP BY 1), w AS (SELECT ticker, q / sum(q) OVER () AS w FROM w0), o AS (SELECT *, row_number() OVER (ORDER BY w DESC, ticker) AS i, sum(w) OVER (ORDER BY w DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, greatest(0.045, 1.0 / count(*) OVER ()) AS c FROM w),
m AS (SELECT *, coalesce(min(i) FILTER (w * (1 - (i - 1) * c) / l <= c + 1e-12) OVER (), count(*) OVER () + 1) AS m FROM o) SELECT ticker, round(CASE WHEN i < m THEN c ELSE w * (1 - (m - 1) * c) / sum(w) FILTER (i >= m) OVER () END, 9) AS weight FROM m""")
def capped_weights(spark, sf):
    w = W.returns(spark, sf).groupBy("ticker").agg(F.pow(F.stddev_samp("r"), 4).alias("q")).withColumn("weight", F.col("q") / F.sum("q").over(Window.partitionBy()))
    return P.capped(w, ["ticker"], 0.045).select("ticker", F.round("weight", 9).alias("weight"))


@query(f"""WITH {W.RETURNS}, p AS (SELECT a.ticker AS t1, b.ticker AS t2 FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker GROUP BY ALL HAVING round(corr(a.r, b.r), 6) > 0.05),
l AS (SELECT t1, t2, t1 AS leg FROM p UNION ALL SELECT t1, t2, t2 FROM p), n AS (SELECT leg, count(*) AS n FROM l GROUP BY leg), w AS (SELECT t1, t2, avg(1.0 / n) AS w FROM l JOIN n USING (leg) GROUP BY ALL) SELECT t1, t2, round(w / sum(w) OVER (), 9) AS weight FROM w""")
def leg_split_weights(spark, sf):
    c = P.pairwise_correlation(W.returns(spark, sf), "ticker", "d", "r").where(F.round("corr", 6) > 0.05)
    p = c.select(F.col("i").alias("t1"), F.col("j").alias("t2"))
    return P.leg_split(p).select(*PAIR, F.round("weight", 9).alias("weight"))


@query(f"""WITH {W.RETURNS}, x AS (SELECT ticker, d, r FROM r UNION ALL SELECT ticker || '-3X', d, round(3 * r + 0.0001 * (day(d) % 5), 9) FROM r), c AS (SELECT a.ticker AS i, b.ticker AS j, corr(a.r, b.r) AS rho, stddev_samp(a.r) FILTER (b.r IS NOT NULL) / nullif(stddev_samp(b.r) FILTER (a.r IS NOT NULL), 0) AS s FROM x a JOIN x b ON a.d = b.d AND a.ticker <> b.ticker GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(rho) DESC, j) AS n FROM c WHERE rho IS NOT NULL) SELECT i, j AS partner, round(rho, 6) AS rho, round(rho * s, 6) AS beta, CASE WHEN abs(rho) >= 0.95 AND abs(rho * s) >= 1.15 THEN 'scaled' WHEN abs(rho) >= 0.98 AND abs(rho * s - 1) < 0.15 THEN 'duplicate' ELSE 'none' END AS kind FROM k WHERE n = 1""")
def scaled_instruments(spark, sf):
    r = W.returns(spark, sf).where("r is not null").select("ticker", "d", "r")
    x = r.unionByName(r.select(F.concat("ticker", F.lit("-3X")).alias("ticker"), "d", F.round(3 * F.col("r") + 0.0001 * (F.dayofmonth("d") % 5), 9).alias("r")))
    return P.scaled_instruments(x, "ticker", "d", "r").select("i", "partner", *r6("rho", "beta"), "kind")


ETF = f"{W.RETURNS}, et AS (SELECT 'E' || right(ticker, 1) AS etf, d, avg(r) AS f FROM r GROUP BY ALL), er AS (SELECT etf, d, round(f, 9) AS f FROM et)"


def _etfs(spark, sf):
    return W.returns(spark, sf).groupBy(F.concat(F.lit("E"), F.right("ticker", F.lit(1))).alias("etf"), "d").agg(F.round(F.avg("r"), 9).alias("f"))


@query(f"""WITH {ETF}, c AS (SELECT ticker, etf, corr(r, f) AS rho, count(*) AS n FROM r JOIN er USING (d) WHERE r IS NOT NULL AND f IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rho * rho DESC, etf) AS i FROM c WHERE n >= 200)
SELECT ticker AS name, etf, round(rho * rho, 6) AS r2 FROM k WHERE i = 1""")
def sector_etfs(spark, sf):
    r = W.returns(spark, sf).where("r is not null").select(F.col("ticker").alias("name"), "d", "r")
    return P.sector_etf(r, _etfs(spark, sf).where("f is not null"), "d").select("name", "etf", *r6("r2"))


OU = f"""{ETF}, g AS (SELECT ticker, r.d, r, f, year(r.d) AS y FROM r JOIN er ON r.d = er.d AND etf = 'E' || right(ticker, 1) WHERE r IS NOT NULL), h AS (SELECT ticker, y, regr_slope(r, f) AS be, regr_intercept(r, f) AS a FROM g GROUP BY ALL),
e AS (SELECT ticker, y, g.d, round(r - a - be * f, 9) AS e FROM g JOIN h USING (ticker, y)), x AS (SELECT *, sum(e) OVER (PARTITION BY ticker, y ORDER BY d ROWS UNBOUNDED PRECEDING) AS x FROM e), x2 AS (SELECT *, lag(x) OVER (PARTITION BY ticker, y ORDER BY d) AS x0 FROM x),
q AS (SELECT ticker, y, regr_slope(x, x0) AS b, regr_intercept(x, x0) AS a, regr_count(x, x0) AS n, regr_syy(x, x0) AS yy, regr_sxy(x, x0) AS xy, regr_sxx(x, x0) AS xx, arg_max(x, d) AS x_last FROM x2 GROUP BY ALL),
o AS (SELECT *, (yy - b * xy) / greatest(n - 2, 1) AS v, -ln(greatest(1e-9, least(b, 0.999999))) * 52 AS kappa, a / (1 - b) AS m FROM q WHERE xx > 1e-18 AND b > 0 AND b < 1),
ou AS (SELECT *, sqrt(v / (1 - b * b)) AS sigma_eq, sqrt(v * 2 * kappa / (1 - b * b)) AS sigma FROM o WHERE v > 0)"""


@query(f"""WITH {OU} SELECT q.ticker, q.y, round(kappa, 5) AS kappa, round(m, 6) AS m, round(sigma_eq, 6) AS sigma_eq, round(sigma, 5) AS sigma, coalesce(kappa > 52 / 30, false) AS model_ok,
round((ou.x_last - (m - avg(m) OVER (PARTITION BY q.y))) / sigma_eq, 5) AS s FROM q LEFT JOIN ou USING (ticker, y)""")
def ou_scores(spark, sf):
    r = W.returns(spark, sf).where("r is not null").withColumn("etf", F.concat(F.lit("E"), F.right("ticker", F.lit(1)))).join(_etfs(spark, sf), ["etf", "d"]).withColumn("y", F.year("d").cast("long"))
    e = P.etf_residuals(r.select("ticker", "y", "d", "r", "f"), ["ticker", "y"]).withColumn("resid", F.round("resid", 9))
    fit = P.s_score(P.ou_fit(e, ["ticker", "y"], "d", days=52.0), ["y"])
    return fit.select("ticker", "y", *r6("kappa", "sigma", "s", n=5), *r6("m", "sigma_eq"), "model_ok")


@query(f"""WITH {W.Z}, t AS (SELECT t1 AS name, t2 AS etf, beta, CASE WHEN z < -1 THEN 1 WHEN z > 1 THEN -1 ELSE 0 END AS state, d FROM zs WHERE d = (SELECT max(d) FROM zs WHERE z IS NOT NULL)), k AS (SELECT * FROM t WHERE state <> 0)
SELECT name AS leg, round(sum(CAST(state AS DOUBLE)), 6) AS notional FROM k GROUP BY name UNION ALL SELECT 'etf ' || etf, round(sum(-state * beta), 6) FROM k GROUP BY etf""")
def state_positions(spark, sf):
    z = W.zs(spark, sf)
    last = z.where("z is not null").agg(F.max("d").alias("d"))
    t = z.join(F.broadcast(last), "d").select(F.col("t1").alias("name"), F.concat(F.lit("etf "), F.col("t2")).alias("etf"), "beta", F.when(F.col("z") < -1, 1).when(F.col("z") > 1, -1).otherwise(0).alias("state"))
    return P.positions_from_state(t).groupBy("leg").agg(F.round(F.sum("notional"), 6).alias("notional"))


@query(f"""WITH {W.BARS}, f AS (SELECT *, avg(volume) OVER w AS a, count(volume) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT ticker, d, round(CASE WHEN n >= 10 THEN greatest(0, least(10, a / nullif(volume, 0))) END, 9) AS factor FROM f""", dates="d")
def trading_time_factor(spark, sf):
    return P.trading_time(W.bars(spark, sf), ["ticker"], "d").select("ticker", "d", *r6("factor", n=9))


@query(f"""WITH {W.RETURNS}, m AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY d) AS m FROM r WHERE r IS NOT NULL), s AS (SELECT *, 1.4826 * quantile_cont(abs(r - m), 0.5) OVER (PARTITION BY d) AS s FROM m) SELECT ticker, d, round(CASE WHEN s > 1e-9 THEN greatest(-3, least(3, (r - m) / s)) END, 6) AS z FROM s""", dates="d")
def cross_sectional_z(spark, sf):
    return P.cross_z(W.returns(spark, sf).where("r is not null"), ["d"], "r").select("ticker", "d", *r6("z"))


@query(f"""WITH {W.RETURNS}, a AS (SELECT ticker, d, sum(r) OVER w AS mom, lead(r) OVER (PARTITION BY ticker ORDER BY d) AS fwd FROM r WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 3 PRECEDING)), i AS (SELECT d, corr(mom, fwd) AS ic, count(mom * fwd) AS n FROM a GROUP BY d HAVING count(mom * fwd) > 10)
SELECT round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 5) AS t, round(avg(CAST(ic > 0 AS DOUBLE)), 6) AS positive, count(ic) AS days FROM i""")
def information_coefficient(spark, sf):
    w = order("ticker")
    a = W.returns(spark, sf).select("ticker", "d", F.sum("r").over(X.rows(w, 4)).alias("mom"), F.lead("r").over(w).alias("fwd"))
    return P.information(a, "d", "mom", "fwd", 10).select(*r6("mean_ic", "positive"), F.round("t", 5).alias("t"), "days")


@query(f"""WITH {W.DAILY}, r AS (SELECT *, round(ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY d)), 9) AS r FROM bars) SELECT ticker, d, round(CASE WHEN count(r) OVER a >= 21 THEN sum(r) OVER a END, 9) AS mom1m, round(CASE WHEN count(r) OVER b >= 231 THEN sum(r) OVER b END, 9) AS mom12_1,
round(CASE WHEN count(volume) OVER v >= 20 THEN volume / nullif(quantile_cont(volume, 0.5) OVER v, 0) END, 9) AS vol_abn, round(CASE WHEN count(px) OVER y >= 252 THEN px / max(px) OVER y END, 9) AS high52, round(CASE WHEN count(r) OVER a >= 21 THEN max(r) OVER a END, 9) AS max21
FROM r WINDOW a AS (PARTITION BY ticker ORDER BY d ROWS 20 PRECEDING), b AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING), v AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), y AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING)""", dates="d")
def desk_panel(spark, sf):
    w = order("ticker")
    b = W.bars(spark, sf, "day").withColumn("r", F.round(X.logret("px", w), 9)).withColumnRenamed("px", "close")
    return P.desk_panel(b, ["ticker"], "d").select("ticker", "d", *r6("mom1m", "mom12_1", "vol_abn", "high52", "max21", n=9))


@query(f"""WITH {W.RETURNS}, y AS (SELECT ticker, year(d) AS y, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM r GROUP BY ALL) SELECT ticker, round(sum(s) / sum(n) / sqrt(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2) * sqrt(252), 6) AS sharpe FROM y GROUP BY ticker""")
def pooled_sharpe(spark, sf):
    y = W.returns(spark, sf).groupBy("ticker", F.year("d")).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    return y.groupBy("ticker").agg(F.round(V.pooled_sharpe(), 6).alias("sharpe"))


@query(f"""WITH {W.RETURNS} SELECT ticker, year(d) AS y, round(sum(r), 6) AS r, round(avg(r) / nullif(stddev_samp(r), 0), 6) AS snr, round(quantile_cont(r, 0.05), 6) AS var5, count(r) AS n FROM r GROUP BY ALL""")
def yearly_risk(spark, sf):
    g = W.returns(spark, sf).groupBy("ticker", F.year("d").cast("long").alias("y"))
    return g.agg(F.round(F.sum("r"), 6).alias("r"), F.round(X.ratio(F.avg("r"), F.stddev_samp("r")), 6).alias("snr"), F.round(F.percentile("r", F.lit(0.05)), 6).alias("var5"), F.count("r").alias("n"))


# ------------------------------------------------------------------ testing, folds, joins


@query(f"""WITH {W.RETURNS}, p AS (SELECT ticker, year(d) AS formation, round(exp(-abs(avg(r) / stddev_samp(r) * sqrt(count(r)))), 9) AS p FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY formation ORDER BY p, ticker) AS i, count(*) OVER (PARTITION BY formation) AS n FROM p),
a AS (SELECT *, least(min(p * n / i) OVER (PARTITION BY formation ORDER BY p, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q, least(max(p * (n - i + 1)) OVER (PARTITION BY formation ORDER BY p, ticker ROWS UNBOUNDED PRECEDING), 1) AS h FROM k)
SELECT ticker, formation, p, round(q, 9) AS p_adj, q <= 0.3 AS reject, round(h, 9) AS p_holm FROM a""")
def multiple_testing(spark, sf):
    t = F.abs(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.count("r")))
    p = W.returns(spark, sf).groupBy("ticker", F.year("d").cast("long").alias("formation")).agg(F.round(F.exp(-t), 9).alias("p"))
    return S.holm(S.benjamini_hochberg(p, alpha=0.3, group=["formation"]).withColumn("q", F.col("p_adj")).drop("p_adj"), group=["formation"]).select("ticker", "formation", "p", F.round("q", 9).alias("p_adj"), "reject", F.round("p_holm", 9).alias("p_holm"))


@query(f"""WITH {W.RETURNS}, p AS (SELECT year(d) AS formation, exp(-abs(avg(r) / stddev_samp(r) * sqrt(count(r)))) AS p FROM r GROUP BY ticker, year(d)) SELECT formation, round(count(*) FILTER (p > 0.5) / (count(p) * 0.5), 6) AS pi0, count(p) AS n FROM p GROUP BY formation""")
def storey_share(spark, sf):
    t = F.abs(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.count("r")))
    p = W.returns(spark, sf).groupBy("ticker", F.year("d").cast("long").alias("formation")).agg(F.exp(-t).alias("p"))
    return p.groupBy("formation").agg(F.round(S.storey_pi0(), 6).alias("pi0"), F.count("p").alias("n"))


@query(f"""WITH {W.BARS}, i AS (SELECT ticker, d, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars), f AS (SELECT unnest(range(0, 40)) AS fold),
x AS (SELECT ticker, fold, d, i >= fold * 26 + 104 AS test FROM i, f WHERE i >= fold * 26 AND i < fold * 26 + 130 AND least(fold * 26 + 130, n) - fold * 26 - 104 >= 13)
SELECT ticker, fold, count(*) FILTER (NOT test) AS train, count(*) FILTER (test) AS test, min(d) FILTER (test) AS test_from, max(d) AS test_to FROM x GROUP BY ALL""", dates="test_from test_to")
def walk_forward_folds(spark, sf):
    x = V.walk_forward_folds(W.bars(spark, sf), ["ticker"], "d", 104, 26, least=13)
    test = F.col("role") == "test"
    return x.groupBy("ticker", F.col("fold").cast("long").alias("fold")).agg(F.count_if(~test).alias("train"), F.count_if(test).alias("test"), F.min(F.when(test, F.col("d"))).alias("test_from"), F.max("d").alias("test_to"))


@query(f"""WITH {W.BARS}, i AS (SELECT ticker, d, px, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS i FROM bars), m AS (SELECT ticker, i // 52 AS fold, max(px) - min(px) AS range_, avg(px) AS level FROM i GROUP BY ALL), u AS (UNPIVOT m ON range_, level INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM u GROUP BY metric""")
def fold_summary(spark, sf):
    i = W.bars(spark, sf).withColumn("i", F.row_number().over(order("ticker")) - 1)
    m = i.groupBy("ticker", F.floor(F.col("i") / 52)).agg((F.max("px") - F.min("px")).alias("range_"), F.avg("px").alias("level"))
    return V.summarize_folds(m, ["range_", "level"]).select("metric", *r6("mean", "std", "median", "min", "max"), "n")


@query(f"""WITH {W.BARS}, q AS (SELECT ticker, d AS since, round(avg(px) OVER (PARTITION BY ticker ORDER BY d ROWS 12 PRECEDING), 6) AS level, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM bars), q1 AS (SELECT * FROM q WHERE i % 13 = 0)
SELECT bars.ticker, bars.d, bars.px, q1.level FROM bars ASOF LEFT JOIN q1 ON bars.ticker = q1.ticker AND bars.d >= q1.since""", dates="d")
def as_of_level(spark, sf):
    w = order("ticker")
    b = W.bars(spark, sf).select("ticker", "d", "px")
    q = b.withColumns({"level": F.round(F.avg("px").over(X.rows(w, 13)), 6), "i": F.row_number().over(w)}).where("i % 13 = 0")
    return V.as_of(b, q, ["ticker"], "d", ["level"])


@query(f"""WITH {W.BARS}, s AS (SELECT DISTINCT d FROM bars), lo AS (SELECT min(d) AS lo, max(d) AS hi FROM s), a AS (SELECT CAST(unnest(generate_series(make_date(CAST(year(lo) AS INTEGER), 6, 30), hi, interval 6 months)) AS DATE) AS anchor, lo FROM lo), f AS (SELECT anchor, max(d) AS formation, any_value(lo) AS lo FROM a JOIN s ON d <= anchor GROUP BY anchor),
g AS (SELECT DISTINCT formation FROM f WHERE formation - interval 24 months >= lo), w AS (SELECT formation, CAST(formation - interval 24 months AS DATE) AS form_lo, coalesce(lead(formation) OVER (ORDER BY formation), CAST(formation + interval 6 months AS DATE)) AS trade_hi FROM g)
SELECT formation, count(*) FILTER (d <= formation) AS form_rows, count(*) FILTER (d > formation) AS trade_rows, round(sum(px), 3) AS px FROM w JOIN bars ON d > form_lo AND d <= trade_hi GROUP BY formation""", dates="formation")
def formation_windows(spark, sf):
    b = W.bars(spark, sf)
    f = V.formations(b.select("d").distinct(), "d")
    x = V.in_window(b, f, "d", "form_lo", "trade_hi")
    return x.groupBy("formation").agg(F.count_if(F.col("d") <= F.col("formation")).alias("form_rows"), F.count_if(F.col("d") > F.col("formation")).alias("trade_rows"), F.round(F.sum("px"), 3).alias("px"))


@query(f"""WITH {W.BARS}, n AS (SELECT ticker, d, px / first_value(px) OVER (PARTITION BY ticker ORDER BY d) AS n FROM bars), s AS (SELECT a.ticker AS t1, b.ticker AS t2, sum((a.n - b.n) ** 2) AS ssd FROM n a JOIN n b ON a.d = b.d AND a.ticker < b.ticker GROUP BY ALL) SELECT t1, t2, round(ssd, 6) AS ssd FROM s ORDER BY ssd, t1, t2 LIMIT 20""")
def distance_pairs(spark, sf):
    w = order("ticker")
    n = W.bars(spark, sf).select("ticker", "d", (F.col("px") / F.first("px").over(w)).alias("n"))
    s = S.pair_series(n, "n").groupBy(*PAIR).agg(F.sum(F.pow(F.col("P1") - F.col("P2"), 2)).alias("ssd"))
    return s.orderBy("ssd", *PAIR).limit(20).select(*PAIR, *r6("ssd"))


@query(f"""WITH {W.BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY year(d) ORDER BY dollar_volume DESC, ticker, d) AS rank FROM bars) SELECT year(d) AS y, rank, ticker, d, dollar_volume FROM k WHERE rank <= 5""", dates="d")
def top_by_year(spark, sf):
    b = W.bars(spark, sf).withColumn("y", F.year("d").cast("long"))
    return V.top_by(b, ["y"], [F.desc("dollar_volume"), "ticker", "d"], 5).select("y", F.col("rank").cast("long").alias("rank"), "ticker", "d", "dollar_volume")


@query(f"""WITH {W.BARS}, c AS (SELECT year(d) AS formation, ticker, round(avg(volume) / 10, 4) AS bps FROM bars GROUP BY ALL HAVING count(*) >= 52), t AS (SELECT DISTINCT ticker FROM bars), y AS (SELECT DISTINCT year(d) AS y FROM bars UNION SELECT max(year(d)) + 1 FROM bars), p AS (SELECT a.ticker AS t1, b.ticker AS t2, y AS formation FROM t a JOIN t b ON a.ticker < b.ticker, y)
SELECT p.formation, p.t1, p.t2, round(CASE WHEN x.bps IS NOT NULL AND z.bps IS NOT NULL THEN (2 * x.bps + z.bps) / 3 ELSE coalesce(x.bps, z.bps, 5) END, 5) AS bps FROM p LEFT JOIN c x ON x.formation = p.formation AND x.ticker = p.t1 LEFT JOIN c z ON z.formation = p.formation AND z.ticker = p.t2""")
def pair_fold_costs(spark, sf):
    b = W.bars(spark, sf)
    c = b.groupBy(F.year("d").cast("long").alias("formation"), "ticker").agg(F.round(F.avg("volume") / 10, 4).alias("bps"), F.count("*").alias("bars")).where("bars >= 52").drop("bars")
    t = b.select("ticker").distinct()
    years = b.select(F.year("d").cast("long").alias("formation")).distinct()
    years = years.unionByName(years.agg((F.max("formation") + 1).alias("formation")))  # the last one has no measured costs
    p = t.select(F.col("ticker").alias("t1")).join(t.select(F.col("ticker").alias("t2")), F.col("t1") < F.col("t2")).crossJoin(years).withColumns({"w1": F.lit(2.0), "w2": F.lit(1.0)})
    return P.pair_costs(p, c, 5.0).select("formation", *PAIR, F.round("bps", 5).alias("bps"))


@query(f"""WITH {W.DAILY}, e AS (SELECT min(d) AS lo, max(d) AS hi FROM bars), f AS (SELECT ticker FROM bars GROUP BY ticker HAVING min(d) = (SELECT lo FROM e) AND max(d) = (SELECT hi FROM e)), n AS (SELECT count(DISTINCT d) AS n FROM bars), c AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(px) = (SELECT n FROM n))
SELECT ticker, ticker IN (SELECT ticker FROM f) AS spans, ticker IN (SELECT ticker FROM c) AS complete, count(*) FILTER (d <= DATE '1995-06-30') AS train, count(*) FILTER (d > DATE '1995-06-30' AND d <= DATE '1996-12-31') AS val, count(*) FILTER (d > DATE '1996-12-31') AS test FROM bars GROUP BY ticker""")
def coverage_and_splits(spark, sf):
    b = W.bars(spark, sf, "day")
    s = V.split_by_date(b, "d", "1995-06-30", "1996-12-31").groupBy("ticker").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("train", "val", "test")))
    flag = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    out = s.join(flag(V.full_span(b, "ticker", "d"), "spans"), "ticker", "left").join(flag(V.complete(b, "ticker", "d", "px"), "complete"), "ticker", "left")
    return out.select("ticker", F.coalesce("spans", F.lit(False)).alias("spans"), F.coalesce("complete", F.lit(False)).alias("complete"), "train", "val", "test")


# ------------------------------------------------------------------ kernels: no SQL form, tested against slow versions


def _monthly(spark, sf):
    return W.bars(spark, sf).select("ticker", "d", "px")


@query(dates="")
def dual_gate_screen(spark, sf):
    out = M.screen(_monthly(spark, sf))
    return out.select(*PAIR, *r6("eg_t", "eg_p", "eg_p_fdr", "joh_stat", n=5), "eg_pass", "joh_pass", "verdict")


@query()
def spread_stationarity(spark, sf):
    out = M.stationarity(W.resid(spark, sf).select(*PAIR, "d", "resid"), PAIR, "d")
    return out.select(*PAIR, *r6("adf_stat", "adf_p", "kpss_stat", "kpss_p", n=5), "verdict")


KALMAN = f"""{W.PAIRS}, ki AS (SELECT *, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM pairs),
k0 AS (SELECT *, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS a, CAST(1e6 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS c, CAST(1e6 AS DOUBLE) AS q FROM ki WHERE i = 1),
kf AS (
  SELECT t1, t2, i, d, P1 AS y, P2 AS x, b + u / s * e AS b, a + v / s * e AS a, p - u / s * u AS p, c - u / s * v AS c, q - v / s * v AS q
  FROM (SELECT *, P2 * u + v + 1.0 AS s, P1 - (P2 * b + a) AS e FROM (SELECT *, p * P2 + c AS u, c * P2 + q AS v FROM k0))
  UNION ALL
  SELECT t1, t2, i, d, y, x, b + u / s * e, a + v / s * e, p - u / s * u, c - u / s * v, q - v / s * v
  FROM (SELECT *, x * u + v + 1.0 AS s, y - (x * b + a) AS e FROM (SELECT *, p * x + c AS u, c * x + q AS v
    FROM (SELECT ki.t1, ki.t2, ki.i, ki.d, ki.P1 AS y, ki.P2 AS x, kf.b, kf.a, kf.p + CAST(1e-4 AS DOUBLE) AS p, kf.c, kf.q + CAST(1e-4 AS DOUBLE) AS q FROM kf JOIN ki ON ki.t1 = kf.t1 AND ki.t2 = kf.t2 AND ki.i = kf.i + 1))))"""
KALMAN_OUT = "SELECT t1, t2, d, round(a, 4) AS alpha, round(b, 4) AS beta, round(y - (a + b * x), 4) AS resid FROM kf"


@query(f"WITH RECURSIVE {KALMAN} {KALMAN_OUT}", dates="d")
def kalman_hedges(spark, sf):
    p = W.pairs(spark, sf)
    return M.fit_kalman(p, PAIR, "d", 1e-4, 1.0).select(*PAIR, "d", *r6("alpha", "beta", "resid", n=4))


@query(f"WITH RECURSIVE {KALMAN} {KALMAN_OUT} WHERE d >= DATE '1998-01-01' AND (t1, t2) IN (SELECT (t1, t2) FROM ki WHERE i = 5 AND d < DATE '1998-01-01')", dates="d")
def kalman_continued(spark, sf):
    p = W.pairs(spark, sf)
    first = M.fit_kalman(p.where("d < '1998-01-01'"), PAIR, "d", 1e-4, 1.0)
    return M.continue_kalman(p.where("d >= '1998-01-01'"), first, PAIR, "d").select(*PAIR, "d", *r6("alpha", "beta", "resid", n=4))


@query()
def hedge_gate(spark, sf):
    """The twenty pairs of the rule that takes the least raw p among those that pass both tests (by month), each with 199 draws for each test."""
    b = W.bars(spark, sf, "month").select("ticker", "d", "px")
    rule = M.screen(b).where("eg_p <= 0.05 and joh_pass").orderBy("eg_p", *PAIR).limit(20).select(*PAIR)
    p = S.pair_series(b, pairs=rule)
    return M.hedge_gate(p, PAIR, "d")


def _similarity(spark, sf):
    r = W.returns(spark, sf).withColumn("y", F.year("d").cast("long"))
    a, b = r.select("y", "d", F.col("ticker").alias("i"), F.col("r").alias("a")), r.select("y", "d", F.col("ticker").alias("j"), F.col("r").alias("b"))
    return a.join(b, ["y", "d"]).where("i < j").groupBy("y", "i", "j").agg(F.round(1 + F.corr("a", "b"), 9).alias("w"))


@query()
def triangulated_graphs(spark, sf):
    return N.filtered_graphs(_similarity(spark, sf), "y")


@query()
def planar_graphs(spark, sf):
    return N.filtered_graphs(_similarity(spark, sf), "y", "pmfg")


@query()
def node_roles(spark, sf):
    g = N.filtered_graphs(_similarity(spark, sf), "y").withColumnRenamed("y", "year")
    return N.node_roles(g, "year").select("year", "node", *r6("X", "Y", "XY"), "role")


@query()
def eigenportfolios(spark, sf):
    r = W.returns(spark, sf).where("r is not null").withColumn("y", F.year("d").cast("long"))
    return P.eigenportfolios_by(r, "y", "ticker", "d", "r", 3).select("y", "factor", "name", *r6("weight", "eigenvalue"))


@query()
def risk_parity(spark, sf):
    r = W.returns(spark, sf).withColumn("y", F.year("d").cast("long"))
    a, b = r.select("y", "d", F.col("ticker").alias("i"), F.col("r").alias("a")), r.select("y", "d", F.col("ticker").alias("j"), F.col("r").alias("b"))
    cov = a.join(b, ["y", "d"]).groupBy("y", "i", "j").agg(F.covar_samp("a", "b").alias("cov"))
    return P.risk_parity_by(cov.withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov") * 1.5).otherwise(F.col("cov"))), "y").select("y", "i", *r6("weight"))


ADJUSTED = f"""{W.RETURNS}, nx AS (SELECT ticker, d, r, lead(r) OVER (PARTITION BY ticker ORDER BY d) AS fwd FROM r), tg AS (SELECT year(d) AS y, d, ticker, -r / sum(abs(r)) OVER (PARTITION BY d) AS t, coalesce(fwd, 0) AS r FROM nx WHERE r IS NOT NULL),
cells AS (SELECT a.y, a.d, b.ticker, coalesce(t, 0) AS t, coalesce(r, 0) AS r FROM (SELECT DISTINCT y, d FROM tg) a JOIN (SELECT DISTINCT y, ticker FROM tg) b USING (y) LEFT JOIN tg ON tg.d = a.d AND tg.ticker = b.ticker),
days AS (SELECT y, d, list(t ORDER BY ticker) AS t, list(r ORDER BY ticker) AS r, row_number() OVER (PARTITION BY y ORDER BY d) AS i FROM cells GROUP BY y, d)"""


@query(f"""WITH RECURSIVE {ADJUSTED}, bk AS (SELECT y, CAST(0 AS BIGINT) AS i, list_transform(t, lambda a: CAST(0 AS DOUBLE)) AS w, CAST(0 AS DOUBLE) AS gross, CAST(0 AS DOUBLE) AS turnover, CAST(0 AS DOUBLE) AS pnl FROM days WHERE i = 1
  UNION ALL SELECT y, i, w, list_sum(list_transform(w, lambda a: abs(a))), moved, list_dot_product(w, r) - moved * 5 / 1e4
  FROM (SELECT *, list_sum(list_transform(list_zip(w, w0), lambda a: abs(a[1] - a[2]))) AS moved FROM (SELECT y, i, r, w0, list_transform(v, lambda a: CASE WHEN g > 1e-12 THEN a * (h / g) ELSE a END) AS w
    FROM (SELECT *, list_sum(list_transform(v, lambda a: abs(a))) AS g, list_sum(list_transform(t, lambda a: abs(a))) AS h
      FROM (SELECT days.y, days.i, days.t, days.r, bk.w AS w0, list_transform(list_zip(bk.w, days.t), lambda a: a[1] + 0.3 * (a[2] - a[1])) AS v FROM bk JOIN days ON days.y = bk.y AND days.i = bk.i + 1)))))
SELECT y, d, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(pnl, 6) AS pnl FROM bk JOIN days USING (y, i)""", dates="d")
def partial_adjustment(spark, sf):
    w = order("ticker")
    r = W.returns(spark, sf).withColumn("y", F.year("d").cast("long")).withColumns({"target": -F.col("r"), "next": F.lead("r").over(w)})
    gross = Window.partitionBy("d")
    t = r.where("r is not null").select("y", "d", F.col("ticker").alias("name"), (F.col("target") / F.sum(F.abs("target")).over(gross)).alias("target"), F.coalesce("next", F.lit(0.0)).alias("r"))
    return P.partial_adjustment(t, "y", "d", 0.3, 5.0).select("y", "d", *r6("gross", "turnover", "pnl"))


EWM = f"""{W.RESID}, ei AS (SELECT t1, t2, d, resid AS x, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM resid), al AS (SELECT 1 - exp(-ln(2) / 10) AS al),
ew AS (SELECT t1, t2, i, d, x, x AS m, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS w2 FROM ei WHERE i = 1
  UNION ALL SELECT t1, t2, i, d, x, m, (1 - al) * (v + (m0 - m) * (m0 - m)) + al * (x - m) * (x - m), w2 * (1 - al) * (1 - al) + al * al
  FROM (SELECT ei.t1, ei.t2, ei.i, ei.d, ei.x, ew.m AS m0, (1 - al) * ew.m + al * ei.x AS m, ew.v, ew.w2, al FROM ew JOIN ei ON ei.t1 = ew.t1 AND ei.t2 = ew.t2 AND ei.i = ew.i + 1, al))"""


@query(f"WITH RECURSIVE {EWM} SELECT t1, t2, d, round(CASE WHEN w2 < 1 AND v > 0 THEN (x - m) / sqrt(v / (1 - w2)) END, 6) AS z FROM ew", dates="d")
def ewm_z(spark, sf):
    e = W.resid(spark, sf).select(*PAIR, "d", "resid")
    return G.z_by_pair(e, PAIR, "d", "resid", method="ewm").select(*PAIR, "d", *r6("z"))


HALF = """{src}, hx AS (SELECT t1, t2, resid, lag(resid) OVER (PARTITION BY t1, t2 ORDER BY d) AS x0 FROM {of}), hh AS (SELECT t1, t2, regr_slope(resid, x0) AS b, count(resid) AS c FROM hx GROUP BY ALL),
hn AS (SELECT t1, t2, CASE WHEN c >= 20 AND b > 0 AND b < 1 THEN CAST(floor(least(greatest(3 * -ln(2) / ln(b), 30), 252)) AS INTEGER) ELSE 30 END AS n FROM hh)"""
OWN_Z = "SELECT t1, t2, d, n, round(CASE WHEN c >= n AND sd > 0 THEN (resid - m) / sd END, 5) AS z FROM (SELECT r.t1, r.t2, r.d, resid, n, avg(resid) OVER w AS m, stddev_pop(resid) OVER w AS sd, count(resid) OVER w AS c FROM resid r JOIN hn USING (t1, t2) WINDOW w AS (PARTITION BY r.t1, r.t2 ORDER BY r.d ROWS BETWEEN (n - 1) PRECEDING AND CURRENT ROW))"


@query(f"WITH {HALF.format(src=W.RESID, of='resid')} {OWN_Z}", dates="d")
def half_life_window_z(spark, sf):
    e = W.resid(spark, sf).select(*PAIR, "d", "resid")
    n = S.half_life(e, "resid", PAIR, "d").select(*PAIR, S.half_life_window(F.col("half_life")).alias("n"))
    return G.z_by_pair(e.join(n, PAIR), PAIR, "d", "resid", window="n").select(*PAIR, "d", "n", *r6("z", n=5))


@query(f"WITH {HALF.format(src=W.RESID + ", old AS (SELECT * FROM resid WHERE d < DATE '1997-01-01')", of='old')} SELECT t1, t2, d, z FROM ({OWN_Z}) WHERE d >= DATE '1997-01-01'", dates="d")
def history_z(spark, sf):
    """Later bars scored with a look-back that the earlier ones chose, and warmed up by them."""
    e = W.resid(spark, sf).select(*PAIR, "d", "resid")
    new, old = e.where("d >= '1997-01-01'"), e.where("d < '1997-01-01'")
    return G.z_from_spread(new, PAIR, "d", "resid", history=old).select(*PAIR, "d", *r6("z", n=5))


@query(f"""WITH {W.Z}, i AS (SELECT t1, t2, d, resid, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY t1, t2) AS n FROM zs), f AS (SELECT CAST(unnest(range(0, 60)) AS INTEGER) AS fold),
x AS (SELECT t1, t2, fold, d, resid, i >= fold * 52 + 104 AS test FROM i, f WHERE i >= fold * 52 AND i < fold * 52 + 156 AND least(fold * 52 + 156, n) - fold * 52 - 104 >= 1),
p AS (SELECT t1, t2, fold, avg(resid) AS m, stddev_pop(resid) AS sd FROM x WHERE NOT test GROUP BY ALL), s AS (SELECT x.*, -greatest(-2, least(2, (resid - m) / sd)) AS s FROM x JOIN p USING (t1, t2, fold) WHERE test),
g AS (SELECT *, coalesce(lag(s) OVER w, 0) * coalesce(resid - lag(resid) OVER w, 0) AS pnl FROM s WINDOW w AS (PARTITION BY t1, t2, fold ORDER BY d))
SELECT t1, t2, fold, round(sum(pnl), 4) AS pnl, count(*) AS bars, CAST(NULL AS VARCHAR) AS err FROM g GROUP BY t1, t2, fold""")
def walk_forward_backtest(spark, sf):
    z = W.zs(spark, sf).select(*PAIR, "d", "resid", "P1", "P2", "beta")
    x = V.walk_forward_folds(z, PAIR, "d", 104, 52)

    def fit(train):
        return train["resid"].mean(), train["resid"].std(ddof=0)

    def signal(test, fitted):
        return -((test["resid"] - fitted[0]) / fitted[1]).clip(-2, 2)

    def evaluate(test, s):
        test, s = test.sort_values("d"), s.reindex(test.sort_values("d").index)
        pnl = s.shift(1).fillna(0) * test["resid"].diff().fillna(0)
        return {"pnl": round(float(pnl.sum()), 4), "bars": len(test)}

    return V.walk_forward(x, PAIR, fit, signal, evaluate, "pnl double, bars long")


STITCHED = f"""{W.Z}, s AS (SELECT t1, t2, d, P1, P2, beta, z, z IS NULL AS bad, year(d) AS fold, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM zs),
st AS (
  SELECT t1, t2, i, fold, pos, abs(pos) AS hold, 0 AS cool, CAST(pos * 10000.0 / (P1 + abs(beta) * P2) AS DOUBLE) AS n1, beta, 0 AS xpos, CAST(0 AS DOUBLE) AS xn1, CAST(0 AS DOUBLE) AS xn2
  FROM (SELECT *, CASE WHEN bad THEN 0 WHEN z <= -1.5 AND z > -4 THEN 1 WHEN z >= 1.5 AND z < 4 THEN -1 ELSE 0 END AS pos FROM s WHERE i = 1)
  UNION ALL
  SELECT t1, t2, i, fold, pos, CASE WHEN pos = 0 THEN 0 WHEN was = 0 THEN 1 ELSE h + 1 END, CASE WHEN NOT bad AND pos = 0 AND was <> 0 THEN 2 ELSE c END,
    CASE WHEN pos <> 0 THEN pos * 10000.0 / (P1 + abs(beta) * P2) ELSE 0 END, beta, xpos, xn1, xn2
  FROM (SELECT *, CASE WHEN bad THEN 0
      WHEN was = 0 AND c = 0 AND z <= -1.5 AND z > -4 THEN 1 WHEN was = 0 AND c = 0 AND z >= 1.5 AND z < 4 THEN -1 WHEN was = 0 THEN 0
      WHEN abs(z) <= 0.5 THEN 0 WHEN was = 1 AND z <= -4 THEN 0 WHEN was = -1 AND z >= 4 THEN 0 WHEN h + 1 >= 12 THEN 0 ELSE was END AS pos
    FROM (SELECT *, CASE WHEN bad THEN c0 ELSE greatest(c0 - 1, 0) END AS c
      FROM (SELECT s.*, CASE WHEN s.fold <> st.fold THEN st.xpos ELSE st.pos END AS was, CASE WHEN s.fold <> st.fold THEN 0 ELSE st.hold END AS h, CASE WHEN s.fold <> st.fold THEN 0 ELSE st.cool END AS c0,
          CASE WHEN s.fold <> st.fold THEN st.xpos ELSE st.pos END AS xpos, CASE WHEN s.fold <> st.fold THEN st.xn1 ELSE st.n1 END AS xn1, CASE WHEN s.fold <> st.fold THEN st.xn2 ELSE -st.beta * st.n1 END AS xn2
        FROM st JOIN s ON s.t1 = st.t1 AND s.t2 = st.t2 AND s.i = st.i + 1))))"""


@query(f"WITH RECURSIVE {STITCHED} SELECT t1, t2, st.fold, d, xpos AS pos, round(xn1, 6) AS n1, round(xn2, 6) AS n2 FROM st JOIN s USING (t1, t2, i)", dates="d")
def stitched_signals(spark, sf):
    z = W.zs(spark, sf).withColumn("fold", F.year("d").cast("long"))
    return G.stitched(z, PAIR, RULE, "d").select(*PAIR, "fold", "d", "pos", *r6("n1", "n2"))


# ------------------------------------------------------------------ studies


@query(f"""WITH {W.RETURNS}, v AS (SELECT year(d) AS y, ticker, var_samp(r) AS v FROM r GROUP BY ALL), s AS (SELECT *, v / sum(v) OVER (PARTITION BY y) AS s FROM v WHERE v IS NOT NULL)
SELECT y, ticker, round(s, 8) AS share, round(1 / sum(s * s) OVER (PARTITION BY y), 6) AS effective FROM s""")
def variance_shares(spark, sf):
    r = W.returns(spark, sf).withColumn("y", F.year("d").cast("long"))
    return Y.variance_share(r, ["y"], "ticker", "r").select("y", "ticker", F.round("share", 8).alias("share"), *r6("effective"))


@query(f"""WITH {W.RETURNS}, c AS (SELECT a.ticker AS t1, b.ticker AS t2 FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker GROUP BY ALL HAVING round(corr(a.r, b.r), 6) > 0.03), e AS (SELECT t1 AS ticker FROM c UNION ALL SELECT t2 FROM c) SELECT ticker, count(*) AS degree FROM e GROUP BY ticker""")
def hub_degrees(spark, sf):
    c = P.pairwise_correlation(W.returns(spark, sf), "ticker", "d", "r").where(F.round("corr", 6) > 0.03)
    return Y.hubs(c.select(F.col("i").alias("t1"), F.col("j").alias("t2")))


@query(f"""WITH {TICK}, a AS (SELECT *, px - lag(px) OVER w AS d FROM sk WHERE k = 1 WINDOW w AS (PARTITION BY ticker, session ORDER BY ts)), b AS (SELECT *, lag(d) OVER (PARTITION BY ticker, session ORDER BY ts) AS d0 FROM a),
c AS (SELECT ticker, covar_pop(d, d0) AS c, count(d * d0) AS n, avg(px) AS m FROM b GROUP BY ticker) SELECT ticker, round(CASE WHEN n >= 30 AND c < 0 THEN 2 * sqrt(-c) / m * 1e4 END, 3) AS roll FROM c""")
def merged_roll_statistics(spark, sf):
    s = Y.roll_statistics(_ticks(spark, sf), ["ticker"], "session", "ts")
    return s.groupBy("ticker").agg(F.round(Y.roll_from_statistics(), 3).alias("roll"))


@query(f"""WITH {TICK}, w AS (SELECT ticker, TIMESTAMP '2023-12-31 23:59:59' + to_days(CAST(7 * k AS INTEGER)) AS lo, TIMESTAMP '2023-12-31 23:59:59' + to_days(CAST(7 * k + 7 AS INTEGER)) AS hi FROM (SELECT DISTINCT ticker FROM tk), (SELECT unnest(range(0, 6)) AS k)),
i AS (SELECT w.ticker, lo, hi, session, ts, px, px - lag(px) OVER (PARTITION BY w.ticker, lo, session ORDER BY ts) AS d FROM w JOIN tk ON tk.ticker = w.ticker AND ts > lo AND ts <= hi), i2 AS (SELECT *, lag(d) OVER (PARTITION BY ticker, lo, session ORDER BY ts) AS d0 FROM i),
g AS (SELECT ticker, lo, covar_pop(d, d0) AS c, count(d * d0) AS n, avg(px) AS m, median(px) AS md FROM i2 GROUP BY ALL)
SELECT w.ticker, CAST(w.lo AS DATE) AS lo, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) >= 30 THEN greatest(-sign(c) * sqrt(abs(c)) / m * 1e4, 0.005 / md * 1e4) END, 3) AS bps, CASE WHEN coalesce(n, 0) < 30 THEN 'too few bars' END AS err FROM w LEFT JOIN g ON g.ticker = w.ticker AND g.lo = w.lo""", dates="lo")
def measured_window_costs(spark, sf):
    t = _ticks(spark, sf)
    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")
    at = lambda c: F.expr(f"timestamp_ntz '2023-12-31 23:59:59' + make_dt_interval(7 * ({c}))")
    w = t.select("ticker").distinct().select("ticker", k).select("ticker", at("k").alias("lo"), at("k + 1").alias("hi"))
    return Y.window_costs(w, t, ts="ts").select("ticker", F.to_date("lo").alias("lo"), "n", F.round("bps", 3).alias("bps"), "err")


@query(f"""WITH {W.TICKS}, p AS (SELECT ticker, ts, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts, event_id) AS pnl, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM ticks)
SELECT ticker, CASE WHEN i = 1 THEN 'overnight' ELSE 'slot ' || CAST(CAST(floor((hour(ts) * 60 + minute(ts) - 570) / 30) AS INTEGER) AS VARCHAR) END AS part, round(coalesce(sum(pnl), 0), 4) AS pnl, count(*) AS bars FROM p GROUP BY ALL""")
def intraday_attribution(spark, sf):
    t = W.ticks(spark, sf)
    t = t.withColumn("pnl", F.col("close") - F.lag("close").over(Window.partitionBy("ticker").orderBy("ingest")))
    return Y.attribution(t, ["ticker"], "ts", "pnl", "ingest").select("ticker", "part", F.round("pnl", 4).alias("pnl"), "bars")


@query(f"""WITH {W.BARS}, x AS (SELECT ticker, d, px / lag(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM bars), m AS (SELECT DISTINCT ticker, CASE WHEN ticker < 'Brand#2' THEN DATE '1994-01-01' ELSE DATE '1997-06-30' END AS lo, DATE '2001-06-30' AS hi FROM bars),
c AS (SELECT d, avg(r) AS r FROM x JOIN m USING (ticker) WHERE d > lo AND d <= hi GROUP BY d HAVING avg(r) IS NOT NULL), e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS e FROM c), f AS (SELECT *, e / max(e) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT round(arg_max(e, d) ** (52.0 / count(*)) - 1, 6) AS cagr, round(stddev_samp(r) * sqrt(52), 6) AS vol, round(avg(r) / stddev_samp(r) * sqrt(52), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, count(*) AS n FROM f""")
def equal_weight_curve(spark, sf):
    b = W.bars(spark, sf).withColumn("r", X.pct("px", order("ticker")))
    m = b.select("ticker", F.when(F.col("ticker") < "Brand#2", "1994-01-01").otherwise("1997-06-30").cast("date").alias("lo"), F.lit("2001-06-30").cast("date").alias("hi")).distinct()
    return Y.equal_weight_curve(b, m, "d", "r", 52.0).select(*r6("cagr", "vol", "sharpe", "max_drawdown"), "n")


@query(f"""WITH {W.Z}, x AS (SELECT t1, t2, d, z, lead(resid) OVER w - resid AS r FROM zs WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)), g AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS config, unnest([1.0, 1.5, 2.0]) AS e), p AS (SELECT t1, t2, config, d < DATE '1998-06-01' AS tune, CASE WHEN z > e THEN -r WHEN z < -e THEN r END AS p FROM x, g),
s AS (SELECT t1, t2, config, tune, count(p) AS n, avg(p) / nullif(stddev_samp(p), 0) AS s FROM p GROUP BY ALL), b AS (SELECT t1, t2, config, row_number() OVER (PARTITION BY t1, t2 ORDER BY s DESC, config) AS i FROM s WHERE tune AND s IS NOT NULL)
SELECT b.t1, b.t2, b.config, s.n, round(s.s, 6) AS sharpe FROM b LEFT JOIN s ON s.t1 = b.t1 AND s.t2 = b.t2 AND s.config = b.config AND NOT s.tune WHERE i = 1""")
def tuned_thresholds(spark, sf):
    z = W.zs(spark, sf).withColumn("r", F.lead("resid").over(order(*PAIR)) - F.col("resid")).select(*PAIR, "d", "z", "r")
    grid = Y.config_grid(spark, z_entry=[1.0, 1.5, 2.0])
    early = F.col("d") < F.lit("1998-06-01").cast("date")
    out = Y.tuned(Y.threshold_grid(z.where(early), grid, PAIR, "d"), Y.threshold_grid(z.where(~early), grid, PAIR, "d"), PAIR)
    return out.select(*PAIR, "config", "n", *r6("sharpe"))


@query(f"""WITH {W.RETURNS}, g AS (SELECT 'calm' AS name, DATE '1995-01-01' AS lo, DATE '1997-12-31' AS hi UNION ALL SELECT 'wild', DATE '1997-12-31', DATE '2000-06-30') SELECT ticker, name, count(r) AS n, round(stddev_samp(r), 8) AS vol FROM r LEFT JOIN g ON d > lo AND d <= hi GROUP BY ALL""")
def regime_slices(spark, sf):
    g = spark.createDataFrame([("calm", "1995-01-01", "1997-12-31"), ("wild", "1997-12-31", "2000-06-30")], "name string, lo string, hi string").select("name", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))
    return Y.regimes(W.returns(spark, sf), g, "d").groupBy("ticker", "name").agg(F.count("r").alias("n"), F.round(F.stddev_samp("r"), 8).alias("vol"))


@query(f"""WITH {W.DAILY}, s AS (SELECT ticker, d, isodow(d) AS slot, volume, avg(volume) OVER w AS a, count(volume) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker, isodow(d) ORDER BY d ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT ticker, d, round(ln(volume / CASE WHEN n >= 4 THEN a END), 7) AS log_ratio FROM s""", dates="d")
def same_clock_ratio(spark, sf):
    b = W.bars(spark, sf, "day").withColumn("slot", F.weekday("d"))
    return Y.same_clock_mean(b, ["ticker"], "d", "slot", "volume", 8, 4).select("ticker", "d", F.round("log_ratio", 7).alias("log_ratio"))


@query(f"""WITH {W.BARS}, z AS (SELECT ticker, d, CASE WHEN count(px) OVER w >= 13 AND stddev_pop(px) OVER w > 0 THEN (px - avg(px) OVER w) / stddev_pop(px) OVER w END AS z FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 12 PRECEDING)),
e AS (SELECT *, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 WHEN z * lag(z) OVER (PARTITION BY ticker ORDER BY d) <= 0 THEN 0 END AS e FROM z) SELECT ticker, d, CAST(coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS side FROM e""", dates="d")
def bollinger_side(spark, sf):
    return Y.bollinger(W.bars(spark, sf), ["ticker"], "d", "px", 13, 1.5).select("ticker", "d", "side")


@query(f"""WITH {W.BARS}, x AS (SELECT ticker, d, px FROM bars), y AS (SELECT ticker, CAST(d + INTERVAL 7 DAY AS DATE) AS d, px FROM bars) SELECT coalesce(x.ticker, y.ticker) AS ticker, coalesce(x.d, y.d) AS d, round(x.px / y.px, 8) AS ratio, CASE WHEN x.px IS NULL THEN 'b' WHEN y.px IS NULL THEN 'a' END AS only FROM x FULL JOIN y ON x.ticker = y.ticker AND x.d = y.d""", dates="d")
def source_comparison(spark, sf):
    b = W.bars(spark, sf).select("ticker", "d", "px")
    return Y.compare(b, b.withColumn("d", F.date_add("d", 7)), ["ticker", "d"], "px").select("ticker", "d", F.round("ratio", 8).alias("ratio"), "only")


@query(f"""WITH {W.BARS}, v AS (SELECT ticker, d, dollar_volume / sum(dollar_volume) OVER (PARTITION BY d) AS w FROM bars), l AS (SELECT max(d) AS d1, max(d) - 7 AS d0 FROM bars), a AS (SELECT ticker, w FROM v JOIN l ON d = d1), b AS (SELECT ticker, w FROM v JOIN l ON d = d0)
SELECT coalesce(a.ticker, b.ticker) AS ticker, round(coalesce(a.w, 0), 9) AS w1, round(coalesce(b.w, 0), 9) AS w0, round(coalesce(a.w, 0) - coalesce(b.w, 0), 9) AS trade FROM a FULL JOIN b ON a.ticker = b.ticker""")
def weight_changes(spark, sf):
    b = W.bars(spark, sf)
    v = b.withColumn("weight", F.col("dollar_volume") / F.sum("dollar_volume").over(Window.partitionBy("d")))
    last = F.broadcast(b.agg(F.max("d").alias("d1")))
    at = lambda k: v.join(last, F.col("d") == F.date_sub("d1", k)).select("ticker", "weight")
    return Y.weight_changes(at(0), at(7)).select("ticker", *r6("w1", "w0", "trade", n=9))


@query(f"""WITH {W.BARS}, c AS (SELECT ticker, year(d) AS year, round(avg(volume) / 7, 6) AS bps FROM bars GROUP BY ALL HAVING count(*) >= 52), w AS (SELECT DISTINCT ticker, year(d) AS year FROM bars), m AS (SELECT year, median(bps) AS m FROM c GROUP BY year)
SELECT w.ticker, w.year, round(coalesce(c.bps, m.m), 6) AS bps FROM w LEFT JOIN c ON c.ticker = w.ticker AND c.year = w.year LEFT JOIN m ON m.year = w.year""")
def yearly_costs(spark, sf):
    b = W.bars(spark, sf).withColumn("year", F.year("d").cast("long"))
    c = b.groupBy("ticker", "year").agg(F.round(F.avg("volume") / 7, 6).alias("bps"), F.count("*").alias("n")).where("n >= 52").drop("n")
    return Y.yearly_cost_map(c, b.select("ticker", "year").distinct()).select("ticker", "year", *r6("bps"))


@query()
def composite_scores(spark, sf):
    e = W.resid(spark, sf)
    t = M.stationarity(e.select(*PAIR, "d", "resid"), PAIR, "d").join(S.half_life(e, "resid", PAIR, "d").select(*PAIR, "half_life"), PAIR)
    t = t.join(S.hedged_sharpe(e, PAIR, "d"), PAIR).join(S.resid_proxy(e, PAIR, "d").select(*PAIR, "resid_sigma"), PAIR)
    return Y.composite_score(t).select(*PAIR, *r6("score", n=5))


@query(f"""WITH {W.RETURNS}, mk AS (SELECT d, avg(r) AS x FROM r GROUP BY d), z AS (SELECT ticker, d, r AS y, x, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM r JOIN mk USING (d) WHERE r IS NOT NULL AND x IS NOT NULL),
f AS (SELECT ticker, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM z GROUP BY ticker HAVING count(*) >= 4),
g AS (SELECT *, sxx / (n * sxx - sx * sx) AS i11, -sx / (n * sxx - sx * sx) AS i12, n / (n * sxx - sx * sx) AS i22 FROM f),
u AS (SELECT ticker, i, y - a - b * x AS e, (y - a - b * x) * x AS ex FROM z JOIN f USING (ticker)),
s0 AS (SELECT ticker, sum(e * e) AS s11, sum(e * ex) AS s12, sum(ex * ex) AS s22 FROM u GROUP BY ticker),
sk AS (SELECT ticker, sum((1 - k / 9.0) * 2 * u.e * v.e) AS s11, sum((1 - k / 9.0) * (u.e * v.ex + u.ex * v.e)) AS s12, sum((1 - k / 9.0) * 2 * u.ex * v.ex) AS s22 FROM u JOIN (SELECT unnest(range(1, 9)) AS k) ON true JOIN u v USING (ticker) WHERE v.i = u.i - k GROUP BY ticker),
s AS (SELECT s0.ticker, s0.s11 + sk.s11 AS s11, s0.s12 + sk.s12 AS s12, s0.s22 + sk.s22 AS s22 FROM s0 JOIN sk USING (ticker))
SELECT ticker, 'const' AS term, round(a, 5) AS coef, round(a / sqrt(i11 * i11 * s11 + 2 * i11 * i12 * s12 + i12 * i12 * s22), 5) AS t FROM g JOIN s USING (ticker)
UNION ALL SELECT ticker, 'market', round(b, 5), round(b / sqrt(i12 * i12 * s11 + 2 * i12 * i22 * s12 + i22 * i22 * s22), 5) FROM g JOIN s USING (ticker)""")
def hac_exposures(spark, sf):
    r = W.returns(spark, sf)
    m = r.groupBy("d").agg(F.avg("r").alias("market"))
    return Y.hac_by(r.join(m, "d"), ["ticker"], "d", "r", ["market"], 8).select("ticker", "term", *r6("coef", "t", n=5))


@query(f"""WITH {W.RETURNS}, a AS (SELECT sum(r) OVER (PARTITION BY ticker ORDER BY d ROWS 3 PRECEDING) AS mom, -r AS rev, lead(r) OVER (PARTITION BY ticker ORDER BY d) AS fwd FROM r),
g AS (SELECT sum(mom * mom) AS a, sum(mom * rev) AS b, sum(rev * rev) AS c, sum(mom * fwd) AS u, sum(rev * fwd) AS v FROM a WHERE mom IS NOT NULL AND rev IS NOT NULL AND fwd IS NOT NULL), h AS (SELECT a + 0.1 * (a + c) / 2 AS a, b, c + 0.1 * (a + c) / 2 AS c, u, v FROM g)
SELECT 'mom' AS alpha, round((c * u - b * v) / (a * c - b * b), 5) AS weight FROM h UNION ALL SELECT 'rev', round((a * v - b * u) / (a * c - b * b), 5) FROM h""")
def ridge_weights(spark, sf):
    w = order("ticker")
    a = W.returns(spark, sf).withColumns({"mom": F.sum("r").over(X.rows(w, 4)), "rev": -F.col("r"), "fwd": F.lead("r").over(w)})
    return Y.ridge_blend(a, "d", ["mom", "rev"], "fwd", 0.1).select("alpha", *r6("weight", n=5))
