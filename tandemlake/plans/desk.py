"""Queries for books, targets, universes, plot data and join shapes, with their DuckDB SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import desk as D
from ..operators import ledger as L
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import stats as S
from ..operators import study as Y
from ..operators import universe as U
from ..operators import validation as V
from ..sources import lake as K
from . import views as W
from .catalog import BOOK, COSTS, LEDGER, PAIR, SIGNALS, TICK, TRIPS, _grid, _ledger, _signals, _ticks, order, query, r6

# ------------------------------------------------------------------ breaker and books

AUDIT = f"""{LEDGER}, t AS (SELECT t1, t2, d, z, pos, n1, coalesce(abs(z) > 2.5, false) AS trig, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) AS i FROM sig), h AS (SELECT *, max(CAST(trig AS INTEGER)) OVER (PARTITION BY t1, t2 ORDER BY d ROWS 3 PRECEDING) = 1 AS h0 FROM t),
ext AS (SELECT t1, t2, i, h0 AS zh FROM h WHERE i = 1 UNION ALL SELECT h.t1, h.t2, h.i, h.h0 OR (ext.zh AND coalesce(abs(h.z) >= 1.0, false)) FROM ext JOIN h ON h.t1 = ext.t1 AND h.t2 = ext.t2 AND h.i = ext.i + 1),
dd AS (SELECT t1, t2, d, (10000 + equity) / max(10000 + equity) OVER a - 1 AS pct, CAST((equity - max(equity) OVER w) / 10000.0 < -0.02 AS INTEGER) AS trip FROM led WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS 25 PRECEDING), a AS (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING)),
dh AS (SELECT *, max(trip) OVER (PARTITION BY t1, t2 ORDER BY d ROWS 7 PRECEDING) = 1 AS dh FROM dd),
both_ AS (SELECT h.t1, h.t2, h.d, h.z, h.pos, h.n1, zh, dh, pct, (zh OR dh) AND max(abs(h.pos)) OVER (PARTITION BY h.t1, h.t2) > 0 AS halted FROM h JOIN ext USING (t1, t2, i) JOIN dh ON dh.t1 = h.t1 AND dh.t2 = h.t2 AND dh.d = h.d),
runs AS (SELECT *, sum(CAST(halted AND NOT coalesce(was, false) AS INTEGER)) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(halted) OVER (PARTITION BY t1, t2 ORDER BY d) AS was FROM both_))"""
BREAKER = L.Breaker(z_halt=2.5, cooldown=3, z_reentry=1.0, max_drawdown_pct=0.02, drawdown_window=26, halt_bars=8, capital_base=10_000)


def _halted(spark, sf):
    return L.apply_breaker(_signals(spark, sf), W.pairs(spark, sf), PAIR, BREAKER, COSTS, "d")


@query(f"WITH RECURSIVE {AUDIT} SELECT t1, t2, d, halted, CASE WHEN halted THEN 0 ELSE pos END AS pos, round(CASE WHEN halted THEN 0 ELSE n1 END, 6) AS n1 FROM both_", dates="d")
def breaker_combined(spark, sf):
    return _halted(spark, sf)[0].select(*PAIR, "d", "halted", "pos", *r6("n1"))


@query(f"""WITH RECURSIVE {AUDIT}, f AS (SELECT t1, t2, run, arg_min(CASE WHEN zh AND dh THEN 'both' WHEN dh THEN 'drawdown' ELSE 'z_halt' END, d) AS trigger_type, arg_min(row(abs(z)), d) AS z, arg_min(row(pct), d) AS p, min(d) AS halt_start, max(d) AS halt_end, count(*) AS n_halted_bars FROM runs WHERE halted GROUP BY t1, t2, run)
SELECT t1, t2, trigger_type, round(CASE WHEN trigger_type <> 'drawdown' THEN z[1] END, 5) AS z_at_trigger, round(CASE WHEN trigger_type <> 'z_halt' THEN p[1] END, 6) AS dd_pct_at_trigger, halt_start, halt_end, n_halted_bars FROM f""", dates="halt_start halt_end")
def breaker_audit(spark, sf):
    return _halted(spark, sf)[1].select(*PAIR, "trigger_type", *r6("z_at_trigger", n=5), *r6("dd_pct_at_trigger"), "halt_start", "halt_end", "n_halted_bars")


DIVIDENDS = "dv AS (SELECT t1, t2, d, CASE WHEN month(d) % 3 = 0 AND day(d) <= 7 THEN round(P1 * 0.01, 4) ELSE 0 END AS D1, CASE WHEN month(d) % 6 = 0 AND day(d) <= 7 THEN round(P2 * 0.005, 4) ELSE 0 END AS D2 FROM resid)"


@query(f"""WITH RECURSIVE {BOOK}, {DIVIDENDS}, k3 AS (SELECT k2.*, D1, D2, n1 * coalesce(P1 - lag(P1) OVER w, 0) + n2 * coalesce(P2 - lag(P2) OVER w, 0) AS price, n1 - coalesce(lag(n1) OVER w, 0) AS dn1, n2 - coalesce(lag(n2) OVER w, 0) AS dn2 FROM k2 JOIN dv USING (t1, t2, d) WINDOW w AS (PARTITION BY k2.t1, k2.t2 ORDER BY k2.d))
SELECT t1, t2, d, round(n1 * D1 + n2 * D2, 3) AS dividends, round(price - (10 * abs(dn1) * P1 + 20 * abs(dn2) * P2) / 1e4 - (greatest(-n1, 0) * P1 + greatest(-n2, 0) * P2) * 0.005 / 252 + n1 * D1 + n2 * D2, 2) AS pnl FROM k3""", dates="d")
def book_with_dividends(spark, sf):
    r = W.resid(spark, sf).select(*PAIR, "d", "P1", "P2", "beta")
    pays = lambda c, months, share: F.when((F.month("d") % months == 0) & (F.dayofmonth("d") <= 7), F.round(F.col(c) * share, 4)).otherwise(0.0)
    dividends = r.select(*PAIR, "d", pays("P1", 3, 0.01).alias("D1"), pays("P2", 6, 0.005).alias("D2"))
    s = _signals(spark, sf).select(*PAIR, "d", "pos").join(r, [*PAIR, "d"]).withColumn("target", F.lit(10000.0))
    out = L.book(L.with_dividends(s, dividends, PAIR, "d"), PAIR, "daily", 0.1, (10.0, 20.0), ts="d")
    return out.select(*PAIR, "d", *r6("dividends", n=3), *r6("pnl", n=2))


#: The daily book of all pairs, and the costs of a ticker.
NETTED = f"""{BOOK}, k3 AS (SELECT *, n1 - coalesce(lag(n1) OVER w, 0) AS dn1, n2 - coalesce(lag(n2) OVER w, 0) AS dn2, n1 * coalesce(P1 - lag(P1) OVER w, 0) + n2 * coalesce(P2 - lag(P2) OVER w, 0) AS price, coalesce(lag(pos) OVER w, 0) AS was,
  CAST(CASE WHEN pos <> 0 THEN id ELSE 0 END AS INTEGER) AS trade_id FROM k2 WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)),
k4 AS (SELECT *, (10 * abs(dn1) * P1 + 20 * abs(dn2) * P2) / 1e4 AS cost, (greatest(-n1, 0) * P1 + greatest(-n2, 0) * P2) * 0.005 / 252 AS borrow, abs(dn1) * P1 + abs(dn2) * P2 AS traded, was <> 0 AND pos <> was AS leaves, coalesce(lag(trade_id) OVER (PARTITION BY t1, t2 ORDER BY d), 0) AS before FROM k3)"""


def _daily_book(spark, sf):
    s = _signals(spark, sf).select(*PAIR, "d", "pos").join(W.resid(spark, sf).select(*PAIR, "d", "P1", "P2", "beta"), [*PAIR, "d"]).withColumn("target", F.lit(10000.0))
    return L.book(s, PAIR, "daily", 0.1, (10.0, 20.0), ts="d")


@query(f"""WITH RECURSIVE {NETTED}, legs AS (SELECT d, t1 AS ticker, dn1 AS dn, P1 AS px, abs(n1) * P1 AS v FROM k4 UNION ALL SELECT d, t2, dn2, P2, abs(n2) * P2 FROM k4),
net AS (SELECT d, sum(abs(dn) * px * (5 + CAST(right(ticker, 1) AS INTEGER)) / 1e4) AS cost_net FROM (SELECT d, ticker, sum(dn) AS dn, min(px) AS px FROM legs WHERE dn <> 0 GROUP BY ALL) GROUP BY d),
top AS (SELECT d, max(v) AS v FROM (SELECT d, ticker, sum(v) AS v FROM legs WHERE v > 0 GROUP BY ALL) GROUP BY d),
day_ AS (SELECT d, sum(price - borrow) AS gross, sum(cost) AS cost, sum(traded) AS traded, count(*) AS n_priced, count(*) FILTER (pos <> 0) AS n_held FROM k4 GROUP BY d)
SELECT d, round(gross, 2) AS gross, round(cost, 2) AS cost, round(coalesce(cost_net, 0), 2) AS cost_net, round(gross - coalesce(cost_net, 0), 2) AS pnl_netted, round((gross - cost) / 1e6, 8) AS ret, round(traded, 1) AS traded, round(coalesce(v, 0), 1) AS top_ticker_notional, n_priced, n_held
FROM day_ LEFT JOIN net USING (d) LEFT JOIN top USING (d)""", dates="d")
def netted_book(spark, sf):
    rates = W.bars(spark, sf).select("ticker").distinct().select("ticker", (5.0 + F.right("ticker", F.lit(1)).cast("double")).alias("bps"))
    out = D.assembled_book(_daily_book(spark, sf), PAIR, "d", rates, 1e6)
    return out.select("d", *r6("gross", "cost", "cost_net", "pnl_netted", n=2), *r6("ret", n=8), *r6("traded", "top_ticker_notional", n=1), "n_priced", "n_held")


@query(f"""WITH RECURSIVE {NETTED}, held AS (SELECT t1, t2, trade_id, min(d) AS entry, count(*) AS rows, sum(price) AS pnl_price, sum(borrow) AS borrow FROM k4 WHERE trade_id > 0 GROUP BY ALL),
paid AS (SELECT t1, t2, CASE WHEN leaves THEN before ELSE trade_id END AS trade_id, sum(cost) AS cost, sum(traded) AS traded, min(d) FILTER (leaves) AS exit FROM k4 GROUP BY ALL)
SELECT t1, t2, trade_id, entry, exit, rows, round(pnl_price, 2) AS pnl_price, round(borrow, 3) AS borrow, round(cost, 3) AS cost, round(traded, 1) AS traded FROM held JOIN paid USING (t1, t2, trade_id)""", dates="entry exit")
def book_trips(spark, sf):
    return D.book_trips(_daily_book(spark, sf), PAIR, "d").select(*PAIR, "trade_id", "entry", "exit", "rows", *r6("pnl_price", n=2), *r6("borrow", "cost", n=3), *r6("traded", n=1))


# ------------------------------------------------------------------ session books

#: Half-hour bars; a name's weight fades its last move against the others', and its return is that of the next bar of the session.
HALF_HOURS = f"""{W.GRID}, hb AS (SELECT ticker, session, CAST(floor(minute / 30) AS INTEGER) AS slot, arg_max(close, minute) FILTER (close IS NOT NULL) AS px FROM grid GROUP BY ALL),
hm AS (SELECT *, px / lag(px) OVER w - 1 AS back, lead(px) OVER w / px - 1 AS r, last_value(px) OVER (PARTITION BY ticker, session ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / px - 1 AS out_ FROM hb WHERE px IS NOT NULL WINDOW w AS (PARTITION BY ticker, session ORDER BY slot)),
hc AS (SELECT *, -(back - avg(back) OVER (PARTITION BY session, slot)) AS x FROM hm WHERE back IS NOT NULL), w AS (SELECT *, round(coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY session, slot), 0), 0), 9) AS w, 2.0 + slot % 3 AS bps FROM hc)"""


def _half_hours(spark, sf):
    b = K.k_minute(_grid(spark, sf), 30).where("close is not null").select("ticker", "session", F.col("bucket").alias("slot"), F.col("close").alias("px"))
    w = Window.partitionBy("ticker", "session").orderBy("slot")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = b.withColumns({"back": F.col("px") / F.lag("px").over(w) - 1, "r": F.lead("px").over(w) / F.col("px") - 1, "out_": F.last("px").over(whole) / F.col("px") - 1}).where("back is not null")
    at = Window.partitionBy("session", "slot")
    m = m.withColumn("x", -(F.col("back") - F.avg("back").over(at)))
    weight = F.round(F.coalesce(X.ratio("x", F.sum(F.abs("x")).over(at)), F.lit(0.0)), 9)
    return m.select("session", "slot", F.col("ticker").alias("name"), weight.alias("weight"), "r", "out_", (2.0 + F.col("slot") % 3).alias("cost_bps"))


@query(f"""WITH {HALF_HOURS} SELECT session, slot, round(sum(w * 1000 * out_), 6) AS pnl_gross, round(2 * sum(abs(w) * 1000 * bps) / 1e4, 10) AS cost, round(2 * sum(abs(w) * 1000), 6) AS traded, count(*) FILTER (w <> 0) AS n FROM w WHERE slot = 4 GROUP BY ALL""", dates="session")
def session_book_a(spark, sf):
    """Opened at 11:30 and closed at the session's end."""
    df = _half_hours(spark, sf).where("slot = 4").withColumn("r", F.col("out_"))
    return D.open_close_book(df, ["session", "slot"], 1000.0).select("session", "slot", *r6("pnl_gross", "traded"), *r6("cost", n=10), "n")


@query(f"""WITH {HALF_HOURS}, s AS (SELECT session, slot, row_number() OVER (PARTITION BY session ORDER BY slot) AS i, count(*) OVER (PARTITION BY session) AS last FROM (SELECT DISTINCT session, slot FROM w)),
g AS (SELECT s.session, s.slot, s.i, s.last, t.ticker, coalesce(w.w, 0) * 1000 AS w, coalesce(w.r, 0) AS r, w.bps FROM s JOIN (SELECT DISTINCT session, ticker FROM w) t USING (session) LEFT JOIN w ON w.session = s.session AND w.slot = s.slot AND w.ticker = t.ticker),
h AS (SELECT *, coalesce(lag(w) OVER v, 0) AS w0, coalesce(bps, lag(bps) OVER v) AS c FROM g WINDOW v AS (PARTITION BY session, ticker ORDER BY i)), k AS (SELECT *, abs(w - w0) + CASE WHEN i = last THEN abs(w) ELSE 0 END AS moved FROM h)
SELECT session, slot, round(sum(w * r), 6) AS pnl_gross, round(coalesce(sum(moved * c), 0) / 1e4, 10) AS cost, round(sum(moved), 6) AS traded, round(sum(abs(w)), 6) AS gross, count(*) FILTER (w <> 0) AS n FROM k GROUP BY ALL""", dates="session")
def session_book_c(spark, sf):
    """Met at every half hour, flat at the close."""
    return D.intraday_book(_half_hours(spark, sf), "session", "slot", "name", 1000.0).select("session", "slot", *r6("pnl_gross", "traded", "gross"), *r6("cost", n=10), "n")


CLOSES = f"""{W.GRID}, cl AS (SELECT ticker, session, arg_max(close, minute) FILTER (close IS NOT NULL) AS px FROM grid GROUP BY ALL), cm AS (SELECT *, px / lag(px) OVER w - 1 AS back, lead(px) OVER w / px - 1 AS r FROM cl WINDOW w AS (PARTITION BY ticker ORDER BY session)),
cx AS (SELECT *, -(back - avg(back) OVER (PARTITION BY session)) AS x FROM cm WHERE back IS NOT NULL), w AS (SELECT *, round(coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY session), 0), 0), 9) AS w FROM cx),
cells AS (SELECT a.session, b.ticker, coalesce(w.w, 0) * 1000 AS t, coalesce(w.r, 0) AS r FROM (SELECT DISTINCT session FROM w) a CROSS JOIN (SELECT DISTINCT ticker FROM w) b LEFT JOIN w ON w.session = a.session AND w.ticker = b.ticker),
days AS (SELECT session, list(t ORDER BY ticker) AS t, list(r ORDER BY ticker) AS r, row_number() OVER (ORDER BY session) AS i FROM cells GROUP BY session)"""


@query(f"""WITH RECURSIVE {CLOSES}, bk AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(t, lambda a: CAST(0 AS DOUBLE)) AS w, CAST(0 AS DOUBLE) AS pnl, CAST(0 AS DOUBLE) AS traded FROM days WHERE i = 1
  UNION ALL SELECT i, w, list_dot_product(w, r), list_sum(list_transform(list_zip(w, w0), lambda a: abs(a[1] - a[2])))
  FROM (SELECT i, r, w0, list_transform(v, lambda a: CASE WHEN abs(CASE WHEN g > 0 THEN a * (1000.0 / g) ELSE a END) < 1e-9 THEN 0 ELSE CASE WHEN g > 0 THEN a * (1000.0 / g) ELSE a END END) AS w
    FROM (SELECT *, list_sum(list_transform(v, lambda a: abs(a))) AS g FROM (SELECT days.i, days.r, bk.w AS w0, list_transform(list_zip(bk.w, days.t), lambda a: a[1] + 0.5 * (a[2] - a[1])) AS v FROM bk JOIN days ON days.i = bk.i + 1))))
SELECT session, round(pnl, 6) AS pnl_gross, round(traded * 4 / 1e4, 6) AS cost, round(-list_sum(list_transform(w, lambda a: least(a, 0))) * 50 / 1e4 / 252, 8) AS borrow, round(traded, 4) AS traded FROM bk JOIN days USING (i)""", dates="session")
def session_book_b(spark, sf):
    """Held over night, half of the way to the target at each close."""
    b = K.session_bars(_grid(spark, sf)).select("ticker", "session", F.col("close").alias("px"))
    w = Window.partitionBy("ticker").orderBy("session")
    m = b.withColumns({"back": F.col("px") / F.lag("px").over(w) - 1, "r": F.lead("px").over(w) / F.col("px") - 1}).where("back is not null")
    at = Window.partitionBy("session")
    m = m.withColumn("x", -(F.col("back") - F.avg("back").over(at)))
    m = m.select(F.lit("all").alias("book"), "session", F.col("ticker").alias("name"), F.round(F.coalesce(X.ratio("x", F.sum(F.abs("x")).over(at)), F.lit(0.0)), 9).alias("weight"), "r", F.lit(4.0).alias("cost_bps"))
    return D.overnight_book(m, "book", "session", 0.5, 1000.0, 50.0).select("session", *r6("pnl_gross", "cost"), *r6("borrow", n=8), *r6("traded", n=4))


# ------------------------------------------------------------------ targets


@query(f"""WITH RECURSIVE {SIGNALS}, x AS (SELECT *, lead(pos) OVER w AS nxt FROM sig WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)), y AS (SELECT *, CASE WHEN nxt <> 0 AND nxt <> pos THEN least(greatest(abs(z) / 2, 1), 2) END AS m FROM x)
SELECT t1, t2, d, round(CASE WHEN nxt <> 0 THEN last_value(m IGNORE NULLS) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING) END, 6) AS zmult FROM y""", dates="d")
def z_sized_targets(spark, sf):
    return D.z_size(_signals(spark, sf), PAIR, "d").select(*PAIR, "d", *r6("zmult"))


@query(f"""WITH {W.RETURNS}, v AS (SELECT year(d) AS y, round(stddev_pop(r), 9) AS sigma FROM r GROUP BY 1), m AS (SELECT *, quantile_cont(CASE WHEN y % 4 <> 0 THEN sigma END, 0.5) OVER w AS median FROM v WINDOW w AS (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT y, sigma, round(median, 9) AS median, round(CASE WHEN median IS NULL THEN 1 ELSE least(greatest(median / sigma, 0.5), 1.05) END, 8) AS scale FROM m""")
def volatility_targets(spark, sf):
    v = W.returns(spark, sf).groupBy(F.year("d").cast("long").alias("y")).agg(F.round(F.stddev_pop("r"), 9).alias("sigma")).withColumn("skip", F.col("y") % 4 == 0)
    return D.volatility_target(v, "y", "sigma", 0.5, 1.05, "skip").select("y", "sigma", *r6("median", n=9), *r6("scale", n=8))


FORMED = f"{W.RETURNS}, se AS (SELECT d, row_number() OVER (ORDER BY d) AS o FROM (SELECT DISTINCT d FROM r)), fo AS (SELECT year(d) AS y, min(o) AS o0 FROM se GROUP BY 1), rn AS (SELECT y, ticker, r.d, r, CAST(o - o0 + 1 AS BIGINT) AS n FROM r JOIN se USING (d) JOIN fo ON o - o0 + 1 BETWEEN -39 AND 40 WHERE r IS NOT NULL)"


def _formed(spark, sf):
    r = W.returns(spark, sf).where("r is not null")
    se = W.returns(spark, sf).select("d").distinct().withColumn("o", F.row_number().over(Window.orderBy("d")))  # the calendar
    fo = se.groupBy(F.year("d").cast("long").alias("y")).agg(F.min("o").alias("o0"))
    n = (F.col("o") - F.col("o0") + 1).cast("long").alias("n")
    return r.join(se, "d").join(F.broadcast(fo), (F.col("o") - F.col("o0") + 1).between(-39, 40)).select("y", "ticker", "d", "r", n)


@query(f"""WITH {FORMED}, sd AS (SELECT *, CASE WHEN count(r) OVER w >= 30 THEN stddev_pop(r) OVER w END AS sd FROM rn WINDOW w AS (PARTITION BY y, ticker ORDER BY n ROWS 29 PRECEDING)), mo AS (SELECT y, max(n) AS most FROM rn GROUP BY y),
st AS (SELECT y, ticker, 0 AS u, arg_max(row(sd), n)[1] AS sd FROM sd WHERE n <= 0 GROUP BY ALL), al AS (SELECT * FROM st UNION ALL SELECT y, ticker, CAST(n AS INTEGER), sd FROM sd WHERE n IN (13, 26)),
gr AS (SELECT st.y, st.ticker, CAST(u.u AS INTEGER) AS u FROM st JOIN mo USING (y) JOIN (SELECT unnest([0, 13, 26]) AS u) u ON u.u <= most),
kn AS (SELECT gr.y, gr.ticker, gr.u, 1 / last_value(sd IGNORE NULLS) OVER (PARTITION BY gr.y, gr.ticker ORDER BY gr.u ROWS UNBOUNDED PRECEDING) AS inv FROM gr LEFT JOIN al ON al.y = gr.y AND al.ticker = gr.ticker AND al.u = gr.u)
SELECT y, ticker, u AS update, round(inv / sum(inv) OVER (PARTITION BY y, u), 8) AS weight FROM kn""")
def reweighted_targets(spark, sf):
    return D.reweighted(_formed(spark, sf), "y", ["ticker"], "d", "r", [13, 26], 30).select("y", "ticker", "update", *r6("weight", n=8))


@query(dates="d")
def reused_targets(spark, sf):
    """Targets of the year's pairs with equal weights, scaled up by what isn't held."""
    s = _signals(spark, sf).where("t1 < 'Brand#15'").withColumns({"nxt": F.coalesce(F.lead("pos").over(order(*PAIR)), F.lit(0)), "y": F.year("d").cast("long"), "name": F.concat_ws("/", *PAIR)})
    n = s.groupBy("y").agg(F.count_distinct("name").alias("n"))
    held = s.join(n, "y").select("y", "d", "name", (1.0 / F.col("n")).alias("weight"), F.col("pos").alias("cur"), "nxt")
    return D.reuse_targets(held, "y", "d", "name", 10_000.0).select("y", "d", "name", *r6("target", "m"))


# ------------------------------------------------------------------ factors and residuals

FACTOR = f"{W.RETURNS}, mk AS (SELECT d, round(avg(r), 9) AS f FROM r GROUP BY d), rf AS (SELECT ticker, d, year(d) AS y, r, f FROM r JOIN mk USING (d) WHERE r IS NOT NULL AND f IS NOT NULL), be AS (SELECT ticker, y, round(regr_slope(r, f), 8) AS b, round(regr_intercept(r, f), 9) AS a FROM rf GROUP BY ALL)"


def _factor(spark, sf):
    r = W.returns(spark, sf)
    m = r.groupBy("d").agg(F.round(F.avg("r"), 9).alias("f"))
    rf = r.where("r is not null").join(m.where("f is not null"), "d").withColumn("y", F.year("d").cast("long")).select("ticker", "d", "y", "r", "f")
    be = rf.groupBy("ticker", "y").agg(F.round(F.regr_slope("r", "f"), 8).alias("b"), F.round(F.regr_intercept("r", "f"), 9).alias("a"))
    return rf, be


@query(f"""WITH {FACTOR}, x AS (SELECT ticker, d, r, b * f AS fit, a FROM rf JOIN be USING (ticker, y))
SELECT ticker, d, {", ".join(f"round(CASE WHEN count(r) OVER w{h} >= {h} THEN sum(r) OVER w{h} END, 9) AS raw{h}, round(CASE WHEN count(r) OVER w{h} >= {h} THEN sum(r - fit) OVER w{h} END, 8) AS fwd{h}, round(CASE WHEN count(r) OVER w{h} >= {h} THEN sum(r - fit) OVER w{h} END - {h} * a, 8) AS fwd{h}_alpha" for h in (1, 5))}
FROM x WINDOW w1 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), w5 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""", dates="d")
def forward_targets(spark, sf):
    rf, be = _factor(spark, sf)
    df = rf.join(be, ["ticker", "y"]).withColumn("fit", F.col("b") * F.col("f"))
    return D.forward_targets(df, ["ticker"], "d", "r", "fit", "a").select("ticker", "d", *r6("raw1", "raw5", n=9), *r6("fwd1", "fwd1_alpha", "fwd5", "fwd5_alpha", n=8))


@query(f"""WITH {FACTOR}, g AS (SELECT *, 1 + 0.1 * (day(d) % 7) AS w FROM rf), m AS (SELECT ticker, y, sum(w * w * f) / sum(w * w) AS x, sum(w * w * r) / sum(w * w) AS m FROM g GROUP BY ALL), s AS (SELECT ticker, y, sum(w * w * (f - x) * (f - x)) AS xx, sum(w * w * (f - x) * (r - m)) AS xy, any_value(x) AS x, any_value(m) AS m FROM g JOIN m USING (ticker, y) GROUP BY ALL),
c AS (SELECT *, CASE WHEN xx > 1e-18 THEN xy / xx END AS b FROM s), e AS (SELECT ticker, y, b, m - b * x AS a, w * (r - (m - b * x) - b * f) AS e, w * r AS wr FROM g JOIN c USING (ticker, y))
SELECT ticker, y, round(any_value(b), 7) AS beta, round(any_value(a), 8) AS a, round(sum(e), 6) AS resid_sum, round(CASE WHEN var_pop(wr) > 1e-18 THEN 1 - var_pop(e) / var_pop(wr) END, 7) AS r2 FROM e GROUP BY ALL""")
def weighted_residuals(spark, sf):
    rf, _ = _factor(spark, sf)
    e = P.etf_residuals(rf.withColumn("w", 1 + 0.1 * (F.dayofmonth("d") % 7)), ["ticker", "y"], "w")
    g = e.groupBy("ticker", "y").agg(F.first("beta").alias("beta"), F.first("a").alias("a"), F.sum("resid").alias("resid_sum"), F.first("r2").alias("r2"))
    return g.select("ticker", "y", *r6("beta", "r2", n=7), *r6("a", n=8), *r6("resid_sum"))


@query()
def factor_loadings(spark, sf):
    r = W.returns(spark, sf).where("r is not null").withColumn("y", F.year("d").cast("long"))
    return D.factor_days_by(r, "y", "ticker", "d", "r", P.eigenportfolios_by(r, "y", "ticker", "d", "r", 2)).select("y", "name", "term", *r6("loading", "r2"))


@query(dates="refit")
def ridge_refits(spark, sf):
    w = order("ticker")
    a = W.returns(spark, sf).withColumns({"mom": F.sum("r").over(X.rows(w, 4)), "rev": -F.col("r"), "fwd": F.lead("r").over(w)})
    return Y.ridge_walk(a, "d", ["mom", "rev"], "fwd", months=24, lag=1, least_days=52).select("refit", "multiple", "n_rows", "alpha", *r6("weight"))


@query()
def market_communities(spark, sf):
    c = P.pairwise_correlation(W.returns(spark, sf), "ticker", "d", "r").where("corr > 0.02").select(F.lit("all").alias("graph"), "i", "j", F.round("corr", 9).alias("w"))
    return D.communities_by(c, "graph")


@query(dates="d")
def kalman_momentum(spark, sf):
    return M.fit_kalman_ahead(W.pairs(spark, sf), PAIR, "d", 52, momentum=True).select(*PAIR, "d", *r6("mu", "gamma", n=3))


@query()
def screen_by_formation(spark, sf):
    """The two years before each formation, both tests with a trend, adjusted within the formation."""
    b = W.bars(spark, sf).select("ticker", "d", "px")
    x = V.in_window(b, V.formations(b.select("d").distinct(), "d"), "d", "form_lo", "trade_hi").where("d <= formation")
    x = x.select(F.date_format("formation", "yyyy-MM-dd").alias("formation"), "ticker", "d", "px")
    out = M.screen(x, M.Gate(trend="ct", det_order=1, max_lag=4, autolag=False, alpha_joh=0.10), group=["formation"])
    return out.select("formation", *PAIR, *r6("eg_t", "eg_p", "eg_p_fdr", "joh_stat", n=5), "eg_pass", "joh_pass", "verdict")


@query()
def score_table(spark, sf):
    return M.score_table(W.bars(spark, sf).select("ticker", "d", "px"), "johansen").select(*PAIR, *r6("score", n=5), "p", "passes")


# ------------------------------------------------------------------ universes and selections


@query("SELECT n_name AS ticker, code, regexp_full_match(code, 'Z[A-Z]ZZT') AS test FROM (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Z' || left(n_name, 1) || 'ZZT' ELSE 'Z' || left(n_name, 2) || 'ZT' END AS code FROM nation)")
def test_symbols(spark, sf):
    n = W.table(spark, sf, "nation")
    code = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Z"), F.left("n_name", F.lit(1)), F.lit("ZZT"))).otherwise(F.concat(F.lit("Z"), F.left("n_name", F.lit(2)), F.lit("ZT")))
    return n.select(F.col("n_name").alias("ticker"), code.alias("code")).withColumn("test", U.is_test_symbol("code"))


@query(f"""WITH {W.RETURNS}, x AS (SELECT ticker, year(d) AS y, px, CASE WHEN month(d) = 6 AND day(d) <= 7 THEN round(px * (0.3 + (day(d) % 4) * 0.1), 4) ELSE 0 END AS div, lag(px) OVER (PARTITION BY ticker, year(d) ORDER BY d) AS p0, greatest(-0.2, least(0.2, r)) AS win, CASE WHEN abs(r) <= 0.2 THEN r END AS kept FROM r)
SELECT ticker, y, round(max(px), 6) AS max_close, coalesce(bool_or(coalesce(div > 0.5 * p0, false)), false) AS big_dividend FROM x GROUP BY ALL HAVING max(px) > 2100 OR bool_or(coalesce(div > 0.5 * p0, false))""")
def corrupt_series(spark, sf):
    b = W.bars(spark, sf).withColumns({"y": F.year("d").cast("long"), "div": F.when((F.month("d") == 6) & (F.dayofmonth("d") <= 7), F.round(F.col("px") * (0.3 + (F.dayofmonth("d") % 4) * 0.1), 4)).otherwise(0.0)})
    return U.corrupt_series(b, ["ticker", "y"], "d", "px", "div", 2100.0).select("ticker", "y", *r6("max_close"), "big_dividend")


@query(f"WITH {W.RETURNS} SELECT ticker, count(r) AS n, round(sum(CASE WHEN r IS NOT NULL THEN greatest(-0.2, least(0.2, r)) END), 6) AS winsorized, round(sum(CASE WHEN abs(r) <= 0.2 THEN r END), 6) AS kept FROM r GROUP BY ticker")
def bounded_returns(spark, sf):
    return W.returns(spark, sf).groupBy("ticker").agg(F.count("r").alias("n"), F.round(F.sum(Y.winsorized("r", 0.2)), 6).alias("winsorized"), F.round(F.sum(Y.capped_return("r", 0.2)), 6).alias("kept"))


@query("""WITH i AS (SELECT DISTINCT p_brand AS ticker, p_type AS id FROM part), m AS (SELECT p_brand AS ticker, p_type AS id, min(CASE WHEN p_size < 10 THEN 'CS' WHEN p_size < 20 THEN 'ADRC' ELSE 'ETF' END) AS type FROM part WHERE p_size < 30 GROUP BY ALL)
SELECT i.ticker, i.id, m.type, coalesce(m.type NOT IN ('CS', 'ADRC'), false) AS nonequity, m.type IS NULL AS type_unknown FROM i LEFT JOIN m ON m.ticker = i.ticker AND m.id = i.id""")
def instrument_types(spark, sf):
    part = W.table(spark, sf, "part").select(F.col("p_brand").alias("ticker"), F.col("p_type").alias("id"), "p_size")
    master = part.where("p_size < 30").select("ticker", "id", F.when(F.col("p_size") < 10, "CS").when(F.col("p_size") < 20, "ADRC").otherwise("ETF").alias("type"))
    return U.typed(part.select("ticker", "id").distinct(), master)


LAKE_ROWS = "lk AS (SELECT lower(p_brand) AS ticker, p_type AS id, l_shipdate AS datetime, l_extendedprice / l_quantity AS p, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey), oh AS (SELECT ticker, id, datetime, round(arg_min(p, (l_orderkey, l_linenumber)), 8) AS open_split, round(max(p), 8) AS high_split, round(min(p), 8) AS low_split FROM lk GROUP BY ALL)"


@query(f"""WITH {W.bars_sql('day', 'p_brand AS ticker, p_type AS id', 'b')}, {LAKE_ROWS}, k AS (SELECT * FROM b WHERE volume >= 40)
SELECT k.ticker, k.id, k.d, px, open_split AS open, high_split AS high, low_split AS low FROM k JOIN oh ON oh.ticker = lower(k.ticker) AND oh.id = k.id AND CAST(oh.datetime AS DATE) = k.d""", dates="d")
def ohlc_of_bars(spark, sf):
    line = W.table(spark, sf, "lineitem").join(W.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p, first = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber")
    lake = line.groupBy(F.lower("p_brand").alias("ticker"), F.col("p_type").alias("id"), F.col("l_shipdate").alias("datetime")).agg(F.round(F.min_by(p, first), 8).alias("open_split"), F.round(F.max(p), 8).alias("high_split"), F.round(F.min(p), 8).alias("low_split"))
    b = W.bars(spark, sf, "day", ("ticker", "id")).where("volume >= 40").withColumnRenamed("d", "ts").select("ticker", "id", "ts", "px")
    names = b.select("ticker").distinct().select("ticker", F.upper("ticker").alias("upper"))
    got = U.with_ohlc(b.withColumn("ticker", F.upper("ticker")), lake, None).withColumnRenamed("ticker", "upper")
    return got.join(F.broadcast(names), "upper").select("ticker", "id", F.col("ts").alias("d"), "px", "open", "high", "low")


MEMBERS = f"{W.BARS}, ye AS (SELECT ticker, year(d) AS y, sum(dollar_volume) AS v FROM bars GROUP BY ALL), me AS (SELECT y AS formation, ticker FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, ticker) AS k FROM ye) WHERE k <= 12)"


def _members(spark, sf):
    ye = W.bars(spark, sf).groupBy("ticker", F.year("d").cast("long").alias("formation")).agg(F.sum("dollar_volume").alias("v"))
    return V.top_by(ye, ["formation"], [F.desc("v"), "ticker"], 12).select("formation", "ticker")


@query(f"""WITH {MEMBERS}, f AS (SELECT formation, lag(formation) OVER (ORDER BY formation) AS p, min(formation) OVER () AS o FROM (SELECT DISTINCT formation FROM me)), x AS (SELECT me.formation, me.ticker, p, a.ticker AS was, b.ticker AS old FROM me JOIN f USING (formation) LEFT JOIN me a ON a.formation = p AND a.ticker = me.ticker LEFT JOIN me b ON b.formation = o AND b.ticker = me.ticker)
SELECT formation, count(*) AS n, count(*) FILTER (p IS NOT NULL AND was IS NULL) AS n_new, round(CASE WHEN any_value(p) IS NOT NULL THEN count(*) FILTER (was IS NULL) / count(*) END, 6) AS share_new, count(old) AS n_first FROM x GROUP BY formation""")
def universe_turnover(spark, sf):
    return U.turnover(_members(spark, sf)).select("formation", "n", "n_new", *r6("share_new"), "n_first")


@query(f"""WITH {MEMBERS}, a AS (SELECT x.formation, x.ticker AS t1, y.ticker AS t2 FROM me x JOIN me y ON x.formation = y.formation AND x.ticker < y.ticker), b AS (SELECT formation, t2 AS t1, t1 AS t2 FROM a WHERE right(t1, 1) = right(t2, 1))
SELECT formation, least(t1, t2) AS t1, greatest(t1, t2) AS t2 FROM a INTERSECT SELECT formation, least(t1, t2), greatest(t1, t2) FROM b""")
def selection_overlap(spark, sf):
    m = _members(spark, sf)
    a = m.withColumnRenamed("ticker", "t1").join(m.withColumnRenamed("ticker", "t2"), "formation").where("t1 < t2")
    b = a.where("right(t1, 1) = right(t2, 1)").select("formation", F.col("t2").alias("t1"), F.col("t1").alias("t2"))
    return U.overlap(a, b, ["formation"])


PAGE = f"""{W.RETURNS}, c AS (SELECT year(a.d) AS formation, a.ticker AS t1, b.ticker AS t2, CASE WHEN NOT isnan(corr(a.r, b.r)) THEN round(exp(-10 * abs(corr(a.r, b.r))), 9) END AS p FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY formation ORDER BY p NULLS LAST, t1, t2) AS i, count(p) OVER (PARTITION BY formation) AS n FROM c),
pg AS (SELECT formation, t1, t2, p AS eg_p, CASE WHEN p IS NULL THEN 1 ELSE least(min(p * n / i) OVER (PARTITION BY formation ORDER BY p NULLS LAST, t1, t2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END AS eg_p_fdr FROM q)"""


def _page(spark, sf):
    r = W.returns(spark, sf).select("ticker", "d", "r")
    both = r.select(F.col("ticker").alias("t1"), "d", F.col("r").alias("a")).join(r.select(F.col("ticker").alias("t2"), "d", F.col("r").alias("b")), "d").where("t1 < t2")
    p = both.groupBy(F.year("d").cast("long").alias("formation"), *PAIR).agg(F.round(F.exp(-10 * F.abs(X.finite(F.corr("a", "b")))), 9).alias("eg_p"))
    return S.benjamini_hochberg(p, "eg_p", group=["formation"]).withColumnRenamed("p_adj", "eg_p_fdr").withColumn("verdict", F.when(F.col("eg_p_fdr") <= 0.9, "pass").otherwise("fail"))


@query(f"WITH {PAGE} SELECT t1, t2, eg_p, round(eg_p_fdr, 9) AS eg_p_fdr FROM pg WHERE formation = 1996 AND eg_p_fdr <= 0.9 AND eg_p <= 0.8 ORDER BY eg_p, t1, t2 LIMIT 200")
def screen_page(spark, sf):
    return U.browse(_page(spark, sf), 1996, True, 0.8).select(*PAIR, "eg_p", *r6("eg_p_fdr", n=9))


@query(f"WITH {PAGE}, e AS (SELECT *, CASE WHEN formation <= 1994 THEN 'early' WHEN formation <= 1997 THEN 'middle' ELSE 'late' END AS era, CASE WHEN eg_p_fdr <= 0.9 THEN 'pass' ELSE 'fail' END AS verdict FROM pg), vc AS (SELECT era, verdict, count(*) AS n FROM e GROUP BY ALL) SELECT era, verdict, n, round(n / sum(n) OVER (PARTITION BY era), 8) AS share FROM vc")
def verdicts_by_era(spark, sf):
    df = U.eras(_page(spark, sf).withColumn("at", F.make_date("formation", F.lit(6), F.lit(30))), "at", ["1994-12-31", "1997-12-31"], ["early", "middle", "late"])
    return U.crosstab(df, "era", "verdict").select("era", "verdict", "n", *r6("share", n=8))


@query(f"""WITH {PAGE}, k AS (SELECT *, row_number() OVER (ORDER BY eg_p, formation, t1, t2) AS i, count(*) OVER () AS m FROM pg WHERE eg_p IS NOT NULL) SELECT formation, t1, t2, round(least(min(eg_p * m / i) OVER (ORDER BY eg_p, formation, t1, t2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS p_adj FROM k
UNION ALL SELECT formation, t1, t2, 1 FROM pg WHERE eg_p IS NULL""")
def testing_over_all(spark, sf):
    """Adjusted over all tests together, by ranges of p."""
    p = _page(spark, sf).select("formation", *PAIR, "eg_p")
    return S.benjamini_hochberg(p, "eg_p").select("formation", *PAIR, *r6("p_adj", n=9))


@query()
def placebo_selection(spark, sf):
    m = _members(spark, sf)
    taken = m.withColumnRenamed("ticker", "t1").join(m.withColumnRenamed("ticker", "t2"), "formation").where("t1 < t2 and right(t1, 1) = right(t2, 1)")
    return Y.placebo_pairs(W.bars(spark, sf).select("ticker").distinct(), m.select("formation").distinct(), taken, 200, 20260918)


# ------------------------------------------------------------------ joins, windows and tests that stand alone


@query(f"""WITH {W.DAILY}, s AS (SELECT ticker, date_trunc('week', d) AS w, avg(px) AS a FROM bars GROUP BY ALL), l AS (SELECT ticker, w, lag(a) OVER (PARTITION BY ticker ORDER BY w) AS known FROM s) SELECT bars.ticker, bars.d, round(known, 8) AS known FROM bars LEFT JOIN l ON l.ticker = bars.ticker AND l.w = date_trunc('week', bars.d)""", dates="d")
def prior_week_level(spark, sf):
    b = W.bars(spark, sf, "day").withColumn("w", F.to_date(F.date_trunc("week", "d")))
    daily = b.groupBy("ticker", "w").agg(F.avg("px").alias("known"))
    return V.prior_session(b, daily, ["ticker"], "w", ["known"]).select("ticker", "d", *r6("known", n=8))


@query(f"""WITH {W.PAIRS}, f AS (SELECT *, covar_samp(P1, P2) OVER w / nullif(var_samp(P2) OVER w, 0) AS b, count(P1) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY t1, t2 ORDER BY d ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
g AS (SELECT t1, t2, d, CASE WHEN n >= 52 THEN round(b, 8) END AS b, row_number() OVER (PARTITION BY t1, t2 ORDER BY d) - 1 AS i FROM f), h AS (SELECT *, last_value(CASE WHEN i % 13 = 0 THEN b END IGNORE NULLS) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING) AS a FROM g)
SELECT t1, t2, d, coalesce(a, first_value(b IGNORE NULLS) OVER (PARTITION BY t1, t2 ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS beta FROM h""", dates="d")
def refitted_hedge(spark, sf):
    h = S.rolling_hedge(W.pairs(spark, sf), 52).select(*PAIR, "d", F.round("beta", 8).alias("beta"))
    return S.refit_every(h, ["beta"], 13, PAIR, "d").select(*PAIR, "d", "beta")


@query(f"""WITH {W.BARS} SELECT ticker, d, round(coalesce(CASE WHEN count(px) OVER w >= 5 AND stddev_pop(px) OVER w > 0 THEN (px - avg(px) OVER w) / stddev_pop(px) OVER w END, 0), 5) AS z FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 12 PRECEDING)""", dates="d")
def filled_rolling_z(spark, sf):
    return W.bars(spark, sf).select("ticker", "d", F.round(X.rolling_zscore("px", order("ticker"), 13, 5), 5).alias("z"))


@query(f"""WITH {W.RESID}, x AS (SELECT t1, t2, resid, lag(resid) OVER (PARTITION BY t1, t2 ORDER BY d) AS x0 FROM resid), h AS (SELECT t1, t2, regr_slope(resid, x0) AS b, count(resid) AS n FROM x GROUP BY ALL) SELECT t1, t2, round(b + (1 + 3 * b) / n, 7) AS ar1 FROM h""")
def unbiased_reversion(spark, sf):
    h = S.half_life(W.resid(spark, sf), "resid", PAIR, "d")
    return h.select(*PAIR, F.round(Y.unbiased_ar1(F.col("ar1"), F.col("n")), 7).alias("ar1"))


@query(f"""WITH {W.RESID}, si AS (SELECT t1, t2, year(d) AS y, d, resid, row_number() OVER (PARTITION BY t1, t2, year(d) ORDER BY d) - 1 AS i FROM resid), sk AS (SELECT si.*, k FROM si, (SELECT CAST(unnest([1, 2, 4]) AS INTEGER) AS k) WHERE i % k = 0), x AS (SELECT t1, t2, k, resid, lag(resid) OVER (PARTITION BY t1, t2, k ORDER BY d) AS x0 FROM sk),
h AS (SELECT t1, t2, k, regr_slope(resid, x0) AS b, count(resid) AS n FROM x GROUP BY ALL) SELECT t1, t2, k, round(CASE WHEN n >= 20 AND b > 0 AND b < 1 THEN -ln(2) / ln(b) * k END, 5) AS half_life FROM h""")
def half_life_intervals(spark, sf):
    e = W.resid(spark, sf).withColumn("y", F.year("d"))
    return S.half_life_by_interval(e, PAIR, "y", "d", "resid", [1, 2, 4]).select(*PAIR, "k", *r6("half_life", n=5))


@query(f"""WITH {W.RETURNS}, y AS (SELECT ticker, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM r GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM y), x AS (SELECT ticker, t.n - y.n AS n, t.s - y.s AS s, t.q - y.q AS q, t.s / t.n / sqrt(t.q / t.n - (t.s / t.n) * (t.s / t.n)) * sqrt(252) AS whole FROM y, t)
SELECT ticker, round(s / n / sqrt(q / n - (s / n) * (s / n)) * sqrt(252), 6) AS sharpe, round(whole - s / n / sqrt(q / n - (s / n) * (s / n)) * sqrt(252), 6) AS delta FROM x""")
def leave_one_out(spark, sf):
    y = W.returns(spark, sf).groupBy("ticker").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    return Y.leave_one_out(y, "ticker").select("ticker", *r6("sharpe", "delta"))


T_OF_ONE = NormalDist().inv_cdf(1 - (1 - 0.95 ** (1 / 300)) / 2)
NEED = T_OF_ONE + NormalDist().inv_cdf(0.8)
K_ = f"(1 / (1 + 0.3275911 * abs({T_OF_ONE!r} - abs(e / se)) / sqrt(2)))"
HALF_TAIL = f"(0.5 * (((((1.061405429 * {K_} - 1.453152027) * {K_} + 1.421413741) * {K_} - 0.284496736) * {K_} + 0.254829592) * {K_}) * exp(-1 * power({T_OF_ONE!r} - abs(e / se), 2) / 2))"


@query(f"""WITH RECURSIVE {TRIPS}, ty AS (SELECT year(entry) AS y, pnl_gross - cost AS p FROM trips), tg AS (SELECT y, sum(p / 10000 * 1e4) AS e, count(*) AS n FROM ty GROUP BY y), tc AS (SELECT quantile_cont(p, 0.9) AS c FROM ty), th AS (SELECT sum(p) FILTER (p >= c) / sum(p) FILTER (p > 0) AS top FROM ty, tc),
te AS (SELECT sum(e) / sum(n) AS e, avg(e / n) AS m, stddev_samp(e / n) / sqrt(count(*)) AS se, CAST(sum(n) AS BIGINT) AS trades FROM tg)
SELECT round(e, 5) AS edge_bps, round(m / se, 5) AS cluster_t, round({T_OF_ONE!r}, 6) AS t_needed, round({NEED!r} * se, 4) AS detectable_bps, round(CASE WHEN {T_OF_ONE!r} - abs(e / se) >= 0 THEN {HALF_TAIL} ELSE 1 - {HALF_TAIL} END, 6) AS power, trades, round(top, 6) AS top_decile_share FROM te, th""")
def trade_edge(spark, sf):
    t = L.round_trips(_ledger(spark, sf), PAIR, "d").withColumn("y", F.year("entry"))
    return Y.trade_edge(t, "y", tests=300).select(*r6("edge_bps", "cluster_t", n=5), *r6("t_needed", "power", "top_decile_share"), *r6("detectable_bps", n=4), "trades")


@query(f"""WITH RECURSIVE {LEDGER}, v AS (SELECT ticker, d, dollar_volume FROM bars) SELECT led.t1, led.t2, led.d, round(traded, 4) AS traded, round(traded / nullif(dollar_volume, 0), 8) AS participation FROM led JOIN v ON v.ticker = led.t1 AND v.d = led.d WHERE traded > 0""", dates="d")
def participation(spark, sf):
    t = _ledger(spark, sf).where("traded > 0").select(F.col("t1").alias("ticker"), *PAIR, "d", "traded")
    return Y.participation(t, W.bars(spark, sf), ["ticker", "d"]).select(*PAIR, "d", *r6("traded", n=4), *r6("participation", n=8))


@query(f"""WITH {W.RESID}, e AS (SELECT t1, t2, var_samp(x) AS v FROM (SELECT t1, t2, resid - lag(resid) OVER (PARTITION BY t1, t2 ORDER BY d) AS x FROM resid) GROUP BY ALL), g AS (SELECT *, (1 / v) / sum(1 / v) OVER () AS g FROM e), h AS (SELECT *, least(g, 0.004) AS h FROM g)
SELECT t1, t2, round(v, 2) AS resid_var, round(g, 9) AS inv_var_weight, round(h / sum(h) OVER (), 9) AS weight FROM h""")
def one_pass_weights(spark, sf):
    out = P.suggested_weights(W.resid(spark, sf), PAIR, "d", "inv_var", 0.004, "price_units", "one_pass")
    return out.select(*PAIR, *r6("resid_var", n=2), *r6("inv_var_weight", "weight", n=9))


# ------------------------------------------------------------------ plot data


@query(f"""WITH RECURSIVE {SIGNALS}, x AS (SELECT *, coalesce(n1 - lag(n1) OVER w, n1) AS s1, coalesce(n2 - lag(n2) OVER w, n2) AS s2, P1 / first_value(P1) OVER w * 100 AS v1, P2 / first_value(P2) OVER w * 100 AS v2 FROM sig WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)),
l AS (SELECT t1, t2, d, 1 AS leg, s1 AS s, v1 AS v, abs(s1) * P1 AS n FROM x UNION ALL SELECT t1, t2, d, 2, s2, v2, abs(s2) * P2 FROM x)
SELECT t1, t2, d, leg, CASE WHEN s > 0 THEN 'buy' ELSE 'sell' END AS side, round(v, 5) AS level, round(n, 3) AS notional, round(least(greatest(n * 0.002, 20), 220), 5) AS size FROM l WHERE abs(s) > 1e-9""", dates="d")
def trade_markers(spark, sf):
    return D.trade_markers(W.pairs(spark, sf), _signals(spark, sf), PAIR, "d").select(*PAIR, "d", "leg", "side", *r6("level", "size", n=5), *r6("notional", n=3))


@query(f"""WITH RECURSIVE {SIGNALS}, x AS (SELECT *, coalesce(lead(d) OVER w, d) AS nd, pos <> 0 AS held, coalesce(lag(pos <> 0) OVER w, false) AS was FROM sig WINDOW w AS (PARTITION BY t1, t2 ORDER BY d)), r AS (SELECT *, sum(CAST(held AND NOT was AS INTEGER)) OVER (PARTITION BY t1, t2 ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT t1, t2, min(d) AS start, max(nd) AS ended FROM r WHERE held GROUP BY t1, t2, run""", dates="start ended")
def position_spans(spark, sf):
    return D.position_spans(_signals(spark, sf), PAIR, "d").select(*PAIR, "start", F.col("end").alias("ended"))


@query(f"""WITH {W.Z}, g AS (SELECT t1, t2, least(greatest(coalesce(greatest(abs(quantile_cont(z, 0.005)), abs(quantile_cont(z, 0.995))), 1), 2.5) * 1.18, 3.2) AS span FROM zs GROUP BY ALL) SELECT zs.t1, zs.t2, round(any_value(span), 6) AS span, count(*) FILTER (abs(z) > span) AS beyond FROM zs JOIN g USING (t1, t2) GROUP BY ALL""")
def z_axis(spark, sf):
    return D.z_limits(W.zs(spark, sf), PAIR, levels=(1.5, 0.5, 2.5), most=3.2).select(*PAIR, *r6("span"), "beyond")
