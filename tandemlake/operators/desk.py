"""Books of a desk: session books, allocation targets, the netted book of many pairs, factor days, communities, plot data."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ session books


def open_close_book(df: DataFrame, keys: list[str], capital: float = 1.0) -> DataFrame:
    """Book A. df (keys: a formation, name, weight, r: from it to the close, cost_bps) -> keys, pnl_gross, cost, traded, gross, n:
    positions are opened at the formation and closed at the session's end, so all is traded twice."""
    w = F.coalesce(F.col("weight"), F.lit(0.0)) * capital
    r = F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))
    out = df.groupBy(*keys).agg(F.sum(w * r).alias("pnl_gross"), F.sum(F.abs(w) * F.coalesce("cost_bps", F.lit(0.0))).alias("_c"), F.sum(F.abs(w)).alias("gross"), F.count_if(w != 0).alias("n"))
    return out.select(*keys, "pnl_gross", (2 * F.col("_c") / 1e4).alias("cost"), (2 * F.col("gross")).alias("traded"), "gross", "n")


def intraday_book(df: DataFrame, session: str, slot: str, name: str, capital: float = 1.0) -> DataFrame:
    """Book C. df (session, slot, name, weight, r: from the slot to the next, cost_bps) -> session, slot, pnl_gross, cost, traded, gross, n:
    weights are met at each slot and all is flat at the session's close. A name without a row in a slot has no position there.

    The slots of a session are numbered, and a trade is the difference to the slot before: a join, no loop.
    """
    d = df.select(session, slot, name, (F.coalesce("weight", F.lit(0.0)) * capital).alias("w"), F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("r"), F.coalesce("cost_bps", F.lit(0.0)).alias("c"))
    slots = d.select(session, slot).distinct().withColumn("i", F.row_number().over(Window.partitionBy(session).orderBy(slot)))
    slots = slots.withColumn("last", F.max("i").over(Window.partitionBy(session)))
    d = d.join(slots, [session, slot])
    before = d.select(session, name, (F.col("i") + 1).alias("i"), F.col("w").alias("w0"), F.col("c").alias("c0"))
    both = d.join(before, [session, name, "i"], "full_outer").withColumns({"w": F.coalesce("w", F.lit(0.0)), "w0": F.coalesce("w0", F.lit(0.0)), "cost_bps": F.coalesce("c", "c0")})
    closes = F.coalesce(F.col("i") == F.col("last"), F.lit(False))
    moved = F.abs(F.col("w") - F.col("w0")) + F.when(closes, F.abs("w")).otherwise(0.0)
    g = both.where(f"`{slot}` is not null or w0 <> 0").groupBy(session, "i").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("pnl_gross"), F.sum(moved * F.col("cost_bps") / 1e4).alias("cost"), F.sum(moved).alias("traded"), F.sum(F.abs("w")).alias("gross"), F.count_if(F.col("w") != 0).alias("n"))
    return slots.join(g, [session, "i"]).select(session, slot, "pnl_gross", "cost", "traded", "gross", "n")


def overnight_book(df: DataFrame, group: str, ts: str, phi: float = 1.0, capital: float = 1.0, borrow_bps: float = 0.0, days: float = 252.0) -> DataFrame:
    """Book B. df (group, ts, name, weight, r: to the next formation, cost_bps) -> group, ts, pnl_gross, cost, borrow, traded, gross, n:
    positions move a share phi to the target and are scaled to the capital; what becomes tiny is dropped. The vector of positions is
    the state, so a group is one task's."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = lambda c: pdf.pivot_table(index=ts, columns="name", values=c, aggfunc="last")
        target = wide("weight").fillna(0.0).sort_index()
        like = lambda c: wide(c).reindex(index=target.index, columns=target.columns)
        r, cost = like("r").fillna(0.0).to_numpy(), like("cost_bps").ffill().bfill().fillna(0.0).to_numpy()
        old, out = np.zeros(target.shape[1]), []
        for i, (day, t) in enumerate(zip(target.index, target.to_numpy() * capital)):
            w = old + phi * (t - old)
            gross = np.abs(w).sum()
            w = w * (capital / gross) if gross > 0 else w
            w[np.abs(w) < 1e-9] = 0.0
            moved = np.abs(w - old)
            out.append((pdf[group].iloc[0], day, w @ r[i], moved @ cost[i] / 1e4, -w[w < 0].sum() * borrow_bps / 1e4 / days, moved.sum(), np.abs(w).sum(), int((w != 0).sum())))
            old = w
        return pd.DataFrame(out, columns=[group, ts, "pnl_gross", "cost", "borrow", "traded", "gross", "n"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = f"{group} {kind(group)}, {ts} {kind(ts)}, pnl_gross double, cost double, borrow double, traded double, gross double, n long"
    return df.select(group, ts, "name", "weight", "r", "cost_bps").groupBy(group).applyInPandas(work, schema)


# ------------------------------------------------------------------ allocation targets


def z_size(signals: DataFrame, keys: list[str], ts: str, divisor: float = 2.0) -> DataFrame:
    """signals (keys, ts, pos, z) plus zmult: on the bar that decides a held one, |z| of the trade's entry decision over the divisor,
    1 to 2. The entry decision is the bar before the trade's first; bars that decide nothing have null."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = signals.withColumns({"_next": F.lead("pos").over(w), "_was": F.coalesce(F.lag("pos").over(w), F.lit(0))})
    df = df.withColumn("_enters", (F.col("_next") != 0) & (F.col("_next") != F.col("pos")))
    size = F.least(F.greatest(F.abs("z") / divisor, F.lit(1.0)), F.lit(2.0))
    at_entry = F.last(F.when(F.col("_enters"), size), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("zmult", F.when(F.col("_next") != 0, at_entry)).drop("_next", "_was", "_enters")


def volatility_target(forecast: DataFrame, ts: str, sigma: str, low: float, high: float, skip: str | None = None, warm: int = 1) -> DataFrame:
    """forecast (ts: a formation, sigma) plus median (of the sigmas before, rows with `skip` left out) and scale: median over sigma, within
    bounds; 1 until `warm` formations are known. A row for each formation."""
    w = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(~F.col(skip), F.col(sigma)) if skip else F.col(sigma)
    df = forecast.withColumns({"median": F.percentile(known, F.lit(0.5)).over(w), "_n": F.count(known).over(w)})
    df = df.withColumn("median", F.when(F.col("_n") >= warm, F.col("median")))
    scale = F.when(F.col("median").isNull(), 1.0).otherwise(F.least(F.greatest(F.col("median") / F.col(sigma), F.lit(low)), F.lit(high)))
    return df.withColumn("scale", scale).drop("_n")


def reweighted(returns: DataFrame, formation: str, pair: list[str], ts: str, r: str, updates: list[int], window: int) -> DataFrame:
    """returns (formation, pair, ts, n: the session's number after the formation, 0 and less before it, r) -> formation, pair, update, weight:
    inverse volatilities of the last `window` returns as of each update (0: the formation), in shares of the formation's pairs.

    A pair without a row on an update's session keeps its last volatility.
    """
    own = Window.partitionBy(formation, *pair).orderBy("n")
    f = own.rowsBetween(-(window - 1), 0)
    sd = F.when(F.count(r).over(f) >= window, F.stddev_pop(r).over(f))
    df = returns.withColumn("_sd", sd)
    start = df.where("n <= 0").groupBy(formation, *pair).agg(F.max_by("_sd", "n").alias("_sd")).withColumn("update", F.lit(0))
    later = df.where(F.col("n").isin(updates)).select(formation, *pair, "_sd", F.col("n").cast("int").alias("update"))
    steps = start.select(formation, *pair).withColumn("update", F.explode(F.array(*(F.lit(u) for u in [0, *sorted(updates)]))))
    live = returns.groupBy(formation).agg(F.max("n").alias("_most"))
    steps = steps.join(live, formation).where("update <= _most").drop("_most")
    known = steps.join(start.unionByName(later), [formation, *pair, "update"], "left")
    run = Window.partitionBy(formation, *pair).orderBy("update").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_inv", 1 / F.last("_sd", True).over(run))
    return known.select(formation, *pair, "update", (F.col("_inv") / F.sum("_inv").over(Window.partitionBy(formation, "update"))).alias("weight"))


def reuse_targets(held: DataFrame, group: str, ts: str, name: str, capital: float = 1.0, divisor: float = 4.0, band: float = 0.25, tie: float = 1e-9) -> DataFrame:
    """held (group, ts, name, weight, cur: the position on the bar, nxt: that decided at its close) -> group, ts, name, target, m.

    The weights of what is held at a close are scaled up by m: one over their sum, at most the number of names over the divisor, at
    least 1. A trade that goes on keeps its target unless the new one differs by more than the band; a new trade takes it. The
    targets of a group are the state, so a group is one task's.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n, now, out = pdf[name].nunique(), {}, []
        for day, rows in pdf.sort_values([ts, name]).groupby(ts, sort=True):
            on = rows[rows["nxt"] != 0]
            total = float(on["weight"].sum())
            m = max(1.0, min(1.0 / total, n / divisor)) if total > 0 else np.nan
            for x, w, cur, nxt in zip(on[name], on["weight"], on["cur"], on["nxt"]):
                new = w * m * capital
                if cur != nxt or x not in now or abs(new - now[x]) > band * now[x] * (1 + tie):
                    now[x] = new
                out.append((pdf[group].iloc[0], day, x, now[x], m))
            for x in rows.loc[rows["nxt"] == 0, name]:
                now.pop(x, None)
        return pd.DataFrame(out, columns=[group, ts, name, "target", "m"])

    kind = lambda c: held.schema[c].dataType.simpleString()
    return held.select(group, ts, name, "weight", "cur", "nxt").groupBy(group).applyInPandas(work, f"{group} {kind(group)}, {ts} {kind(ts)}, {name} {kind(name)}, target double, m double")


# ------------------------------------------------------------------ the netted book


def netted_orders(ledger: DataFrame, keys: list[str], ts: str, rates: DataFrame) -> DataFrame:
    """ledger (keys with t1 and t2, ts, P1, P2, dn1, dn2) and rates (ticker, bps) -> ts, ticker, dn, px, bps, cost: the orders of all pairs in a
    ticker at one close, netted before they cost."""
    legs = [ledger.where(f"dn{k} <> 0").select(ts, F.col(f"t{k}").alias("ticker"), F.col(f"dn{k}").alias("dn"), F.col(f"P{k}").alias("px")) for k in (1, 2)]
    net = legs[0].unionByName(legs[1]).groupBy(ts, "ticker").agg(F.sum("dn").alias("dn"), F.min("px").alias("px"))
    return net.join(rates.select("ticker", "bps"), "ticker", "left").withColumn("cost", F.abs("dn") * F.col("px") * F.col("bps") / 1e4)


def assembled_book(ledger: DataFrame, keys: list[str], ts: str, rates: DataFrame, capital: float) -> DataFrame:
    """ledger of all pairs (as from book(), with t1 and t2 among the keys) -> the book by session: gross, cost, cost_net (orders netted by
    ticker), pnl, pnl_netted, returns on the capital, borrow, dividends, traded, gross_notional, net_notional, n_priced, n_held,
    top_ticker_notional."""
    sums = ["borrow", "dividends", "gross_notional", "net_notional", "cost"]
    day = ledger.groupBy(ts).agg(F.sum(F.col("pnl_price") - F.col("borrow") + F.col("dividends")).alias("gross"), *(F.sum(c).alias(c) for c in sums), F.sum(F.col("traded_notional_1") + F.col("traded_notional_2")).alias("traded"), F.count("*").alias("n_priced"), F.count_if(F.col("pos") != 0).alias("n_held"))
    net = netted_orders(ledger, keys, ts, rates).groupBy(ts).agg(F.sum("cost").alias("cost_net"))
    legs = [ledger.where(f"notional_{k} > 0").select(ts, F.col(f"t{k}").alias("ticker"), F.col(f"notional_{k}").alias("v")) for k in (1, 2)]
    top = legs[0].unionByName(legs[1]).groupBy(ts, "ticker").agg(F.sum("v").alias("v")).groupBy(ts).agg(F.max("v").alias("top_ticker_notional"))
    out = day.join(net, ts, "left").join(top, ts, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cost_net", "top_ticker_notional")})
    out = out.withColumns({"pnl": F.col("gross") - F.col("cost"), "pnl_netted": F.col("gross") - F.col("cost_net")})
    return out.withColumns({"ret": F.col("pnl") / capital, "ret_netted": F.col("pnl_netted") / capital})


def book_trips(ledger: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """A row for each trade of a book(): keys, trade_id, entry, exit (null: still open), rows, resizes, pnl_price, borrow, dividends, cost, traded.
    The print that closes a trade belongs to the trade, though it stands on the bar after its last."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = ledger.withColumns({"_before": F.coalesce(F.lag("trade_id").over(w), F.lit(0)), "_traded": F.col("traded_notional_1") + F.col("traded_notional_2")})
    held = df.where("trade_id > 0").groupBy(*keys, "trade_id").agg(F.min(ts).alias("entry"), F.count("*").alias("rows"), F.count_if("resize").alias("resizes"), *(F.sum(c).alias(c) for c in ("pnl_price", "borrow", "dividends")))
    payer = F.when(F.col("exit"), F.col("_before")).otherwise(F.col("trade_id"))
    paid = df.withColumn("_payer", payer).where("_payer > 0").groupBy(*keys, F.col("_payer").alias("trade_id")).agg(F.sum("cost").alias("cost"), F.sum("_traded").alias("traded"), F.min(F.when(F.col("exit"), F.col(ts))).alias("exit"))
    return held.join(paid, [*keys, "trade_id"])


# ------------------------------------------------------------------ factor days


def factor_day(returns: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regression of each name's returns (days by names) on a constant and the factors that weights (names by factors) make of them:
    coefficients (constant first), residuals and R2 by name."""
    x = np.column_stack([np.ones(len(returns)), returns @ weights])
    beta, *_ = np.linalg.lstsq(x, returns, rcond=None)
    resid = returns - x @ beta
    return beta, resid, 1 - resid.var(axis=0) / (returns.var(axis=0) + 1e-18)


def forward_targets(df: DataFrame, keys: list[str], ts: str, r: str, fitted: str | None = None, alpha: str | None = None, horizons: Iterable[int] = (1, 5)) -> DataFrame:
    """df plus raw<h> (the sum of the next h returns), and with fitted (the return that factors explain) fwd<h>, the hedged one, and with alpha
    (the regression's constant) fwd<h>_alpha, less that as well; null where fewer than h returns follow."""
    w = Window.partitionBy(*keys).orderBy(ts)
    out = df
    for h in horizons:
        f = w.rowsBetween(1, h)
        ahead = lambda c: F.when(F.count(c).over(f) >= h, F.sum(c).over(f))
        out = out.withColumn(f"raw{h}", ahead(F.col(r)))
        if fitted:
            out = out.withColumn(f"fwd{h}", ahead(F.col(r) - F.col(fitted)))
        if fitted and alpha:
            out = out.withColumn(f"fwd{h}_alpha", ahead(F.col(r) - F.col(fitted)) - h * F.col(alpha))
    return out


def factor_days_by(df: DataFrame, group: str, name: str, ts: str, r: str, weights: DataFrame) -> DataFrame:
    """df (group, name, ts, r: a formation's window) and weights (group, factor, name, weight) -> group, name, term (const, f0, ...), loading, r2
    over the names that have every day; a window is one task's."""

    def work(pdf: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=[group, "name", "term", "loading", "r2"])
        if not len(pdf) or not len(w):
            return none
        m = pdf.pivot_table(index=ts, columns=name, values=r).dropna(axis=1)
        q = w.pivot_table(index="name", columns="factor", values="weight").reindex(m.columns).dropna()
        m = m[q.index]
        if m.shape[1] < 2:
            return none
        beta, _, r2 = factor_day(m.to_numpy(), q.to_numpy())
        terms = ["const", *(f"f{c}" for c in q.columns)]
        return pd.DataFrame([(w[group].iloc[0], c, t, beta[i, j], r2[j]) for j, c in enumerate(m.columns) for i, t in enumerate(terms)], columns=none.columns)

    left, right = df.select(group, name, ts, r), weights.select(group, "factor", "name", "weight")
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(work, f"{group} {df.schema[group].dataType.simpleString()}, name string, term string, loading double, r2 double")


# ------------------------------------------------------------------ communities


def communities(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Greedy modularity: every node starts alone, and the two communities whose union raises the modularity most are merged until none
    does. Numbers by size, the largest first, then by the least name. Ties go to the union of the least names."""
    nodes = sorted({x for i, j, _ in edges for x in (i, j)})
    total = sum(w for _, _, w in edges)
    if total <= 0:
        return {x: k for k, x in enumerate(nodes)}
    between: dict[str, dict[str, float]] = {x: {} for x in nodes}
    degree = dict.fromkeys(nodes, 0.0)
    for i, j, w in edges:
        if i != j:
            between[i][j] = between[i].get(j, 0.0) + w
            between[j][i] = between[j].get(i, 0.0) + w
        degree[i] += w
        degree[j] += w
    members = {x: [x] for x in nodes}
    while True:
        best = max(((w / total - degree[i] * degree[j] / (2 * total**2), i, j) for i, row in between.items() for j, w in row.items() if i < j), key=lambda g: (g[0], [-ord(c) for c in g[1] + "\0" + g[2]]), default=(0.0, "", ""))
        if best[0] <= 1e-12:
            break
        _, i, j = best
        members[i] = sorted(members[i] + members.pop(j))
        degree[i] += degree.pop(j)
        for k, w in between.pop(j).items():
            del between[k][j]
            if k != i:
                between[i][k] = between[k][i] = between[i].get(k, 0.0) + w
    order = sorted(members.values(), key=lambda m: (-len(m), m[0]))
    return {x: k for k, m in enumerate(order) for x in m}


def communities_by(edges: DataFrame, group: str) -> DataFrame:
    """edges (group, i, j, w) -> group, node, community; a group's graph is one task's."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        got = communities([(i, j, float(w)) for i, j, w in zip(pdf["i"], pdf["j"], pdf["w"]) if w == w])
        return pd.DataFrame({group: pdf[group].iloc[0], "node": list(got), "community": list(got.values())})

    return edges.select(group, "i", "j", "w").groupBy(group).applyInPandas(work, f"{group} {edges.schema[group].dataType.simpleString()}, node string, community int")


# ------------------------------------------------------------------ data behind the plots


def trade_markers(pairs: DataFrame, signals: DataFrame, keys: list[str], ts: str, scale: float = 0.002, low: float = 20.0, high: float = 220.0, base: float = 100.0) -> DataFrame:
    """pairs (keys, ts, P1, P2) and signals (keys, ts, n1, n2) -> a marker for each bar and leg on which shares change: keys, ts, leg, side (buy
    or sell), shares, level (the price, with the pair's first bar at `base`), notional, size (notional times scale, within low and high)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.where("P1 is not null and P2 is not null").select(*keys, ts, "P1", "P2").join(signals.select(*keys, ts, "n1", "n2"), [*keys, ts], "left")
    moved = lambda k: F.coalesce(F.col(f"n{k}") - F.lag(f"n{k}").over(w), F.col(f"n{k}"))
    rows = rows.withColumns({f"s{k}": moved(k) for k in (1, 2)} | {f"v{k}": F.col(f"P{k}") / F.first(f"P{k}").over(run) * base for k in (1, 2)})
    legs = [rows.select(*keys, ts, F.lit(k).alias("leg"), F.col(f"s{k}").alias("shares"), F.col(f"v{k}").alias("level"), (F.abs(f"s{k}") * F.col(f"P{k}")).alias("notional")) for k in (1, 2)]
    m = legs[0].unionByName(legs[1]).where("abs(shares) > 1e-9")
    size = F.least(F.greatest(F.col("notional") * scale, F.lit(low)), F.lit(high))
    return m.select(*keys, ts, "leg", F.when(F.col("shares") > 0, "buy").otherwise("sell").alias("side"), "shares", "level", "notional", size.alias("size"))


def position_spans(signals: DataFrame, keys: list[str], ts: str, pos: str = "pos") -> DataFrame:
    """Runs of bars with a position: keys, start, end; the end is the first bar without one, or the last bar of the pair."""
    w = Window.partitionBy(*keys).orderBy(ts)
    on = F.coalesce(F.col(pos) != 0, F.lit(False))
    df = signals.withColumns({"_on": on, "_next": F.coalesce(F.lead(ts).over(w), F.col(ts))})
    new = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    runs = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    return runs.groupBy(*keys, "_run").agg(F.min(ts).alias("start"), F.max("_next").alias("end")).drop("_run")


def z_limits(df: DataFrame, keys: list[str], z: str = "z", levels: tuple[float, ...] = (), tail: float = 0.005, room: float = 1.18, most: float = 15.0) -> DataFrame:
    """keys, span (a z axis goes from -span to span: the wider tail quantile of the finite values and the drawn levels, with some room, at
    most `most`) and beyond, the number of bars outside."""
    ok = F.col(z).isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))
    x = F.when(ok, F.col(z))
    wide = F.greatest(F.abs(F.percentile(x, F.lit(tail))), F.abs(F.percentile(x, F.lit(1 - tail))))
    g = df.groupBy(*keys).agg(wide.alias("_w")).withColumn("_w", F.greatest(F.coalesce("_w", F.lit(1.0)), F.lit(max([0.0, *map(abs, levels)]))))
    span = g.select(*keys, F.least(F.col("_w") * room, F.lit(abs(most))).alias("span"))
    return df.join(span, keys).groupBy(*keys).agg(F.first("span").alias("span"), F.count_if(F.abs(F.when(~F.isnan(z), F.col(z))) > F.col("span")).alias("beyond"))
