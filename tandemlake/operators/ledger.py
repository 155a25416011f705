"""Profit and loss: ledgers, round trips, summaries, books, circuit breakers. Windows and aggregates only, but for the band book."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import market_impact, ratio, rows


@dataclass(frozen=True)
class Costs:
    cost_bps: float = 0.0
    fee_1: float = 0.0
    fee_2: float = 0.0
    borrow_bps: float = 0.0
    days_per_year: float = 252.0
    adv_1: float | None = None
    adv_2: float | None = None
    impact_eta: float = 0.14
    impact_window: int = 63
    capital_base: float | None = None
    capital_percentile: float = 0.5
    min_capital: float = 1.0
    periods_per_year: float | None = None

    def __post_init__(self):
        if not 0 < self.capital_percentile < 1:
            raise ValueError("capital_percentile must lie between 0 and 1")
        if self.capital_base is not None and not 0 < self.capital_base < float("inf"):
            raise ValueError("capital_base must be positive and finite")

    @property
    def periods(self) -> float:
        return self.periods_per_year or self.days_per_year


def check_alignment(prices: DataFrame, signals: DataFrame, keys: list[str], ts: str = "ts") -> None:
    """Refuse signals without a price row and repeated timestamps: two small actions, each an aggregate or an anti-join."""
    on = [*keys, ts]
    if signals.join(prices.select(*on), on, "left_anti").limit(1).count():
        raise ValueError("signals are not aligned to prices")
    for df, name in ((prices, "prices"), (signals, "signals")):
        if df.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} repeat a timestamp")


def _closed_opened(now: str, before: Column) -> tuple[Column, Column]:
    """Shares that a print closes and opens; a change of sign closes all and opens anew."""
    a, b = F.abs(before), F.abs(F.col(now))
    same = before * F.col(now) >= 0
    return F.when(same, F.greatest(F.lit(0.0), a - b)).otherwise(a), F.when(same, F.greatest(F.lit(0.0), b - a)).otherwise(b)


def daily_ledger(prices: DataFrame, signals: DataFrame, keys: list[str], costs: Costs = Costs(), ts: str = "ts") -> DataFrame:
    """prices (keys, ts, P1, P2), signals (keys, ts, n1, n2, z?) -> the ledger by bar; see the columns at the end.

    Signals meet prices by a left join; bars with an unusable price fall out first, as the ledger is between usable ones.
    """
    on = [*keys, ts]
    held = signals.select(*on, "n1", "n2", *(["z"] if "z" in signals.columns else []))
    df = prices.select(*on, "P1", "P2").join(held, on, "left")
    df = df.where(_priced(F.col("P1")) & _priced(F.col("P2"))).withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in ("n1", "n2")})
    w = Window.partitionBy(*keys).orderBy(ts)
    every = Window.partitionBy(*keys)
    lag0 = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    diff = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    df = df.withColumns({"m1": lag0("n1"), "m2": lag0("n2"), "dP1": diff("P1"), "dP2": diff("P2"), "r1": F.coalesce(F.log(F.col("P1") / F.lag("P1").over(w)), F.lit(0.0)), "r2": F.coalesce(F.log(F.col("P2") / F.lag("P2").over(w)), F.lit(0.0))})
    (c1, o1), (c2, o2) = _closed_opened("n1", F.col("m1")), _closed_opened("n2", F.col("m2"))
    df = df.withColumns({"dn1": F.col("n1") - F.col("m1"), "dn2": F.col("n2") - F.col("m2"), "close_notional": c1 * F.col("P1") + c2 * F.col("P2"), "open_notional": o1 * F.col("P1") + o2 * F.col("P2")})

    def impact(leg: int, adv: float | None) -> Column:
        if not adv or adv <= 0:
            return F.lit(0.0)
        r, f = F.col(f"r{leg}"), rows(w, costs.impact_window)
        vol = F.coalesce(F.when(F.count(r).over(f) >= 5, F.stddev_samp(r).over(f)), F.stddev_samp(r).over(every))
        return F.coalesce(market_impact(F.col(f"dn{leg}"), F.col(f"P{leg}"), F.lit(float(adv)), vol * (costs.periods**0.5) * 1e4, costs.impact_eta), F.lit(0.0))

    short = F.greatest(-F.col("n1"), F.lit(0.0)) * F.col("P1") + F.greatest(-F.col("n2"), F.lit(0.0)) * F.col("P2")
    df = df.withColumns(
        {
            "pnl_gross": F.col("n1") * F.col("dP1") + F.col("n2") * F.col("dP2"),
            "traded": F.abs("dn1") * F.col("P1") + F.abs("dn2") * F.col("P2"),
            "impact_cost": impact(1, costs.adv_1) + impact(2, costs.adv_2),
            "borrow": short * (costs.borrow_bps / 1e4) / costs.days_per_year,
            "gross_exposure": F.abs("n1") * F.col("P1") + F.abs("n2") * F.col("P2"),
            "net_exposure": F.col("n1") * F.col("P1") + F.col("n2") * F.col("P2"),
            "in_pos": ((F.col("n1") != 0) | (F.col("n2") != 0)).cast("int"),
            "side": F.when(F.col("n1") != 0, F.signum("n1")).otherwise(F.signum("n2")).cast("int"),
        }
    )
    df = df.withColumn("trade_cost", costs.cost_bps / 1e4 * F.col("traded") + costs.fee_1 * F.abs("dn1") + costs.fee_2 * F.abs("dn2") + F.col("impact_cost"))
    df = df.withColumn("close_cost", F.coalesce(F.col("trade_cost") * ratio("close_notional", F.col("close_notional") + F.col("open_notional")), F.lit(0.0)))
    df = df.withColumn("cost", F.col("trade_cost") + F.col("borrow")).withColumn("pnl_net", F.col("pnl_gross") - F.col("cost"))
    q = F.lit(costs.capital_percentile)
    base = F.lit(float(costs.capital_base)) if costs.capital_base else F.coalesce(F.percentile(F.when(F.col("in_pos") == 1, F.col("gross_exposure")), q).over(every), F.percentile("gross_exposure", q).over(every))
    df = df.withColumn("capital_base", base).withColumn("capital_base", F.when(F.col("capital_base") > 0, F.col("capital_base")).otherwise(costs.min_capital))
    df = df.withColumns({"ret_gross": F.col("pnl_gross") / F.col("capital_base"), "ret_net": F.col("pnl_net") / F.col("capital_base"), "equity": F.sum("pnl_net").over(w.rowsBetween(Window.unboundedPreceding, 0)), "turnover": F.col("traded") / F.col("capital_base")})
    df = df.withColumn("portfolio", F.col("capital_base") + F.col("equity")).withColumn("peak", F.max("portfolio").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"drawdown": F.col("portfolio") - F.col("peak"), "drawdown_pct": F.coalesce(ratio("portfolio", "peak") - 1, F.lit(0.0))})
    shown = ["pnl_gross", "cost", "impact_cost", "pnl_net", "ret_gross", "ret_net", "equity", "portfolio", "gross_exposure", "net_exposure", "turnover", "in_pos", "drawdown", "drawdown_pct"]
    return df.select(*on, "P1", "P2", "n1", "n2", *(["z"] if "z" in df.columns else []), *shown, "side", "capital_base", "traded", "borrow", "trade_cost", "close_cost", "close_notional")


def round_trips(ledger: DataFrame, keys: list[str], ts: str = "ts", reversals: bool = True) -> DataFrame:
    """Trades: each entry with the first exit after it; a reversal is both. An entry without an exit is dropped.

    The trade's number is a running count of entries, so the whole is one window over the ledger and one aggregate.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    was, side0 = F.coalesce(F.lag("in_pos").over(w), F.lit(0)), F.lag("side").over(w)
    turn = (F.col("in_pos") == 1) & (was == 1) & (F.col("side") != side0) if reversals else F.lit(False)
    df = ledger.withColumns({"enters": ((F.col("in_pos") == 1) & (was == 0)) | turn, "leaves": ((F.col("in_pos") == 0) & (was == 1)) | turn})
    df = df.withColumn("trade", F.sum(F.col("enters").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = w
    df = df.withColumns({"next_leaves": F.lead("leaves").over(after), "next_ts": F.lead(ts).over(after), "next_close": F.lead("close_cost").over(after), "next_closed": F.lead("close_notional").over(after), "z_here": F.col("z") if "z" in ledger.columns else F.lit(None).cast("double")})
    held = df.where("in_pos = 1")
    t = Window.partitionBy(*keys, "trade").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("dip", F.col("portfolio") - F.max("portfolio").over(t))
    first = lambda c: F.min_by(c, ts)
    last = lambda c: F.max_by(c, ts)
    out = held.groupBy(*keys, "trade").agg(
        F.min(ts).alias("entry"),
        last("next_ts").alias("exit"),
        last("next_leaves").alias("_closed"),
        first("side").alias("side"),
        F.count("*").alias("bars"),
        F.sum("pnl_gross").alias("pnl_gross"),
        (F.sum("trade_cost") - first("close_cost") + last("next_close") + F.sum("borrow")).alias("cost"),
        first("z_here").alias("z_at_entry"),
        last("z_here").alias("z_prev_exit"),
        F.min("dip").alias("pae"),
        (F.sum("turnover") + last("next_closed") / first("capital_base")).alias("turnover"),
        first("capital_base").alias("_base"),
    )
    out = out.where("_closed").withColumn("pnl_net", F.col("pnl_gross") - F.col("cost"))
    return out.withColumn("ret_on_cap", F.col("pnl_net") / F.col("_base")).drop("_closed", "_base", "trade")


def summary(ledger: DataFrame, trades: DataFrame, keys: list[str], costs: Costs = Costs(), ts: str = "ts") -> DataFrame:
    """One row for each pair: risk and return of the ledger (population deviations), and statistics of its round trips."""
    p = costs.periods
    sharpe = lambda sd: F.when(sd > 0, F.avg("ret_net") / sd * p**0.5)
    sd, down = F.stddev_pop("ret_net"), F.stddev_pop(F.least("ret_net", F.lit(0.0)))
    a = ledger.groupBy(*keys).agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.count("*").alias("bars"),
        F.first("capital_base").alias("capital_base"),
        F.sum("pnl_gross").alias("gross_pnl"),
        F.sum("pnl_net").alias("net_pnl"),
        (F.pow(F.product(1 + F.col("ret_net")), p / F.count("*")) - 1).alias("ann_return"),
        sharpe(sd).alias("sharpe"),
        F.when(sd > 0, sd * p**0.5).alias("ann_vol"),
        sharpe(down).alias("sortino"),
        (-F.min("drawdown")).alias("max_drawdown"),
        (-F.min("drawdown_pct")).alias("max_drawdown_pct"),
        F.avg("gross_exposure").alias("avg_gross_exposure"),
        F.coalesce(F.avg(F.when(F.col("in_pos") == 1, F.col("gross_exposure"))) / F.first("capital_base"), F.lit(0.0)).alias("avg_exposure_utilization"),
        (F.sum("turnover") * p / F.count("*")).alias("turnover_annualized"),
        F.avg("traded").alias("avg_daily_dollars_traded"),
        F.sum("impact_cost").alias("impact_cost_total"),
    )
    win, lose = F.col("pnl_net") > 0, F.col("pnl_net") <= 0
    b = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.avg(win.cast("double")).alias("hit_rate"),
        F.coalesce(F.avg(F.when(win, F.col("pnl_net"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(lose, F.col("pnl_net"))), F.lit(0.0)).alias("avg_loss"),
        F.when(F.count_if(lose) == 0, float("inf")).otherwise(ratio(F.coalesce(F.sum(F.when(win, F.col("pnl_net"))), F.lit(0.0)), -F.sum(F.when(lose, F.col("pnl_net"))))).alias("profit_factor"),
        F.avg("bars").alias("avg_hold_bars"),
        F.median("bars").alias("med_hold_bars"),
    )
    return a.join(b, keys, "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))


# ------------------------------------------------------------------ books


def with_dividends(df: DataFrame, dividends: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """df plus D1 and D2 of dividends (keys, ts, D1, D2); a NaN or null amount is none, but a row of df that dividends don't have is
    refused when it is read."""
    on = [*keys, ts]
    out = df.drop("D1", "D2").join(dividends.select(*on, F.struct("D1", "D2").alias("_d")), on, "left")
    amount = lambda c: F.coalesce(F.nanvl(F.col(f"_d.{c}").cast("double"), F.lit(0.0)), F.lit(0.0))
    missing = F.raise_error(F.concat(F.lit("dividends do not cover the ledger at "), F.col(ts).cast("string"))).cast("double")
    return out.withColumns({c: F.when(F.col("_d").isNull(), missing).otherwise(amount(c)) for c in ("D1", "D2")}).drop("_d")


def _priced(c: Column) -> Column:
    """A finite price above zero."""
    return F.coalesce(~F.isnan(c) & (c > 0) & (c != float("inf")), F.lit(False))


def book(df: DataFrame, keys: list[str], reset: str = "daily", band: float = 0.1, cost_bps: tuple[float, float] = (0.0, 0.0), borrow_bps: float = 50.0, days_per_year: float = 252.0, ts: str = "ts") -> DataFrame:
    """df (keys, ts, P1, P2, pos, beta, target, D1?, D2?) -> the book ledger: the decision at a bar's close sizes the next bar.

    daily sizes anew on each bar, frozen keeps the shares of the trade's first bar (both by windows), band sizes anew when
    the gross leaves the target by more than the band (a fold over the pair's bars). Shares are found on all bars; the ledger,
    its entries, exits and trade numbers are between bars with usable prices. A position that can't be sized (on the first bar, or
    after a bar without usable prices, beta or target) is refused when it is read, and so is a pos other than -1, 0 and 1.
    """
    if reset not in ("daily", "frozen", "band"):
        raise ValueError("reset must be daily, frozen or band")
    if not 0 <= band < float("inf") or days_per_year <= 0 or not 0 <= borrow_bps < float("inf") or not all(0 <= c < float("inf") for c in cost_bps):
        raise ValueError("band, borrow_bps and cost_bps must be finite and not negative, days_per_year positive")
    w = Window.partitionBy(*keys).orderBy(ts)
    for d in ("D1", "D2"):
        df = df if d in df.columns else df.withColumn(d, F.lit(0.0))
    df = df.select(*keys, ts, "P1", "P2", F.col("pos").cast("int").alias("pos"), "beta", "target", F.coalesce("D1", F.lit(0.0)).alias("D1"), F.coalesce("D2", F.lit(0.0)).alias("D2"))
    prev = F.coalesce(F.lag("pos").over(w), F.lit(0))
    finite_ = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    known = _priced(F.col("P1")) & _priced(F.col("P2")) & finite_(F.col("beta")) & finite_(F.col("target")) & (F.col("target") >= 0)
    df = df.withColumns({"_known": F.coalesce(F.lag(known).over(w), F.lit(False)), "_s": F.lag(F.col("target") / (F.col("P1") + F.abs("beta") * F.col("P2"))).over(w), "b0": F.lag("beta").over(w), "held": prev == F.col("pos")})
    refused = F.raise_error(F.concat(F.lit("cannot size the position held on "), F.col(ts).cast("string"))).cast("double")
    size = F.when(F.col("pos") == 0, 0.0).when(~F.col("pos").isin(-1, 1), refused)
    if reset == "frozen":
        size = size.when(F.col("held"), F.lit(None).cast("double"))
    df = df.withColumn("n1", size.when(F.col("_known"), F.col("pos") * F.col("_s")).otherwise(refused))
    df = df.withColumn("n2", F.when(F.col("pos") == 0, 0.0).otherwise(-F.col("b0") * F.col("n1")))
    if reset == "frozen":
        df = df.withColumn("_trade", F.sum((~F.col("held")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        t = Window.partitionBy(*keys, "_trade").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({c: F.when(F.col("pos") == 0, 0.0).otherwise(F.first(c).over(t)) for c in ("n1", "n2")}).drop("_trade")
    elif reset == "band":
        schema = df.schema.simpleString()[7:-1].replace(":", " ")

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
            n1, n2 = pdf["n1"].to_numpy(copy=True), pdf["n2"].to_numpy(copy=True)
            p1, p2, pos, target, held = (pdf[c].to_numpy() for c in ("P1", "P2", "pos", "target", "held"))
            for i in range(1, len(pdf)):
                if pos[i] and held[i] and abs(abs(n1[i - 1]) * p1[i - 1] + abs(n2[i - 1]) * p2[i - 1] - target[i - 1]) <= band * target[i - 1]:
                    n1[i], n2[i] = n1[i - 1], n2[i - 1]
            return pdf.assign(n1=n1, n2=n2)

        df = df.groupBy(*keys).applyInPandas(work, schema)
    df = df.where(_priced(F.col("P1")) & _priced(F.col("P2")))
    df = df.withColumns({"entry": (F.col("pos") != 0) & (F.col("pos") != prev), "exit": (prev != 0) & (F.col("pos") != prev)})
    df = df.withColumn("trade_id", F.sum(F.col("entry").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = lambda c, start: F.coalesce(F.col(c) - F.lag(c).over(w), start)
    df = df.withColumns({"dn1": d("n1", F.col("n1")), "dn2": d("n2", F.col("n2")), "pnl_price": F.col("n1") * d("P1", F.lit(0.0)) + F.col("n2") * d("P2", F.lit(0.0))})
    short = F.greatest(-F.col("n1"), F.lit(0.0)) * F.col("P1") + F.greatest(-F.col("n2"), F.lit(0.0)) * F.col("P2")
    df = df.withColumns(
        {
            "traded_notional_1": F.abs("dn1") * F.col("P1"),
            "traded_notional_2": F.abs("dn2") * F.col("P2"),
            "borrow": short * (borrow_bps / 1e4) / days_per_year,
            "dividends": F.col("n1") * F.col("D1") + F.col("n2") * F.col("D2"),
            "notional_1": F.abs("n1") * F.col("P1"),
            "notional_2": F.abs("n2") * F.col("P2"),
            "net_notional": F.col("n1") * F.col("P1") + F.col("n2") * F.col("P2"),
            "resize": (F.col("pos") != 0) & ~F.col("entry") & ((F.col("dn1") != 0) | (F.col("dn2") != 0)),
            "trade_id": F.when(F.col("pos") != 0, F.col("trade_id")).otherwise(0).cast("int"),
        }
    )
    df = df.withColumn("cost", (cost_bps[0] * F.col("traded_notional_1") + cost_bps[1] * F.col("traded_notional_2")) / 1e4)
    df = df.withColumns({"pnl": F.col("pnl_price") - F.col("cost") - F.col("borrow") + F.col("dividends"), "gross_notional": F.col("notional_1") + F.col("notional_2")})
    shown = ["pos", "n1", "n2", "dn1", "dn2", "pnl_price", "cost", "borrow", "dividends", "pnl", "traded_notional_1", "traded_notional_2", "notional_1", "notional_2", "gross_notional", "net_notional", "entry", "exit", "resize", "trade_id"]
    return df.select(*keys, ts, "P1", "P2", *shown)


# ------------------------------------------------------------------ circuit breaker


@dataclass(frozen=True)
class Breaker:
    z_halt: float | None = None
    cooldown: int = 5
    z_reentry: float | None = None
    max_drawdown_pct: float | None = None
    drawdown_window: int = 63
    halt_bars: int = 21
    #: None: that of the ledger.
    capital_base: float | None = 10_000.0

    def __post_init__(self):
        if self.z_halt is not None and self.z_halt <= 0 or self.max_drawdown_pct is not None and not 0 < self.max_drawdown_pct <= 1:
            raise ValueError("z_halt must be positive, max_drawdown_pct between 0 and 1")
        if self.halt_bars < 1 or self.cooldown < 0 or self.drawdown_window < 1:
            raise ValueError("halt_bars and drawdown_window must be 1 or more, cooldown 0 or more")


def z_halts(df: DataFrame, keys: list[str], b: Breaker, ts: str = "ts") -> DataFrame:
    """df (keys, ts, z) plus halted: from a bar with |z| above the limit for cooldown + 1 bars, and on while |z| stays at re-entry or more."""
    w = Window.partitionBy(*keys).orderBy(ts)
    z = F.abs(F.when(~F.isnan("z"), F.col("z")))  # a NaN neither trips nor holds a halt
    trigger = F.coalesce(z > b.z_halt, F.lit(False))
    base = F.coalesce(F.max(trigger.cast("int")).over(w.rowsBetween(-b.cooldown, 0)) == 1, F.lit(False))
    df = df.withColumn("halted", base)
    if b.z_reentry is None:
        return df
    # runs of |z| >= z_reentry: a run goes on being halted if it is halted anywhere before, or follows a halted bar at once
    high = F.coalesce(z >= b.z_reentry, F.lit(False))
    df = df.withColumns({"_high": high, "_before": F.coalesce(F.lag("halted").over(w), F.lit(False))})
    df = df.withColumn("_run", F.sum(F.when(F.col("_high"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(*keys, "_run", "_high").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.col("_high") & (F.max((F.col("halted") | F.col("_before")).cast("int")).over(r) == 1)
    return df.withColumn("halted", F.col("halted") | carried).drop("_high", "_before", "_run")


def drawdown_halts(ledger: DataFrame, keys: list[str], b: Breaker, ts: str = "ts") -> DataFrame:
    """ledger (keys, ts, equity, ...) plus halted: halt_bars bars from one where equity is below its rolling peak by more than the limit."""
    df = drawdown_trips(ledger, keys, b, ts)
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("halted", F.coalesce(F.max("_trip").over(rows(w, b.halt_bars)) == 1, F.lit(False))).drop("_trip")


def drawdown_trips(ledger: DataFrame, keys: list[str], b: Breaker, ts: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts)
    dip = (F.col("equity") - F.max("equity").over(rows(w, b.drawdown_window))) / (F.col("capital_base") if b.capital_base is None else b.capital_base)
    return ledger.withColumn("_trip", (dip < -b.max_drawdown_pct).cast("int"))


def patched(signals: DataFrame, halted: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """signals with pos, n1, n2 flat on halted bars; the flags stay."""
    on = [*keys, ts]
    df = signals.join(halted.select(*on, "halted"), on, "left").withColumn("halted", F.coalesce("halted", F.lit(False)))
    return df.withColumns({c: F.when(F.col("halted"), F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in (("pos", "int"), ("n1", "double"), ("n2", "double"))})


def spans(df: DataFrame, keys: list[str], flag: str, ts: str = "ts") -> DataFrame:
    """Contiguous runs of a true flag: keys, first, last, bars."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    runs = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(flag))
    return runs.groupBy(*keys, "_run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("bars")).drop("_run")


def apply_breaker(signals: DataFrame, prices: DataFrame, keys: list[str], b: Breaker, costs: Costs = Costs(), ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """signals (keys, ts, z, pos, n1, n2, ...) through both halts -> (signals that are flat on halted bars, the audit table).

    The drawdown is that of a shadow ledger of the signals as they were. A bar is halted if either rule halts it; flags of the
    decisions stay. The audit has a row for each run of halted bars: trigger_type (z_halt, drawdown or both, by its first bar),
    z_at_trigger, dd_pct_at_trigger (the shadow ledger's), halt_start, halt_end, n_halted_bars. A pair that is always flat is left
    as it is, and so is everything without limits.
    """
    on, w = [*keys, ts], Window.partitionBy(*keys).orderBy(ts)
    df = signals.withColumn("_active", F.max(F.abs("pos")).over(Window.partitionBy(*keys)) > 0)
    no = F.lit(False)
    if b.z_halt is not None:
        df = z_halts(df, keys, b, ts).withColumnRenamed("halted", "_z")
    if b.max_drawdown_pct is not None:
        shadow = daily_ledger(prices, signals, keys, costs if b.capital_base is None else replace(costs, capital_base=b.capital_base), ts)
        halts = drawdown_halts_on(signals.select(*on).join(shadow, on, "left"), keys, b, ts)
        df = df.join(halts.select(*on, F.col("halted").alias("_dd"), F.col("drawdown_pct").alias("_dd_pct")), on, "left")
    for c, empty in (("_z", no), ("_dd", no), ("_dd_pct", F.lit(None).cast("double"))):
        df = df if c in df.columns else df.withColumn(c, empty)
    df = df.withColumn("halted", F.col("_active") & (F.coalesce("_z", no) | F.coalesce("_dd", no)))
    flat = {c: F.when(F.col("halted"), F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in (("pos", "int"), ("n1", "double"), ("n2", "double"))}
    patched_ = df.withColumns(flat).select(*signals.columns, "halted")
    new = F.col("halted") & ~F.coalesce(F.lag("halted").over(w), no)
    runs = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("halted")
    first = lambda c: F.min_by(c, ts)
    z = F.abs(F.when(~F.isnan("z"), F.col("z"))) if "z" in signals.columns else F.lit(None).cast("double")
    audit = runs.withColumn("_abs_z", z).groupBy(*keys, "_run").agg(first(F.coalesce("_z", no)).alias("a"), first(F.coalesce("_dd", no)).alias("d"), first("_abs_z").alias("_abs_z"), first("_dd_pct").alias("_dd_pct"), F.min(ts).alias("halt_start"), F.max(ts).alias("halt_end"), F.count("*").alias("n_halted_bars"))
    kind = F.when(F.col("a") & F.col("d"), "both").when(F.col("d"), "drawdown").otherwise("z_halt")
    audit = audit.withColumn("trigger_type", kind)
    return patched_, audit.select(
        *keys, "trigger_type", F.when(F.col("trigger_type") != "drawdown", F.col("_abs_z")).alias("z_at_trigger"), F.when(F.col("trigger_type") != "z_halt", F.col("_dd_pct")).alias("dd_pct_at_trigger"), "halt_start", "halt_end", "n_halted_bars",
    )


def drawdown_halts_on(ledger: DataFrame, keys: list[str], b: Breaker, ts: str = "ts") -> DataFrame:
    """drawdown_halts() on bars some of which aren't in the ledger: their equity is null, they trip nothing, and the rolling peak is over
    the ledger's own bars."""
    there = drawdown_trips(ledger.where("equity is not null"), keys, b, ts).select(*keys, ts, "_trip")
    w = Window.partitionBy(*keys).orderBy(ts)
    df = ledger.join(there, [*keys, ts], "left")
    return df.withColumn("halted", F.coalesce(F.max("_trip").over(rows(w, b.halt_bars)) == 1, F.lit(False))).drop("_trip")


# ------------------------------------------------------------------ spread accounting


def decompose_spread(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """df (keys, ts, y1, y2, w1, w2, c, signal) plus spread (w.y - c), book, tradable and revaluation: the change of the spread,
    what the weights of the bar before earn, and the rest. The position is the signal of the bar before; the first bar has nothing."""
    w = Window.partitionBy(*keys).orderBy(ts)
    lag = lambda c: F.lag(c).over(w)
    df = df.withColumn("spread", F.col("w1") * F.col("y1") + F.col("w2") * F.col("y2") - F.col("c"))
    book_ = lag("signal") * (F.col("spread") - lag("spread"))
    tradable = lag("signal") * (lag("w1") * (F.col("y1") - lag("y1")) + lag("w2") * (F.col("y2") - lag("y2")))
    df = df.withColumns({"book": F.coalesce(book_, F.lit(0.0)), "tradable": F.coalesce(tradable, F.lit(0.0))})
    return df.withColumn("revaluation", F.col("book") - F.col("tradable"))


def turnover_and_fees(df: DataFrame, keys: list[str], cost_bps: tuple[float, float], ts: str = "ts") -> DataFrame:
    """df (keys, ts, w1, w2, signal) plus traded_1, traded_2 (dollars by leg) and fees; nothing on the first bar."""
    w = Window.partitionBy(*keys).orderBy(ts)
    moved = lambda c: F.coalesce(F.abs(F.col("signal") * F.col(c) - F.lag(F.col("signal") * F.col(c)).over(w)), F.lit(0.0))
    df = df.withColumns({"traded_1": moved("w1"), "traded_2": moved("w2")})
    return df.withColumn("fees", (F.col("traded_1") * cost_bps[0] + F.col("traded_2") * cost_bps[1]) / 1e4)
