"""The live path: bars from ticks with a watermark, and signals by the same transition function as the batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.models import Hedge
from ..operators.signals import SignalRule, SignalState, delayed, step
from ..sources.lake import CLOSE_MINUTE, EARLY_CLOSE, OPEN_MINUTE


def stream_bars(ticks: DataFrame, minutes: int = 5, late: str = "2 minutes", ts: str = "ts") -> DataFrame:
    """ticks (ticker, ts, px, volume) -> bars by ticker and window of event time; ticks later than the watermark are dropped."""
    w = F.window(ts, f"{minutes} minutes")
    out = ticks.withWatermark(ts, late).groupBy("ticker", w).agg(
        F.min_by("px", ts).alias("open"), F.max_by("px", ts).alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    return out.select("ticker", F.col("window.start").alias("bar"), "open", "close", "high", "low", "volume", "n")


def stream_session_bars(ticks: DataFrame, early: DataFrame | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """ticks (ticker, ts in exchange time, px, volume) -> a bar for each ticker and session: ticker, session, open, close, high, low, volume, n.

    Only ticks from the open to the (early) close count. A session is a day of event time, so its bar comes out once the
    watermark has left the day, however long nobody trades; early (day) is a small static calendar.
    """
    minute = F.hour(ts) * 60 + F.minute(ts)
    df = ticks.withWatermark(ts, late)
    shut = F.lit(CLOSE_MINUTE)
    if early is not None:
        df = df.withColumn("_day", F.to_date(ts)).join(F.broadcast(early.select(F.col("day").alias("_day"), F.lit(EARLY_CLOSE).alias("_shut"))), "_day", "left")
        shut = F.coalesce("_shut", shut)
    w = F.window(ts, "1 day")
    out = df.where((minute >= OPEN_MINUTE) & (minute < shut)).groupBy("ticker", w).agg(
        F.min_by("px", ts).alias("open"), F.max_by("px", ts).alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    return out.select("ticker", F.to_date("window.start").alias("session"), "open", "close", "high", "low", "volume", "n")


def late_rows(query: StreamingQuery) -> int:
    """How many rows (partial aggregates, as the engine counts them) came behind the watermark and were dropped, in the progress that the query still has."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


SIGNALS = "pair string, ts timestamp, pos int, n1 double, n2 double, entry boolean, exit boolean, stop boolean"
STATE = "state string"


def stream_signals(bars: DataFrame, rule: SignalRule) -> DataFrame:
    """bars (pair, ts, z, P1, P2, beta) -> executed decisions. The state of a pair is its position, bars held, cooldown and pending decisions.

    Bars of a micro-batch are taken in order of ts; a source must deliver a pair's bars in order across batches.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = SignalState()
        if state.exists:
            pos, hold, cool, pending = json.loads(state.get[0])
            s = SignalState(pos, hold, cool, [tuple(p) for p in pending])
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        rows = []
        for ts, z, a, b, beta in zip(pdf["ts"], pdf["z"], pdf["P1"], pdf["P2"], pdf["beta"]):
            rows.append((key[0], ts, *delayed(s, rule, step(s, rule, z, a, b, beta), (0, 0.0, 0.0, False, False, False))))
        state.update((json.dumps([s.pos, s.hold, s.cooldown, s.pending]),))
        yield pd.DataFrame(rows, columns=["pair", "ts", "pos", "n1", "n2", "entry", "exit", "stop"])

    df = bars.select("pair", "ts", "z", "P1", "P2", "beta")
    return df.groupBy("pair").applyInPandasWithState(work, SIGNALS, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_kalman(bars: DataFrame, q: float = 1e-5, r: float = 1e-2, init_cov: float = 1e6) -> DataFrame:
    """bars (pair, ts, P1, P2) -> filtered alpha, beta and residual; a pair's posterior is the state, advanced once before each later bar."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        h = Hedge(np.eye(2) * q, r, np.zeros(2), np.eye(2) * init_cov)
        if state.exists:
            mean, cov = json.loads(state.get[0])
            h.mean, h.cov = np.array(mean), np.array(cov)
        started, rows = state.exists, []
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for ts, a, b in zip(pdf["ts"], pdf["P1"], pdf["P2"]):
            if started:
                h.advance()
            beta, alpha = h.update(a, b)
            started = True
            rows.append((key[0], ts, alpha, beta, a - alpha - beta * b))
        state.update((json.dumps([h.mean.tolist(), h.cov.tolist()]),))
        yield pd.DataFrame(rows, columns=["pair", "ts", "alpha", "beta", "resid"])

    df = bars.select("pair", "ts", "P1", "P2")
    return df.groupBy("pair").applyInPandasWithState(work, "pair string, ts timestamp, alpha double, beta double, resid double", STATE, "append", GroupStateTimeout.NoTimeout)


def aligned_legs(a: DataFrame, b: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Two streams of bars (pair, bar, close) joined on pair and bar, with watermarks on both sides."""
    a = a.select("pair", "bar", F.col("close").alias("P1")).withWatermark("bar", late)
    b = b.select(F.col("pair").alias("pair_b"), F.col("bar").alias("bar_b"), F.col("close").alias("P2")).withWatermark("bar_b", late)
    return a.join(b, (F.col("pair") == F.col("pair_b")) & (F.col("bar") == F.col("bar_b"))).select("pair", "bar", "P1", "P2")
