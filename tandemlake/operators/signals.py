"""Stateful trading rules as one transition function each, shared by the batch fold and the stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, full, median, rows
from .stats import half_life, half_life_window

SIGNAL_SCHEMA = "ts date, z double, pos int, n1 double, n2 double, entry boolean, exit boolean, stop boolean"


@dataclass(frozen=True)
class SignalRule:
    z_entry: float = 2.0
    z_exit: float = 0.5
    z_stop: float = 4.0
    capital: float = 10_000.0
    max_hold: int | None = None
    cooldown: int = 0
    exec_lag: int = 1

    def __post_init__(self):
        if not 0 <= self.z_exit < self.z_entry < self.z_stop:
            raise ValueError("need 0 <= z_exit < z_entry < z_stop")
        if self.exec_lag < 0 or self.cooldown < 0 or self.max_hold is not None and self.max_hold < 1:
            raise ValueError("exec_lag and cooldown must be 0 or more, max_hold 1 or more")


@dataclass
class SignalState:
    """What a pair carries from bar to bar: position, bars held, bars of cooldown left, and decisions not yet executed."""

    pos: int = 0
    hold: int = 0
    cooldown: int = 0
    pending: list[tuple] = field(default_factory=list)


def step(state: SignalState, rule: SignalRule, z, p1, p2, beta, flat: bool = False, block: bool = False) -> tuple[int, float, float, bool, bool, bool]:
    """One bar: the decision (pos, n1, n2, entry, exit, stop); a stop is no exit. A bar with an unusable input flattens silently and
    leaves the cooldown."""
    if any(v is None or not isfinite(v) for v in (z, p1, p2, beta)) or p1 <= 0 or p2 <= 0:
        state.pos = state.hold = 0
        return 0, 0.0, 0.0, False, False, False
    state.cooldown -= state.cooldown > 0
    may_enter = not state.cooldown and not block and not flat
    entry = leave = stop = False
    if flat and state.pos:
        leave = True
    elif not state.pos and may_enter:
        if -rule.z_stop < z <= -rule.z_entry:
            state.pos, state.hold, entry = 1, 1, True
        elif rule.z_entry <= z < rule.z_stop:
            state.pos, state.hold, entry = -1, 1, True
    elif state.pos:
        state.hold += 1
        losing = z <= -rule.z_stop if state.pos > 0 else z >= rule.z_stop
        if abs(z) <= rule.z_exit:
            leave = True
        elif losing:
            leave = stop = True
        elif rule.max_hold is not None and state.hold >= rule.max_hold:
            leave = True
    if leave:
        state.pos = state.hold = 0
        state.cooldown = rule.cooldown
    n1 = state.pos * rule.capital / (p1 + abs(beta) * p2)
    return state.pos, n1, -beta * n1, entry, leave and not stop, stop


def delayed(state: SignalState, rule: SignalRule, decision: tuple, initial: tuple) -> tuple:
    """The decision that is executed on this bar: the one exec_lag bars ago, before that what was held at first."""
    if not rule.exec_lag:
        return decision
    if not state.pending:
        state.pending = [initial] * rule.exec_lag
    state.pending.append(decision)
    return state.pending.pop(0)


def _fold(pdf: pd.DataFrame, rule: SignalRule, initial: tuple[int, float, float]) -> list[tuple]:
    state, out = SignalState(pos=initial[0]), []
    first = (*initial, False, False, False)
    get = lambda c: pdf[c].to_numpy(float) if c in pdf else np.zeros(len(pdf))
    for z, a, b, beta, flat, block in zip(get("z"), get("P1"), get("P2"), get("beta"), get("force_flat") > 0, get("block_entry") > 0):
        out.append((None if np.isnan(z) else z, *delayed(state, rule, step(state, rule, z, a, b, beta, flat, block), first)))
    return out


def generate_signals(pairs: DataFrame, keys: list[str], rule: SignalRule = SignalRule(), initial: tuple[int, float, float] = (0, 0.0, 0.0), ts: str = "ts") -> DataFrame:
    """pairs (keys, ts, P1, P2, beta, z, force_flat?, block_entry?) -> keys, ts, z and the executed pos, n1, n2, entry, exit, stop.

    A pair's bars come to one task in order (a pair is a bounded series); only the columns that the rule reads are sent.
    """
    used = [*keys, ts, *(c for c in ("P1", "P2", "beta", "z", "force_flat", "block_entry") if c in pairs.columns)]
    kinds = {"force_flat": "int", "block_entry": "int"}
    df = pairs.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in used))
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + SIGNAL_SCHEMA.replace("ts date", f"{ts} {df.schema[ts].dataType.simpleString()}")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        out = pd.DataFrame(_fold(pdf, rule, initial), columns=["z", "pos", "n1", "n2", "entry", "exit", "stop"], index=pdf.index)
        return pd.concat([pdf[[*keys, ts]], out], axis=1)

    return df.groupBy(*keys).applyInPandas(work, schema)


def rolling_z(spread: Column | str, order, n: int) -> Column:
    """z of the spread against its last n bars (population deviation), null until there are n and where the deviation is zero."""
    f = rows(order, n)
    c = F.col(spread) if isinstance(spread, str) else spread
    sd = full(F.stddev_pop(c).over(f), c, f, n)
    return F.when(sd > 0, (c - F.avg(c).over(f)) / sd)


def robust_rolling_z(df: DataFrame, spread: str, keys: list[str], ts: str, n: int) -> DataFrame:
    """df plus z by rolling median and the rolling median of absolute deviations from it; it needs 2n - 1 bars."""
    order = Window.partitionBy(*keys).orderBy(ts)
    f = rows(order, n)
    df = df.withColumn("_med", full(median(spread, f), spread, f, n))
    df = df.withColumn("_dev", F.abs(F.col(spread) - F.col("_med")))
    mad = full(median("_dev", f), "_dev", f, n) * 1.4826
    return df.withColumn("z", F.when(mad > 0, (F.col(spread) - F.col("_med")) / mad)).drop("_med", "_dev")


def ewm_z(values: np.ndarray, halflife: float) -> np.ndarray:
    """Recursive exponentially weighted z, with the debiased deviation."""
    s = pd.Series(values)
    m = s.ewm(halflife=halflife, adjust=False)
    sd = m.std(bias=False)
    return ((s - m.mean()) / sd.where(sd > 0)).replace([np.inf, -np.inf], np.nan).to_numpy()


def _rolling(s: pd.Series, n: int) -> tuple[pd.Series, pd.Series]:
    return s.rolling(n, min_periods=n).mean(), s.rolling(n, min_periods=n).std(ddof=0)


def _robust(s: pd.Series, n: int) -> tuple[pd.Series, pd.Series]:
    med = s.rolling(n, min_periods=n).median()
    return med, 1.4826 * (s - med).abs().rolling(n, min_periods=n).median()


def z_by_pair(df: DataFrame, keys: list[str], ts: str, spread: str, window: str | None = None, method: str = "rolling", halflife: str | float = 10.0) -> DataFrame:
    """df plus z where each pair has a window (column `window`; method rolling or robust) or a half-life (a column or a number; ewm) of its own."""
    if method not in ("rolling", "robust", "ewm"):
        raise ValueError("method must be rolling, robust or ewm")
    schema = df.schema.simpleString()[7:-1].replace(":", " ")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        s = pdf[spread].astype(float)
        if method == "ewm":
            return pdf.assign(z=ewm_z(s.to_numpy(), float(pdf[halflife].iloc[0]) if isinstance(halflife, str) else halflife))
        m, sd = (_rolling if method == "rolling" else _robust)(s, int(pdf[window].iloc[0]))
        return pdf.assign(z=((s - m) / sd.where(sd > 0)).replace([np.inf, -np.inf], np.nan))

    return df.groupBy(*keys).applyInPandas(work, schema + ", z double").withColumn("z", finite("z"))


def z_from_spread(df: DataFrame, keys: list[str], ts: str, spread: str, method: str = "rolling", window: int | None = None, halflife: float | None = None, history: DataFrame | None = None) -> DataFrame:
    """df (keys, ts, spread, ...) plus z. Without a window (rolling, robust) three half-lives of the pair's spread are taken, 30 to
    252 bars; without a half-life (ewm) its own, or 10 bars where it has none.

    history (keys, ts, spread): what was before df. The look-back is then estimated from it alone, so that nothing of df chooses
    its own look-back, and it warms up the statistics; only rows of df come out. It stands before df whatever its ts are.
    """
    ref = df if history is None else history
    hl = half_life(ref.select(*keys, ts, spread), spread, keys, ts).select(*keys, "half_life")
    look = hl.select(*keys, half_life_window(F.col("half_life")).alias("_n"), F.coalesce("half_life", F.lit(10.0)).alias("_hl"))
    if window is not None:
        look = look.withColumn("_n", F.lit(window))
    if halflife is not None:
        look = look.withColumn("_hl", F.lit(float(halflife)))
    every = df.withColumn("_old", F.lit(0))
    if history is not None:
        every = every.unionByName(history.select(*keys, ts, spread).withColumn("_old", F.lit(1)), allowMissingColumns=True)
    every = every.join(look, keys, "left").withColumns({"_n": F.coalesce("_n", F.lit(window or 30)), "_hl": F.coalesce("_hl", F.lit(float(halflife or 10.0)))})
    every = every.withColumn("_place", F.struct((-F.col("_old")).alias("old"), F.col(ts).alias("ts")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_place")).alias("_place")
    got = z_by_pair(every.select(*keys, place, "_old", "_n", "_hl", *(c for c in df.columns if c not in keys)), keys, "_place", spread, "_n", method, "_hl")
    return got.where("_old = 0").select(*df.columns, "z")


def session_masks(df: DataFrame, keys: list[str], ts: str, exec_lag: int = 1, flatten: bool = True, cutoff_minute: int | None = None) -> DataFrame:
    """df plus force_flat (the last exec_lag bars of a session) and block_entry (those, and bars from cutoff_minute of the day on)."""
    session = F.to_date(ts)
    last = F.row_number().over(Window.partitionBy(*keys, session).orderBy(F.desc(ts))) <= exec_lag
    flat = last if flatten else F.lit(False)
    late = F.lit(False) if cutoff_minute is None else F.hour(ts) * 60 + F.minute(ts) >= cutoff_minute
    return df.withColumn("force_flat", flat).withColumn("block_entry", flat | late)


# ------------------------------------------------------------------ bang-bang


def bang_bang(state: int, s: float | None, ok: bool, open_: float = 1.25, close_long: float = 0.5, close_short: float = 0.75) -> int:
    """One step of the s-score rule: out if the model fails, open only from flat, never straight to the other side."""
    if state not in (-1, 0, 1):
        raise ValueError("state must be -1, 0 or 1")
    if not ok or s is None or not isfinite(s):
        return 0
    if state == 0:
        return 1 if s < -open_ else -1 if s > open_ else 0
    if state == 1:
        return 0 if s > -close_long else 1
    return 0 if s < close_short else -1


def fold_bang_bang(df: DataFrame, keys: list[str], ts: str, open_: float = 1.25, close_long: float = 0.5, close_short: float = 0.75) -> DataFrame:
    """df (keys, ts, s, model_ok) -> keys, ts, state: an ordered fold by higher-order functions, inside the engine."""
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col("s"), F.col("model_ok").alias("ok")))).alias("bars"))

    def merge(acc: Column, x: Column) -> Column:
        state, s = F.element_at(acc, -1)["state"], x["s"]
        new = (
            F.when(~F.coalesce(x["ok"], F.lit(False)) | s.isNull() | F.isnan(s), 0)
            .when((state == 0) & (s < -open_), 1)
            .when((state == 0) & (s > open_), -1)
            .when((state == 1) & (s > -close_long), 0)
            .when((state == -1) & (s < close_short), 0)
            .otherwise(state)
        )
        return F.concat(acc, F.array(F.struct(x["ts"].alias("ts"), new.cast("int").alias("state"))))

    kind = df.schema[ts].dataType.simpleString()
    start = F.array(F.struct(F.lit(None).cast(kind).alias("ts"), F.lit(0).alias("state")))
    out = series.select(*keys, F.explode(F.slice(F.aggregate("bars", start, merge), 2, 1_000_000_000)).alias("r"))
    return out.select(*keys, F.col("r.ts").alias(ts), "r.state")


def stitched(folds: DataFrame, keys: list[str], rule: SignalRule = SignalRule(), ts: str = "ts") -> DataFrame:
    """Walk-forward signals whose position is carried from fold to fold: folds (keys, fold, ts, P1, P2, beta, z)."""
    df = folds.select(*keys, "fold", ts, "P1", "P2", "beta", "z")
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", fold {df.schema['fold'].dataType.simpleString()}, {ts} {df.schema[ts].dataType.simpleString()}, z double, pos int, n1 double, n2 double, entry boolean, exit boolean, stop boolean"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        carried, parts = (0, 0.0, 0.0), []
        for _, part in pdf.sort_values(["fold", ts], kind="stable").groupby("fold"):
            got = _fold(part, rule, carried)
            carried = got[-1][1:4]
            parts.append((part.index, got))
        frame = pd.DataFrame([row for _, got in parts for row in got], columns=["z", "pos", "n1", "n2", "entry", "exit", "stop"])
        left = pdf.loc[[i for index, _ in parts for i in index], [*keys, "fold", ts]].reset_index(drop=True)
        return pd.concat([left, frame], axis=1)

    return df.groupBy(*keys).applyInPandas(work, schema)


def replay(bars: Iterator[tuple], rule: SignalRule) -> Iterator[tuple]:
    """The stream's view of the same rule, bar by bar: (z, p1, p2, beta) -> the executed decision."""
    state = SignalState()
    for z, a, b, beta in bars:
        yield delayed(state, rule, step(state, rule, z, a, b, beta), (0, 0.0, 0.0, False, False, False))
