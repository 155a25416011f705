"""Folds, formation windows, walk-forward runs and their summaries; as-of and range joins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_date(df: DataFrame, ts: str, train_end: str, val_end: str) -> DataFrame:
    """df plus role: train up to train_end, val up to val_end, test after."""
    return df.withColumn("role", F.when(F.col(ts) <= F.lit(train_end).cast("date"), "train").when(F.col(ts) <= F.lit(val_end).cast("date"), "val").otherwise("test"))


def full_span(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of the keys that have both the first and the last ts of all."""
    ends = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    mine = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).join(F.broadcast(ends), (F.col("_a") == F.col("_lo")) & (F.col("_b") == F.col("_hi")))
    return df.join(mine.select(key), key, "left_semi")


def complete(df: DataFrame, key: str, ts: str, x: str) -> DataFrame:
    """Rows of the keys that have a value at every ts."""
    n = df.agg(F.count_distinct(ts).alias("_n"))
    have = df.groupBy(key).agg(F.count(x).alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n"))
    return df.join(have.select(key), key, "left_semi")


def folds(n: int, train: int, test: int, step: int | None = None, least: int | None = None) -> list[tuple[int, int, int, int]]:
    """(fold, first of training, first of test, end of test) as positions; the last test may be short, not below `least`. None if the series is."""
    if train < 1 or test < 1 or (step is not None and step < 1):
        raise ValueError("need positive sizes")
    out, at = [], 0
    while at + train < n:
        end = min(at + train + test, n)
        if end - at - train < (1 if least is None else least):
            break
        out.append((len(out), at, at + train, end))
        at += step or test
    return out


def walk_forward_folds(df: DataFrame, keys: list[str], ts: str, train: int, test: int, step: int | None = None, least: int = 1, by_session: bool = False) -> DataFrame:
    """df rows by fold and role: each key's bars (or sessions) are numbered and meet the folds that can hold them by arithmetic, without a join."""
    step = step or test
    w = Window.partitionBy(*keys)
    i = (F.dense_rank().over(w.orderBy(F.to_date(ts))) if by_session else F.row_number().over(w.orderBy(ts))) - 1
    df = df.withColumn("_i", i).withColumn("_n", F.max("_i").over(w) + 1)
    first = F.greatest(F.ceil((F.col("_i") - train - test + 1) / step), F.lit(0)).cast("int")
    last = F.floor(F.col("_i") / step).cast("int")
    df = df.withColumn("fold", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    at = F.col("fold") * step
    df = df.where((F.col("_i") >= at) & (F.col("_i") < at + train + test) & (F.least(at + train + test, F.col("_n")) - at - train >= least))
    return df.withColumn("role", F.when(F.col("_i") < at + train, "train").otherwise("test")).drop("_i", "_n")


def walk_forward(df: DataFrame, keys: list[str], fit: Callable, signal: Callable, evaluate: Callable, schema: str) -> DataFrame:
    """Callbacks by key and fold: fit(train), signal(test, fitted), evaluate(test, signals) -> dict. A fold that fails has its error in `err`."""
    names = [p.split()[0] for p in schema.split(",")]
    by = [*keys, "fold"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in by}
        try:
            train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
            row |= {**evaluate(test, signal(test, fit(train))), "err": None}
        except Exception as e:  # the caller's functions: a failing fold is reported, the others go on
            row["err"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([{c: row.get(c) for c in [*by, *names, "err"]}])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return df.groupBy(*by).applyInPandas(work, f"{kinds}, {schema}, err string")


def summarize_folds(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, std, median, min, max, n over the folds."""
    long = df.select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def formations(sessions: DataFrame, ts: str, months: int = 6, lookback_months: int = 24) -> DataFrame:
    """Semi-annual formation dates: the last session up to each anchor, and the window (lo, hi] before it and the one after."""
    span = sessions.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    start = F.expr(f"make_date(year(lo), {6 if months == 6 else 12}, 30)")
    anchors = span.select(F.explode(F.sequence(start, F.col("hi"), F.expr(f"interval {months} months"))).alias("anchor"), "lo")
    last = sessions.join(F.broadcast(anchors), F.col(ts) <= F.col("anchor")).groupBy("anchor").agg(F.max(ts).alias("formation"), F.first("lo").alias("first"))
    f = last.select("formation", "first").distinct().where(F.add_months("formation", -lookback_months) >= F.col("first"))
    after = F.lead("formation").over(Window.orderBy("formation"))  # a row for each half year
    return f.select("formation", F.add_months("formation", -lookback_months).alias("form_lo"), F.coalesce(after, F.add_months("formation", months)).alias("trade_hi"))


def in_window(df: DataFrame, windows: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Range join lo < ts <= hi; the windows are a row for each formation, which bounds what is broadcast."""
    return df.join(F.broadcast(windows), (F.col(ts) > F.col(lo)) & (F.col(ts) <= F.col(hi)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """left plus the values of the last right row at or before its ts: one window over the union of both, no range join."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(*values).alias("_v")).schema["_v"].dataType)})
    b = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def prior_session(bars: DataFrame, daily: DataFrame, keys: list[str], session: str, values: list[str]) -> DataFrame:
    """Intraday bars with what was known at the close of the session before."""
    w = Window.partitionBy(*keys).orderBy(session)
    known = daily.select(*keys, session, *(F.lag(v).over(w).alias(v) for v in values))
    return bars.join(known, [*keys, session], "left")


def top_by(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n of each group; ranks are limited before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def pooled_sharpe(periods: float = 252.0):
    """From counts, sums and squares of returns, as an aggregate over pieces."""
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return s / n / F.sqrt(q / n - (s / n) * (s / n)) * periods**0.5
