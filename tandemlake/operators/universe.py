"""Universes: which names take part, and how selections differ."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio


def normalize_prices(df: DataFrame, ticker: str | None = None, ts: str | None = None) -> DataFrame:
    """df with its first two columns (or those named) as ticker and datetime, in that place. Fewer than two columns are refused."""
    if len(df.columns) < 2:
        raise ValueError("need a ticker and a datetime column")
    ticker, ts = ticker or df.columns[0], ts or df.columns[1]
    if missing := {ticker, ts} - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    rest = [c for c in df.columns if c not in (ticker, ts)]
    if clash := {"ticker", "datetime"} & set(rest):
        raise ValueError(f"columns {sorted(clash)} stand for something else")
    return df.select(F.col(ticker).alias("ticker"), F.col(ts).alias("datetime"), *rest)


def is_test_symbol(c: Column | str) -> Column:
    """The exchange's test symbols: Z, a letter, ZZT."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike("^Z[A-Z]ZZT$"), F.lit(False))


def corrupt_series(bars: DataFrame, keys: list[str], ts: str, close: str = "close", dividend: str | None = None, most: float = 1e5, share: float = 0.5) -> DataFrame:
    """keys of series that can't be trusted: a close above `most`, or a dividend of more than `share` of the close before."""
    df = bars
    if dividend:
        before = F.lag(close).over(Window.partitionBy(*keys).orderBy(ts))
        df = df.withColumn("_big", F.coalesce(F.col(dividend) > share * before, F.lit(False)))
    else:
        df = df.withColumn("_big", F.lit(False))
    return df.groupBy(*keys).agg(F.max(close).alias("max_close"), F.bool_or("_big").alias("big_dividend")).where((F.col("max_close") > most) | F.col("big_dividend"))


def typed(df: DataFrame, master: DataFrame, kept: Iterable[str] = ("CS", "ADRC")) -> DataFrame:
    """df (ticker, id, ...) plus type, nonequity and type_unknown from a security master (ticker, id, type), by the pair of ticker and id:
    a ticker that was used again has another type in another era. Unknown types are kept; of several rows the least type counts."""
    one = master.where("type is not null").groupBy("ticker", "id").agg(F.min("type").alias("type"))
    out = df.join(one, ["ticker", "id"], "left")
    return out.withColumns({"nonequity": F.coalesce(~F.col("type").isin(*kept), F.lit(False)), "type_unknown": F.col("type").isNull()})


def with_ohlc(bars: DataFrame, lake: DataFrame, tz: str | None = "US/Eastern") -> DataFrame:
    """bars (ticker, ts, id, close, ...) with open, high and low of the lake's row of the same ticker, session and id; rows without one fall out.

    Only ids that bars have are read from the lake (a semi-join, which becomes a filter of the scan), and of rows that repeat a
    ticker and session one.
    """
    ids = bars.select("id").distinct()
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), "datetime")) if tz else F.to_date("datetime")
    rows = lake.join(ids, "id", "left_semi").select(F.upper("ticker").alias("ticker"), day.alias("ts"), "id", *(F.col(f"{c}_split").alias(c) for c in ("open", "high", "low")))
    one = rows.groupBy("ticker", "ts", "id").agg(F.min(F.struct("open", "high", "low")).alias("_o")).select("ticker", "ts", "id", "_o.open", "_o.high", "_o.low")
    return bars.join(one, ["ticker", "ts", "id"])


def turnover(members: DataFrame, at: str = "formation", name: str = "ticker") -> DataFrame:
    """members (at, name) -> at, n, n_new, share_new (against the formation before; the first has none) and n_first: how many of the first one's are in it."""
    m = members.select(at, name).distinct()
    dates = m.select(at).distinct().select(at, F.lag(at).over(Window.orderBy(at)).alias("_before"), F.min(at).over(Window.partitionBy()).alias("_first"))  # a row for each formation
    df = m.join(F.broadcast(dates), at)
    was = m.select(F.col(at).alias("_before"), name, F.lit(1).alias("_was"))
    first = m.select(F.col(at).alias("_first"), name, F.lit(1).alias("_old"))
    df = df.join(was, ["_before", name], "left").join(first, ["_first", name], "left")
    fresh = F.count_if(F.col("_was").isNull() & F.col("_before").isNotNull())
    out = df.groupBy(at).agg(F.count("*").alias("n"), fresh.alias("n_new"), F.count("_old").alias("n_first"), F.first("_before").alias("_b"))
    return out.select(at, "n", "n_new", F.when(F.col("_b").isNotNull(), ratio(F.col("n_new").cast("double"), F.col("n"))).alias("share_new"), "n_first")


def pair_key(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys and the legs of a pair in order, whichever way round it was given."""
    return df.select(*keys, F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str] = []) -> DataFrame:
    """The pairs that two selections have in common, as sets of unordered pairs (by keys, such as the formation)."""
    return pair_key(a, keys).intersect(pair_key(b, keys))


def browse(screen: DataFrame, formation: object = None, only_pass: bool = False, max_p: float = 1.0, sort: str = "eg_p", limit: int = 200) -> DataFrame:
    """A page of a screen: rows of a formation with a raw p of max_p at most, the `limit` with the least eg_p or eg_p_fdr, or with the largest
    of another column. Ties go by pair."""
    df = screen if formation is None else screen.where(F.col("formation") == F.lit(formation))
    df = df.where("verdict = 'pass'") if only_pass else df
    order = F.asc_nulls_last(sort) if sort in ("eg_p", "eg_p_fdr") else F.desc_nulls_last(sort)
    return df.where(F.col("eg_p") <= max_p).orderBy(order, "t1", "t2").limit(limit)


def by_weight(weights: DataFrame, order: str | None = None) -> DataFrame:
    """Weights from the largest; equal ones stay in the order of a column, or of their names."""
    return weights.orderBy(F.desc_nulls_last("weight"), *([order] if order else [c for c in weights.columns if c != "weight"]))


def eras(df: DataFrame, ts: str, cuts: list[str], names: list[str]) -> DataFrame:
    """df plus era: names[0] up to cuts[0], names[1] up to cuts[1], ... and the last name after the last cut."""
    if len(names) != len(cuts) + 1:
        raise ValueError("need a name for each era")
    era = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        era = F.when(F.col(ts) <= F.lit(cut).cast("date"), name).otherwise(era)
    return df.withColumn("era", F.when(F.col(ts).isNotNull(), era))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n and share: counts of each combination that occurs, and their share of the row."""
    c = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))
