"""Lakes and lists: layouts, file selection, scans, day bars, minute sessions, tickers, sinks."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..schemas import DAY_LAKE, MINUTE_LAKE


def _children(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path)]


def detect_layout(spark: SparkSession, root: str) -> str:
    """market (year folders on top) or ticker (ticker folders on top); a mixture is refused."""
    names = [n for n, is_dir in _children(spark, root) if is_dir]
    if not names:
        raise FileNotFoundError(f"no folders under {root}")
    years = [bool(re.fullmatch(r"\d{4}", n)) for n in names]
    if all(years):
        return "market"
    if any(years):
        raise ValueError(f"{root} mixes year and ticker folders")
    return "ticker"


def months(start: dt.date, end: dt.date) -> list[tuple[int, int]]:
    return [(m // 12, m % 12 + 1) for m in range(start.year * 12 + start.month - 1, end.year * 12 + end.month)]


def select_files(spark: SparkSession, root: str, start: dt.date, end: dt.date, tickers: Iterable[str] | None = None, layout: str | None = None) -> list[str]:
    """Month files that can hold rows of the range; only folders that exist are listed."""
    layout = layout or detect_layout(spark, root)
    tops = [root] if layout == "market" else [f"{root}/{t}" for t in (sorted({t.upper() for t in tickers}) if tickers else sorted(n for n, d in _children(spark, root) if d))]
    out, wanted = [], months(start, end)
    for top in tops:
        for year in sorted({y for y, _ in wanted}):
            try:
                files = {n for n, d in _children(spark, f"{top}/{year:04d}")}
            except FileNotFoundError:
                continue
            out += [f"{top}/{year:04d}/{m:02d}.parquet" for y, m in wanted if y == year and f"{m:02d}.parquet" in files]
    return out


def select_day_files(spark: SparkSession, root: str, start: dt.date, end: dt.date, tickers: Iterable[str] | None = None, layout: str | None = None) -> list[str]:
    """Day files <YYYY>/<MM>/<DD>.parquet (under a ticker's folder in the ticker layout) of the range; only folders that exist are listed, and
    index files beside the day files are not data."""
    layout = layout or detect_layout(spark, root)
    tops = [root] if layout == "market" else [f"{root}/{t}" for t in (sorted({t.upper() for t in tickers}) if tickers else sorted(n for n, d in _children(spark, root) if d))]
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    out = []
    for top in tops:
        for y, m in sorted({(d.year, d.month) for d in days}):
            try:
                files = {n for n, _ in _children(spark, f"{top}/{y:04d}/{m:02d}")}
            except FileNotFoundError:
                continue
            out += [f"{top}/{y:04d}/{m:02d}/{d.day:02d}.parquet" for d in days if (d.year, d.month) == (y, m) and f"{d.day:02d}.parquet" in files]
    return out


def select_from_manifest(manifest: DataFrame, start: str, end: str, tickers: Iterable[str] | None = None) -> DataFrame:
    """manifest (ticker, path, start, end, rows) -> the distinct paths whose span overlaps the range."""
    df = manifest.where((F.col("end") >= F.lit(start).cast("timestamp")) & (F.col("start") <= F.lit(end).cast("timestamp")))
    return (df.where(F.upper("ticker").isin([t.upper() for t in tickers])) if tickers else df).select("path").distinct()


def parse_manifest(df: DataFrame, column: str = "value") -> DataFrame:
    """A JSON object {ticker: [{path, start, end, rows}]} in a text column -> a row for each file."""
    kind = "map<string, array<struct<path: string, start: timestamp, end: timestamp, rows: bigint>>>"
    return df.select(F.explode(F.from_json(column, kind)).alias("ticker", "files")).select("ticker", F.inline("files"))


def scan(spark: SparkSession, paths: list[str], kind: str = "day", columns: list[str] | None = None) -> DataFrame:
    """Files of a lake as one frame; unreadable files are skipped, and only the named columns are read (datetime and ticker always are)."""
    schema = DAY_LAKE if kind == "day" else MINUTE_LAKE
    if not paths:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*paths)
    return df.select(*dict.fromkeys(["datetime", "ticker", *columns])) if columns else df


def to_instant(c: Column, tz: str) -> Column:
    """Clock times of a zone as UTC: a time that the clock skips is moved to the first one after the gap, one that it shows twice is null."""
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), c)
    shown = lambda u: F.convert_timezone(F.lit("UTC"), F.lit(tz), u)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (shown(utc + hour) == c) | (shown(utc - hour) == c)
    skipped = shown(utc) != c
    return F.when(twice, F.lit(None).cast("timestamp_ntz")).when(skipped, F.date_trunc("hour", utc).cast("timestamp_ntz")).otherwise(utc)


def load_lake(spark: SparkSession, paths: list[str], tickers: Iterable[str] | None, start: str, end: str, source_tz: str = "UTC", to_tz: str | None = None, columns: list[str] | None = None, kind: str = "day") -> DataFrame:
    """Rows of the tickers within [start, end] (clock times of source_tz); a date alone as the end means the whole of that day.

    The lake's times are clock times of source_tz (see to_instant; what has no instant falls out) and are shown in to_tz, or as they are.
    """
    df = scan(spark, paths, kind, columns).withColumn("ticker", F.upper("ticker"))
    stop = F.expr(f"timestamp_ntz '{end}'") if len(end) > 10 else F.expr(f"timestamp_ntz '{end}' + interval 1 day - interval 1 microsecond")
    df = df.where(F.col("datetime").between(F.expr(f"timestamp_ntz '{start}'"), stop))
    if tickers is not None:
        df = df.where(F.col("ticker").isin(sorted({t.upper() for t in tickers})))
    if source_tz != "UTC":
        utc = to_instant(F.col("datetime"), source_tz)
        df = df.withColumn("datetime", F.convert_timezone(F.lit("UTC"), F.lit(to_tz or source_tz), utc)).where("datetime is not null")
    elif to_tz:
        df = df.withColumn("datetime", F.convert_timezone(F.lit("UTC"), F.lit(to_tz), "datetime"))
    return df


def open_lake(spark: SparkSession, root: str, tickers: Iterable[str], start: str, end: str, granularity: str = "day", manifest: str | None = None, fallback: bool = True, **options) -> DataFrame:
    """Rows of a lake by tickers and range: files come from a manifest (a JSON text file; relative paths are under root), or, where there is none or
    it names none and fallback is on, from the folders. No files: no rows. Options as for load_lake()."""
    if granularity not in ("day", "minute"):
        raise ValueError("granularity must be day or minute")
    names, paths = sorted({t.upper() for t in tickers}), []
    lo, hi = dt.date.fromisoformat(start[:10]), dt.date.fromisoformat(end[:10])
    if manifest:
        table = parse_manifest(spark.read.option("wholetext", "true").text(manifest))
        stop = end if len(end) > 10 else f"{end} 23:59:59"
        paths = sorted(r["path"] if "://" in r["path"] or r["path"].startswith("/") else f"{root}/{r['path']}" for r in select_from_manifest(table, start, stop, names).collect())  # file names
    if not paths and (fallback or not manifest):
        paths = (select_files if granularity == "day" else select_day_files)(spark, root, lo, hi, names)
    return load_lake(spark, paths, names, start, end, kind=granularity, **options)


def write(df: DataFrame, path: str) -> None:
    """A sink by suffix: .parquet, .csv, .txt, or .feather and .ft (a folder with a file for each task); others are refused."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith((".csv", ".txt")):
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif path.endswith((".feather", ".ft")):
        _write_feather(df, path)
    else:
        raise ValueError(f"no sink for {path}")


def _write_feather(df: DataFrame, path: str) -> None:
    """Each task writes a file under a name of its own and reports it; files of attempts that didn't count are removed."""
    import pyarrow as pa
    from pyarrow import fs, ipc

    def work(batches):
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.feather"
        out = None
        for b in batches:
            out = out or ipc.new_file(store.open_output_stream(f"{folder}/{name}", compression=None), b.schema)
            out.write_batch(b)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    made = {r["name"] for r in df.mapInArrow(work, "name string").collect()}  # a name for each task
    store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.base_name not in made:
            store.delete_file(f.path)


def append_missing(df: DataFrame, path: str, keys: list[str], partition: str) -> int:
    """A resumable sink: rows whose keys the sink doesn't have yet are appended, by partition. How many there were."""
    spark = df.sparkSession
    try:
        _children(spark, path)
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except FileNotFoundError:
        pass
    n = df.count()
    if n:
        df.write.mode("append").partitionBy(partition).parquet(path)
    return n


# ------------------------------------------------------------------ day bars


def recover_dividends(df: DataFrame, keys: list[str], price: str, factor: str, ts: str = "ts") -> Column:
    """Dividends from a total-return factor: (1 - f[t-1] / f[t]) of the price before, at least zero; the first row has none."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = (1 - ratio(F.lag(factor).over(w), factor)) * F.lag(price).over(w)
    return F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0))


def dominant(df: DataFrame, ticker: str = "ticker", id_: str = "id", dollars: str = "dollar_volume") -> tuple[DataFrame, DataFrame]:
    """(rows of each ticker's instrument with the most dollar volume, the collisions: ticker, kept, dropped, dropped_dollar_volume).

    Ties go to the least id. The choice is an aggregate over (ticker, id) and joined back, so no ticker meets in one task.
    """
    total = df.groupBy(ticker, id_).agg(F.sum(dollars).alias("_dv"))
    best = total.groupBy(ticker).agg(F.min_by(id_, F.struct(-F.coalesce("_dv", F.lit(0.0)), id_)).alias("_kept"))
    kept = df.join(best, ticker).where(F.col(id_) == F.col("_kept")).drop("_kept")
    lost = total.join(best, ticker).where(F.col(id_) != F.col("_kept")).select(ticker, F.col("_kept").alias("kept"), F.col(id_).alias("dropped"), F.col("_dv").alias("dropped_dollar_volume"))
    return kept, lost


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that was ingested last."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def daily_bars(raw: DataFrame, price: str = "split", tz: str = "US/Eastern", start: str | None = None, end: str | None = None, tickers: Iterable[str] | None = None, with_dividends: bool = False, min_rows: int = 0) -> DataFrame:
    """Day-lake rows -> ticker, ts (session date), close, raw_close, volume, dollar_volume, id (and dividend)."""
    columns = {"split": "close_split", "tr": "close_tr", "raw": "close"}
    if price not in columns:
        raise ValueError(f"price must be one of {sorted(columns)}")
    df = raw.withColumn("ticker", F.upper("ticker"))
    if tickers is not None:
        df = df.where(F.col("ticker").isin(sorted({t.upper() for t in tickers})))
    df = df.withColumn("ts", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), "datetime")))
    df = df.where(F.col("ts") >= F.lit(start).cast("date")) if start else df
    df = df.where(F.col("ts") <= F.lit(end).cast("date")) if end else df
    if "ingest" not in df.columns:
        df = df.withColumn("ingest", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    df = df.withColumn("dollar_volume", F.col("close_split") * F.col("volume_split"))
    df, _ = dominant(df)
    df = df.select("ticker", "ts", F.col(columns[price]).alias("close"), F.col("close").alias("raw_close"), F.col("volume_split").alias("volume"), "dollar_volume", "id", "close_split", "tr_price_factor", "ingest")
    df = keep_last(df, ["ticker", "ts"], "ingest").drop("ingest")
    if with_dividends:
        df = df.withColumn("dividend", recover_dividends(df, ["ticker"], "close_split", "tr_price_factor"))
    if min_rows:
        df = df.join(df.groupBy("ticker").count().where(F.col("count") >= min_rows).select("ticker"), "ticker", "left_semi")
    return df.drop("close_split", "tr_price_factor")


def liquidity_screen(bars: DataFrame, min_price: float = 5.0, min_dollar_volume: float = 1e6, min_ann_vol: float = 0.05, min_coverage: float = 0.95, max_abs_return: float | None = 1.0, exclude: Iterable[str] = (), price: str = "raw_close", top_n: int | None = None, ts: str = "ts") -> DataFrame:
    """One row for each ticker with its figures and whether it is eligible (of those the top_n by median dollar volume).

    Returns are between neighbouring sessions of the common calendar, so a gap gives none; a ticker without any return fails.
    max_abs_return None: no bound on returns.
    """
    sessions = bars.select(ts).distinct()
    ordinal = sessions.withColumn("_ord", F.row_number().over(Window.orderBy(ts)))  # a row for each session: bounded by the calendar
    n = sessions.count()
    w = Window.partitionBy("ticker").orderBy(ts)
    df = bars.join(ordinal, ts).withColumn("_r", F.when(F.col("_ord") - F.lag("_ord").over(w) == 1, ratio("close", F.lag("close").over(w))))
    stats = df.groupBy("ticker").agg(
        F.median(price if price in bars.columns else "close").alias("median_price"),
        F.median("dollar_volume").alias("median_dollar_volume"),
        (F.stddev_samp(F.log("_r")) * 252**0.5).alias("ann_vol"),
        (F.count("close") / n).alias("coverage"),
        F.max(F.abs(F.col("_r") - 1)).alias("max_abs_return"),
    )
    ok = (F.col("median_price") >= min_price) & (F.col("median_dollar_volume") >= min_dollar_volume) & (F.col("ann_vol") >= min_ann_vol) & (F.col("coverage") >= min_coverage)
    if max_abs_return is not None:
        ok &= F.col("max_abs_return") <= max_abs_return
    ok = F.coalesce(ok, F.lit(False)) & ~F.col("ticker").isin([t.upper() for t in exclude] or [""])
    out = stats.withColumn("eligible", ok)
    if top_n is not None:
        rank = F.row_number().over(Window.partitionBy("eligible").orderBy(F.desc("median_dollar_volume"), "ticker"))
        out = out.withColumn("_r", rank).withColumn("eligible", F.col("eligible") & (F.col("_r") <= top_n)).drop("_r")
    return out


# ------------------------------------------------------------------ minute sessions

OPEN_MINUTE, CLOSE_MINUTE, EARLY_CLOSE = 570, 960, 780


def early_closes(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Days that close at 13:00: the day after the fourth Thursday of November, July 3 and December 24 if they are Monday to Thursday."""
    years = spark.sql(f"SELECT explode(sequence(year(date '{start}'), year(date '{end}'))) AS y")
    thanks = F.expr("date_add(next_day(make_date(y, 10, 31), 'Thu'), 22)")
    days = years.select(F.explode(F.array(thanks, F.expr("make_date(y, 7, 3)"), F.expr("make_date(y, 12, 24)"))).alias("day"), thanks.alias("friday"))
    keep = (F.col("day") == F.col("friday")) | (F.weekday("day") <= 3)
    return days.where(keep & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("day")


def freq_minutes(freq: str) -> int | None:
    """Whole minutes of '5min', '1h' and the like; None for 'session'."""
    if freq == "session":
        return None
    m = re.fullmatch(r"(\d*)\s*(min|t|m|h|s)", freq.strip().lower())
    if not m:
        raise ValueError(f"can't read {freq!r}")
    seconds = int(m[1] or 1) * {"h": 3600, "s": 1}.get(m[2], 60)
    if seconds < 60 or seconds % 60:
        raise ValueError("need whole minutes, one or more")
    return seconds // 60


def session_grid(raw: DataFrame, early: DataFrame | None = None, tz: str | None = "US/Eastern", order: str | None = None) -> DataFrame:
    """Minute rows (ticker, ts, close, volume) -> every minute of the session, from the open to the (early) close, of every ticker
    that has a close in it, filled forward within the session.

    ticker, session, minute (from the open), close (null before the first trade), volume, traded (a volume and a close), print (the
    minute's own close). Rows outside the session are left out, of rows of one minute the last one counts. The grid is made by a
    sequence for each session, so minutes in which nobody traded are there as well. Early closes are a row for each such day.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), "ts") if tz else F.col("ts")
    df = raw.withColumn("ts", F.date_trunc("minute", local)).withColumn("session", F.to_date("ts")).withColumn("m", F.hour("ts") * 60 + F.minute("ts"))
    shut = F.lit(CLOSE_MINUTE)
    if early is not None:
        df = df.join(early.select(F.col("day").alias("session"), F.lit(EARLY_CLOSE).alias("_early")), "session", "left")
        shut = F.coalesce("_early", shut)
    df = df.withColumn("shut", shut).where((F.col("m") >= OPEN_MINUTE) & (F.col("m") < F.col("shut")))
    prints = df.groupBy("ticker", "session", "m").agg(F.max_by("close", order or "ts").alias("close"), F.max_by("volume", order or "ts").alias("volume"), F.first("shut").alias("shut"))
    there = prints.groupBy("ticker", "session").agg(F.count("close").alias("n"), F.first("shut").alias("shut")).where("n > 0")
    minutes = there.select("ticker", "session", F.explode(F.sequence(F.lit(OPEN_MINUTE), F.col("shut") - 1)).alias("m"))
    grid = minutes.join(prints.drop("shut"), ["ticker", "session", "m"], "left")
    w = Window.partitionBy("ticker", "session").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    volume = F.coalesce("volume", F.lit(0))
    return grid.select(
        "ticker", "session", (F.col("m") - OPEN_MINUTE).alias("minute"),
        F.last("close", True).over(w).alias("close"), volume.alias("volume"),
        ((volume > 0) & F.col("close").isNotNull()).cast("int").alias("traded"), F.col("close").alias("print"),
    )


def k_minute(grid: DataFrame, k: int) -> DataFrame:
    """Bars of k minutes from the open: last close, sums of volume and of traded minutes."""
    return grid.groupBy("ticker", "session", F.floor(F.col("minute") / k).cast("int").alias("bucket")).agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("minute"))).alias("close"), F.sum("volume").alias("volume"), F.sum("traded").alias("n_traded")
    )


def roll_by_session(grid: DataFrame) -> DataFrame:
    """ticker, session, roll_spread_bps from the minutes that have a close of their own: twice the root of the negative covariance
    of neighbouring changes over the mean close. Each mean is over its own values; it needs 30 products."""
    w = Window.partitionBy("ticker", "session").orderBy("minute")
    p = grid.where("print is not null").select("ticker", "session", "minute", "print")
    p = p.withColumn("d1", F.col("print") - F.lag("print").over(w)).withColumn("d0", F.lag("d1").over(w))
    out = p.groupBy("ticker", "session").agg(
        (F.avg(F.col("d1") * F.col("d0")) - F.avg("d1") * F.avg("d0")).alias("cov"), F.count(F.col("d1") * F.col("d0")).alias("n"), F.avg("print").alias("mean")
    )
    return out.select("ticker", "session", F.when((F.col("cov") < 0) & (F.col("n") >= 30), 2 * F.sqrt(-F.col("cov")) / F.col("mean") * 1e4).alias("roll_spread_bps"))


def session_bars(grid: DataFrame) -> DataFrame:
    """A bar for each session: open (its first own close), close (the last one, filled), volume, dollar volume, traded minutes, all
    minutes, and Roll's spread in bps."""
    out = grid.groupBy("ticker", "session").agg(
        F.min_by("print", F.when(F.col("print").isNotNull(), F.col("minute"))).alias("open"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("minute"))).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.coalesce(F.col("print") * F.col("volume"), F.lit(0.0))).alias("dollar_volume"),
        F.sum("traded").alias("n_traded"),
        F.count("*").alias("n_bars"),
    )
    return out.where("close is not null").join(roll_by_session(grid), ["ticker", "session"], "left")


PRICES = ("close_tr", "close_split", "close")


def load_minute_bars(spark: SparkSession, root: str, tickers: Iterable[str], start: str, end: str, freq: str = "1min", price: str = "close_tr", tz: str = "US/Eastern", layout: str | None = None, early: DataFrame | None = None) -> DataFrame:
    """Regular-session bars of the tickers from start to end (both days, in tz) from a minute lake in either layout.

    1min: ticker, session, ts (the bar's start), close, volume, n_traded; k minutes: the same by bars from 09:30; session: as
    session_bars(). Files hold UTC days, so one day more is read on either side and cut off afterwards; tickers are a filter of
    the scan, by which row groups are skipped. No files or rows: no bars. early: days that close early, in place of the rule.
    """
    k = freq_minutes(freq)
    names = sorted({str(t).upper() for t in tickers})
    lo, hi = dt.date.fromisoformat(str(start)[:10]), dt.date.fromisoformat(str(end)[:10])
    if not names:
        raise ValueError("no tickers")
    if hi < lo:
        raise ValueError("end is before start")
    if price not in PRICES:
        raise ValueError(f"price must be one of {PRICES}")
    layout = layout or detect_layout(spark, root)
    if layout not in ("ticker", "market"):
        raise ValueError("layout must be ticker or market")
    files = select_day_files(spark, root, lo - dt.timedelta(days=1), hi + dt.timedelta(days=1), names, layout)
    raw = scan(spark, files, "minute", [price, "volume"]).where(F.col("ticker").isin(names))
    # of rows of one minute the last in the files counts
    raw = raw.select("ticker", F.col("datetime").alias("ts"), F.col(price).cast("double").alias("close"), "volume", F.struct("datetime", F.monotonically_increasing_id().alias("row")).alias("ingest"))
    grid = session_grid(raw, early_closes(spark, str(lo), str(hi)) if early is None else early, tz, "ingest").where(F.col("session").between(F.lit(lo), F.lit(hi)))
    at = lambda minute: (F.col("session").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(OPEN_MINUTE) + minute)).alias("ts")
    if k is None:
        return session_bars(grid)
    if k == 1:
        return grid.select("ticker", "session", at(F.col("minute")), "close", "volume", F.col("traded").alias("n_traded"))
    return k_minute(grid, k).select("ticker", "session", at(F.col("bucket") * k), "close", "volume", "n_traded")


def summarize_sessions(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.count("*").alias("n_sessions"), F.min("session").alias("first"), F.max("session").alias("last"),
        F.median(F.col("n_traded") / F.col("n_bars")).alias("median_traded_share"), F.median("dollar_volume").alias("median_dollar_volume"), F.median("roll_spread_bps").alias("median_roll_bps"),
    )


# ------------------------------------------------------------------ tickers


def clean_tickers(df: DataFrame, column: str) -> DataFrame:
    t = F.upper(F.trim(F.col(column)))
    return df.select(t.alias("ticker")).where((F.col("ticker") != "") & F.col("ticker").isNotNull()).distinct()


def load_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a list (.txt: # starts a comment), a table (.csv: the column that is named like a ticker) or .json (strings or objects)."""
    if path.endswith((".txt", ".list")):
        return clean_tickers(spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("v")), "v")
    if path.endswith(".csv"):
        df = spark.read.option("header", "true").csv(path)
        named = [c for c in df.columns if c.strip().lower() in ("ticker", "symbol", "tickers", "symbols")]
        return clean_tickers(df, (named or df.columns)[0])
    if path.endswith(".json"):
        text = spark.read.option("wholetext", "true").text(path)
        plain, objects = F.from_json("value", "array<string>"), F.from_json("value", "array<struct<ticker: string, symbol: string>>")
        one = text.select(F.explode_outer(plain).alias("s"))
        two = text.select(F.explode_outer(objects).alias("o")).select(F.coalesce("o.ticker", "o.symbol").alias("s"))
        return clean_tickers(one.where(~F.col("s").startswith("{")).unionByName(two), "s")
    raise ValueError(f"can't read tickers from {path}")


ENDINGS = (".txt", ".csv", ".json")


def list_universes(spark: SparkSession, folder: str) -> list[str]:
    """Names of the ticker lists in a folder."""
    return sorted({n.rpartition(".")[0] for n, is_dir in _children(spark, folder) if not is_dir and n.endswith(ENDINGS)})


def load_universe(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The list of that name in a folder; of several formats .txt comes first, then .csv, then .json."""
    there = {n for n, _ in _children(spark, folder)}
    for ending in ENDINGS:
        if name + ending in there:
            return load_tickers(spark, f"{folder}/{name}{ending}")
    raise FileNotFoundError(f"no list {name} in {folder}; there are {list_universes(spark, folder)}")


def combine_tickers(frames: list[DataFrame], op: str = "union") -> DataFrame:
    """Sets of tickers by union, intersection or difference (the first less the others)."""
    if op not in ("union", "intersection", "difference"):
        raise ValueError(op)
    out = frames[0].select("ticker")
    for f in frames[1:]:
        f = f.select("ticker")
        out = out.union(f) if op == "union" else out.intersect(f) if op == "intersection" else out.subtract(f)
    return out.distinct()


def normalize_symbol(c: Column | str) -> Column:
    """Share-class spelling with a dash."""
    return F.replace(F.upper(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit("."), F.lit("-"))
