import datetime as dt
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tandemlake.operators import portfolio as P
from tandemlake.operators import signals as G
from tandemlake.operators import stats as S
from tandemlake.operators import validation as V
from tandemlake.schemas import DAY_LAKE
from tandemlake.sources import lake as K
from tandemlake.streaming import live


def day_rows():
    rows = []
    for i, d in enumerate(pd.bdate_range("2024-10-28", "2024-11-08")):
        utc = d.tz_localize("US/Eastern").tz_convert("UTC").tz_localize(None).to_pydatetime()
        factor = 1.0 if d >= pd.Timestamp("2024-11-01") else 0.99
        rows.append((utc, "aaa", "A1", 200.0 + 2 * i, 100.0 + i, 90.0, 1000.0, factor))
        rows.append((utc, "DUP", "REAL", 20.0, 10.0, 10.0, 500.0, 1.0))
        if i < 3:
            rows.append((utc, "DUP", "OLD", 8.0, 4.0, 4.0, 1.0, 1.0))
    return rows


def test_day_bars_across_the_clock_change(spark):
    raw = spark.createDataFrame(day_rows(), DAY_LAKE)
    bars = K.daily_bars(raw, with_dividends=True).orderBy("ticker", "ts").collect()
    a = [r for r in bars if r.ticker == "AAA"]
    assert [r.ts for r in a] == [d.date() for d in pd.bdate_range("2024-10-28", "2024-11-08")]
    assert [round(r.dividend, 6) for r in a] == [0, 0, 0, 0, round(0.01 * 103, 6), 0, 0, 0, 0, 0]
    assert {r.id for r in bars if r.ticker == "DUP"} == {"REAL"} and len(bars) == 20
    _, lost = K.dominant(raw.withColumn("dollar_volume", F.col("close_split") * F.col("volume_split")))
    assert [tuple(r) for r in lost.collect()] == [("DUP", "REAL", "OLD", 12.0)]
    assert K.daily_bars(raw, min_rows=11).count() == 0
    with pytest.raises(ValueError):
        K.daily_bars(raw, price="best")


def test_lake_layouts_and_files(spark, tmp_path):
    df = spark.createDataFrame(day_rows(), DAY_LAKE)
    for name in ("AAA/2024/10", "AAA/2024/11", "BBB/2024/11"):
        p = tmp_path / "ticker" / f"{name}.parquet"
        p.parent.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_parquet(p, coerce_timestamps="us")
    root = f"file://{tmp_path}/ticker"
    assert K.detect_layout(spark, root) == "ticker"
    files = K.select_files(spark, root, dt.date(2024, 11, 1), dt.date(2024, 12, 31))
    assert [f.split("ticker/")[1] for f in files] == ["AAA/2024/11.parquet", "BBB/2024/11.parquet"]
    got = K.load_lake(spark, files[:1], ["aaa"], "2024-11-01", "2024-11-04", columns=["close"])
    assert got.columns == ["datetime", "ticker", "close"] and got.count() == 2
    (tmp_path / "mixed" / "2024").mkdir(parents=True)
    (tmp_path / "mixed" / "AAA").mkdir()
    with pytest.raises(ValueError):
        K.detect_layout(spark, f"file://{tmp_path}/mixed")
    with pytest.raises(FileNotFoundError):
        K.detect_layout(spark, f"file://{tmp_path}/none")
    sink = f"file://{tmp_path}/sink"
    few = spark.createDataFrame([(1, "x"), (2, "x")], "k int, f string")
    assert K.append_missing(few, sink, ["k"], "f") == 2 and K.append_missing(few.unionAll(spark.createDataFrame([(3, "y")], few.schema)), sink, ["k"], "f") == 1
    manifest = spark.createDataFrame([(json.dumps({"A": [{"path": "p1", "start": "2024-01-01 00:00:00", "end": "2024-01-31 00:00:00", "rows": 1}, {"path": "p2", "start": "2024-02-01 00:00:00", "end": "2024-02-28 00:00:00", "rows": 1}]}),)], "value string")
    assert [r.path for r in K.select_from_manifest(K.parse_manifest(manifest), "2024-02-10", "2024-03-01", ["a"]).collect()] == ["p2"]


def test_sessions(spark):
    rows = [("A", dt.datetime(2024, 7, 1, 13, 30 + m), 10.0 + m, 5) for m in (0, 1, 5)] + [("B", dt.datetime(2024, 7, 1, 13, 33), 7.0, 1), ("A", dt.datetime(2024, 7, 1, 12, 0), 1.0, 1), ("A", dt.datetime(2024, 11, 29, 18, 30), 3.0, 1), ("A", dt.datetime(2024, 11, 29, 15, 0), 4.0, 2)]
    raw = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double, volume int")
    grid = K.session_grid(raw, K.early_closes(spark, "2024-01-01", "2024-12-31"))
    g = {(r.ticker, r.session.month, r.minute): (r.close, r.traded) for r in grid.collect()}
    assert g["A", 7, 3] == (11.0, 0) and g["B", 7, 0] == (None, 0) and g["B", 7, 5] == (7.0, 0)
    assert ("A", 11, 240) not in g and g["A", 11, 30] == (4.0, 1)
    sizes = {(r.ticker, r.session.month): r["count"] for r in grid.groupBy("ticker", "session").count().collect()}
    assert sizes == {("A", 7): 390, ("B", 7): 390, ("A", 11): 210}  # every minute, whoever traded
    bars = {(r.ticker, r.session.month): r for r in K.session_bars(grid).collect()}
    assert bars["A", 7].open == 10.0 and bars["A", 7].close == 15.0 and bars["A", 7].volume == 15 and bars["A", 7].dollar_volume == 5 * (10 + 11 + 15)
    k = {(r.ticker, r.session.month, r.bucket): r.close for r in K.k_minute(grid, 5).collect()}
    assert k["A", 7, 0] == 11.0 and k["A", 7, 1] == 15.0
    assert K.freq_minutes("5min") == 5 and K.freq_minutes("1h") == 60 and K.freq_minutes("session") is None
    for bad in ("30s", "90s", "x"):
        with pytest.raises(ValueError):
            K.freq_minutes(bad)


def test_tickers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("aapl # one\n\nMSFT\n aapl\n")
    (tmp_path / "b.csv").write_text("name,Symbol\nx,msft\ny,goog\n")
    (tmp_path / "c.json").write_text('["ibm", "brk.b"]')
    (tmp_path / "d.json").write_text('[{"ticker": "ibm"}, {"symbol": "x"}]')
    load = lambda n: {r.ticker for r in K.load_tickers(spark, f"file://{tmp_path}/{n}").collect()}
    assert [load(n) for n in ("a.txt", "b.csv", "c.json", "d.json")] == [{"AAPL", "MSFT"}, {"MSFT", "GOOG"}, {"IBM", "BRK.B"}, {"IBM", "X"}]
    (r,) = spark.createDataFrame([(" brk.b ",)], "s string").select(K.normalize_symbol("s").alias("s")).collect()
    assert r.s == "BRK-B"


def test_benjamini_hochberg_1995(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "i int, p double")
    got = S.benjamini_hochberg(rows).orderBy("i").collect()
    assert [r.reject for r in got] == [True] * 4 + [False] * 12 and got[15].p_adj == 1.0
    want = [min(min(15 / (j + 1) * p[j] for j in range(i, 15)), 1) for i in range(15)]
    assert [r.p_adj for r in got[:15]] == pytest.approx(want)


def test_capped_weights(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.5, 0.2, 0.15, 0.1, 0.05])], "i int, weight double")
    got = [r.weight for r in P.capped(df, ["i"], 0.3).orderBy("i").collect()]
    assert got == pytest.approx([0.3, 0.28, 0.21, 0.14, 0.07])
    got = [r.weight for r in P.capped(df, ["i"], 0.22).orderBy("i").collect()]
    assert max(got) <= 0.22 + 1e-9 and sum(got) == pytest.approx(1)
    assert [r.weight for r in P.capped(df, ["i"], 0.1).collect()] == pytest.approx([0.2] * 5)


def test_kernels_of_the_cross_section():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 6))
    cov = np.cov(a.T)
    w = P.risk_parity(cov)
    part = w * (cov @ w)
    assert np.allclose(part, part.mean(), rtol=1e-4)
    b = rng.normal(size=(30, 3))
    n = P.neutralize(rng.normal(size=30), b)
    assert abs(np.abs(n).sum() - 1) < 1e-9 and np.abs(b.T @ n).max() < 1e-6 and abs(n.sum()) < 1e-6
    shrunk, rho = P.ledoit_wolf(a)
    assert 0 <= rho <= 1 and np.trace(shrunk) == pytest.approx(np.trace(np.cov(a.T, ddof=0)))
    w, v = P.eigenportfolios(a, 3)
    assert np.allclose(np.abs(w).sum(axis=1), 1) and v[0] >= v[1] >= v[2]


def test_ewm_against_pandas():
    x = np.random.default_rng(1).normal(size=50)
    z = G.ewm_z(x, 5.0)
    alpha = 1 - 0.5 ** (1 / 5)
    w = np.array([(1 - alpha) ** i for i in range(49)] + [(1 - alpha) ** 49])
    w[:49] *= alpha
    v = x[::-1]
    m = (w * v).sum() / w.sum()
    var = (w * (v - m) ** 2).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())
    assert z[-1] == pytest.approx((x[-1] - m) / np.sqrt(var))


def test_no_look_ahead(spark):
    """Blanking the future leaves the last row of every causal operator as it was."""
    rng = np.random.default_rng(2)
    rows = [("p", "q", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(100 + np.cumsum(rng.normal(size=90)), 80 + np.cumsum(rng.normal(size=90))))]
    df = spark.createDataFrame(rows, "t1 string, t2 string, d date, P1 double, P2 double")
    cut = rows[69][2]
    for op in (lambda x: S.rolling_hedge(x, 20), lambda x: P.trading_time(x.withColumnRenamed("P1", "volume"), ["t1"], "d")):
        whole = {r.d: r for r in op(df).collect()}[cut]
        short = {r.d: r for r in op(df.where(F.col("d") <= cut)).collect()}[cut]
        assert whole == short


def test_folds(spark):
    assert V.folds(10, 4, 3) == [(0, 0, 4, 7), (1, 3, 7, 10)] and V.folds(3, 4, 3) == []
    df = spark.createDataFrame([("p", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(23)], "k string, d date")
    got = V.walk_forward_folds(df, ["k"], "d", 8, 4, step=3).groupBy("fold", "role").count().collect()
    sizes = {(r.fold, r.role): r["count"] for r in got}
    want = {(f, role): n for f, a, b, c in V.folds(23, 8, 4, 3) for role, n in (("train", b - a), ("test", c - b))}
    assert sizes == want
    with pytest.raises(ValueError):
        V.folds(10, 0, 1)
    out = V.walk_forward(V.walk_forward_folds(df.withColumn("x", F.lit(1.0)), ["k"], "d", 8, 4), ["k"], lambda t: 1 / (len(t) - 8 + 0), lambda t, f: f, lambda t, s: {"v": 1.0}, "v double").collect()
    assert all(r.v is None and "ZeroDivisionError" in r.err for r in out)


# ------------------------------------------------------------------ streams


def collect_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        time.sleep(0.1)
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def source(spark, tmp_path, pdf, parts, schema):
    for i, part in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        spark.createDataFrame(pdf.iloc[part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 60
    pdf = pd.DataFrame({"pair": "p", "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "z": rng.normal(size=n) * 2, "P1": 100 + np.cumsum(rng.normal(size=n)), "P2": 50 + np.cumsum(rng.normal(size=n)), "beta": 1.0})
    schema = "pair string, ts timestamp, z double, P1 double, P2 double, beta double"
    rule = G.SignalRule(cooldown=1, exec_lag=1)
    bars = source(spark, tmp_path, pdf, 3, schema)
    got = sorted(collect_stream(spark, live.stream_signals(bars, rule), "live_signals"), key=lambda r: r.ts)
    assert [(r.pos, r.n1, r.n2, r.entry, r.exit, r.stop) for r in got] == list(G.replay(zip(pdf["z"], pdf["P1"], pdf["P2"], pdf["beta"]), rule))
    states = sorted(collect_stream(spark, live.stream_kalman(bars), "live_kalman"), key=lambda r: r.ts)
    from tandemlake.operators.models import Hedge, kalman_filter

    want, _ = kalman_filter(pdf["P1"].to_numpy(), pdf["P2"].to_numpy(), Hedge(np.eye(2) * 1e-5, 1e-2, np.zeros(2), np.eye(2) * 1e6))
    assert np.allclose([(r.beta, r.alpha) for r in states], want)


def test_stream_sessions_and_late_rows(spark, tmp_path):
    day = lambda d, h, m, px: {"ticker": "A", "ts": pd.Timestamp(2024, 7, d, h, m), "px": px, "volume": 1}
    pdf = pd.DataFrame([day(3, 9, 29, 1.0), day(3, 9, 30, 2.0), day(3, 12, 59, 3.0), day(3, 13, 0, 9.0), day(5, 10, 0, 4.0), day(5, 11, 0, 5.0), day(5, 15, 58, 6.0), day(5, 15, 59, 6.0), day(3, 10, 0, 7.0), day(8, 10, 0, 1.0), day(8, 10, 1, 1.0), day(8, 10, 2, 1.0)])
    ticks = source(spark, tmp_path, pdf, 6, "ticker string, ts timestamp, px double, volume long")
    q = live.stream_session_bars(ticks, K.early_closes(spark, "2024-01-01", "2024-12-31")).writeStream.format("memory").queryName("live_sessions").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert live.late_rows(q) == 1  # the tick of the 3rd that came after the 5th
        got = {r.session.day: (r.open, r.close, r.n) for r in spark.table("live_sessions").collect()}
    finally:
        q.stop()
    assert got == {3: (2.0, 3.0, 2), 5: (4.0, 6.0, 4)}


def test_stream_legs_meet(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 10, m) for m in range(0, 30, 5)]
    side = lambda name, rows: source(spark, tmp_path / name, pd.DataFrame(rows, columns=["pair", "bar", "close"]), 2, "pair string, bar timestamp, close double")
    a, b = side("a", [("p", t, float(i)) for i, t in enumerate(at)]), side("b", [("p", t, 10.0 + i) for i, t in enumerate(at) if i != 2])
    got = sorted((r.bar, r.P1, r.P2) for r in collect_stream(spark, live.aligned_legs(a, b), "live_legs"))
    assert got == [(t, float(i), 10.0 + i) for i, t in enumerate(at) if i != 2]


def test_stream_bars_close_behind_the_watermark(spark, tmp_path):
    pdf = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-01 09:30", periods=30, freq="min"), "px": np.arange(30.0), "volume": 1})
    ticks = source(spark, tmp_path, pdf, 2, "ticker string, ts timestamp, px double, volume long")
    got = sorted(collect_stream(spark, live.stream_bars(ticks), "live_bars"), key=lambda r: r.bar)
    assert [(r.open, r.close, r.n) for r in got[:4]] == [(0, 4, 5), (5, 9, 5), (10, 14, 5), (15, 19, 5)]
