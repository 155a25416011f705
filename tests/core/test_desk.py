import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tandemlake.operators import desk as D
from tandemlake.operators import ledger as L
from tandemlake.operators import models as M
from tandemlake.operators import portfolio as P
from tandemlake.operators import signals as G
from tandemlake.operators import stats as S
from tandemlake.operators import study as Y
from tandemlake.operators import universe as U
from tandemlake.sources import lake as K
from tandemlake.sources import registry as R

DAY = dt.date(2021, 3, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


# ------------------------------------------------------------------ lakes


def minute_rows():
    """Two tickers on a summer day, the day after Thanksgiving (13:00) and a winter day, with rows before and after the session."""
    rows = []
    for day, shift, last in ((dt.datetime(2024, 7, 1), 4, 390), (dt.datetime(2024, 11, 29), 5, 210), (dt.datetime(2024, 12, 2), 5, 390)):
        for name in ("AAA", "BBB"):
            if name == "BBB" and day.month == 11:
                continue
            for m in (-30, *range(last), last, last + 60):
                if name == "AAA" and day.month == 7 and m in (3, 4, 5):
                    continue
                t = day + dt.timedelta(hours=9 + shift, minutes=30 + m)
                rows.append((t, name, 100.0 + m / 100, 110.0 + m / 100, 7))
    return pd.DataFrame(rows, columns=["datetime", "ticker", "close_tr", "close", "volume"])


def test_minute_lake_in_both_layouts(spark, tmp_path):
    rows = minute_rows()
    for day, part in rows.groupby(rows["datetime"].dt.date):
        p = tmp_path / "market" / f"{day:%Y/%m}" / f"{day:%d}.parquet"
        p.parent.mkdir(parents=True, exist_ok=True)
        part.to_parquet(p, coerce_timestamps="us", row_group_size=64)
        (p.parent / f"{day:%d}.idx.parquet").write_bytes(b"not data")
        for name, own in part.groupby("ticker"):
            q = tmp_path / "ticker" / name / f"{day:%Y/%m}" / f"{day:%d}.parquet"
            q.parent.mkdir(parents=True, exist_ok=True)
            own.to_parquet(q, coerce_timestamps="us")
    roots = [f"file://{tmp_path}/{x}" for x in ("market", "ticker")]
    load = lambda root, *a, **kw: K.load_minute_bars(spark, root, *a, **kw)
    one = [sorted(load(r, ["aaa", "BBB"], "2024-07-01", "2024-12-02").collect()) for r in roots]
    assert one[0] == one[1] and len(one[0]) == 390 * 4 + 210
    a = {(r.ticker, r.ts): r for r in one[0]}
    at = lambda m: dt.datetime(2024, 7, 1, 9, 30) + dt.timedelta(minutes=m)
    assert (a["AAA", at(0)].close, a["AAA", at(4)].close, a["AAA", at(4)].n_traded, a["AAA", at(6)].volume) == (100.0, 100.02, 0, 7)
    assert max(r.ts for r in one[0] if r.ts.month == 11) == dt.datetime(2024, 11, 29, 12, 59)
    five = load(roots[0], ["AAA"], "2024-11-29", "2024-11-30", freq="5min", price="close")
    assert five.count() == 42 and five.agg(F.min("close")).first()[0] == pytest.approx(110.04)
    bars = {(r.ticker, r.session.month): r for r in load(roots[1], ["AAA", "BBB"], "2024-07-01", "2024-12-02", freq="session").collect()}
    assert (bars["AAA", 7].n_traded, bars["AAA", 7].n_bars, bars["BBB", 7].n_traded, bars["AAA", 11].n_bars, ("BBB", 11) in bars) == (387, 390, 390, 210, False)
    assert load(roots[0], ["ZZZ"], "2024-07-01", "2024-07-02").count() == 0 and load(roots[0], ["AAA"], "2023-07-01", "2023-07-02").count() == 0
    for bad in ({"freq": "90s"}, {"price": "open"}, {"layout": "odd"}):
        with pytest.raises(ValueError):
            load(roots[0], ["AAA"], "2024-07-01", "2024-07-02", **bad)
    for tickers, start, end in (([], "2024-07-01", "2024-07-02"), (["AAA"], "2024-07-02", "2024-07-01")):
        with pytest.raises(ValueError):
            load(roots[0], tickers, start, end)


def test_clock_times_of_a_zone(spark, tmp_path):
    t = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 11, 3, 0, 59), dt.datetime(2024, 11, 3, 2, 0), dt.datetime(2024, 7, 1, 9, 30)]
    got = [r.u for r in spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t timestamp_ntz").select("i", K.to_instant(F.col("t"), "US/Eastern").alias("u")).orderBy("i").collect()]
    want = pd.Series(t).dt.tz_localize("US/Eastern", nonexistent="shift_forward", ambiguous="NaT").dt.tz_convert("UTC").dt.tz_localize(None)
    assert [None if x is None else pd.Timestamp(x) for x in got] == [None if pd.isna(x) else x for x in want]


def test_open_lake_sinks_and_command_line(spark, tmp_path, capsys, monkeypatch):
    from tandemlake.sources import cli

    rows = minute_rows().assign(close_split=1.0)
    rows = rows[rows["datetime"].dt.date == dt.date(2024, 7, 1)]
    p = tmp_path / "lake" / "AAA" / "2024" / "07" / "01.parquet"
    p.parent.mkdir(parents=True)
    own = rows[rows["ticker"] == "AAA"]
    own.to_parquet(p, coerce_timestamps="us")
    root = f"file://{tmp_path}/lake"
    n = K.open_lake(spark, root, ["aaa"], "2024-07-01", "2024-07-01", "minute").count()
    assert n == len(own) > 380
    manifest = tmp_path / "m.json"
    manifest.write_text('{"AAA": [{"path": "AAA/2024/07/01.parquet", "start": "2024-07-01 00:00:00", "end": "2024-07-01 23:00:00", "rows": 1}]}')
    opened = lambda lo, **kw: K.open_lake(spark, root, ["AAA"], lo, "2024-07-01", "minute", f"file://{manifest}", **kw).count()
    assert opened("2024-07-01") == n
    manifest.write_text("{}")
    assert opened("2024-07-01") == n and opened("2024-07-01", fallback=False) == 0
    with pytest.raises(ValueError):
        K.open_lake(spark, root, ["AAA"], "2024-07-01", "2024-07-01", "hour")
    df = K.open_lake(spark, root, ["AAA"], "2024-07-01", "2024-07-01", "minute", columns=["close"])
    for name in ("a.parquet", "a.csv", "a.feather"):
        K.write(df, f"file://{tmp_path}/out/{name}")
    import pyarrow.feather as feather

    assert sum(feather.read_table(f).num_rows for f in (tmp_path / "out" / "a.feather").iterdir()) == n == spark.read.parquet(f"file://{tmp_path}/out/a.parquet").count()
    with pytest.raises(ValueError):
        K.write(df, "x.xls")
    monkeypatch.setattr(cli, "build_session", lambda app: spark)
    common = ["--tickers", "aaa, zzz", "--start", "2024-07-01", "--end", "2024-07-01", "--root", root, "--granularity", "minute"]
    assert cli.main(common) == 0 and f"{n} rows" in capsys.readouterr().out
    assert cli.main([*common, "--columns", "close", "--out", f"file://{tmp_path}/out/b.csv"]) == 0 and spark.read.option("header", "true").csv(f"file://{tmp_path}/out/b.csv").count() == n


def test_session_helpers(spark):
    from tandemlake.session import build_session, panel, require_columns

    assert build_session("x") is not None and require_columns(spark.range(1), "id").columns == ["id"]
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "x")


def test_panels_follow_their_files(spark, tmp_path):
    from tandemlake.session import panel

    src, made = f"{tmp_path}/src.parquet", []

    def make():
        made.append(1)
        return spark.read.parquet(src)

    spark.range(3).write.parquet(src)
    assert [panel(spark, "p", [src], make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(src)
    assert panel(spark, "p", [src], make).count() == 5 and len(made) == 2


def test_suggested_weights(spark):
    rng = np.random.default_rng(12)
    rows = [(k, d, 100.0 + float(a), 50.0, 1.0, float(a)) for k, s in (("a", 1.0), ("b", 2.0), ("c", 4.0), ("flat", 0.0)) for d, a in zip(days(40), np.cumsum(rng.normal(size=40)) * s)]
    df = spark.createDataFrame(rows, "pair string, ts date, P1 double, P2 double, beta double, resid double")
    got = {r.pair: r for r in P.suggested_weights(df, ["pair"], "ts", "inv_vol", 0.5, "price_units").collect()}
    sd = {k: np.std(np.diff([r[5] for r in rows if r[0] == k]), ddof=1) for k in "abc"}
    raw = {k: 1 / sd[k] / sum(1 / x for x in sd.values()) for k in "abc"}
    assert got["flat"].weight == 0 and got["a"].weight == pytest.approx(0.5) and all(got[k].inv_var_weight == pytest.approx(raw[k]) for k in "abc")
    assert got["b"].weight == pytest.approx(0.5 * raw["b"] / (raw["b"] + raw["c"])) and got["a"].var_per_dollar is None
    once = {r.pair: r.weight for r in P.suggested_weights(df, ["pair"], "ts", "inv_vol", 0.4, "price_units", "one_pass").collect()}
    cut = {k: min(raw[k], 0.4) for k in "abc"}
    assert all(once[k] == pytest.approx(cut[k] / sum(cut.values())) for k in "abc") and P.suggested_weights(df, ["pair"], "ts").where("var_per_dollar > 0").count() == 3
    with pytest.raises(ValueError):
        P.suggested_weights(df, ["pair"], "ts", max_weight=0.0)


def test_roll_takes_traded_minutes_only(spark):
    rng = np.random.default_rng(5)
    price = 100 + rng.choice([-0.02, 0.02], 60) + np.cumsum(rng.normal(0, 0.001, 60))
    rows = [("A", dt.datetime(2024, 7, 1, 13, 30) + dt.timedelta(minutes=6 * i), float(p), 5) for i, p in enumerate(price)]
    grid = K.session_grid(spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double, volume int"))
    (got,) = K.session_bars(grid).collect()
    d = np.diff(price)
    cov = (d[1:] * d[:-1]).mean() - d.mean() * d[:-1].mean()
    assert got.n_bars == 390 and got.n_traded == 60 and got.roll_spread_bps == pytest.approx(2 * math.sqrt(-cov) / price.mean() * 1e4)


def test_universes_and_registry(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "big.csv").write_text("ticker\nx\n")
    (tmp_path / "lists" / "big.txt").write_text("aapl\n# none\nmsft\n")
    (tmp_path / "lists" / "small.json").write_text('["a"]')
    folder = f"file://{tmp_path}/lists"
    assert K.list_universes(spark, folder) == ["big", "small"]
    assert {r.ticker for r in K.load_universe(spark, folder, "big").collect()} == {"AAPL", "MSFT"}
    with pytest.raises(FileNotFoundError):
        K.load_universe(spark, folder, "none")
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/t.parquet")
    reg = R.Registry(spark, f"file://{tmp_path}", {"u": "the screen"}, (R.Source("s", "", ("t",)), R.Source("v", "", ("t", "u"))))
    assert reg.table("t", ("id",)).columns == ["id"] and reg.table("t") is reg.table("t") and reg.ready() == {"s": True, "v": False}
    with pytest.raises(R.MissingTable, match="the screen"):
        reg.table("u")
    assert reg.once("a", lambda: reg.table("t", cached=True).count()) == 3 and (reg.look(), reg.look()) == (1, 2)
    reg.clear()
    assert R.load_prices(spark, "day", {"day": lambda s, n: s.range(n)}, n=2).count() == 2
    with pytest.raises(ValueError):
        R.load_prices(spark, "week", {"day": None})


def test_names_and_types(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "sym string, at int, close double")
    assert U.normalize_prices(df).columns == ["ticker", "datetime", "close"] and U.normalize_prices(df, "sym", "close").columns == ["ticker", "datetime", "at"]
    with pytest.raises(ValueError):
        U.normalize_prices(df.select("sym"))
    got = spark.createDataFrame([(x,) for x in ("ZVZZT", "ZZZT", "ZAZZTX", "zvzzt", None)], "t string").select("t", U.is_test_symbol("t").alias("x")).collect()
    assert [r.t for r in got if r.x] == ["ZVZZT"]
    master = spark.createDataFrame([("A", "1", "CS"), ("A", "2", "ETF"), ("B", "1", None)], "ticker string, id string, type string")
    rows = U.typed(spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "ticker string, id string"), master).collect()
    assert sorted((r.ticker, r.id, r.nonequity, r.type_unknown) for r in rows) == [("A", "1", False, False), ("A", "2", True, False), ("B", "1", False, True)]
    tests = spark.createDataFrame([("a", "b", "pass", 0.1, 3.0), ("a", "c", "fail", 0.01, 9.0), ("b", "c", "pass", 0.05, 5.0), ("c", "d", "fail", None, 0.0)], "t1 string, t2 string, verdict string, eg_p double, joh_stat double").withColumn("eg_p_fdr", F.col("eg_p"))
    order = lambda by: [r.t1 + r.t2 for r in M.screen_order(tests, by).collect()]
    assert order("eg_p") == ["bc", "ab", "ac", "cd"] and order("joh_stat") == ["bc", "ab", "ac", "cd"] and order("t2") == ["ab", "ac", "bc", "cd"]
    w = spark.createDataFrame([("x", 0.2, 2), ("y", 0.5, 3), ("z", 0.2, 1)], "t string, weight double, seq int")
    assert [r.t for r in U.by_weight(w, "seq").collect()] == ["y", "z", "x"]


# ------------------------------------------------------------------ z, halts, books


@pytest.mark.parametrize("method", ["rolling", "robust", "ewm"])
def test_z_with_history(spark, method):
    rng = np.random.default_rng(7)
    x = np.zeros(260)
    for t in range(1, 260):
        x[t] = 0.93 * x[t - 1] + rng.normal()
    old, new = x[:180], x[180:]
    rows = [("p", d, float(v)) for d, v in zip(days(260), x)]
    df = spark.createDataFrame(rows, "pair string, d date, s double")
    cut = days(260)[180]
    got = [r.z for r in G.z_from_spread(df.where(F.col("d") >= cut), ["pair"], "d", "s", method, history=df.where(F.col("d") < cut)).orderBy("d").collect()]
    b = np.polyfit(old[:-1], old[1:], 1)[0]
    hl = -math.log(2) / math.log(b)
    n = int(np.clip(3 * hl, 30, 252))
    s = pd.Series(x)
    if method == "ewm":
        e = s.ewm(halflife=hl, adjust=False)
        m, sd = e.mean(), e.std(bias=False)
    elif method == "robust":
        m = s.rolling(n).median()
        sd = 1.4826 * (s - m).abs().rolling(n).median()
    else:
        m, sd = s.rolling(n).mean(), s.rolling(n).std(ddof=0)
    assert len(got) == len(new) and got == pytest.approx(((s - m) / sd).iloc[180:].tolist())
    alone = [r.z for r in G.z_from_spread(df.where(F.col("d") >= cut), ["pair"], "d", "s", "rolling", window=40).orderBy("d").collect()]
    assert alone[38] is None and alone[39] is not None
    with pytest.raises(ValueError):
        G.z_from_spread(df, ["pair"], "d", "s", "mean")


def test_a_missing_z_halts_nothing(spark):
    df = spark.createDataFrame([("p", d, z) for d, z in zip(days(5), [0.0, math.nan, 0.0, None, 9.0])], "pair string, ts date, z double")
    got = [r.halted for r in L.z_halts(df, ["pair"], L.Breaker(z_halt=3, cooldown=1, z_reentry=0.5)).orderBy("ts").collect()]
    assert got == [False, False, False, False, True]


def slow_breaker(z, pos, dd, b):
    """Halts bar by bar, and the runs with their labels. dd: the rolling drawdown over the capital."""
    n = len(z)
    zh, dh = [False] * n, [False] * n
    for t in range(n):
        if not math.isnan(z[t]) and abs(z[t]) > b.z_halt:
            for i in range(t, min(n, t + b.cooldown + 1)):
                zh[i] = True
        if dd[t] < -b.max_drawdown_pct:
            for i in range(t, min(n, t + b.halt_bars)):
                dh[i] = True
    for t in range(1, n):
        if not zh[t] and zh[t - 1] and not math.isnan(z[t]) and abs(z[t]) >= b.z_reentry:
            zh[t] = True
    both = [(x or y) and any(pos) for x, y in zip(zh, dh)]
    runs = []
    for on, part in itertools.groupby(range(n), lambda t: both[t]):
        part = list(part)
        if on:
            a, c = zh[part[0]], dh[part[0]]
            runs.append(("both" if a and c else "drawdown" if c else "z_halt", part[0], part[-1], len(part)))
    return both, runs


def test_breaker_against_loops(spark):
    rng = np.random.default_rng(11)
    b = L.Breaker(z_halt=2.6, cooldown=2, z_reentry=1.2, max_drawdown_pct=0.004, drawdown_window=10, halt_bars=4, capital_base=1000.0)
    rows, prices, flat = [], [], days(120)
    for pair in ("p", "q", "idle"):
        z = rng.normal(size=120) * 1.5
        z[7] = math.nan
        n1 = np.zeros(120) if pair == "idle" else rng.integers(-1, 2, 120).astype(float)
        p = 100 + np.cumsum(rng.normal(size=120))
        rows += [(pair, d, float(a), int(x), float(x), 0.0) for d, a, x in zip(flat, z, n1)]
        prices += [(pair, d, float(x), 50.0) for d, x in zip(flat, p)]
    s = spark.createDataFrame(rows, "pair string, ts date, z double, pos int, n1 double, n2 double")
    px = spark.createDataFrame(prices, "pair string, ts date, P1 double, P2 double")
    patched, audit = L.apply_breaker(s, px, ["pair"], b)
    got, runs = {(r.pair, r.ts): (r.halted, r.pos, r.n1) for r in patched.collect()}, sorted(audit.collect(), key=lambda r: (r.pair, r.halt_start))
    for pair in ("p", "q", "idle"):
        own = [r for r in rows if r[0] == pair]
        n1, p = np.array([r[4] for r in own]), np.array([r[2] for r in prices if r[0] == pair])
        equity = np.cumsum(n1 * np.diff(p, prepend=p[0]))
        dd = [(equity[t] - equity[max(0, t - 9) : t + 1].max()) / 1000 for t in range(120)]
        both, want = slow_breaker([r[2] for r in own], [r[3] for r in own], dd, b)
        assert [got[pair, d] for d in flat] == [(h, 0 if h else r[3], 0.0 if h else r[4]) for h, r in zip(both, own)]
        mine = [r for r in runs if r.pair == pair]
        assert [(r.trigger_type, r.halt_start, r.halt_end, r.n_halted_bars) for r in mine] == [(k, flat[i], flat[j], n) for k, i, j, n in want]
        for r, (kind, i, _, _) in zip(mine, want):
            assert (r.z_at_trigger is None) == (kind == "drawdown" or math.isnan(own[i][2])) and (r.dd_pct_at_trigger is None) == (kind == "z_halt")
    assert {r.trigger_type for r in runs} >= {"z_halt", "drawdown"}


def slow_book(rows, reset, band):
    """rows (P1, P2, pos, beta, target): shares and the ledger's flags, bar by bar."""
    good = [a > 0 and c > 0 and math.isfinite(a) and math.isfinite(c) for a, c, *_ in rows]
    n1, n2 = [0.0] * len(rows), [0.0] * len(rows)
    for i in range(1, len(rows)):
        p1, p2, was, beta, target = rows[i - 1]
        side = rows[i][2]
        if not side:
            continue
        held = was == side
        if held and (reset == "frozen" or reset == "band" and abs(abs(n1[i - 1]) * p1 + abs(n2[i - 1]) * p2 - target) <= band * target):
            n1[i], n2[i] = n1[i - 1], n2[i - 1]
        else:
            n1[i] = side * target / (p1 + abs(beta) * p2)
            n2[i] = -beta * n1[i]
    keep, out, before = [i for i in range(len(rows)) if good[i]], [], 0
    for i in keep:
        pos = rows[i][2]
        out.append((i, n1[i], n2[i], pos != 0 and pos != before, before != 0 and pos != before))
        before = pos
    return out


@pytest.mark.parametrize("reset", ["daily", "frozen", "band"])
def test_book_with_bad_prices(spark, reset):
    rng = np.random.default_rng(3)
    pos = [0, 1, 1, 0, 0, -1, -1, -1, 1, 1, 0, 0]
    rows = [(float(100 + i + rng.normal()), float(50 + rng.normal()), p, 1.5, 1000.0) for i, p in enumerate(pos)]
    for i, bad in ((3, (math.nan, 50.0)), (10, (100.0, 0.0))):  # exits on bars without a price
        rows[i] = (*bad, *rows[i][2:])
    df = spark.createDataFrame([("p", d, *r) for d, r in zip(days(12), rows)], "pair string, ts date, P1 double, P2 double, pos int, beta double, target double")
    got = [(r.ts, r.n1, r.n2, r.entry, r.exit) for r in L.book(df, ["pair"], reset, 0.02).orderBy("ts").collect()]
    want = slow_book(rows, reset, 0.02)
    assert [g[0] for g in got] == [days(12)[i] for i, *_ in want] and [g[3:] for g in got] == [w[3:] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want]) and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert sum(g[4] for g in got) == 3


def test_book_refuses_what_it_cannot_size(spark):
    kinds = "pair string, ts date, P1 double, P2 double, pos int, beta double, target double"
    make = lambda *rows: spark.createDataFrame([("p", d, *r) for d, r in zip(days(9), rows)], kinds)
    good = (100.0, 50.0, 1, 1.0, 1000.0)
    for first in ((100.0, 50.0, 1, 1.0, 1000.0), (math.nan, 50.0, 0, 1.0, 1000.0), (100.0, 50.0, 0, None, 1000.0), (100.0, 50.0, 0, 1.0, -1.0)):
        with pytest.raises(Exception, match="cannot size"):
            L.book(make(first, good), ["pair"]).collect()
    with pytest.raises(Exception, match="cannot size"):
        L.book(make((100.0, 50.0, 0, 1.0, 1000.0), (100.0, 50.0, 2, 1.0, 1000.0)), ["pair"]).collect()
    for bad in ({"band": -1.0}, {"days_per_year": 0.0}, {"cost_bps": (1.0, math.inf)}):
        with pytest.raises(ValueError):
            L.book(make(good), ["pair"], "band", **bad)
    df = make((100.0, 50.0, 0, 1.0, 1000.0), good)
    d = spark.createDataFrame([("p", days(2)[0], 0.1, math.nan), ("p", days(2)[1], 0.5, None)], "pair string, ts date, D1 double, D2 double")
    assert [r.dividends for r in L.book(L.with_dividends(df, d, ["pair"]), ["pair"]).orderBy("ts").collect()] == pytest.approx([0, 0.5 * 1000 / 150])
    with pytest.raises(Exception, match="do not cover"):
        L.with_dividends(df, d.limit(1), ["pair"]).collect()


# ------------------------------------------------------------------ targets, ridge, placebos, graphs


def test_reused_targets_against_a_loop(spark):
    rng = np.random.default_rng(2)
    names, cal = [f"n{i}" for i in range(5)], days(60)
    pos = np.where(rng.random((61, 5)) < 0.55, rng.integers(-1, 2, (61, 5)), 0)
    pos[1:] = np.where(rng.random((60, 5)) < 0.6, pos[:-1], pos[1:])
    rows = [("g", d, n, 0.2, int(pos[i, j]), int(pos[i + 1, j])) for i, d in enumerate(cal) for j, n in enumerate(names)]
    got = {(r.d, r.name): (r.target, r.m) for r in D.reuse_targets(spark.createDataFrame(rows, "g string, d date, name string, weight double, cur int, nxt int"), "g", "d", "name", 100.0, 2.0).collect()}
    now, want = {}, {}
    for i, d in enumerate(cal):
        on = [j for j in range(5) if pos[i + 1, j]]
        total = 0.2 * len(on)
        m = max(1.0, min(1 / total, 5 / 2.0)) if on else math.nan
        for j in on:
            new = 0.2 * m * 100
            if pos[i, j] != pos[i + 1, j] or j not in now or abs(new - now[j]) > 0.25 * now[j] * (1 + 1e-9):
                now[j] = new
            want[d, names[j]] = (now[j], m)
        now = {j: v for j, v in now.items() if j in on}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len({v for v, _ in got.values()}) >= 3


def test_ridge_walk_against_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        d = dt.date(2019, 1, 1) + dt.timedelta(days=i)
        for n in range(4):
            a, b = rng.normal(size=2)
            rows.append((d, str(n), float(a), None if rng.random() < 0.05 else float(b), None if i > 495 else float(0.3 * a - 0.1 * b + rng.normal())))
    kinds = "d date, name string, a double, b double, y double"
    got = {(r.refit, r.alpha): (r.multiple, r.n_rows, r.weight) for r in Y.ridge_walk(spark.createDataFrame(rows, kinds), "d", ["a", "b"], "y", (0.01, 1.0), 12, 5, 100).collect()}
    pdf = pd.DataFrame(rows, columns=["d", "name", "a", "b", "y"])
    cal = sorted(pdf["d"].unique())
    want = {}
    for refit in sorted({min(d for d in cal if (d.year, d.month) == k) for k in {(d.year, d.month) for d in cal}}):
        lo = (pd.Timestamp(refit) - pd.DateOffset(months=12)).date()
        use = pdf[[lo <= d < refit and cal.index(d) + 5 < cal.index(refit) for d in pdf["d"]]].dropna(subset=["y"])
        if use["d"].nunique() < 100:
            continue
        x, y, year = use[["a", "b"]].fillna(0).to_numpy(), use["y"].to_numpy(), np.array([d.year for d in use["d"]])
        solve = lambda x, y, m: np.linalg.solve(x.T @ x + m * np.mean(np.diag(x.T @ x)) * np.eye(2), x.T @ y)
        scores = {}
        for m in (0.01, 1.0):
            errors = [np.mean((y[year == h] - x[year == h] @ solve(x[year != h], y[year != h], m)) ** 2) for h in set(year) if (year != h).sum() >= 50 and (year == h).sum() >= 10]
            if errors and len(set(year)) > 1:
                scores[m] = np.mean(errors)
        best = min(scores, key=scores.get) if scores else 1.0
        want |= {(refit, c): (best, len(y), w) for c, w in zip("ab", solve(x, y, best))}
    assert got.keys() == want.keys() and len(want) > 10 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_placebos(spark):
    t = spark.createDataFrame([(f"t{i}",) for i in range(12)], "ticker string")
    f = spark.createDataFrame([(y,) for y in (1, 2, 3)], "formation int")
    real = spark.createDataFrame([("t1", "t0"), ("t2", "t5")], "t1 string, t2 string")
    got = Y.placebo_pairs(t, f, real, 50, 7).collect()
    assert len({tuple(r) for r in got}) == len(got) == 50 and all(r.t1 < r.t2 for r in got)
    assert not {("t0", "t1"), ("t2", "t5")} & {(r.t1, r.t2) for r in got}
    assert sorted(map(tuple, got)) == sorted(map(tuple, Y.placebo_pairs(t.repartition(3), f, real, 50, 7).collect())) != sorted(map(tuple, Y.placebo_pairs(t, f, real, 50, 8).collect()))
    rows = [(m, d, n, float(100 * m + 10 * d + i)) for m in (1, 2) for d in (1, 2) for i, n in enumerate("abcdef") if (m, d, n) != (2, 2, "c")]
    moved = Y.permuted_names(spark.createDataFrame(rows, "m int, d int, name string, x double"), ["m"], "name", "x", 3).collect()
    of = {(m, d, n): x for m, d, n, x in rows}
    back = {(m, d, x): n for (m, d, n), x in of.items()}
    for m in (1, 2):
        maps = {d: {r.name: back.get((m, d, r.x)) for r in moved if (r.m, r.d) == (m, d)} for d in (1, 2)}
        assert sorted(maps[1].values()) == list("abcdef") and all(maps[2][n] in (maps[1][n], None) for n in maps[2])
    picks = Y.random_picks(spark.createDataFrame([("g", str(i)) for i in range(30)] + [("h", "x")], "grp string, name string"), ["grp"], "name", 20, 4, 1).groupBy("draw", "grp").count().collect()
    assert {(r.draw, r.grp): r["count"] for r in picks} == {(k, g): n for k in range(4) for g, n in (("g", 20), ("h", 1))}


def modularity(edges, parts):
    total = sum(w for *_, w in edges)
    degree = {}
    for i, j, w in edges:
        degree[i], degree[j] = degree.get(i, 0) + w, degree.get(j, 0) + w
    inside = sum(w for i, j, w in edges if parts[i] == parts[j])
    return inside / total - sum((sum(d for x, d in degree.items() if parts[x] == c) / (2 * total)) ** 2 for c in set(parts.values()))


def test_communities():
    rng = np.random.default_rng(1)
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 0.2), ("b1", "c1", 0.2)]
    got = D.communities(edges)
    assert {x[0]: k for x, k in got.items()} == {"a": 0, "b": 1, "c": 2} and all(got[x] == got[x[0] + "0"] for x in got)
    odd = [(str(i), str(j), float(rng.random())) for i, j in itertools.combinations(range(12), 2) if rng.random() < 0.3]
    parts = D.communities(odd)
    best, single = modularity(odd, parts), modularity(odd, {x: x for x in parts})
    assert best > single
    for a, b in itertools.combinations(set(parts.values()), 2):  # no union of two is better
        assert modularity(odd, {x: a if k == b else k for x, k in parts.items()}) <= best + 1e-12
    assert D.communities([("x", "y", 0.0)]) == {"x": 0, "y": 1}


def test_adjusted_over_all_ranges(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random(3000) ** 3, np.ones(500), np.full(300, 0.01)]).round(4)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(9999, None), (9998, math.nan)], "i int, p double")
    got = {r.i: (r.p_adj, r.reject) for r in S.benjamini_hochberg(rows).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(0, 1)
    assert [got[int(i)][0] for i in order] == pytest.approx(q.tolist()) and got[9999] == got[9998] == (1.0, False)
    assert sum(v[1] for v in got.values()) == (q <= 0.05).sum() > 0


@pytest.mark.parametrize("cap", [0.9, 0.31, 0.2, 0.13, 0.05])
def test_caps_against_filling_up(spark, cap):
    w = np.array([0.4, 0.25, 0.12, 0.1, 0.06, 0.04, 0.02, 0.01])
    got = [r.weight for r in P.capped(spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "i int, weight double"), ["i"], cap).orderBy("i").collect()]
    c, x = max(cap, 1 / len(w)), w.copy()
    for _ in range(50):
        over = x > c + 1e-15
        if not over.any():
            break
        fixed = np.isclose(x, c) | over
        x = np.where(fixed, c, x / x[~fixed].sum() * (1 - c * fixed.sum())) if (~fixed).any() else np.full(len(w), 1 / len(w))
    assert got == pytest.approx(x.tolist()) and sum(got) == pytest.approx(1)


def test_block_correlations(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 8)) + rng.normal(size=(80, 1))
    x[:, 7] = 1.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7][~np.isnan(x[:, 7])] = 1.0
    rows = [(f"s{j}", d, float(x[i, j])) for i, d in enumerate(days(80)) for j in range(8)]
    got = {(r.i, r.j): (r.n, r["corr"]) for r in P.pairwise_correlation(spark.createDataFrame(rows, "k string, d date, x double"), "k", "d", "x", 30).collect()}
    want = pd.DataFrame(x, columns=[f"s{j}" for j in range(8)])
    assert len(got) == 28
    for (i, j), (n, c) in got.items():
        both = want[[i, j]].dropna()
        assert n == len(both)
        assert c is None if j == "s7" else c == pytest.approx(both[i].corr(both[j]))


def test_kernels():
    rng = np.random.default_rng(9)
    x = np.cumsum(rng.normal(size=300)) + 50
    y = 3 + 1.5 * x + rng.normal(size=300) * 0.3
    plain, moving = M.kalman_ahead(y, x, 100), M.kalman_ahead(y, x, 100, momentum=True)
    assert abs(plain[-1, 1] - 1.5) < 0.1 and abs(moving[-1, 1] - 1.5) < 0.1
    changed = y.copy()
    changed[200:] += 99
    assert np.array_equal(M.kalman_ahead(changed, x, 100)[:201], plain[:201])  # nothing of a bar is in its own state
    q = np.eye(2) * 1e-4
    h = M.Hedge(q.copy(), 1.0, np.zeros(2), np.eye(2) * 1e6)
    whole, _ = M.kalman_filter(y, x, h)
    first = M.Hedge(q.copy(), 1.0, np.zeros(2), np.eye(2) * 1e6)
    M.kalman_filter(y[:150], x[:150], first)
    for state in ((first.mean, first.cov), {"mean": first.mean, "cov": first.cov}, np.concatenate([first.mean, first.cov.ravel()])):
        assert np.allclose(M.filter_on_new(y[150:], x[150:], q, 1.0, state)[0], whole[150:])
    assert np.allclose(M.filter_on_new(y, x, q, 1.0)[0], whole) and M.coerce_state(None) is None
    for bad in ({"mean": [1, 2]}, (np.zeros(2), np.zeros(3)), (np.array([math.nan, 0]), np.eye(2)), 5):
        with pytest.raises(ValueError):
            M.coerce_state(bad)
    with pytest.raises(ValueError):
        M.filter_on_new(y[:4], x[:4], q, 1.0)
    r, w = rng.normal(size=(60, 7)), rng.normal(size=(7, 2))
    beta, resid, r2 = D.factor_day(r, w)
    f = np.column_stack([np.ones(60), r @ w])
    assert np.abs(f.T @ resid).max() < 1e-9 and np.allclose(f @ beta + resid, r) and ((0 <= r2) & (r2 <= 1)).all()
    walks = np.cumsum(rng.normal(size=(200, 2)), axis=0)
    stats = {k: M.johansen(walks, 1, k)[0][0] for k in (-1, 0, 1)}
    assert len(set(stats.values())) == 3 and all(M.JOHANSEN_TRACE[k][0][0] < M.JOHANSEN_TRACE[k][0][2] for k in stats)
    for (trend, n), table in {("n", 1): {-2.58: 0.01, -1.95: 0.05}, ("ct", 1): {-3.96: 0.01, -3.41: 0.05}, ("n", 2): {-2.76: 0.05}, ("ct", 2): {-3.78: 0.05}}.items():
        assert all(abs(M.mackinnon_p(s, n, trend) - p) < 0.002 for s, p in table.items())
    with pytest.raises(ValueError):
        M.Gate(trend="x")


def test_adf_lag_is_that_of_separate_fits():
    rng = np.random.default_rng(10)
    for _ in range(10):
        x = np.cumsum(rng.normal(size=150) + 0.5 * rng.normal(size=150).cumsum() * 0.01)
        t, lag = M.adf(x, max_lag=8)
        d, best = np.diff(x), []
        for k in range(9):
            i = np.arange(8, len(d))
            z = np.column_stack([x[i], *(d[i - j] for j in range(1, k + 1)), np.ones(len(i))])
            e = d[i] - z @ np.linalg.lstsq(z, d[i], rcond=None)[0]
            best.append(len(i) * math.log(e @ e / len(i)) + 2 * z.shape[1])
        assert lag == int(np.argmin(best)) and math.isfinite(t)


def test_fit_on_the_full_span_only(spark):
    x = 50 + np.cumsum(np.random.default_rng(1).normal(size=40))
    rows = [(k, d, float(1.2 * v), float(v)) for k, part in (("whole", slice(0, 40)), ("short", slice(5, 40))) for d, v in list(zip(days(40), x))[part]]
    df = spark.createDataFrame(rows, "pair string, d date, P1 double, P2 double")
    assert {r.pair for r in M.fit_kalman(df, ["pair"], "d", full_span=True).collect()} == {"whole"} and M.fit_kalman(df, ["pair"], "d", em_rounds=1, keep_prior=True).select("pair").distinct().count() == 2
