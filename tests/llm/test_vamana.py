import numpy as np
from tandemlake.llm import vamana

ROWS = "vec_id long, embedding array<float>, label int"


def slow(rows, k=20):
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            scores = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            if scores:
                out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def ask(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as rank")
    asked = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    out = {}
    for r in sorted(vamana.nearest(df, asked, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    got, want = ask(spark, rows, shard=400), slow(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    for q in got:
        exact = dict(((i, float((v[q].astype(float) * v[i]).sum())) for i, _ in got[q]))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)


def test_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(60)] + [(100, None, 0), (101, [0.0, 0.0], 0), (102, [1.0, None], 0), (103, [float("nan"), 1.0], 0), (104, [float("inf"), 1.0], 0), (105, [], 0), (None, [1.0, 1.0], 0), (120, [1.0, 2.0, 3.0], 0), (140, [3.0, 1.0], 0), (140, [3.0, 1.0], 0), (3, [1.0, 2.0], 0)]
    assert ask(spark, rows) == slow(rows)


def test_empty_table(spark):
    assert ask(spark, []) == {}
    assert ask(spark, [(20, [1.0], 0)]) == {}


def test_robust_prune_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    out = vamana.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1, 0]]), 4, 1.2)
    assert out.tolist() == [[1, 3, -1, -1]]
