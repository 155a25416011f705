import math
import random
from collections import Counter

import numpy as np
from tandemlake.llm import toxicity

from .helpers import DOCS, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = prose(i, 80).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["vilething", "awfulword"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", None, None, None), (5, None, None, None, None)], DOCS)
    got = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS)).collect()
    assert len(got) == len(rows) + 3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {d: y for d, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = toxicity.remove_toxic(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns and {9000, 9001} <= {r.doc_id for r in kept.collect()}


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(120)
    import zlib

    other = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, q, y in labels]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, other))
    assert one == two


def test_scores_do_not_depend_on_the_batch():
    rows, labels = corpus(100)
    texts = [r[1] for r in rows]
    bucket, weight, bias = toxicity.fit_rows(texts, np.array([y for _, _, y in labels]))
    table = np.zeros(toxicity.BUCKETS, np.float32)
    table[bucket] = weight
    model = toxicity.Model(table, bias)
    together = model.scores([None, "", *texts])
    assert np.allclose(together, [model.scores([t])[0] for t in [None, "", *texts]])
    z = [bias + table[toxicity.present(t)].sum(dtype=np.float64) for t in texts]
    assert np.allclose(together[2:], 1 / (1 + np.exp(-np.array(z))))


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(0, "a", None, None, None), (2, "b", None, None, None)], DOCS)
    for labels in ([], [(0, 1, 0)], [(0, 1, 0), (2, 1, 0), (None, 0, None)]):
        assert [r.predicted for r in toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_long_text_is_scored_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    text = prose(1, 400) + " vilething " + prose(2, 400)
    table = np.zeros(toxicity.BUCKETS, np.float32)
    table[toxicity.present("vilething")] = 1
    assert toxicity.Model(table, -3.0).scores([text])[0] > 0.9


def test_labelled_null_text_is_not_learnt_from(spark):
    """Ids 0 and 7 are labelled and not held out; their texts are null."""
    rows, labels = corpus(120)
    rows = [(d, None if d in (0, 7) else t, *rest) for d, t, *rest in rows]
    docs, some = spark.createDataFrame(rows, DOCS), [x for x in labels if x[0] not in (0, 7)]
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, some))
    assert one == two and {0, 7} <= set(one)


def slow_grams(text):
    """The n-grams of a text with their buckets, character by character."""
    codes = [ord(c) + 1 for c in f" {text.lower()} "]
    out = set()
    for n in (3, 4, 5):
        for i in range(len(codes) - n + 1):
            h = codes[i]
            for c in codes[i + 1 : i + n]:
                h = (h * 0x100000001B3 + c) % 2**64
            out.add(int(toxicity.mix(np.array([h * (2 * n + 1) % 2**64], np.uint64))[0]) >> 44)
    return out


def slow_weights(rows, y, l2, rounds):
    """Log-count ratios, evidence and the regression, one text and one feature at a time."""
    n, pos = len(rows), sum(y)
    seen = {label: Counter(f for r, t in zip(rows, y) if t == label for f in r) for label in (0, 1)}
    ratio, keep = {}, []
    for f in sorted(set(seen[0]) | set(seen[1])):
        a, b = seen[1][f], seen[0][f]
        ratio[f] = math.log((a + 1) / (pos + 2) / ((b + 1) / (n - pos + 2)))
        g = 0.0
        for got, size in ((a, pos), (b, n - pos)):
            for part, whole in ((got, a + b), (size - got, n - a - b)):
                if part:
                    g += 2 * part * math.log(part * n / (whole * size))
        if g >= toxicity.LEAST_EVIDENCE and a + b >= 3:
            keep.append(f)
    used = [[f for f in sorted(r) if f in set(keep)] for r in rows]
    norm = math.sqrt(sum(max(1, len(u)) for u in used) / n)
    r = {f: ratio[f] / norm for f in keep}
    w, b = dict.fromkeys(keep, 0.0), 0.0
    m, v = dict.fromkeys([*keep, None], 0.0), dict.fromkeys([*keep, None], 0.0)
    for t in range(1, rounds + 1):
        grad = {f: l2 * w[f] for f in keep} | {None: 0.0}
        for u, label in zip(used, y):
            z = b + sum(r[f] * w[f] for f in u)
            d = (1 / (1 + math.exp(-z)) - label) * (0.5 / pos if label else 0.5 / (n - pos))
            grad[None] += d
            for f in u:
                grad[f] += r[f] * d
        for f, g in grad.items():
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.99 * v[f] + 0.01 * g * g
            step = 0.05 * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.99**t)) + 1e-9)
            if f is None:
                b -= step
            else:
                w[f] -= step
    return {f: w[f] * r[f] for f in keep}, b


def slow_fit(texts, y, l2=1e-3, rounds=100, folds=3):
    rows = [slow_grams(t) for t in texts]
    part, seen = [], Counter()
    for label in y:
        part.append(seen[label] % folds)
        seen[label] += 1
    z = [0.0] * len(y)
    for k in range(folds):
        learn = [i for i in range(len(y)) if part[i] != k]
        w, b = slow_weights([rows[i] for i in learn], [y[i] for i in learn], l2, rounds)
        for i in range(len(y)):
            if part[i] == k:
                z[i] = b + sum(w.get(f, 0) for f in rows[i])
    pos = sum(y)
    target = [(pos + 1) / (pos + 2) if t else 1 / (len(y) - pos + 2) for t in y]
    slope = shift = 0.0
    for _ in range(50):
        g, h = [-1e-6 * slope, -1e-6 * shift], [1e-6, 0.0, 1e-6]
        for x, t in zip(z, target):
            p = 1 / (1 + math.exp(-max(-30, min(30, slope * x + shift))))
            g[0] += (t - p) * x
            g[1] += t - p
            for i, c in enumerate((x * x, x, 1)):
                h[i] += p * (1 - p) * c
        det = h[0] * h[2] - h[1] ** 2
        a, c = (h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det
        slope, shift = slope + a, shift + c
        if max(abs(a), abs(c)) < 1e-8:
            break
    w, b = slow_weights(rows, y, l2, rounds)
    return {f: slope * x for f, x in w.items()}, slope * b + shift


def test_fit_against_loops():
    rows, labels = corpus(60)
    texts, y = [r[1][:160] for r in rows], [t for _, _, t in labels]
    texts = [t if not label else t + " vilething" for t, label in zip(texts, y)]
    want, bias = slow_fit(texts, y)
    bucket, weight, got = toxicity.fit_rows(texts, np.array(y))
    assert dict(zip(bucket.tolist(), [0] * len(bucket))).keys() == want.keys() and len(want) > 5
    assert abs(got - bias) < 1e-3 * max(1, abs(bias))
    assert all(abs(w - want[f]) < 1e-3 * max(1, abs(want[f])) for f, w in zip(bucket.tolist(), weight.tolist()))
