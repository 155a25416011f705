import numpy as np
import xxhash
from tandemlake.llm import simhash
from tandemlake.llm.components import connected_components

from .helpers import DOCS, prose, table


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """fps: (doc_id, fingerprint)"""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    base = prose(1, 400).split()
    texts = [None, "", " \n\t", "One", "one two", "ONE TWO THREE", prose(9, 70_000)]
    for k in range(30):
        w = list(base)
        w[13 * k % 400] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [prose(s, 200) for s in range(20, 30)] + [texts[8]] * 4
    got = simhash.components(table(spark, texts, "'x' as fp")).collect()
    fps = [(i, slow_fingerprint(t)) for i, t in enumerate(texts)]
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {i: (f, c) for (i, f), c in zip(fps, slow_components(fps))}
    assert len(got) == len(texts)


def test_links_of_planted_fingerprints(spark):
    """Small and large buckets, down to the second cut, give the components of brute force."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set()
    for c in centre[:3]:
        for _ in range(60):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                f ^= 1 << int(b)
            fps.add(f)
    for _ in range(150):  # agree in the upper half: one bucket
        f = int(centre[4])
        for b in rng.integers(0, 32, rng.integers(0, 9)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    want = slow_components([(s[0], f) for s, f in zip(signed, fps)])
    for limit in (4096, 20):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), bucket_limit=limit)
        rows = links.collect()
        assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in rows)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        assert [roots.get(s[0], s[0]) for s in signed] == want


def test_forest_by_flips_equals_the_plain_one():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 2**12, 300, dtype=np.uint64))

    def parts(links):
        parent = {int(f): int(f) for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = find(int(a)), find(int(b))
            parent[max(a, b)] = min(a, b)
        return [find(int(f)) for f in fps]

    everything = [(a, b) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 3]
    assert parts(simhash._forest_by_flips(fps, 0)) == parts(everything)


def test_odd_tables(spark):
    assert simhash.components(table(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", None, None, None), (1, "a b c d", None, None, None), (None, "a b c d", None, None, None), (None, None, None, None, None)], DOCS)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.components(docs).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_texts_without_or_with_repeated_ids_stay(spark):
    """Rows are told apart by text: null ids keep each text once, and an id that two texts have keeps both."""
    texts = [prose(s, 40) for s in range(60, 66)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3]), (2, texts[2]), (None, texts[4]), (3, texts[4]), (0, texts[5]), (3, texts[5])]
    kept = simhash.keep_one(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), texts.index(r.text)) for r in kept) == [("0", 5), ("1", 2), ("1", 3), ("3", 4), ("None", 0), ("None", 1)]
