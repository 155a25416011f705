import random

import corpus_pipeline
from tandemlake.llm import near_copies

from .helpers import DOCS, prose


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(rows):
    """The doc_ids that stay, by all pairs."""
    parent, sets = list(range(len(rows))), [grams(t) for _, t in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_stage_keeps_one_of_all_pairs_at_four_fifths(spark):
    r, texts = random.Random(4), [None, "", "One two", "one  TWO", "one two three"]
    for k in range(12):
        base = prose(200 + k, 60 + 40 * k).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            w = list(texts[-1 if k % 2 else -edits % len(texts)].split() if k % 3 == 0 and texts[-1] else base)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(x.doc_id for x in got) == slow(rows)
    assert 20 < len(got) < len(rows) - 20


def edited(base, r, edits, words):
    w = list(base)
    for _ in range(edits):
        at, how = r.randrange(len(w)), r.random()
        w[at : at + 1] = [] if how < 0.3 else [r.choice(words)] if how < 0.6 else [w[at], f"new{r.random()}"]
    return w


def test_large_buckets_of_texts_that_are_alike(spark):
    """Links by size alone, by shared differences, between two bases of one group, and none."""
    r, texts = random.Random(9), []
    one = prose(31, 150).split()
    two = one[:75] + prose(32, 25).split() + one[100:]
    for base in (one, two):
        for k in range(80):
            texts.append(edited(base, r, 1 + k % 10, ["the", "of"]))
        for _ in range(6):  # far from the base, near each other
            far = edited(base, r, 9, ["the", "of"])
            texts += [edited(far, r, 1, ["the"]) for _ in range(3)]
    rows = list(enumerate(" ".join(w) for w in texts))
    r.shuffle(rows)
    got = near_copies.keep_one(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)).collect()
    assert sorted(x.doc_id for x in got) == slow(rows)
    assert 30 < len(got) < len(rows) - 60


def test_pairs_tried_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Texts with edits of their own are alike at some 0.7: no pair of them is to be tried for sharing a bucket."""
    r, base, tried, plain = random.Random(3), prose(51, 150).split(), [], near_copies._alike
    rows = [(d, " ".join(edited(base, r, 5, ["the"]))) for d in range(200)]

    def counted(pairs, sets):
        tried.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(near_copies, "_alike", counted)
    got = near_copies.keep_one(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)).collect()
    assert sorted(x.doc_id for x in got) == slow(rows)
    assert len(got) > 100
    assert sum(tried[3:]) < 10 * len(rows)


def test_no_rows(spark):
    assert near_copies.keep_one(spark.createDataFrame([], DOCS)).count() == 0
