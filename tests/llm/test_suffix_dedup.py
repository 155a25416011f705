import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
from tandemlake.llm import common, suffix_dedup
from tandemlake.llm.suffix_dedup import Suffixes

from .helpers import DOCS, prose, table


def slow(texts, gram):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + gram] for d in data for i in range(len(d) - gram + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - gram + 1):
            if seen[d[i : i + gram]] > 1:
                gone[i : i + gram] = b"\1" * gram
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fast(df):
    return {r.doc_id: (r.n_bytes, sum(e - s for s, e in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def corpus():
    r = random.Random(4)
    base = [prose(s, 300) for s in range(8)]
    passage = prose(99, 60)
    texts = [None, "", "short", "=" * 900, "ab" * 500, base[0], base[0], base[1] + passage, passage + base[2], base[3][:700] + passage + base[3][700:] + passage, prose(50, 20)]
    for k in range(25):  # near copies
        w = base[4].split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = f"e{k}"
        texts.append(" ".join(w))
    return [*texts, base[5][:199], base[5][:199], base[6][:200], base[6][:200], base[5] + "é" * 130]


def test_whole_corpus(spark):
    texts = corpus()
    assert fast(suffix_dedup.remove_repeats(table(spark, texts, "'x' as found"))) == dict(enumerate(slow(texts, 200)))


def test_large_groups_are_counted(spark):
    texts = corpus()
    assert fast(suffix_dedup.remove_repeats(table(spark, texts), group_limit=3)) == dict(enumerate(slow(texts, 200)))


def test_equal_digests_of_different_bytes_are_noticed(spark):
    """With digests of two bits almost all records have the same one: another digest is taken."""
    texts = corpus()
    assert fast(suffix_dedup.remove_repeats(table(spark, texts), digest_bits=2)) == dict(enumerate(slow(texts, 200)))


def test_repeated_rows_do_not_gather(spark):
    """Many rows alike, without an id: one list of records for all of them."""
    t = prose(70, 150)
    docs = spark.createDataFrame([(None, t, None, None, None)] * 400 + [(-(1 << 63), t + "x", None, None, None), (1, prose(71, 90), None, None, None)], DOCS)
    got = sorted((str(r.doc_id), len(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([("None", 0)] * 400 + [(str(-(1 << 63)), 1), ("1", len(prose(71, 90).encode()))])


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    got = [list(x) for x in zip(*(a.tolist() for a in next(suffix_dedup._anchors([texts[5].encode()], 200, 40))))]
    assert got and all(0 <= at - first <= 160 for _, at, first, _, _ in got)
    long = " ".join(prose(s, 3000) for s in range(40))  # over a megabyte
    monkeypatch.undo()
    docs = [long, "x" + long[500_000:]]
    n = len(docs[0].encode())
    got = fast(suffix_dedup.remove_repeats(table(spark, docs)))
    shared = len(long[500_000:].encode())
    assert got[1][:3] == (shared + 1, shared, 1) and got[0][:3] == (n, shared, 1)


def test_mergesort_orders_suffixes():
    r = random.Random(8)
    data = bytes(r.choice(b"ab") for _ in range(600))
    s = Suffixes(np.frombuffer(data, np.uint8), 20)
    at = np.array([r.randrange(580) for _ in range(300)])
    segment = np.sort(np.array([r.randrange(5) for _ in range(300)]))
    order = s.sort(at, segment)
    want = sorted(range(300), key=lambda i: (segment[i], data[at[i] : at[i] + 20]))
    assert [(segment[i], data[at[i] : at[i] + 20]) for i in order] == [(segment[i], data[at[i] : at[i] + 20]) for i in want]


def test_collisions_are_found(monkeypatch):
    """With a hash that takes all bytes for the same, verification still gives the right repeats."""
    data = b"abcdefgh" * 3 + b"abcdxxgh" + b"zzzzzzzz"
    s = Suffixes(np.frombuffer(data, np.uint8), 8)
    at, segment = np.array([0, 8, 24, 32]), np.zeros(4, np.int64)
    monkeypatch.setattr(s, "hash", lambda at, n: np.zeros(len(at), np.uint64))
    assert s.repeated(at, segment).tolist() == [True, True, False, False]


def test_odd_tables(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    t = prose(3, 120)
    docs = spark.createDataFrame([(7, t, "a", None, 5), (7, t, "b", None, 5), (None, t, None, None, None), (7, "other", None, None, 1), (None, None, None, None, None)], DOCS)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), len(r.kept)) for r in rows) == [("7", 0), ("7", 0), ("7", 5), ("None", 0), ("None", 0)]
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((str(r.text), str(r.lang), r.n_chars or 0) for r in cut.collect()) == [("", "None", 0), ("", "a", 0), ("", "b", 0), ("None", "None", 0), ("other", "None", 1)]


def test_records_of_unique_anchors_are_not_dealt_out(spark, monkeypatch):
    made, plain = [], suffix_dedup._records

    def counted(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "_records", counted)
    passage = prose(901, 60)
    texts = [prose(700 + i, 150) + (" " + passage + " " + prose(800 + i, 20) if i % 20 == 0 else "") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(table(spark, texts)).selectExpr("doc_id", "aggregate(spans, 0L, (n, s) -> n + s[1] - s[0]) AS n_removed").collect()}
    assert got == {i: w[1] for i, w in enumerate(slow(texts, 200))} and sum(got.values()) > 0
    assert 0 < made[0] < 40


def test_shuffle_files_go_without_garbage_collection(spark, monkeypatch):
    """What the executions on the way have shuffled is gone when they end, and the session's setting is as it was."""
    monkeypatch.setattr(common, "release", lambda spark: None)
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*") if f.suffix != ".tmp"}
    key, texts, before, left = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", corpus(), files(), []
    was, plain = spark.conf.get(key), common.write_stored

    def watched(df, name):
        path, until = plain(df, name), time.time() + 10
        while files() - before and time.time() < until:  # the engine removes them in the background
            time.sleep(0.1)
        left.append((name, len(files() - before)))
        return path

    monkeypatch.setattr(common, "write_stored", watched)
    monkeypatch.setattr(suffix_dedup, "write_stored", watched)
    out = suffix_dedup.remove_repeats(table(spark, texts))
    assert left == [("anchors", 0), ("repeats", 0), ("classes", 0), ("spans", 0)]
    assert spark.conf.get(key) == was
    assert fast(out) == dict(enumerate(slow(texts, 200)))
