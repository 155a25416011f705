"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item (13 consecutive words; an item of fewer is one window) is the set of its three-word shingles. A
document can hold the window only if it holds every shingle, so one necessary token is enough as the prefix: the shingle
that is rarest in the corpus. An inverted index of these tokens is probed with the shingles of each document; the place of
the token gives the only place where the window can start, which must leave room for the window's length inside the
document; what is left is verified word by word and then byte by byte.

The items are the stated query set. They are taken in blocks of at most BLOCK windows, so what is broadcast has a fixed
bound. One block judges the documents as they stream by. Of more blocks each reads the documents twice (counts, then hits)
and writes its hits alone; they are summed by document and joined back, and no text is written or shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import all_of, drop_all_but, field, mix, prefix_hashes, quoted, runs_by_size, small_batches, stored, tidy, write_stored, written

WINDOW = 13
SHINGLE = 3
BLOCK = 50_000
CHUNK = 1_000_000
#: ASCII capitals become small letters; every other ASCII byte but digits and letters separates words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
STEPS = [mix(np.array([7919 + k], dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))[0] | np.uint64(1) for k in range(WINDOW)]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def hashed_words(data: bytes) -> Words:
    """Places and hashes of the words of translated text, some megabytes at a time."""
    parts, at = [], 0
    while at < len(data):
        stop = len(data) if len(data) - at <= CHUNK else data.find(b" ", at + CHUNK)
        stop = len(data) if stop < 0 else stop
        a = np.frombuffer(data, np.uint8, stop - at, at)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = a != 32
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        prefix, up = prefix_hashes(a)
        parts.append((s + at, e + at, mix((prefix[e] - prefix[s]) * up[s] + (e - s).astype(np.uint64))))
        at = stop
    if not parts:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    return Words(*(np.concatenate(x) for x in zip(*parts)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """For each word the hash of the n words from there on (the last n - 1 have none)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k : k + m] * STEPS[k]
    return mix(out + np.uint64(n))


@dataclass
class Index:
    """A block of windows: words by number, distinct windows with their items, and the tokens in order."""

    lengths: np.ndarray  # of the windows, in words
    hashes: np.ndarray  # windows by WINDOW; beyond the length zero
    texts: list[bytes]  # words joined by spaces
    items: list[list]
    tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by shingle length: token, window, place in the window

    def prefixes(self, counts: dict[tuple[int, int], int] | None) -> dict[int, tuple]:
        """The rarest token of each window (the first of equally rare ones), as sorted tokens with a list of (window, place)."""
        out = {}
        for n, (token, window, place) in self.tokens.items():
            if counts is not None:
                rare = np.array([counts.get((n, int(t)), 0) for t in token.view(np.int64)], dtype=np.int64)
                order = np.lexsort((place, rare, window))
                first = order[np.concatenate([[True], np.diff(window[order]) > 0])] if len(order) else order
                token, window, place = token[first], window[first], place[first]
            order = np.argsort(token, kind="stable")
            token, window, place = token[order], window[order], place[order]
            unique, start = np.unique(token, return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[(unique >> np.uint64(44)).astype(np.int64)] = True
            out[n] = (unique, np.append(start, len(token)), window, place, seen)
        return out


def index_of(rows: list[tuple[object, list[bytes]]]) -> Index:
    """rows: (item_id, the words of some of its windows)."""
    seen: dict[bytes, int] = {}
    items: list[list] = []
    for item, words in rows:
        k = seen.setdefault(b" ".join(words), len(seen))
        if k == len(items):
            items.append([])
        items[k].append(item)
    texts = list(seen)
    w = hashed_words(b" ".join(texts))
    lengths = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    hashes = np.zeros((len(texts), WINDOW), np.uint64)
    for k in range(WINDOW):
        m = lengths > k
        hashes[m, k] = w.hash[first[:-1][m] + k]
    tokens = {}
    for n in range(1, SHINGLE + 1):
        own = np.flatnonzero(lengths == n) if n < SHINGLE else np.flatnonzero(lengths >= SHINGLE)
        if len(own):
            per = lengths[own] - n + 1
            window = np.repeat(own, per)
            place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            tokens[n] = (gram_hashes(w.hash, n)[first[window] + place], window, place)
    return Index(lengths, hashes, texts, items, tokens)


def _probe(h: np.ndarray, n: int, prefixes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-word shingles that are among the prefixes, and which they are."""
    unique, seen = prefixes[0], prefixes[4]
    grams = gram_hashes(h, n)
    at = np.flatnonzero(seen[(grams >> np.uint64(44)).astype(np.int64)])
    which = np.minimum(np.searchsorted(unique, grams[at]), len(unique) - 1)
    ok = unique[which] == grams[at]
    return at[ok], which[ok]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int, bytes, Words, np.ndarray]]:
    """Runs of texts: from, to, their bytes, their words, and for each text the number of its first word (one more at the end)."""
    for a, b in runs_by_size([len(t or b"") for t in texts], CHUNK):
        data = b" ".join((t or b"").translate(TABLE) for t in texts[a:b])
        words = hashed_words(data)
        begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts[a:b])])
        yield a, b, data, words, np.searchsorted(words.start, begins)


def find(index: Index, prefixes: dict[int, tuple], texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """For each text: the number of its words, the maximal runs of words that are hit, and the items with a window in it."""
    for a, b, data, words, first in _chunks(texts):
        found_at, found = [], []
        for n, p in prefixes.items():
            at, which = _probe(words.hash, n, p)
            if not len(at):
                continue
            per = p[1][which + 1] - p[1][which]
            entry = np.repeat(p[1][which], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            window, begin = p[2][entry], np.repeat(at, per) - p[3][entry]
            text = np.searchsorted(first, np.repeat(at, per), side="right") - 1
            ok = (begin >= first[text]) & (begin + index.lengths[window] <= first[text + 1])
            window, begin = window[ok], begin[ok]
            for k in range(WINDOW):
                use = index.lengths[window] > k
                ok = ~use
                ok[use] = words.hash[begin[use] + k] == index.hashes[window[use], k]
                window, begin = window[ok], begin[ok]
            found_at.append(begin)
            found.append(window)
        begin, window = (np.concatenate(found_at), np.concatenate(found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(begin, kind="stable")
        begin, window = begin[order], window[order]
        split = np.searchsorted(begin, first)
        for t in range(b - a):
            runs: list[tuple[int, int]] = []
            items: set = set()
            for s, w in zip(begin[split[t] : split[t + 1]].tolist(), window[split[t] : split[t + 1]].tolist()):
                e = s + int(index.lengths[w])
                if b" ".join(data[words.start[i] : words.end[i]] for i in range(s, e)) != index.texts[w]:
                    continue
                items.update(index.items[w])
                s, e = s - int(first[t]), e - int(first[t])
                if runs and s <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
                else:
                    runs.append((s, e))
            yield int(first[t + 1] - first[t]), runs, items


def _joined(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The windows of the items, at most so many at a time; the items come to the driver one partition after another."""
    rows: list[tuple[object, list[bytes]]] = []
    for r in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(r["text"])
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            rows.append((r["item_id"], words[i : i + WINDOW]))
            if len(rows) == block:
                yield rows
                rows = []
    if rows:
        yield rows


def _count_tokens(docs: DataFrame, index: Index) -> dict[tuple[int, int], int]:
    """How often each token of the block occurs in the documents; at most one row for each token comes back."""
    every = docs.sparkSession.sparkContext.broadcast(index.prefixes(None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = every.value
        counts = {n: np.zeros(len(p[0]), np.int64) for n, p in tables.items()}
        for b in batches:
            for _, _, _, words, _ in _chunks(b.column(0).to_pylist()):
                for n, p in tables.items():
                    np.add.at(counts[n], _probe(words.hash, n, p)[1], 1)
        for n, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(tables[n][0][some].view(np.int64)), pa.array(c[some])], ["n", "token", "count"])

    rows = docs.select("text").mapInArrow(tidy(work), "n int, token long, count long").groupBy("n", "token").agg(F.sum("count").alias("count")).collect()
    return {(r["n"], r["token"]): r["count"] for r in rows}


class _Finder:
    """A block of windows, as the workers see it."""

    def __init__(self, docs: DataFrame, rows: list[tuple[object, list[bytes]]]):
        index = index_of(rows)
        self.shared = docs.sparkSession.sparkContext.broadcast((index, index.prefixes(_count_tokens(docs, index) if rows else {})))

    def find(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, the runs of words that are hit, and the items found, sorted."""
        for n, runs, items in find(*self.shared.value, texts):
            yield n, runs, sorted({str(i) for i in items if i is not None})


JUDGED = "n_words long, n_hit long, hit_runs array<array<long>>, items array<string>"


def _verdicts(found: Iterable[tuple[int, list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    words, runs, items = zip(*found) if (found := list(found)) else ([], [], [])
    hits = [sum(e - s for s, e in r) for r in runs]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
    return [pa.array(x, k) for x, k in zip((list(words), hits, [[list(x) for x in r] for r in runs], list(items)), kinds)]


def _judge(docs: DataFrame, benchmark: DataFrame, block: int, carried: Column) -> DataFrame:
    """A row for each row of docs: the columns of JUDGED, and carried."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    blocks = item_blocks(benchmark, block)
    rows, following = next(blocks, []), next(blocks, None)
    if following is None:
        finder, plain = _Finder(texts, rows), docs.select(F.col("text").cast("binary").alias("text"), carried.alias("carried"))
        schema = StructType([*_parse(JUDGED), plain.schema["carried"]])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*_verdicts(finder.find(b.column(0).to_pylist())), b.column(1)], schema.names)

        return plain.mapInArrow(tidy(work), schema)

    # more than one block: each reads the documents and leaves only its hits, by a 128-bit hash of doc_id and text
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]
    keyed, parts, before = docs.select(*keys, F.col("text").cast("binary").alias("text")), [], written()
    while rows:
        finder = _Finder(texts, rows)

        def hits(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, runs, items) for i, (_, runs, items) in enumerate(finder.find(b.column(2).to_pylist())) if runs]
                at = pa.array([i for i, _, _ in found], pa.int64())
                arrays = [pa.array([[list(x) for x in r] for _, r, _ in found], pa.list_(pa.list_(pa.int64()))), pa.array([i for _, _, i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *arrays], ["k1", "k2", "runs", "items"])

        parts.append(stored(keyed.mapInArrow(tidy(hits), "k1 long, k2 long, runs array<array<long>>, items array<string>"), "contamination"))
        rows, following = following or [], next(blocks, None)
    own = [F.flatten(F.collect_set("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]
    path = write_stored(reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(*own), "contamination")
    drop_all_but(docs.sparkSession, before, {path})
    joined = docs.select(*keys, F.col("text").cast("binary").alias("text"), carried.alias("carried"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(w) for w in map(words_of, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(3)], ["k1", "k2", "n_words", "carried"])

    counted = joined.mapInArrow(tidy(sizes), StructType([*_parse("k1 long, k2 long, n_words long"), joined.schema["carried"]]))
    both = counted.join(docs.sparkSession.read.parquet(path), ["k1", "k2"], "left").select("n_words", "runs", "items", "carried")
    schema = StructType([*_parse(JUDGED), joined.schema["carried"]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, items = (c.to_pylist() for c in b.columns[:3])
            yield pa.RecordBatch.from_arrays([*_verdicts((m, _joined(map(tuple, r or [])), i or []) for m, r, i in zip(n, runs, items)), b.column(3)], schema.names)

    return both.mapInArrow(tidy(merge), schema)


def _parse(schema: str) -> list[StructField]:
    return StructType.fromDDL(schema).fields


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text) -> a row for each row of docs:
    doc_id, n_words, n_hit, hit_runs (array of [from, to) word numbers), items (array of item_ids as strings, sorted), and the columns in keep.

    A word is hit if it lies in an occurrence of an item's window. Null texts and texts without words have no words and no hits.
    Items without words are never found; items with the same text are all found; a null item_id hits but is not listed.
    No items: nothing is hit. Rows that repeat a doc_id are judged each. Columns named like the result's are not carried.
    """
    own = ("doc_id", "n_words", "n_hit", "hit_runs", "items")
    extra = [c for c in keep if c in docs.columns and c not in own]
    out = _judge(docs, benchmark, block, F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(quoted(c).alias(c) for c in extra)))
    return out.select(F.col("carried.doc_id").alias("doc_id"), *own[1:], *(field("carried", c) for c in extra))


def is_contaminated(hit: str = "n_hit", words: str = "n_words"):
    """At least one word in twenty is hit."""
    return (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without the contaminated ones; rows and columns are otherwise as they were, whatever the columns are called."""
    return _judge(docs, benchmark, block, all_of(docs)).where(~is_contaminated()).select(*(field("carried", c) for c in docs.columns))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
