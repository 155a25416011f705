"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of GRAM bytes that covers it starts anywhere else in the corpus as well. The suffixes that can have
such a partner are found first: the minimum of a K-byte hash over each GRAM-byte string (its anchor) depends on the string
alone, so equal strings have equal anchors at equal places. Anchors whose hash is unique in the corpus are dropped by a
partial aggregate and a join; most go beforehand, where a bitmap of bounded size has no shared hash with the same low bits. The record of an anchor holds the starts that share it, and the bytes that they need. Records
of equal bytes are one class (grouped by the bytes themselves, within the tasks first): one suffix each in the sort, with the
number of its copies. The suffixes of the classes that share an anchor are sorted by mergesort, where two suffixes are
compared by prefix polynomial hashes and binary search for their common extension; a suffix repeats if it has copies or
GRAM bytes in common with a neighbour. Every neighbour pair is checked byte by byte, and a group with a collision is sorted
again by its bytes. A group of more than GROUP_LIMIT classes is not brought together: its strings are counted by a partial
aggregate on a 128-bit digest. Verdicts go back to records by a 64-bit digest of their bytes; that no two classes have
the same one is checked, and with another digest all of it is done again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import all_of, drop_all_but, field, join_splittable, mix, prefix_hashes, quoted, runs_by_size, shuffles_removed, small_batches, stored, tidy, write_stored, written

GRAM = 200
K = 40
CHUNK = 500_000
GROUP_LIMIT = 4096
KERNEL_BYTES = 2_000_000
BLOCK = 16
#: Bits of the map of shared anchors, at most: 32 MB, however many there are.
MAP_BITS = 1 << 28
LOW = np.uint64((1 << 28) - 1)


def _anchors(texts: list[bytes], gram: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: text, place of the anchor, first start, number of starts, hash of the anchor."""
    width = gram - k + 1
    pieces = []  # text, offset of the piece in it, bytes: a long text is cut; the pieces overlap by a string less one byte
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - gram + 1), CHUNK):
            if len(t) - a >= gram:
                pieces.append((i, a, t[a : a + CHUNK + gram - 1]))
    for x, y in runs_by_size([len(p[2]) for p in pieces], CHUNK):
        part = pieces[x:y]
        data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        lens = np.array([len(p[2]) for p in part])
        begin = np.concatenate([[0], np.cumsum(lens)])
        prefix, up = prefix_hashes(data)
        m = len(data) - k + 1
        h = mix((prefix[k:] - prefix[:m]) * up[:m])
        low = (h & ~LOW) | (LOW - np.arange(m, dtype=np.uint64))  # of equal hashes the last one in the string
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        ok = np.zeros(len(data) + 1, np.int8)
        ok[begin[:-1]] += 1
        ok[begin[1:] - gram + 1] -= 1
        starts = np.flatnonzero(np.cumsum(ok)[: len(low)])
        at = (LOW - (low[starts] & LOW)).astype(np.int64)
        new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        piece = np.searchsorted(begin, starts[first], side="right") - 1
        shift = np.array([p[1] for p in part])[piece] - begin[piece]
        yield np.array([p[0] for p in part])[piece], at[first] + shift, starts[first] + shift, count, h[at[first]]


def _hashes(docs: DataFrame, gram: int, k: int) -> DataFrame:
    """The anchor hashes of all documents, one row each (within a batch, one row for equal ones, with their number)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x[4] for x in _anchors([t or b"" for t in b.column(0).to_pylist()], gram, k)]
            h, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(tidy(work), "h long, n long")


def _bitmap(shared: DataFrame) -> np.ndarray:
    """A bit for the low bits of each hash in shared (h), as 64-bit words: what has no bit is not in shared."""
    bits = min(MAP_BITS, max(64, 1 << (16 * shared.count()).bit_length()))
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = shared.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _records(docs: DataFrame, gram: int, k: int, attempt: int, mask: int, bitmap: Broadcast) -> DataFrame:
    """(h, c, k1, k2, place): anchor, digest of the record's bytes, document, and first start, anchor and starts in one long.
    Only records whose anchor may be shared, by the bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            k1, k2 = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for text, at, first, count, h in _anchors(texts, gram, k):
                low = h & np.uint64(64 * len(words) - 1)
                maybe = np.flatnonzero(words[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))
                text, at, first, count, h = text[maybe], at[maybe], first[maybe], count[maybe], h[maybe]
                back = at - first
                digests = b"".join(
                    hashlib.blake2b(texts[i][s : s + n + gram - 1], digest_size=8, salt=d.to_bytes(2, "little"), person=bytes([attempt])).digest()
                    for i, s, n, d in zip(text.tolist(), first.tolist(), count.tolist(), back.tolist())
                )
                place = first << 20 | back << 10 | count
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.frombuffer(digests, "<i8") & mask), pa.array(k1[text]), pa.array(k2[text]), pa.array(place)], ["h", "c", "k1", "k2", "place"])

    return docs.select("k1", "k2", "text").mapInArrow(tidy(work), "h long, c long, k1 long, k2 long, place long")


# ------------------------------------------------------------------ the sort


class Suffixes:
    """Suffixes of a buffer, compared on their first `gram` bytes."""

    def __init__(self, data: np.ndarray, gram: int):
        self.data, self.gram = data, gram
        self.prefix, self.up = prefix_hashes(data)

    def hash(self, at: np.ndarray, n) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.up[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, gram at most, by binary search over prefix hashes."""
        same = np.zeros(len(x), np.int64)
        step = 1 << (self.gram.bit_length() - 1)
        while step:
            to = same + step
            ok = to <= self.gram
            n = np.where(ok, step, 0)
            ok &= self.hash(x + same, n) == self.hash(y + same, n)
            same[ok] = to[ok]
            step >>= 1
        return same

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether y comes before x; where or_equal, equal ones count too."""
        n = self.common(x, y)
        equal = n >= self.gram
        n = np.minimum(n, self.gram - 1)
        return np.where(equal, or_equal, self.data[y + n] < self.data[x + n])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes, segment by segment (segment numbers rise): bottom-up mergesort of all segments together.

        In a round each suffix finds its rank in the neighbouring run by binary search.
        """
        n = len(at)
        first = np.flatnonzero(np.concatenate([[True], np.diff(segment) != 0])) if n else np.empty(0, np.int64)
        length = np.diff(np.append(first, n))
        start, size = np.repeat(first, length), np.repeat(length, length)
        order = np.arange(n)
        width = 1
        while width < (length.max() if n else 0):
            who = np.flatnonzero(size > width)
            rank = who - start[who]
            run = rank // width
            other = (run ^ 1) * width
            others = np.clip(size[who] - other, 0, width)
            left = run % 2 == 0
            lo, hi = np.zeros(len(who), np.int64), others.copy()
            active = np.flatnonzero(lo < hi)
            while len(active):
                w = who[active]
                mid = (lo[active] + hi[active]) // 2
                y = at[order[start[w] + other[active] + mid]]
                before = self.less(at[order[w]], y, ~left[active])
                lo[active] = np.where(before, mid + 1, lo[active])
                hi[active] = np.where(before, hi[active], mid)
                active = active[lo[active] < hi[active]]
            new = start[who] + (run - run % 2) * width + rank % width + lo
            moved = order[who]
            order[new] = moved
            width *= 2
        return order

    def repeated(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Which suffixes share gram bytes with another one of their segment."""
        out = np.zeros(len(at), bool)
        if len(at) < 2:
            return out
        order = self.sort(at, segment)
        x, y = order[:-1], order[1:]
        pair = segment[x] == segment[y]
        x, y = x[pair], y[pair]
        n = self.common(at[x], at[y])
        wrong = self.collisions(at[x], at[y], n)
        equal = n >= self.gram
        out[x[equal]] = out[y[equal]] = True
        for s in np.unique(segment[x[wrong]]):  # two different strings had one hash: these segments by their bytes
            own = np.flatnonzero(segment == s)
            seen: dict[bytes, list[int]] = {}
            for i in own:
                seen.setdefault(self.data[at[i] : at[i] + self.gram].tobytes(), []).append(i)
            out[own] = False
            for group in seen.values():
                out[group] = len(group) > 1
        return out

    def collisions(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Neighbours whose bytes don't agree with the common extension that hashes gave, or are out of order."""
        wrong = np.zeros(len(x), bool)
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.gram)
        for a in range(0, len(x), 20_000):
            s = slice(a, a + 20_000)
            differ = view[x[s]] != view[y[s]]
            real = np.where(differ.any(axis=1), differ.argmax(axis=1), self.gram)
            m = np.minimum(real, self.gram - 1)
            wrong[s] = (real != n[s]) | ((real < self.gram) & (self.data[x[s] + m] > self.data[y[s] + m]))
        return wrong


def _compare(rows: list[tuple], gram: int) -> Iterator[tuple[int, int, bytes]]:
    """rows (h, c, n, place, bytes) of whole groups, records of a group different, n copies of each -> (h, c, bitmap of repeated starts)
    where n = 1; all starts of a record with copies repeat."""
    h = np.array([r[0] for r in rows], np.int64)
    place = np.array([r[3] for r in rows], np.int64)
    back, count = place >> 10 & 1023, place & 1023
    base = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])[:-1]])
    suffixes = Suffixes(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), gram)
    group = np.cumsum(np.concatenate([[0], np.diff(h) != 0]))
    record = np.repeat(np.arange(len(rows)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    before = back[record] - j  # how far before its anchor a suffix starts
    at = base[record] + j
    # suffixes of one anchor whose inner part (what BLOCK neighbouring starts share) is unique need no sorting
    core = before // BLOCK * BLOCK
    inner = suffixes.hash(base[record] + back[record] - core, gram - BLOCK + 1)
    key = mix(inner + mix((group[record] << 9 | before).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    many = same.copy()
    many[:-1] |= same[1:]
    chosen = order[many]
    segment = np.cumsum(~same[many])
    flags = np.zeros(len(at), bool)
    flags[chosen] = suffixes.repeated(at[chosen], segment)
    ends = np.cumsum(count)
    for i, r in enumerate(rows):
        if r[2] == 1:
            yield r[0], r[1], np.packbits(flags[ends[i] - count[i] : ends[i]]).tobytes()


def _kernel(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, n, place, window), a row for each class, sorted by h; whole groups are gathered until there are KERNEL_BYTES."""
    rows: list[tuple] = []
    size = 0

    def out(part: list[tuple]) -> pa.RecordBatch:
        got = list(_compare(part, gram))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.binary())], ["h", "c", "bits"])

    for b in batches:
        for r in zip(*(x.to_pylist() for x in b.columns)):
            if size > KERNEL_BYTES and rows[-1][0] != r[0]:
                yield out(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[4])
    if rows:
        yield out(rows)


def _counted(classes: DataFrame, gram: int) -> DataFrame:
    """The same verdicts for the classes of very large groups, by counting digests of their strings."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, n, place, w in zip(*(x.to_pylist() for x in b.columns)):
                m = place & 1023
                g = np.frombuffer(b"".join(hashlib.blake2b(w[j : j + gram], digest_size=16).digest() for j in range(m)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, h)), pa.array(np.full(m, c)), pa.array(np.full(m, n)), pa.array(np.arange(m)), pa.array(g[:, 0].copy()), pa.array(g[:, 1].copy())], ["h", "c", "n", "j", "g0", "g1"])

    each = classes.mapInArrow(tidy(strings), "h long, c long, n long, j long, g0 long, g1 long")
    twice = each.groupBy("g0", "g1").agg(F.count("*").alias("times")).where("times > 1").select("g0", "g1", F.lit(True).alias("again"))
    marked = join_splittable(each.where("n = 1"), twice, ["g0", "g1"], "left")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for js, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                flags = np.zeros(m, bool)
                flags[js] = True
                made.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["h", "c", "bits"])

    found = marked.groupBy("h", "c").agg(F.collect_list(F.when(F.col("again"), F.col("j"))).alias("js"), F.count("*").alias("m"))
    return found.mapInArrow(tidy(bits), "h long, c long, bits binary")


# ------------------------------------------------------------------ the operator


def _classes(own: DataFrame, found: DataFrame, gram: int) -> DataFrame:
    """Records with equal bytes, once: h, c, place (without the first start), window, and n, how many there are."""
    lists = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "c", "place")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for packed, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = unpack(packed)
                places = [r["place"] for r in records]
                windows = [text[p >> 20 : (p >> 20) + (p & 1023) + gram - 1] for p in places]
                columns = [pa.array([r[x] for r in records], pa.int64()) for x in ("h", "c")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([p & 0xFFFFF for p in places], pa.int64()), pa.array(windows, pa.binary())], ["h", "c", "place", "window"])

    windows = join_splittable(own.select("k1", "k2", "packed"), lists, ["k1", "k2"]).select("packed", "wanted")
    return windows.mapInArrow(tidy(cut), "h long, c long, place long, window binary").groupBy("h", "c", "place", "window").agg(F.count("*").alias("n"))


def _packed(docs: DataFrame, carried: Column) -> DataFrame:
    """k1, k2 (a 128-bit hash of doc_id and text), the text compressed, and carried: what is dealt out by document."""
    blob = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(*_keys(), blob.alias("packed"), carried.alias("carried"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t) for t in b.column(2).to_pylist()], pa.binary()), b.column(3)], ["k1", "k2", "packed", "carried"])

    return rows.mapInArrow(tidy(work), rows.schema)


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def _spans(docs: DataFrame, packed: DataFrame, gram: int, k: int, group_limit: int, digest_bits: int) -> DataFrame:
    """(k1, k2, found), stored: the records of each document that has some, as structs of place and bits (null: all starts repeat)."""
    spark = docs.sparkSession
    own = docs.select(*_keys(), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    before = written()
    # stored, so that the joins are between plain exchanges and a very common anchor can be split over tasks
    shared = stored(_hashes(own, gram, k).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors")
    bitmap = spark.sparkContext.broadcast(_bitmap(shared))
    for attempt in range(5):
        mask = -1 if attempt else (1 << digest_bits) - 1 if digest_bits < 64 else -1
        found = stored(_records(own, gram, k, attempt, mask, bitmap).join(shared, "h"), "repeats")
        classes = stored(_classes(packed, found, gram), "classes")
        if classes.groupBy("h", "c").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("different strings have equal digests again and again")
    bitmap.unpersist()
    groups = classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    together = join_splittable(classes, groups, ["h"]).select("h", "c", "n", "place", "window", "kinds")
    small = together.where(F.col("kinds") <= group_limit).drop("kinds").repartition("h").sortWithinPartitions("h", "c")
    verdicts = small.mapInArrow(tidy(lambda x: _kernel(x, gram)), "h long, c long, bits binary")
    large = together.where(F.col("kinds") > group_limit).drop("kinds")
    if not large.isEmpty():
        verdicts = verdicts.unionByName(_counted(large, gram))
    spans = found.join(verdicts, ["h", "c"], "left").groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "bits")).alias("found"))
    path = write_stored(spans, "spans")
    drop_all_but(spark, before, {path})
    return spark.read.schema(spans.schema).parquet(path)


def _removed(docs: DataFrame, carried: Column, gram: int, k: int, group_limit: int, as_text: bool, digest_bits: int = 64, at_once: bool = False) -> DataFrame:
    """A row for each row of docs: n_bytes, spans, kept and carried, as remove_repeats() has them. at_once: shuffle files go with their execution."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = _packed(docs, carried)
    with shuffles_removed(spark) if at_once else nullcontext():
        spans = _spans(docs, packed, gram, k, group_limit, digest_bits)
    joined = join_splittable(packed, spans, ["k1", "k2"], "left").select("packed", "found", "carried")
    schema = StructType([StructField("n_bytes", LongType()), StructField("spans", ArrayType(ArrayType(LongType()))), StructField("kept", StringType() if as_text else BinaryType()), joined.schema["carried"]])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            sizes, gone, kept = [], [], []
            for text, records in zip(map(unpack, b.column(0).to_pylist()), b.column(1).to_pylist()):
                runs = _runs(len(text), records or [], gram)
                parts, at = [], 0
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                sizes.append(len(text))
                gone.append(runs)
                kept.append(b"".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64()))), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), b.column(2)], schema.names)

    return joined.mapInArrow(tidy(remove), schema)


def remove_repeats(docs: DataFrame, gram: int = GRAM, k: int = K, group_limit: int = GROUP_LIMIT, carry: list[str] | None = None, as_text: bool = False, digest_bits: int = 64) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, spans (array of [from, to) byte offsets that go), kept (the rest, binary),
    and carried, a struct of the columns in carry. as_text: kept is a string, without the bytes of characters that were cut.

    A row for each row of docs. A null text is empty; texts shorter than gram keep all; a text that stands in two rows (of
    one doc_id or of two) goes, if it is long enough, from both. Matches never cross documents. An empty table gives none.
    """
    carried = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(quoted(c).alias(c) for c in carry or ["doc_id"])).alias("rest"))
    out = _removed(docs, carried, gram, k, group_limit, as_text, digest_bits, at_once=True)
    return out.select(F.col("carried.doc_id").alias("doc_id"), "n_bytes", "spans", "kept", F.col("carried.rest").alias("carried"))


def _runs(n: int, records: list[dict], gram: int) -> list[list[int]]:
    """Maximal runs of bytes covered by repeated strings."""
    if not records:
        return []
    place = np.array([r["place"] for r in records], np.int64)
    first, count = place >> 20, place & 1023
    edge = np.zeros(n + 1, np.int32)
    for r, f, m in zip(records, first.tolist(), count.tolist()):
        if r["bits"] is None:
            edge[f] += 1
            edge[f + m + gram - 1] -= 1
        else:
            s = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=m)) + f
            np.add.at(edge, s, 1)
            np.add.at(edge, s + gram, -1)
    inside = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
    step = np.diff(inside)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).tolist()


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what repeats taken out of the texts; the bytes of a character that was cut go too. n_chars follows, if there is one.

    Texts that lose nothing stay as they are (null ones too); every row keeps its other columns, whatever they are called.
    """
    carried = F.struct(all_of(docs, ("text",)).alias("rest"), F.col("text").isNull().alias("none"))
    out = _removed(docs, carried, GRAM, K, GROUP_LIMIT, True).select("kept", "spans", F.col("carried.rest").alias("rest"), F.col("carried.none").alias("none"))
    text, changed = F.when(~F.col("none"), F.col("kept")), F.size("spans") > 0
    chars = lambda c: F.when(changed, F.length("kept").cast(docs.schema[c].dataType)).otherwise(field("rest", c))
    return out.select(*((text if c == "text" else chars(c) if c == "n_chars" else field("rest", c)).alias(c) for c in docs.columns))
