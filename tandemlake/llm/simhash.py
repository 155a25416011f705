"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. It is cut into two halves, so that of two fingerprints that differ in at most three bits
one half differs in at most one. Each half is indexed 32 times, each time with one bit as a wildcard; the variants are
joined by equality and the candidates verified. All of it works on distinct fingerprints, so copies cost nothing, and
inside a bucket a spanning forest of the verified links is emitted, never all pairs. A bucket beyond BUCKET_LIMIT is cut
again: its members agree in 31 bits, and the other 33 are cut and indexed in the same way, which leaves at most 2**18
distinct members in a bucket, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, field, join_splittable, small_batches, stored, tidy
from .components import connected_components

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
PIECE = 1 << 16
BUCKET_LIMIT = 4096
DISTANCE = 3


def hashes_of(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text, repeats included, some at a time; of fewer words, of all of them."""
    words = (text or b"").lower().split()  # ASCII letters and ASCII white space only, as bytes
    joined, digest = b" ".join([b"%b"] * shingle), xxhash.xxh64_intdigest
    if 0 < len(words) < shingle:
        yield np.array([digest(b" ".join(words), 42)], dtype="<u8")
    for a in range(0, len(words) - shingle + 1, PIECE):
        part = words[a : a + PIECE + shingle - 1]
        yield np.array([digest(joined % x, 42) for x in zip(*(part[k:] for k in range(shingle)))], dtype="<u8")


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """A bit is set where over half of the hashes have it; none give zero."""
    total, counts = 0, np.zeros((8, 256), np.int64)
    for h in hashes:
        total += len(h)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = counts @ BITS  # by byte and bit
    return int(np.packbits((2 * ones > total).astype(np.uint8).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    return fingerprint_of(hashes_of(text, shingle))


def digest() -> Column:
    """SHA-256 of the column text, as bytes. A null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def fingerprints(docs: DataFrame, shingle: int = 3, digests: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp: the 64 bits as a signed long), with digests the text's digest as well. A null text counts as empty."""
    small_batches(docs.sparkSession)
    more = ["digest"] if digests else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *more])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *(digest().alias(c) for c in more))
    return rows.mapInArrow(tidy(work), "doc_id long, fp long" + ", digest binary" * len(more))


# ------------------------------------------------------------------ links within buckets


def _near(x: np.uint64, others: np.ndarray, variant: int) -> np.ndarray:
    """Which of others are within DISTANCE of x and have this variant as the first in which the two meet."""
    d = others ^ x
    high, low = d >> np.uint64(32), d & np.uint64(0xFFFFFFFF)
    own = high if variant < 32 else low
    bit = np.uint64(1 << (variant % 32))
    first = (own == bit) | ((own == 0) & (variant % 32 == 0))
    if variant >= 32:
        first &= np.bitwise_count(high) > 1
    return first & (np.bitwise_count(d) <= DISTANCE)


def _forest(fps: np.ndarray, variant: int) -> list[tuple[np.uint64, np.uint64]]:
    """A spanning forest of the links in a bucket: each member is expanded once against those not yet reached."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(x, left, variant)
            if hit.any():
                found = left[hit]
                out += [(x, y) for y in found]
                queue += list(found)
                left = left[~hit]
    return out


def _forest_by_flips(fps: np.ndarray, variant: int) -> list[tuple[np.uint64, np.uint64]]:
    """The same for a bucket whose members differ in few bit positions: neighbours are looked up by flipping bits."""
    free = [i for i in range(64) if np.bitwise_or.reduce(fps ^ fps[0]) >> np.uint64(i) & np.uint64(1)]
    masks = [1 << a for a in free] + [1 << a | 1 << b for i, a in enumerate(free) for b in free[:i]]
    masks += [m | 1 << c for m in masks[len(free) :] for c in free if 1 << c < (m & -m)]
    fps = np.sort(fps)
    reached, out = np.zeros(len(fps), bool), []
    for seed in range(len(fps)):
        if reached[seed]:
            continue
        reached[seed], front = True, np.array([seed])
        while len(front):
            fresh = []
            for m in masks:
                want = fps[front] ^ np.uint64(m)
                at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
                ok = np.flatnonzero((fps[at] == want) & ~reached[at])
                if len(ok):
                    reached[at[ok]] = True
                    fresh.append(at[ok])
                    out += list(zip(fps[front[ok]], fps[at[ok]]))
            front = np.concatenate(fresh) if fresh else front[:0]
    return out


def _links(batches: Iterator[pa.RecordBatch], shift: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted by key, to (kind, a, b): links (kind 0) and the rows of keys beyond limit (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def groups(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        sizes = ends - starts
        two = starts[sizes == 2]
        if len(two):
            variants = keys[two] >> shift
            ok = np.zeros(len(two), bool)
            for v in np.unique(variants):
                m = variants == v
                ok[m] = _near(fps[two[m]], fps[two[m] + 1], int(v))
            if ok.any():
                yield batch(0, fps[two[ok]], fps[two[ok] + 1])
        links = []
        for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
            links += (_forest if e - s <= BUCKET_LIMIT else _forest_by_flips)(fps[s:e], int(keys[s] >> shift))
        if links:
            yield batch(0, *np.array(links, dtype=np.uint64).T.copy())

    keys, fps, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for b in batches:
        k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        if not len(keys):
            continue
        last = np.searchsorted(keys, keys[-1])
        if limit:
            n_last = len(keys) - last
            where, counts = np.unique(keys, return_counts=True)
            over = np.isin(keys, where[(counts > limit) | (where == hot if hot is not None else False)])
            if over.any():
                yield batch(1, keys[over], fps[over])
            hot = keys[-1] if n_last > limit or keys[-1] == hot else None
            if hot is not None:
                last = len(keys)
            done = ~over
            done[last:] = False
            if done.any():
                yield from groups(keys[done], fps[done])
        elif last:
            yield from groups(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield from groups(keys, fps)


def _variants(fps: DataFrame) -> DataFrame:
    """64 one-wildcard variants of the halves of each fingerprint, as (key, fp); a key holds the variant's number."""
    half = F.expr("IF(v < 32, shiftrightunsigned(fp, 32), fp & 4294967295L)")
    rest = F.expr("half & ~shiftleft(1L, v % 32)")
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).withColumn("half", half).select((F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(rest)).alias("key"), "fp")


def _second_variants(hot: DataFrame) -> DataFrame:
    """For (key, fp) of a large bucket: the 33 bits that its members may differ in, cut into 17 and 16, one bit a wildcard."""
    other = F.expr("IF(shiftright(key, 32) < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))")
    wild = F.expr("shiftrightunsigned(fp, cast(IF(shiftright(key, 32) < 32, 32, 0) + shiftright(key, 32) % 32 as int)) & 1L")
    df = hot.withColumn("free", F.shiftleft(other, 1).bitwiseOR(wild)).select("key", "fp", "free", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("w"))
    rest = F.expr("IF(w < 17, shiftrightunsigned(free, 16) & ~shiftleft(1L, w), (free & 65535L) & ~shiftleft(1L, w - 17))")
    return df.select(F.col("key"), F.shiftleft(F.col("w").cast("long"), 17).bitwiseOR(rest).alias("sub"), "fp")


def near_links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b): enough of the pairs within DISTANCE bits to connect all that are linked."""
    first = _variants(fps)
    first = first.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(lambda x: _links(x, 32, bucket_limit)), "kind int, a long, b long")
    first = stored(first, "simhash-links")
    links, hot = first.where("kind = 0").select("a", "b"), first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return links

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, sub, fp), sorted: the pairs of key and sub are numbered, so that one column tells the buckets apart."""

        def renamed() -> Iterator[pa.RecordBatch]:
            before, number = None, 0
            for b in batches:
                pairs = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], axis=1)
                if not len(pairs):
                    continue
                step = np.concatenate([[before is not None and bool((pairs[0] != before).any())], (pairs[1:] != pairs[:-1]).any(axis=1)])
                numbers = number + np.cumsum(step)
                before, number = pairs[-1], int(numbers[-1])
                keys = ((pairs[:, 0] >> 32) << 40) | numbers
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(2)], ["key", "fp"])

        yield from _links(renamed(), 40, None)

    more = _second_variants(hot).repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(tidy(second), "kind int, a long, b long")
    return links.unionByName(more.select("a", "b"))


def _rooted(own: DataFrame) -> DataFrame:
    """Rows (doc_id, fp, ...) -> each fp once: fp, the least doc_id that has it, and the root of its component."""
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(distinct.select("fp")))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp, component_id), a row for each row of docs.

    component_id is the least doc_id that is reachable by links of at most 3 differing bits, the document's own included.
    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Rows that repeat
    a doc_id keep a row each. A null doc_id is carried; it never is a component's id unless all its members have none.
    """
    own = stored(fingerprints(docs, shingle), "simhash-fps")
    named = _rooted(own)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = join_splittable(named.select("fp", "root"), ids, ["root"]).select("fp", "component_id")
    return join_splittable(own, of_fp, ["fp"]).select("doc_id", "fp", "component_id")


def row_keys() -> list[Column]:
    """A 128-bit hash of doc_id (null or not) and digest: k1, k2."""
    return [F.xxhash64("doc_id", "digest").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "digest").alias("k2")]


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """docs, and for each of its rows a member (doc_id, digest, root) -> one row of each root: the least doc_id, then the least digest.

    Rows that agree in doc_id and text have one root. A null doc_id comes last; rows with null or repeated ids are told apart by
    their texts. The columns of docs may have any names.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    kept = members.groupBy("root").agg(first).select("first.doc_id", "first.digest").select(*row_keys())
    rows = docs.select(all_of(docs).alias("carried"), F.col("doc_id"), digest().alias("digest")).select("carried", *row_keys())
    # repeated rows go first, within the tasks already, so that rows without an id and of one text don't meet in one task
    rows = rows.dropDuplicates(["k1", "k2"]).join(kept, ["k1", "k2"], "left_semi")
    return rows.select(*(field("carried", c) for c in docs.columns))


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without all but one document of each group of linked fingerprints: the one with the component's id stays (of repeated rows, one)."""
    own = stored(fingerprints(docs, shingle, digests=True), "simhash-fps")
    return one_of_each(docs, join_splittable(own, _rooted(own).select("fp", "root"), ["fp"]))
