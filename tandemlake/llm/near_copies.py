"""Near copies by SimHash, made complete: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The deletion-variant signatures of the SimHash operator propose pairs first: equal fingerprints, and those that differ in at
most three bits. They can't propose all: at a similarity of 0.8 two fingerprints differ in about 15 % of their bits, however
long they are, and segments short enough for that to leave one bit to each would be some six bits long, which tells no two
texts apart. So the pairs that fingerprints leave open are proposed by MinHash bands; one at 0.8 agrees in none of the BANDS
bands of ROWS minima with a probability of (1 - 0.8**10)**100 = 1.2e-5, one above it more rarely, and one at a half meets in a tenth
of the cases, so that texts which are merely alike are seldom tried. Whole sets of shingles decide in either case. All of it works on distinct sets, so copies cost nothing. In a bucket some members are held against all
others first. What these rounds did not bring together is tried in pairs in buckets of up to SMALL members only. Larger ones,
which many texts share that are alike but no copies, are merged into groups of buckets with members in common, and the
members of a group are told apart by where they differ from its core, the shingles that over half of them have: two sets are as
far apart as their differences from the core are. Two differences that are small enough are a link by their sizes alone, and all
such links meet in the member that is nearest to the core. Any other link shares an element of the two differences, and in an
order by rarity the first shared one is among the first few of each (prefix filter, with positions). Both are exact, and
members that differ from the core each in its own way never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_all_but, join_splittable, mix, runs_by_size, small_batches, stored, tidy, write_stored, written
from .components import connected_components
from .simhash import digest, fingerprint_of, hashes_of, near_links, one_of_each

SHINGLE = 5
BANDS, ROWS = 100, 10
#: Rounds in which one member of each bucket is held against the others, before all pairs that are left.
STARS = 2
#: Members of a bucket that are tried in pairs.
SMALL = 8
PIECE = 256
#: Hashes that are counted at a time.
HASHES = 500_000
_RNG = np.random.default_rng(42)
FLIPS = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The XXH64 (seed 42) of the five-word shingles, each once, sorted; of fewer words, of all of them. No words, none."""
    return _once(list(hashes_of(text, SHINGLE)))


def _once(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band, by its number and its minima; an empty set has none."""
    if not len(s):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(s), PIECE):
        np.minimum(low, ((s[None, a : a + PIECE] ^ FLIPS) * FACTORS).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix((key ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, digest, node (names the set of shingles), n (its size), fp (SimHash), keys (of its bands)."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for t in b.column(2):
                hashes = list(hashes_of(t.as_py(), SHINGLE))
                s = _once(hashes)
                fps.append(fingerprint_of(hashes))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                keys.append(band_keys(s))
            arrays = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["doc_id", "digest", "node", "n", "fp", "keys"])

    rows = docs.select("doc_id", digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, digest binary, node long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted (node, digest): node and the hashes of its shingles, from a text with that digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    texts = docs.select(digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    return texts.join(wanted, "digest").dropDuplicates(["node"]).select("node", "text").mapInArrow(tidy(work), "node long, hashes array<long>")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the SimHash signatures propose: one node of each fingerprint with the others of it, and with those of linked fingerprints."""
    one = nodes.groupBy("fp").agg(F.min("node").alias("one"))
    links = near_links(one.select("fp"))
    far = links.join(one.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b").select("x", "y")
    own = join_splittable(nodes.select("fp", "node"), one, ["fp"]).select(F.col("one").alias("x"), F.col("node").alias("y")).where("x <> y")
    return far.unionByName(own).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    return members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _in_order(pairs: DataFrame) -> DataFrame:
    """Pairs of node and x.node in different components and of not too different sizes, each once, as (a, b)."""
    p = pairs.where("root <> x.root and 5 * least(n, x.n) >= 4 * greatest(n, x.n)")
    return p.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()


def _stars(members: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a, b) of one member of each bucket, another in each turn, and the others."""
    m = _rooted(members, roots)
    own, one = F.struct("node", "n", "root"), F.struct(F.xxhash64("node", F.lit(turn)), "node")
    other = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(own, one).alias("x")).where("lo < hi").select("key", "x")
    return _in_order(join_splittable(m, other, ["key"]))


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members of buckets that still hold different components, with the number of members and the least of them."""
    m = _rooted(members, roots)
    keys = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.min("node").alias("least")).where("lo < hi")
    return join_splittable(m, keys.select("key", "size", "least"), ["key"])


def _within(small: DataFrame) -> DataFrame:
    """All pairs (a, b) of small buckets."""
    other = small.select("key", F.struct("node", "n", "root").alias("x"))
    return _in_order(small.select("key", "node", "n", "root").join(other, "key").where("node < x.node"))


# ------------------------------------------------------------------ large buckets


def _shared_hashes(held: DataFrame) -> DataFrame:
    """held (g, hashes) -> (g, h, c): the hashes that more than one member of a group has, and how many have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, lists = b.column(0).to_numpy(), b.column(1)
            for x, y in runs_by_size(lists.value_lengths().to_pylist(), HASHES):
                part = lists.slice(x, y - x)
                h, of = part.flatten().to_numpy(), np.repeat(g[x:y], part.value_lengths().to_numpy())
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(h) != 0) | (np.diff(of) != 0)]))
                c = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array(h[first]), pa.array(c)], ["g", "h", "c"])

    return held.select("g", "hashes").mapInArrow(tidy(work), "g long, h long, c long").groupBy("g", "h").agg(F.sum("c").alias("c")).where("c > 1")


def _differences(held: DataFrame, counts: DataFrame) -> DataFrame:
    """held (node, n, g, hashes) -> node, n, g, far (how many elements a member and its group's core differ in), has (those that
    the core lacks) and lacks (c, h: those that only the core has, c the number of members that lack them)."""
    sizes = held.groupBy("g").agg(F.count("*").alias("members"))
    core = counts.join(sizes, "g").where("2 * c > members").groupBy("g").agg(F.collect_list("h").alias("core"), F.collect_list(F.expr("members - c")).alias("rest"))
    rows = join_splittable(held.select("node", "n", "g", "hashes"), core, ["g"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far, has, lacks = [], [], []
            for own, core, rest in zip(b.column(3), b.column(4), b.column(5)):
                own = own.values.to_numpy()
                core, rest = (core.values.to_numpy(), rest.values.to_numpy()) if core.is_valid else (own[:0], own[:0])
                more, less = np.setdiff1d(own, core), ~np.isin(core, own)
                far.append(len(more) + int(less.sum()))
                has.append(more)
                lacks.append([{"c": c, "h": h} for c, h in zip(rest[less].tolist(), core[less].tolist())])
            arrays = [pa.array(far, pa.int64()), pa.array(has, pa.list_(pa.int64())), pa.array(lacks, pa.list_(pa.struct([("c", pa.int64()), ("h", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *arrays], ["node", "n", "g", "far", "has", "lacks"])

    return rows.select("node", "n", "g", "hashes", "core", "rest").mapInArrow(tidy(work), "node long, n long, g long, far long, has array<long>, lacks array<struct<c:long,h:long>>")


def _centres(apart: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of a group's member that is nearest to the core, for its size, and those that are linked with it by their sizes alone."""
    m = _rooted(apart.select("node", "n", "g", F.expr("n - 9 * far").alias("slack")), roots)
    centre = m.groupBy("g").agg(F.max_by(F.struct("node", "n", "root", "slack"), F.struct("slack", "node")).alias("x"))
    return _in_order(join_splittable(m, centre, ["g"]).where("slack + x.slack >= 0"))


def _prefixes(apart: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, n, g, far, h, at): the first elements of each difference that others may share, the rarest of the group first, and
    their places. A set at 0.8 or more is at most n / 4 elements away, so at most that many stand before the first shared one."""
    more = apart.select("node", "g", F.explode("has").alias("h")).join(counts, ["g", "h"]).groupBy("node").agg(F.collect_list(F.struct("c", "h")).alias("has"))
    rows = apart.drop("has").join(more, "node", "left")
    listed = F.array_sort(F.concat(F.coalesce("has", F.expr("cast(array() as array<struct<c:long,h:long>>)")), F.expr("filter(lacks, x -> x.c > 1)")))
    rows = rows.select("node", "n", "g", "far", listed.alias("listed")).withColumn("alone", F.expr("cast(far - size(listed) as int)"))
    first = F.expr("slice(listed, 1, greatest(0, cast(n div 4 as int) + 1 - alone))")
    return rows.select("node", "n", "g", "far", "alone", F.posexplode(first).alias("at", "e")).select("node", "n", "g", "far", F.col("e.h").alias("h"), (F.col("at") + F.col("alone")).cast("long").alias("at"))


def _by_difference(prefixes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that share an element of their prefixes and may be near enough by its places. Of the members of a group's
    most common component none is tried with another one of it."""
    m = _rooted(prefixes, roots)
    main = m.groupBy("g", "root").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    rare = join_splittable(m, main, ["g"]).where("root <> main").select("g", "h", F.struct("node", "n", "root", "far", "at").alias("x"))
    most = "9 * (2 * greatest(at, x.at + far - x.far) - (far - x.far)) <= n + x.n"
    return _in_order(m.join(rare, ["g", "h"]).where(most))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least 0.8, in whole numbers."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("two")), "b")
    return both.where("9 * size(array_intersect(one, two)) >= 4 * (size(one) + size(two))").select("a", "b")


def members(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, digest, root: rows with one root are linked by pairs at 0.8 or more. Texts without words are alike."""
    before = written()
    own_path = write_stored(sketches(docs), "near-sketches")
    own = docs.sparkSession.read.parquet(own_path)
    nodes = own.groupBy("node").agg(F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.min("digest").alias("digest"))
    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stored(join_splittable(each, each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), ["key"]), "near-bands")
    pairs = stored(_by_fingerprint(nodes.select("fp", "node")), "near-pairs")
    asked = shared.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = asked.join(own.groupBy("node").agg(F.min("digest").alias("digest")), "node")
    sets, links, tried, roots = stored(_sets(docs, wanted), "near-sets"), None, None, None

    def settle(proposed: DataFrame) -> None:
        nonlocal links, tried, roots
        pairs = proposed if tried is None else stored(proposed.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        found = stored(_alike(pairs, sets), "near-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            roots = connected_components(links).select("node", "root")

    settle(pairs)
    for turn in range(STARS):
        settle(_stars(shared, roots, turn))
    left = stored(_open(shared, roots), "near-open")
    close, large = _within(left.where(F.col("size") <= SMALL)), left.where(F.col("size") > SMALL)
    if large.isEmpty():
        settle(close)
    else:
        groups = connected_components(large.select(F.col("node").alias("a"), F.col("least").alias("b"))).select("node", F.col("root").alias("g"))
        groups = groups.unionByName(groups.select(F.col("g").alias("node"), "g")).distinct()
        held = stored(sets.join(groups, "node").select("node", F.size("hashes").cast("long").alias("n"), "g", "hashes"), "near-held")
        counts = stored(_shared_hashes(held), "near-counts")
        apart = stored(_differences(held, counts), "near-differences")
        settle(close.unionByName(_centres(apart, roots)).distinct())
        settle(_by_difference(stored(_prefixes(apart, counts), "near-prefixes"), roots))
    if roots is None:
        drop_all_but(docs.sparkSession, before, {own_path})
        return own.select("doc_id", "digest", F.col("node").alias("root"))
    out = write_stored(join_splittable(own.select("doc_id", "digest", "node"), roots, ["node"], "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root")), "near-members")
    drop_all_but(docs.sparkSession, before, {out})
    return docs.sparkSession.read.parquet(out)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group of near copies: the least doc_id stays."""
    return one_of_each(docs, members(docs))
