"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of hashed character 3-, 4- and 5-grams of the lower-cased text; the log-count ratio of each feature between toxic
and other texts; logistic regression on the scaled features that tell most. The fit reads a bounded sample of labelled
rows (SAMPLE, SAMPLE_CHARS) in one task; the model, a table of at most FEATURES weights, is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import all_of, field, mix, runs_by_size, small_batches, tidy

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 20_000
#: Features whose evidence (a log-likelihood ratio statistic) is less are not used.
LEAST_EVIDENCE = 6.0
SAMPLE = 8_000
SAMPLE_CHARS = 25_000_000
CHUNK = 500_000
THRESHOLD = 0.7
SCHEMA = "feature array<int>, weight array<float>, bias double"


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that are never learnt from: the CRC-32 of the doc_id as text leaves 1 on division by 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def _features(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram from each character on."""
    c = codes.astype(np.uint64) + np.uint64(1)
    for n in ORDERS:
        m = len(c) - n + 1
        if m > 0:
            h = c[:m].copy()
            for k in range(1, n):
                h = h * np.uint64(0x100000001B3) + c[k : k + m]
            yield (mix(h * np.uint64(2 * n + 1)) >> np.uint64(44)).astype(np.int32)


def present(text: str) -> np.ndarray:
    """The features of a text, each once; a long text is taken piece by piece, the pieces overlapping."""
    found = np.zeros(BUCKETS, bool) if len(text) > 4 * CHUNK else None
    parts = []
    for a in range(0, max(1, len(text)), CHUNK):
        for f in _features(_codes(f" {text[a : a + CHUNK + max(ORDERS) - 1]} ")):
            if found is None:
                parts.append(f)
            else:
                found[f] = True
    if found is not None:
        return np.flatnonzero(found).astype(np.int32)
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


@dataclass
class Model:
    weight: np.ndarray  # by bucket; most are zero
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for whole texts, any number of them at a time."""
        out = np.full(len(texts), self.bias)
        used = self.weight != 0
        for a, b in runs_by_size([len(t or "") for t in texts], CHUNK):
            if b - a == 1 and len(texts[a] or "") > CHUNK:
                out[a] += self.weight[present(texts[a])].sum(dtype=np.float64)
                continue
            codes = [_codes(f" {t or ''} ") for t in texts[a:b]]
            begins = np.cumsum([0, *map(len, codes)])
            pairs = []
            for n, f in zip(ORDERS, _features(np.concatenate(codes))):
                at = np.flatnonzero(used[f])
                text = np.searchsorted(begins, at, side="right") - 1
                ok = at + n <= begins[text + 1]
                pairs.append(text[ok].astype(np.int64) << 32 | f[at[ok]])
            both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            np.add.at(out, a + (both >> 32), self.weight[both & 0xFFFFFFFF].astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _evidence(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-likelihood ratio statistic of each feature's table of presence against label."""
    n, seen = n_toxic + n_other, toxic + other
    out = np.zeros(len(seen))
    for got, size in ((toxic, n_toxic), (other, n_other)):
        for part, whole in ((got, seen), (size - got, n - seen)):
            some = part > 0
            out[some] += 2 * part[some] * np.log(part[some] * n / (whole[some] * size))
    return out


def _weights(rows: list[np.ndarray], y: np.ndarray, features: int, l2: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket, weight, bias): log-count ratios, the features that tell most, logistic regression on them with both classes alike."""
    n, pos = len(rows), int(y.sum())
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for f, label in zip(rows, y):
        counts[int(label)][f] += 1
    ratio = np.log((counts[1] + 1) / (pos + 2) / ((counts[0] + 1) / (n - pos + 2)))
    tells = _evidence(counts[1], counts[0], pos, n - pos)
    tells[(tells < LEAST_EVIDENCE) | (counts[0] + counts[1] < 3)] = 0
    keep = np.sort(np.argsort(-tells, kind="stable")[: min(features, int((tells > 0).sum()))])
    place = np.full(BUCKETS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    mine = [place[f][place[f] >= 0] for f in rows]
    row = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in mine])
    col = np.concatenate(mine)
    r = ratio[keep] / np.sqrt(np.mean([max(1, len(f)) for f in mine]))
    scale = r.astype(np.float32)[col]
    share = np.where(y == 1, 0.5 / pos, 0.5 / (n - pos))
    w, b, gw, gb, mw, mb = np.zeros(len(keep)), 0.0, np.zeros(len(keep)), 0.0, np.zeros(len(keep)), 0.0
    for t in range(1, rounds + 1):  # gradient steps with moments
        z = np.bincount(row, scale * w[col], minlength=n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g, h = np.bincount(col, scale * d[row], minlength=len(keep)) + l2 * w, d.sum()
        mw, mb = 0.9 * mw + 0.1 * g, 0.9 * mb + 0.1 * h
        gw, gb = 0.99 * gw + 0.01 * g * g, 0.99 * gb + 0.01 * h * h
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.05 * (mw / c1) / (np.sqrt(gw / c2) + 1e-9)
        b -= 0.05 * (mb / c1) / (np.sqrt(gb / c2) + 1e-9)
    return keep, w * r, float(b)


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of the label on scores of texts that were not learnt from (Newton steps)."""
    x, target = np.column_stack([z, np.ones(len(z))]), np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit_rows(texts: list[str], labels: np.ndarray, features: int = FEATURES, l2: float = 1e-3, rounds: int = 100, folds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket, weight, bias), calibrated on folds that were held out. One class only: no features, and a bias towards it."""
    n, pos = len(texts), int(labels.sum())
    if not n or pos in (0, n):
        return np.empty(0, np.int32), np.empty(0, np.float32), -3.0 if not pos else 3.0
    rows, y = [present(t) for t in texts], labels.astype(np.float64)
    slope, shift = 1.0, 0.0
    part = np.empty(n, np.int64)  # every fold has its share of both classes
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        part[own] = np.arange(len(own)) % folds
    if min(pos, n - pos) >= 2 * folds:
        z = np.empty(n)
        for k in range(folds):
            learn, held = np.flatnonzero(part != k), np.flatnonzero(part == k)
            keep, w, b = _weights([rows[i] for i in learn], y[learn], features, l2, rounds)
            table = np.zeros(BUCKETS)
            table[keep] = w
            z[held] = [table[rows[i]].sum() + b for i in held]
        slope, shift = _calibration(z, y)
    keep, w, b = _weights(rows, y, features, l2, rounds)
    return keep.astype(np.int32), (slope * w).astype(np.float32), slope * b + shift


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most sample labelled documents that aren't held out, those with the least hash of doc_id; of these, in
    that order, as many as have sample_chars characters together. Rows without a label, a doc_id or a text are not learnt from."""
    ids = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # what is broadcast: sample rows of 12 bytes at most
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").select("doc_id", "text", "toxic")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, total = [], [], 0
        for b in batches:
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if total + len(t) <= sample_chars or not texts:
                    texts.append(t[:sample_chars])
                    marks.append(y)
                    total += len(t)
        bucket, weight, bias = fit_rows(texts, np.array(marks, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([bucket.tolist()], pa.list_(pa.int32())), pa.array([weight.tolist()], pa.list_(pa.float32())), pa.array([bias])], ["feature", "weight", "bias"])

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(tidy(work), SCHEMA).collect()
    weight = np.zeros(BUCKETS, np.float32)
    if not got:
        return Model(weight, -3.0)
    weight[np.array(got[0]["feature"], np.int64)] = np.array(got[0]["weight"], np.float32)
    return Model(weight, got[0]["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus toxicity_score (double, 0 to 1; one of that name is replaced), for every row and its whole text; a null text scores as an empty one."""
    out = _scored(docs.drop("toxicity_score"), model)
    return out.select(*(field("carried", c) for c in docs.columns if c != "toxicity_score"), "toxicity_score")


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """carried (the columns of docs) and toxicity_score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("text"), all_of(docs, ("text",)).alias("carried"))
    schema = StructType([*rows.schema.fields, StructField("toxicity_score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column(0).to_pylist()))], names=schema.names)

    out = rows.mapInArrow(tidy(work), schema)
    others = [field("carried", c) if c != "text" else F.col("text") for c in docs.columns]
    return out.select(F.struct(*others).alias("carried"), "toxicity_score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted (1 from THRESHOLD on), a row for each row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score THRESHOLD or more; columns are as they were, whatever they are called."""
    return _scored(docs, fit(docs, labels)).where(F.col("toxicity_score") < THRESHOLD).select(*(field("carried", c) for c in docs.columns))
