"""Language identification of pages by Bayesian evidence fusion.

Three kinds of evidence are combined as log-probabilities: the likelihood of the visible text under character n-gram models,
the language that the markup declares, and the address: the suffix and the host have priors that are counted over all pages
by grouped aggregation and smoothed along host -> site -> suffix -> all. How far declarations can be trusted is itself
counted: the table of declared against textual language. A page's own count is taken out of every prior that it meets.
A page is read in one forward scan; counts are summed within tasks first, and joined such that a common host can be split.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_splittable, mix, small_batches, stored, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: The text model is fitted on so many documents at most, as many of each language as of another where there are enough (those with
#: the least hash of doc_id), and on so many characters of each.
SAMPLE = 4000
DOC_CHARS = 3000
SPREAD = 64
SMOOTH = 0.5
STRENGTH = 10.0
#: Characters of a page are far from independent: their evidence counts like that of this many n-grams at most.
EVIDENCE = 60.0

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)|[!?/]")
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style")}
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def scan(page: str | None) -> tuple[str, str]:
    """The visible text of a page and the language that its html tag declares ('' if none): one forward scan.

    Tags, comments, scripts and styles are blanks; what of these has no end takes the rest of the page. A < that begins no tag is text.
    """
    page, parts, said, at = page or "", [], "", 0
    while (i := page.find("<", at)) >= 0:
        parts.append(page[at:i])
        m = _NAME.match(page, i) or _NAME.match(page, i + 1, i + 2)
        if not m:
            parts.append("<")
            at = i + 1
            continue
        parts.append(" ")
        comment = page.startswith("<!--", i)
        end = page.find("-->", i + 4) if comment else page.find(">", m.end())
        if end < 0:
            at = len(page)
            break
        at = end + (3 if comment else 1)
        name = (m[1] or "").lower()
        if name == "html" and not said and page[i + 1] != "/" and (found := _LANG.search(page, m.end(), end)):
            said = found[1].lower()
        if name in _ENDS and page[i + 1] != "/":
            close = _ENDS[name].search(page, at)
            at = close.end() if close else len(page)
    parts.append(page[at:])
    return " ".join(html.unescape("".join(parts)).split()), said


def grams(text: str) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams of the letters; none if there are no letters."""
    kept = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not kept:
        return np.zeros(BUCKETS, np.int64)
    c = np.frombuffer(f" {kept} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    out = np.zeros(BUCKETS, np.int64)
    for n in ORDERS:
        m = len(c) - n + 1
        h = np.full(max(m, 0), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : k + m]
        out += np.bincount((mix(h) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, doc_chars: int = DOC_CHARS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities by language and bucket, from documents (doc_id, text, lang) with a lang and a text."""
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))  # a common language is dealt to many tasks; ranks are limited before that
    first = Window.partitionBy("lang", part).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample // SPREAD + 1)
    # about sample rows of a language are left, which are ranked once more
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    ids = ids.orderBy("rank", F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).select("doc_id", "lang").distinct()
    # what is broadcast: sample rows of a number and a language
    rows = known.select("doc_id", "lang", F.substring("text", 1, doc_chars).alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts[lang] = counts.get(lang, 0) + grams(text)
        names = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[x].tolist() for x in names], pa.list_(pa.int64()))], ["lang", "counts"])

    # rows that repeat a doc_id don't make it more
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(sample).repartition(1).mapInArrow(tidy(work), "lang string, counts array<long>").collect()
    table = np.array([r["counts"] for r in got], np.float64).reshape(-1, BUCKETS) + SMOOTH
    return [r["lang"] for r in got], np.log(table / table.sum(axis=1, keepdims=True))


def evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """pages (page_id, url, html) -> page_id, declared, text_scores (log-likelihood by language), text_lang (null if there is no text)."""
    small_batches(pages.sparkSession, 1000)
    shared = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, scores, best = [], [], []
            for page in b.column(2).to_pylist():
                text, lang = scan(page)
                count = grams(text)
                used = np.flatnonzero(count)
                n = count.sum()
                s = shared.value[:, used].astype(np.float64) @ count[used] * min(1.0, EVIDENCE / max(n, 1))
                said.append(lang)
                scores.append((s - s.max()).tolist())
                best.append(languages[int(s.argmax())] if n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said), pa.array(scores, pa.list_(pa.float64())), pa.array(best, pa.string())], ["page_id", "url", "declared", "text_scores", "text_lang"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(work), "page_id long, url string, declared string, text_scores array<double>, text_lang string")


def address() -> tuple[Column, Column, Column]:
    """Host, site (its last two names) and suffix (the last one) of url."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    names = F.split(host, r"\.")
    return host, F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), "."), F.element_at(names, -1)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """pages (page_id, url, html), docs (doc_id, text, lang) -> page_id, lang, probability, text_lang, declared; a row for each row of pages.

    A null url has an empty host, a null html or one without letters no text: the priors decide. Without any labelled
    document there are no languages: lang and probability are null. Ties go to the first language by name.
    """
    languages, table = fit(docs)
    if not languages:
        return pages.select("page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"))))
    host, site, suffix = address()
    seen = stored(evidence(pages, languages, table).select("page_id", "declared", "text_scores", "text_lang", host.alias("host"), site.alias("site"), suffix.alias("suffix")), "language-evidence")

    def counts(key: str, name: str) -> DataFrame:
        """By key an array of counts by language; partial aggregates, one row for each key."""
        each = [F.count_if(F.col("text_lang") == x) for x in languages]
        return seen.groupBy(key).agg(F.array(*each).alias(name))

    k = len(languages)
    own = F.array(*(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0) for x in languages))
    everything = seen.agg(F.array(*(F.count_if(F.col("text_lang") == x) for x in languages))).first()[0]
    df = seen.withColumn("own", own).withColumn("prior", F.array(*(F.lit((c + 1.0) / (sum(everything) + k)) for c in everything)))
    for key in ("suffix", "site", "host"):  # each level is smoothed by the one above; the page's own count is left out
        df = join_splittable(df, counts(key, "n"), [key]).withColumn("rest", F.zip_with("n", "own", lambda a, b: a - b))
        total = F.aggregate("rest", F.lit(0.0), lambda s, x: s + x)
        df = df.withColumn("total", total).withColumn("prior", F.zip_with("rest", "prior", lambda n, p: (n + STRENGTH * p) / (F.col("total") + STRENGTH))).drop("n", "rest", "total")
    by_lang = F.array(*(F.lit(float(c)) for c in everything))
    df = join_splittable(df, counts("declared", "d"), ["declared"]).withColumn("rest", F.zip_with("d", "own", lambda a, b: a - b))
    trust = F.zip_with("rest", F.zip_with(by_lang, "own", lambda a, b: a - b), lambda n, m: (n + 1.0) / (m + k + 1.0))
    post = F.zip_with(F.zip_with("text_scores", "prior", lambda a, p: a + F.log(p)), trust, lambda a, t: F.when(F.col("declared") == "", a).otherwise(a + F.log(t)))
    top = F.array_max("post")
    weights = F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("post")))
    df = df.withColumn("post", post)
    names = F.array(*map(F.lit, languages))
    return df.select("page_id", F.element_at(names, F.array_position("post", top).cast("int")).alias("lang"), (1 / weights).alias("probability"), "text_lang", "declared")
