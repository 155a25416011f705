import math
import random
import re
import time
from collections import Counter

from tandemlake.llm import language_id

from .helpers import DOCS

PAGES = "page_id long, url string, html string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sche", "ung", "ein", "ber"], "cc": ["ção", "nho", "est", "ra"]}


def text(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def docs(spark):
    return spark.createDataFrame([(3 * i + j, text(x, 3 * i + j), x, None, None) for i in range(30) for j, x in enumerate(SYLLABLES)] + [(999, None, "aa", None, None), (998, "x", None, None, None)], DOCS)


def test_text_markup_and_host(spark):
    pages, truth = [], {}
    for i in range(90):
        x = ["aa", "bb", "cc"][i % 3]
        body = text(x, 500 + i) if i % 2 else ""  # without a text, the address has to tell
        pages.append((i, f"http://www.{x}site.{x}/p", f'<html lang="{x if i % 5 else "zz"}"><script>{text("aa", 1)}</script><p>{body}</p></html>'))
        truth[i] = x
    pages += [(200, None, None), (201, "http://bbsite.bb/", None), (202, "", "<html lang=cc>"), (203, "http://aasite.aa/", f"<html lang='aa'>{text('bb', 77)}</html>"), (200, None, None)]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, PAGES).selectExpr("*", "1 as prior", "'x' as lang"), docs(spark)).collect()}
    assert len(got) == 94
    assert all(got[i].lang == x for i, x in truth.items())
    assert got[201].lang == "bb" and got[202].lang == "cc" and got[203].lang == "bb" and got[200].lang in SYLLABLES
    assert all(0 < r.probability <= 1 for r in got.values()) and got[200].text_lang is None


def test_odd_tables(spark):
    none = spark.createDataFrame([], PAGES)
    assert language_id.identify(none, docs(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.b", "<p>x")], PAGES)
    assert [tuple(r) for r in language_id.identify(one, docs(spark).limit(0)).collect()] == [(1, None, None, None, None)]


def test_visible_text():
    assert language_id.scan("<p>a&amp;b<!-- <p>no --><style>x{}</style> c<br>d") == ("a&b c d", "")
    assert language_id.scan('<!DOCTYPE html><HTML class="x" data-lang="fr" lang = "De-at"><body>1 < 2 <3</body></HTML>') == ("1 < 2 <3", "de")
    assert language_id.scan("a<script>b</script >c<SCRIPT>d</script>e<style>f") == ("a c e", "")
    assert language_id.scan("a<!-- b") == language_id.scan("a<b") == ("a", "")
    assert language_id.scan(None) == ("", "") and language_id.scan("<") == ("<", "") and language_id.scan("</>x") == ("x", "")


def test_odd_markup_is_read_in_linear_time():
    for piece in ("<script ", "<!--", "<html ", "<", "</script", "<html lang ", "<script>", "<style></styl"):
        start = time.perf_counter()
        language_id.scan(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - start < 5


def slow_identify(pages, docs):
    """Posteriors by loops over dicts and lists."""
    langs = sorted({d[2] for d in docs if d[1] is not None and d[2] is not None and d[0] is not None})

    def counts(text):
        kept = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "
        return Counter(kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)) if kept.strip() else Counter()

    of_lang = {x: sum((counts(d[1]) for d in docs if d[2] == x and d[1]), Counter()) for x in langs}
    size = {x: sum(c.values()) + 0.5 * language_id.BUCKETS for x, c in of_lang.items()}
    rows = []
    for page, url, markup in pages:
        text, said = re.sub("<[^>]*>", " ", markup or ""), re.search("lang=.?([a-z]{2})", markup or "")
        c = counts(text)
        n = sum(c.values())
        score = {x: min(1, 60 / max(n, 1)) * sum(k * math.log((of_lang[x][g] + 0.5) / size[x]) for g, k in c.items()) for x in langs}
        host = (re.search("://([^/?#]*)", url or "") or [0, ""])[1].lower()
        rows.append((page, score, max(langs, key=lambda x: (score[x], -langs.index(x))) if n else None, said[1] if said else "", {"suffix": host.split(".")[-1], "site": ".".join(host.split(".")[-2:]), "host": host}))
    every, out, k = Counter(r[2] for r in rows), {}, len(langs)
    total = sum(every[x] for x in langs)
    for page, score, text_lang, said, keys in rows:
        prior = {x: (every[x] + 1) / (total + k) for x in langs}
        for key in ("suffix", "site", "host"):
            c = Counter(r[2] for r in rows if r[4][key] == keys[key])
            c[text_lang] -= 1
            m = sum(c[x] for x in langs)
            prior = {x: (c[x] + 10 * prior[x]) / (m + 10) for x in langs}
        same = Counter(r[2] for r in rows if r[3] == said)
        trust = {x: (same[x] - (x == text_lang) + 1) / (every[x] - (x == text_lang) + k + 1) for x in langs}
        post = {x: math.exp(score[x] - max(score.values())) * prior[x] * (trust[x] if said else 1) for x in langs}
        best = max(langs, key=lambda x: (post[x], -langs.index(x)))
        out[page] = (best, post[best] / sum(post.values()), text_lang, said)
    return out


def test_posteriors_against_loops(spark):
    r, pages = random.Random(9), []
    for i in range(80):
        x = r.choice("abc") * 2
        body = text(x, 900 + i, r.choice([0, 1, 2, 5, 30]))
        pages.append((i, r.choice([None, f"http://{x}.site{i % 3}.{r.choice(['aa', 'bb', 'com'])}/p", "http://www.hot.com/"]), f"<html lang={r.choice(['aa', 'bb', 'cc', 'zz'])}><p>{body}</p>" if i % 4 else f"<p>{body}"))
    rows = docs(spark).collect()
    want = slow_identify(pages, [(d.doc_id, d.text, d.lang) for d in rows])
    got = language_id.identify(spark.createDataFrame(pages, PAGES), docs(spark)).collect()
    assert len(got) == len(pages)
    for g in got:
        lang, p, text_lang, said = want[g.page_id]
        assert (g.lang, g.text_lang, g.declared) == (lang, text_lang, said) and abs(g.probability - p) < 1e-3


def test_the_sample_is_spread_over_languages(spark):
    """A very long text of one language, and very many of it, leave the others their share."""
    rows = [(i, text("aa", i) if i else text("aa", 0, 60_000), "aa", None, None) for i in range(300)] + [(1000 + i, text(x, i), x, None, None) for i in range(5) for x in ("bb", "cc")]
    names, table = language_id.fit(spark.createDataFrame(rows, DOCS), sample=30)
    assert names == ["aa", "bb", "cc"]
    for k, x in enumerate(names):
        c = language_id.grams(text(x, 77, 20))
        assert (table @ c).argmax() == k
