import re

from tandemlake.llm import decontaminate

from .helpers import DOCS, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(texts, items):
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for item, body in items:
            v = words(body)
            for i in range(max(1, len(v) - 12) if v else 0):
                win = v[i : i + 13]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def case():
    items = [(i, prose(200 + i, 15 + i)) for i in range(6)] + [(10, "Two words"), (11, "one"), (12, ""), (13, None), (14, "!!"), (15, prose(200, 15)), (16, "É ß"), (16, prose(203, 18))]
    t = [p for _, p in items[:6]]
    texts = [None, "", "...", prose(1, 300), t[0], t[1].upper() + " tail", "x " + t[2].replace(" ", "--") + " y", " ".join(t[3].split()[:13]), " ".join(t[3].split()[:12])]
    texts += [prose(2, 40) + " " + t[4] + " " + prose(3, 900), "two  WORDS two words", "twowords", "a one b", "é ß É ß", t[5] + " " + t[5], " ".join(prose(5, 100).split()[:50] + t[0].split()[1:14] + ["z"] * 9)]
    return texts, items


def test_against_brute_force(spark):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts, "'x' as runs")
    for block in (50_000, 7):  # one block, and many whose hits are joined
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench, block=block).collect()}
        assert got == dict(enumerate(slow(texts, items)))


def test_chunks_inside_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 50)
    texts, items = case()
    for t in texts:
        data = (t or "").encode().translate(decontaminate.TABLE)
        w = decontaminate.hashed_words(data)
        assert [data[s:e].decode() for s, e in zip(w.start, w.end)] == words(t)
    same = decontaminate.hashed_words(b"aa " + b"b" * 300 + b" aa")
    assert same.hash[0] == same.hash[2] != same.hash[1]


def test_removal_keeps_clean_documents_and_columns(spark):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    want = {i for i, (n, hit, _) in enumerate(slow(texts, items)) if not (hit and 20 * hit >= n)}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in want}


def test_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", None, None, None), (1, "a b", None, None, None), (None, None, None, None, None)], DOCS)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in decontaminate.contamination(docs, none).collect()) == [("1", 2, 0), ("1", 2, 0), ("None", 0, 0)]
    assert decontaminate.contamination(table(spark, []), none).count() == 0
    nameless = spark.createDataFrame([(None, "a")], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in decontaminate.contamination(docs.limit(1), nameless).collect()] == [(1, [])]
