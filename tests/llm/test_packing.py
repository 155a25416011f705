import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tandemlake.llm import packing
from tokenizers import Tokenizer

from .helpers import DOCS, prose, table

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check(rows, ids, window=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts, whole in [*((v, len(ids[d])) for d, v in by_doc.items()), *((v, None) for v in by_seq.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == whole if whole is not None else at <= window and at & (at - 1) == 0 or at == window
    assert set(by_doc) == set(ids)


def test_pieces(spark):
    texts = [None, "", " ", "one", prose(1, 9000), "x" * 5000, "a<|endoftext|>b <|startoftext|>", "don't we'll I'M", *(prose(s, 37 * s) for s in range(30))]
    rows = packing.pack(table(spark, texts, "1 as offset").repartition(3), PATH).collect()
    check(rows, {i: [*plain(t), 1] for i, t in enumerate(texts)})


def test_odd_tables(spark):
    assert packing.pack(table(spark, []), PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b", None, None, None), (1, "a b", None, None, None), (None, None, None, None, None)], DOCS)
    lengths = Counter()
    for r in packing.pack(docs, PATH).collect():
        assert r.doc_tokens == {1: 3, None: 1}[r.doc_id]
        lengths[r.doc_id] += r.length
    assert lengths == {1: 6, None: 1}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\u00a0\x1c\x85aÀéΣς1½'s!.,;HK×÷«İﬁ漢", "\u0331", "\u0307", "<|endoftext|>", "<|ENDOFTEXT|>", "é. ", "x'S, ", "don't", "×!"]), max_size=30).map("".join))
def test_words_on_their_own_have_the_ids_of_the_text(text):
    tokens = packing.Tokens(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.of([text.encode(), text.encode()])]
    assert got == [plain(text)] * 2


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \tasSdDtTré7\'\'\"(-_<>=|@×ªß²\x00\x1c\u00a0İK", "\u0338", "\u030c", "J", "<|startoftext|>", "'ll", "'RE", "<|"]), max_size=15).map("".join), max_size=4))
def test_pre_tokens_on_their_own_have_the_ids_of_the_text(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Tokens(PATH).of([t.encode() for t in texts])]
    assert got == [plain(t) for t in texts]


def test_words_are_looked_up_once_whatever_signs_stand_around(monkeypatch):
    asked = Counter()
    encoded = packing._Ids._encoded
    monkeypatch.setattr(packing._Ids, "_encoded", lambda self, words: asked.update(words) or encoded(self, words))
    packing._shared.cache_clear()
    texts = ['Blorwhent, (blorwhent) "blorwhent" blorwhent-blorwhent', "blorwhent's BLORWHENT; été-blorwhent/été 2024", "blorwhent!! <|endoftext|> <blorwhent>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Tokens(PATH).of([t.encode() for t in texts])]
    assert got == [plain(t) for t in texts]
    assert set(asked) <= {w.encode() for w in ["", "blorwhent", "été", "'s", *',()"-;/<>024', "!!", "<|endoftext|>"]} and set(asked.values()) == {1}


def test_many_words_are_put_together_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "GATHERED", 7)
    texts = ["", prose(5, 100), None, "one", prose(6, 7)]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Tokens(PATH).of([t and t.encode() for t in texts])]
    assert got == [plain(t) for t in texts]


def test_cache_that_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    packing._shared.cache_clear()
    text = prose(4, 300)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Tokens(PATH).of([text.encode()] * 70)] == [plain(text)] * 70


@pytest.mark.parametrize("window", [8, 64])
def test_levels_are_chosen_by_least_squares(window):
    rng = np.random.default_rng(1)
    packer = packing.Packer(0, window)
    out = []
    for d in range(300):
        size = int(rng.integers(1, window))
        want = {}
        for level in range(window - size + 1):
            if level and not packer.level[level]:
                continue
            n = packer.level.copy()
            if level:
                n[level] -= 1
            if level + size < window:
                n[level + size] += 1
            want[level] = int((n[1:window] ** 2).sum())
        best = packer.best_level(size)
        assert best in want and want[best] == min(want.values())
        out += list(packer.add(d, np.full(size, d, "<u4").tobytes()))
    out += list(packer.finish())
    fill = Counter()
    for _, _, n, _, _, seq, _ in out:
        fill[seq] += n
    assert sum(1 for f in fill.values() if f != window) <= window.bit_length()
    assert sum(fill.values()) == sum(n for _, _, n, *_ in out)
    assert all(f == window or f & (f - 1) == 0 for f in fill.values())


def rests(packer, sizes):
    """Pack documents of these sizes; every id comes out once, in whole windows but for the last ones."""
    out, most = [], 0
    for d, n in enumerate(sizes):
        out += list(packer.add(d, np.arange(n, dtype="<u4").tobytes()))
        most = max(most, packer.n_open)
        assert packer.n_open == sum(map(len, packer.open.values())) == packer.level.sum()
        assert all(packer._near(f) in (k, 0, packer.units) and f == sum(len(p[2]) // 4 for p in ps) for k, ws in packer.open.items() for f, ps in ws)
    out += list(packer.finish())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, total, seq, offset in out:
        assert total == sizes[doc] and crc == zlib.crc32(np.arange(start, start + n, dtype="<u4").tobytes())
        by_doc[doc].append((start, n))
        by_seq[seq].append((offset, n))
    for parts in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
    assert {d: sum(n for _, n in v) for d, v in by_doc.items()} == {d: n for d, n in enumerate(sizes) if n}
    lengths = [sum(n for _, n in v) for v in by_seq.values()]
    assert all(f == packer.window or f & (f - 1) == 0 for f in lengths) and sum(f != packer.window for f in lengths) <= 12
    return most


def test_nearly_all_tokens_are_placed_by_level():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0)
    sizes = rng.lognormal(6.3, 0.8, 6000).astype(int) + 1
    most = rests(packer, sizes.tolist())
    assert packer.merged < 0.04 * sum(n % 2048 for n in sizes.tolist()) and most <= packing.MOST_OPEN + 1


@pytest.mark.parametrize("sizes", [[1100] * 900, [5] * 3000, [2041] * 300, [2047, 1] * 300, [7, 2040, 9, 1024, 8] * 200, [2048, 4096, 2049]])
def test_rests_that_do_not_fit_together(sizes):
    assert rests(packing.Packer(0, most_open=64), sizes) <= 65
