"""Sum-of-squares online packing of token sequences.

Texts become token ids, documents are cut into whole windows and a rest, and each rest is placed on arrival: into the fill
level for which the sum of the squared numbers of partially filled windows by level is least. The numbers are held in an
array by level, so a placement is one vectorised expression. There are LEVELS of them, a unit of 32
tokens each, and what a window lacks or has too much by rounding, less than a unit, is cut from or left to another rest. At
most MOST_OPEN windows are open; beyond that the fullest is filled up from the emptiest.

Every task packs the documents that it reads by itself: there is no shuffle, the state is one level array and the ids of
windows that are still open, and a lost task is simply run again. At the end of a task the open windows are merged by cutting
pieces, and what is left over stands in sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, runs_by_size, small_batches, tidy

WINDOW = 2048
LEVELS = 64
MOST_OPEN = 64
END_ID = 1
TEXT_BYTES = 8_000_000
NEVER = 1 << 62
CACHE_WORDS = 340_000
LONG_WORD = 48
#: Words that are looked up as one text.
TOGETHER = 200
#: Words whose ids are put together at once.
GATHERED = 200_000
#: What may hold a special token: from `<|` to the next white space.
SPECIAL = re.compile(rb"<\|\S*")
#: Kinds of bytes: white space and all beyond ASCII, letters, digits, what is left, the apostrophe.
NONE, A_LETTER, A_DIGIT, A_SIGN, AN_APOSTROPHE = range(5)
KIND = np.array([AN_APOSTROPHE if c == 39 else NONE if c > 127 or chr(c) in " \t\n\r\v\f" else A_LETTER if chr(c).isalpha() else A_DIGIT if chr(c).isdigit() else A_SIGN for c in range(256)], np.uint8)
#: By two kinds, whether a pre-token ends between them, whatever stands around. An apostrophe may go on with a letter.
ENDS = np.array([[x and y and (x != y or x == A_DIGIT) and {x, y} != {A_SIGN, AN_APOSTROPHE} and (x, y) != (AN_APOSTROPHE, A_LETTER) for y in range(8)] for x in range(5)], bool).ravel()
#: Second bytes of the Latin-1 letters that begin with C3 in UTF-8: all but the signs of times and division.
LATIN = np.array([0x80 <= c <= 0xBF and c not in (0x97, 0xB7) for c in range(256)])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Ids(dict):
    """Ids (little-endian, 32 bits) by word; short words are remembered while there is room."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.extra: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.extra[word]

    def learn(self, words: list[bytes]) -> None:
        """Look words up that aren't known; those for which there is no room are in `extra` until the next call."""
        self.extra = {}
        new = self._encoded(words)
        room = CACHE_WORDS - len(self)
        if len(new) <= room and max(map(len, new), default=0) <= LONG_WORD:
            self.update(new)
            return
        kept = {w: ids for w, ids in islice(new.items(), max(0, room)) if len(w) <= LONG_WORD}
        self.update(kept)
        self.extra = {w: ids for w, ids in new.items() if w not in kept}

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters alone are one pre-token each and go to the tokenizer as one text, the others one by one."""
        out, others, letters = {}, [], []
        for w, text in zip(words, b"\n".join(words).decode("utf-8", "replace").split("\n")):  # no word holds a line's end
            (letters if text.isalpha() else others).append((w, text))
        for a in range(0, len(letters), TOGETHER):
            part = letters[a : a + TOGETHER]
            got = self.tokenizer.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(part) or ends[-1] != 4 * len(ids):  # a letter that falls apart when it becomes small, or another kind of model
                others += part
                continue
            ids, ends = ids.tobytes(), ends.tolist()
            for (w, _), start, end in zip(part, [0, *ends], ends):
                out[w] = ids[start:end]
        if others:
            got = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
            out.update({w: array("I", e.ids).tobytes() for (w, _), e in zip(others, got)})
        return out


#: The tokenizer and what it remembers stay with the worker process, from task to task.
_shared = cache(_Ids)
KEPT["packing"] = _shared.cache_clear


def _words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All texts' words as numbers, the words by number, and where each text's begin and end.

    ASCII white space parts words, and so does the end of a pre-token that can be told from the two bytes around it."""
    raw = b"\n".join([*texts, b""])
    small = np.frombuffer(bytearray(raw.lower()), np.uint8)
    kind = KIND[small]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for m in SPECIAL.finditer(raw):
        small[m.start() : m.end()] = np.frombuffer(m[0], np.uint8)
        kind[m.start() : m.end()] = NONE
    for t, at in zip(texts, bounds.tolist()):
        if b"\xcc" in t or b"\xcd" in t:  # a capital and a small letter may take a combining mark differently
            small[at : at + len(t)] = np.frombuffer(t, np.uint8)
    before, after = kind[:-1] * np.uint8(8), kind[1:]
    latin = np.flatnonzero(small[:-1] == 0xC3)
    latin = latin[LATIN[small[latin + 1]]]
    before[latin[latin + 1 < len(before)] + 1] = 8 * A_LETTER
    after[latin[latin > 0] - 1] = A_LETTER
    before += after
    cuts = np.flatnonzero(ENDS[before]) + 1
    del raw, kind, before, after  # a text may be large
    small = np.insert(small, cuts, 32)
    bounds += np.searchsorted(cuts, bounds)
    parted = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(small)))
    words = parted.flatten().dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), parted.offsets.to_numpy()


class Tokens:
    """Ids of whole texts. Runs between ASCII white space are tokenised on their own and remembered: the tokenizer drops
    white space and no rule of it looks across, so the ids are those of the whole text. For the same reason runs are parted
    where the tokenizer parts them anyway: between letters, digits and signs of ASCII and Latin-1, but for a letter after an
    apostrophe. ASCII capitals become small ones beforehand, though not in texts with combining marks, where that could make
    a difference; what may hold a special token is left as it is. The words of some texts that aren't known yet are looked
    up together, each once, and the ids of all words are taken from a table by the words' numbers."""

    def __init__(self, path: str):
        self.known = _shared(path)

    def of(self, texts: list[bytes | None]) -> Iterator[bytes]:
        known = self.known
        texts = [t or b"" for t in texts]
        for a, b in runs_by_size([len(t) for t in texts], TEXT_BYTES):
            numbers, words, bounds = _words(texts[a:b])
            known.learn([w for w in words if w not in known])
            table = [known[w] for w in words]
            sizes = np.array([len(x) // 4 for x in table], np.int64)
            starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), "<u4")
            del words, table
            ends = np.concatenate([[0], np.cumsum(sizes[numbers])])
            got = np.empty(ends[-1], "<u4")
            for c in range(0, len(numbers), GATHERED):
                part = numbers[c : c + GATHERED]
                first, last = ends[c], ends[c + len(part)]
                got[first:last] = ids[np.repeat(starts[part] + first - ends[c : c + len(part)], sizes[part]) + np.arange(last - first)]
            for start, end in pairwise(ends[bounds].tolist()):
                yield got[start:end].tobytes()


class Packer:
    """One task's sequences. Pieces (doc, start, ids, total) come out as soon as their sequence is full."""

    def __init__(self, first_id: int, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.next, self.most_open = window, first_id, most_open
        self.unit = max(1, window // LEVELS)
        self.units = window // self.unit
        self.level = np.zeros(self.units + 1, np.int64)
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)  # by level: fill and pieces
        self.n_open = 0
        self.spare: list[tuple] = []  # ends of rests, less than a unit each, for windows that lack less than that
        self.spare_tokens = 0
        self.lacking: list[tuple[int, list]] = []
        self.merged = 0  # tokens that stood in open windows at the end

    def _close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next, at
            at += n
        self.next += 1

    def best_level(self, size: int) -> int:
        """The level (0: a new window) for which the sum of squares rises least by a rest of so many units; of equals, the fullest."""
        n, w = self.level, self.units
        to = np.arange(size, w + 1)
        rise = 2 * n[to] + 1
        rise[-1] = 0  # a full window is no longer counted
        source = to - size
        fall = np.where(source > 0, 1 - 2 * n[source], 0)
        cost = np.where((source == 0) | (n[source] > 0), rise + fall, NEVER)
        return int(source[len(cost) - 1 - np.argmin(cost[::-1])])

    def _near(self, tokens: int) -> int:
        """The level that is nearest to so many tokens."""
        return (2 * tokens + self.unit) // (2 * self.unit)

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        total, whole = len(ids) // 4, 4 * self.window
        for at in range(0, len(ids) - whole + 1, whole):
            yield from self._close([(doc, at // 4, ids[at : at + whole], total)])
        rest = len(ids) % whole
        if rest:
            yield from self._place((doc, (len(ids) - rest) // 4, ids[len(ids) - rest :], total))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        while self.lacking and len(piece[2]) // 4 > self.unit:  # windows that no spare end has filled: cut from this one
            fill, pieces = self.lacking.pop()
            head, piece = _cut(piece, self.window - fill)
            yield from self._close([*pieces, head])
        n = len(piece[2]) // 4
        size = self._near(n)
        if not size:
            yield from self._keep(piece)
            return
        level = self.best_level(size)
        fill, pieces = self._take(level) if level else (0, [])
        if fill + n > self.window:
            head, end = _cut(piece, self.window - fill)
            yield from self._close([*pieces, head])
            yield from self._keep(end)
        elif fill + n == self.window:
            yield from self._close([*pieces, piece])
        elif self._near(fill + n) == self.units:
            self.lacking.append((fill + n, [*pieces, piece]))
            yield from self._fill_up()
        else:
            self._put(fill + n, [*pieces, piece])
            if self.n_open > self.most_open:
                yield from self._merge_two()

    def _take(self, level: int) -> tuple[int, list]:
        self.level[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, fill: int, pieces: list) -> None:
        level = max(1, min(self._near(fill), self.units - 1))
        self.level[level] += 1
        self.n_open += 1
        self.open[level].append((fill, pieces))

    def _keep(self, piece: tuple) -> Iterator[tuple]:
        self.spare.append(piece)
        self.spare_tokens += len(piece[2]) // 4
        yield from self._fill_up()
        if self.spare_tokens >= self.window:
            yield from self._close(self._spares(self.window))

    def _spares(self, n: int) -> list[tuple]:
        out = []
        self.spare_tokens -= n
        while n:
            head, end = _cut(self.spare.pop(), n)
            out.append(head)
            n -= len(head[2]) // 4
            if end[2]:
                self.spare.append(end)
        return out

    def _fill_up(self) -> Iterator[tuple]:
        while self.lacking and self.window - self.lacking[-1][0] <= self.spare_tokens:
            fill, pieces = self.lacking.pop()
            yield from self._close([*pieces, *self._spares(self.window - fill)])

    def _merge_two(self) -> Iterator[tuple]:
        """Fill the fullest open window up from the emptiest one."""
        levels = np.flatnonzero(self.level)
        fill, pieces = self._take(int(levels[-1]))
        low = int(np.flatnonzero(self.level)[0])
        other, donor = self._take(low)
        while fill < self.window and donor:
            head, end = _cut(donor.pop(), self.window - fill)
            pieces.append(head)
            fill, other = fill + len(head[2]) // 4, other - len(head[2]) // 4
            if end[2]:
                donor.append(end)
        if donor:
            self._put(other, donor)
        if fill == self.window:
            yield from self._close(pieces)
        else:
            self._put(fill, pieces)

    def finish(self) -> Iterator[tuple]:
        """Merge what is open: pieces in order of their windows' fill, cut at the window; the last in powers of two."""
        windows = [*self.lacking, *(w for level in sorted(self.open, reverse=True) for w in self.open[level])]
        left = [p for _, pieces in windows for p in pieces] + self.spare
        self.merged = tokens = sum(len(p[2]) // 4 for p in left)
        sizes = [self.window] * (tokens // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if tokens % self.window >> b & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                head, end = _cut(left.pop(), size)
                pieces.append(head)
                size -= len(head[2]) // 4
                if end[2]:
                    left.append(end)
            yield from self._close(pieces)
        self.open.clear()
        self.level[:] = 0
        self.n_open, self.spare, self.spare_tokens, self.lacking = 0, [], 0, []


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n tokens (all, if there are no more) and what is left."""
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> the pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and then id 1; a null or empty text is that id alone. Every id lies in one piece,
    a document of any length is cut at whole windows, repeated rows are packed each, an empty table gives no pieces.
    sequence_id is the task's number times 2**33 and a counter. tokenizer_path must be readable on the executors.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, end = Tokens(tokenizer_path), Packer(TaskContext.get().partitionId() << 33, window), np.array([END_ID], "<u4").tobytes()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64()) for x in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tokens.of(b.column(1).to_pylist())):
                out.extend(packer.add(doc, ids + end))
                if len(out) >= 5000:
                    yield batch()
        out.extend(packer.finish())
        if out:
            yield batch()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(work, "packing"), SCHEMA)
