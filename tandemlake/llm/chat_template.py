"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes Python closures that emit text
with a mark for what lies between {% generation %} and {% endgeneration %} (the loss mask). Expressions know literals, names,
keys of mappings, comparisons, and, or, not, +, ~ and a fixed list of filters; there are no calls, no attributes of Python
objects, no imports, and output is streamed, so a conversation of any length needs the memory of two turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Control strings that the default template marks turns with, and others that models commonly know.
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]")
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: str) -> str:
    """Backslashes are doubled and one is put after the first character of each control string."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------ syntax tree


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x if isinstance(x, (str, list, tuple, Mapping)) else _text(x)),
}
OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: a % b if isinstance(a, int) else _no_format(),
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
}


def _no_format():
    raise TemplateError("% works on whole numbers only")


def _text(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, (str, int, float)):
        return str(x)
    raise TemplateError(f"a {type(x).__name__} can't be written")


# ------------------------------------------------------------------ parser

_PARTS = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~%<>|.\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent, from the loosest binding on: or, and, not, comparison, + - ~ %, filter, key."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> str:
        kind, value = self.peek()
        if kind == "end" or text is not None and value != text:
            raise TemplateError(f"expected {text or 'more'}, found {value or 'the end'}")
        self.at += 1
        return value

    def whole(self) -> object:
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]}")
        return out

    def _left(self, part: Callable, ops: tuple[str, ...]) -> object:
        out = part()
        while self.peek()[1] in ops and self.peek()[0] in ("op", "name"):
            op = self.take()
            out = Apply(op, (out, part()))
        return out

    def either(self) -> object:
        return self._left(lambda: self._left(self.negated, ("and",)), ("or",))

    def negated(self) -> object:
        if self.peek() == ("name", "not"):
            self.take()
            return Apply("not", (self.negated(),))
        return self._left(lambda: self._left(self.filtered, ("+", "-", "~", "%")), ("==", "!=", "<", "<=", ">", ">=", "in"))

    def filtered(self) -> object:
        out = self.keyed()
        while self.peek() == ("op", "|"):
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter named {name}")
            out = Apply("|" + name, (out,))
        return out

    def keyed(self) -> object:
        kind, value = self.peek()
        if kind == "number":
            out: object = Literal(int(self.take()))
        elif kind == "string":
            out = Literal(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self.take()[1:-1], flags=re.S))
        elif kind == "name" and value in ("true", "false", "none"):
            out = Literal({"true": True, "false": False, "none": None}[self.take()])
        elif kind == "name":
            out = Name(self.take())
        elif value == "(":
            self.take()
            out = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value or 'end'}")
        while self.peek()[1] in (".", "[") and self.peek()[0] == "op":
            if self.take() == ".":
                out = Item(out, Literal(self.take()))
            else:
                out = Item(out, self.either())
                self.take("]")
        return out


def parse(source: str) -> tuple:
    """The template as a tree."""
    at, stack = 0, [("top", None, [])]

    def close(*kinds: str) -> tuple:
        if stack[-1][0] not in kinds:
            raise TemplateError(f"a block ends that isn't open ({', '.join(kinds)})")
        return stack.pop()

    def body() -> list:
        return stack[-1][2]

    for m in _PARTS.finditer(source):
        if m.start() > at:
            body().append(Text(source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body().append(Output(_Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "for":
                name, _, over = rest.partition(" in ")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError("for needs one name")
                stack.append(("for", (name.strip(), _Expression(over).whole()), []))
            elif word == "endfor":
                _, (name, over), inner = close("for")
                body().append(For(name, over, tuple(inner)))
            elif word == "if":
                stack.append(("if", [(_Expression(rest).whole(), [])], []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][-1][1])
            elif word in ("elif", "else"):
                _, tests, _ = close("if")
                tests.append((_Expression(rest).whole() if word == "elif" else Literal(True), []))
                stack.append(("if", tests, tests[-1][1]))
            elif word == "endif":
                _, tests, _ = close("if")
                tree: tuple = ()
                for test, inner in reversed(tests):
                    tree = (If(test, tuple(inner), tree),)
                body().extend(tree)
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                inner = close("generation")[2]
                body().append(Generation(tuple(inner)))
            elif word == "set":
                name, _, value = rest.partition("=")
                body().append(Set(name.strip(), _Expression(value).whole()))
            else:
                raise TemplateError(f"no statement named {word}")
    if at < len(source):
        body().append(Text(source[at:]))
    return tuple(close("top")[2])


def fold(node: object) -> object:
    """The tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Literal) for a in args):
            return Literal(_evaluator(Apply(node.op, args))({}))
        if node.op in ("and", "or") and isinstance(args[0], Literal):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Apply(node.op, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        value = fold(node.value)
        return Text(_text(value.value)) if isinstance(value, Literal) else Output(value)
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Literal):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# ------------------------------------------------------------------ closures


def _evaluator(node: object) -> Callable[[dict], object]:
    if isinstance(node, Literal):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Item):
        of, key = _evaluator(node.of), _evaluator(node.key)

        def item(names: dict) -> object:
            x, k = of(names), key(names)
            if isinstance(x, Mapping):
                return x.get(k)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int) and -len(x) <= k < len(x):
                return x[k]
            return None

        return item
    args = [_evaluator(a) for a in node.args]
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    f = FILTERS[node.op[1:]] if node.op[0] == "|" else OPERATORS[node.op]
    if len(args) == 1:
        return lambda names: f(args[0](names))
    return lambda names: f(args[0](names), args[1](names))


Emit = Callable[[str, bool], None]


def _writer(node: object) -> Callable[[dict, Emit, bool], None]:
    if isinstance(node, tuple):
        parts = [_writer(x) for x in node]

        def every(names: dict, emit: Emit, marked: bool) -> None:
            for p in parts:
                p(names, emit, marked)

        return every
    if isinstance(node, Text):
        text = node.text
        return lambda names, emit, marked: emit(text, marked)
    if isinstance(node, Output):
        value = _evaluator(node.value)
        return lambda names, emit, marked: emit(_text(value(names)), marked)
    if isinstance(node, Set):
        name, value = node.name, _evaluator(node.value)
        return lambda names, emit, marked: names.__setitem__(name, value(names))
    if isinstance(node, If):
        test, then, other = _evaluator(node.test), _writer(node.then), _writer(node.other)
        return lambda names, emit, marked: (then if test(names) else other)(names, emit, marked)
    if isinstance(node, Generation):
        inner = _writer(node.body)
        return lambda names, emit, marked: inner(names, emit, True)
    name, over, body = node.name, _evaluator(node.over), _writer(node.body)

    def loop(names: dict, emit: Emit, marked: bool) -> None:
        items = iter(over(names) or ())
        inner, end = dict(names), object()
        now, i = next(items, end), 0
        while now is not end:
            following = next(items, end)
            inner[name] = now
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": following is end}
            body(inner, emit, marked)
            now, i = following, i + 1

    return loop


class Template:
    def __init__(self, source: str = TEMPLATE):
        self.tree = fold(parse(source))
        self._write = _writer(self.tree)

    def stream(self, emit: Emit, **names: object) -> None:
        """Emit pieces of text and whether they are under the loss mask; messages may be any iterable."""
        self._write(dict(names), emit, False)

    def render(self, messages: Iterable[Mapping], **names: object) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of it (in code points) that are under the loss mask."""
        parts, spans, at = [], [], 0

        def emit(text: str, marked: bool) -> None:
            nonlocal at
            parts.append(text)
            if marked and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            at += len(text)

        self.stream(emit, messages=messages, **names)
        return "".join(parts), spans


# ------------------------------------------------------------------ reading back


@dataclass
class Reader:
    """Reads what the default template wrote, piece by piece: turns, and the text under the loss mask."""

    chars: int = 0
    turns: int = 0
    loss_chars: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    loss_digest: object = field(default_factory=hashlib.sha256)
    buffer: list[str] = field(default_factory=list)
    masked: list[str] = field(default_factory=list)

    def feed(self, text: str, marked: bool) -> None:
        self.chars += len(text)
        self.buffer.append(text)
        if marked:
            self.masked.append(text)
        elif text:
            self._end_of_mask()
        if END in text or text.endswith("\n") and "".join(self.buffer[-3:]).endswith(END):
            self._turns()

    def _end_of_mask(self) -> None:
        if self.masked:
            text = unescape("".join(self.masked))
            self.masked.clear()
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode("utf-8", "surrogatepass"))

    def _turns(self) -> None:
        *whole, rest = "".join(self.buffer).split(END)
        self.buffer[:] = [rest] if rest else []
        for turn in whole:
            role, mark, text = turn.removeprefix(TURN).partition(TEXT)
            if not mark or not turn.startswith(TURN):
                raise ValueError("not a turn")
            self.turns += 1
            self.digest.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))

    def end(self) -> tuple:
        self._end_of_mask()
        if "".join(self.buffer):
            raise ValueError("text after the last turn")
        return self.turns, self.digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for b in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns[:1] + b.columns[2:])):
            yield conv, {"role": role or "", "text": text or ""}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Runs of equal conv_id, each an iterator over its turns that must be used up before the next one."""
    rows = _turns(batches)
    ahead = next(rows, None)

    def one(conv: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            turn, ahead = ahead[1], next(rows, None)
            yield turn

    while ahead is not None:
        yield ahead[0], one(ahead[0])


def _sorted(conversations: DataFrame) -> DataFrame:
    small_batches(conversations.sparkSession)
    df = conversations.select("conv_id", "turn", "role", "text")
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, formatted, loss_spans (array of [from, to) in code points)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for conv, turns in _conversations(batches):
            text, spans = compiled.render(turns)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text]), pa.array([[list(s) for s in spans]], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "loss_spans"])

    return _sorted(conversations).mapInArrow(tidy(work), "conv_id long, formatted string, loss_spans array<array<long>>")


def format_digests(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: what reads back from its formatted text (see SCHEMA).

    Rows are taken by turn (null first), then by role and text; repeated rows are turns each. A null role or text is empty, null conv_ids
    are one conversation, an empty table gives none. A conversation's digest runs over its turns in order, so one task
    takes it, but as a stream: it holds two turns and a batch, never a conversation.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, out = Template(), []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, turns in _conversations(batches):
            reader = Reader()
            compiled.stream(reader.feed, messages=turns)
            out.append((conv, *reader.end()))
            if len(out) == 2000:
                yield batch()
        if out:
            yield batch()

    return _sorted(conversations).mapInArrow(tidy(work), SCHEMA)


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts look like control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
