import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tandemlake.llm import chat_template
from tandemlake.llm.chat_template import Template, TemplateError, escape, fold, parse, unescape

ROWS = "conv_id long, turn long, role string, text string"
SPEC = "</s>[INST] ok [/INST]"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<|", "<s>", "</s>", "[INST]", "[/INST]", "<", "|", "x", "[", "/", "end|>\n"])).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(c in out for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def slow(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        pairs = [(role or "", text or "") for _, _, role, text in turns]
        said = "".join(t for r, t in pairs if r == "assistant")
        n = sum(24 + len(escape(r)) + len(escape(t)) for r, t in pairs)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), n)
    return out


def rows():
    r = random.Random(1)
    bits = ["<|end|>\n", "<|text|>", "<|turn|>", SPEC, "\\", "é", "\n", " x ", "𝒳"]
    out = [(c, t, r.choice(["user", "assistant", "system", None, "a<|text|>b\n"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for c in range(30) for t in range(r.randint(1, 8))]
    out += [(99, 1, "assistant", None), (99, 1, "assistant", None), (99, None, "user", ""), (None, 3, "user", "q"), (98, 0, "assistant", "y" * 300_000)]
    return out


def test_digests(spark):
    df = spark.createDataFrame(rows(), ROWS).selectExpr("*", "'x' as n_turns")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat_template.format_digests(chat_template.with_probe(df)).collect()}
    assert got == slow([*rows(), (-7, 0, "user", SPEC), (-7, 1, "assistant", SPEC)])


def test_formatted_text_and_spans(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", SPEC)], ROWS)
    (r,) = chat_template.format_conversations(df).collect()
    assert r.formatted == f"<|turn|>user<|text|>hi<|end|>\n<|turn|>assistant<|text|>{escape(SPEC)}<|end|>\n"
    assert [unescape(r.formatted[a:b]) for a, b in r.loss_spans] == [SPEC]
    assert chat_template.format_digests(df.limit(0)).count() == 0


def render(source, **names):
    out = []
    Template(source).stream(lambda t, m: out.append(t), **names)
    return "".join(out)


def test_language():
    assert render("{{ 1 + 2 }}{# gone #}{{ 'a' ~ 3 | trim }}") == "3a3"
    assert render("{% if x == 'a' and not y %}A{% endif %}", x="a") == "A"
    assert render("{% for m in ms %}{{ loop.index0 }}{{ m['k'] }}{% if not loop.last %},{% endif %}{% endfor %}", ms=iter([{"k": "p"}, {"k": "q"}])) == "0p,1q"
    assert render("{% set z = n + 1 %}{{ z }}{{ missing }}", n=4) == "5"
    assert render("{% if a %}1{% elif b > 2 %}2{% else %}3{% endif %}", a=False, b=3) == "2"
    assert Template("{% generation %}{{ t }}{% endgeneration %}!").render([], t="ab") == ("ab!", [(0, 2)])


def test_constants_are_folded():
    tree = fold(parse("a{{ 1 + 1 }}{% if false %}b{% else %}c{% endif %}{{ 'D' | lower }}{{ x }}"))
    assert tree == (chat_template.Text("a2cd"), chat_template.Output(chat_template.Name("x")))


@pytest.mark.parametrize("bad", ["{{ x.__class__() }}", "{% import os %}", "{{ x | eval }}", "{% for a in b %}", "{% endif %}", "{{ 1 + }}", "{{ f('x') }}", "{{ a b }}"])
def test_nothing_else_is_understood(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_objects_are_out_of_reach():
    assert render("{{ x.__class__ }}{{ x['__dict__'] }}", x=object()) == ""
    with pytest.raises(TemplateError):
        render("{{ x }}", x=object())
