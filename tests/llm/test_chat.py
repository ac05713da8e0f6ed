import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "[GEN]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "\n", " ", "/s>", "ok", "é", "</s>\n", "<\\/s>", "{{ x }}", "{% if %}"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["user", "assistant", "", *BITS]), max_size=3), st.lists(st.sampled_from(BITS), max_size=8)), max_size=5))
def test_round_trip(turns):
    turns = [("assistant" if k % 2 else "".join(r), "".join(t)) for k, (r, t) in enumerate(turns)]
    template, reader = C.Template(), C.Reader()
    messages = [{"role": r, "text": t} for r, t in turns]
    whole, spans = template.render(iter(messages))
    for piece, masked in template.pieces(iter(messages)):
        reader.feed(piece, masked)
    assert "".join(reader.held) == "" and reader.turns == len(turns) and reader.chars == len(whole)
    assert reader.turn_hash.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = [t for r, t in turns if r == "assistant" and t]
    assert [C.unescape(whole[a:b]) for a, b in spans] == loss
    again = C.Reader()
    again.feed(whole, False)
    assert again.turn_hash.hexdigest() == reader.turn_hash.hexdigest()


def test_language():
    render = lambda s, *m: C.Template(s).render([{"role": r, "text": t} for r, t in m])[0]
    assert render("a{# no #}b{{ 'x' ~ 1 + 2 }}") == "abx12"
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% else %}-{% endif %}{{ m.text | trim | upper }};{% endfor %}", ("u", " a "), ("v", "b"), ("w", "c")) == "1FA;2-B;3LC;"
    assert render("{% if not (1 == 2) and 'a' < 'b' or false %}yes{% endif %}") == "yes"
    assert C.Template("{% if 1 == 2 %}a{% else %}b{% endif %}{{ 'c' | upper }}").tree == [("text", "bC")]
    text, spans = C.Template("<{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}|{% endfor %}").render([{"text": "ab"}, {"text": "c"}])
    assert text == "<ab|c|" and spans == [(1, 3), (4, 5)]


@pytest.mark.parametrize("bad", ["{% for x in y %}{% endfor %}", "{{ f() }}", "{{ a.__class__ }}", "{% if %}{% endif %}", "{% for m in messages %}", "{{ 'a' | eval }}", "{% endfor %}", "{{ 1 + }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ (1 }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}"])
def test_sandbox(bad):
    with pytest.raises(C.TemplateError):
        C.Template(bad).render([{"role": "a", "text": "b"}])


def test_fields_are_no_attributes():
    with pytest.raises(C.TemplateError):
        C.Template("{% for m in messages %}{{ m.text.__class__ }}{% endfor %}").render([{"text": "x"}])
    with pytest.raises(C.TemplateError):
        C.Template("{{ messages.append }}").render([])


def expected(rows):
    out, by = {}, {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    for c, turns in by.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_table(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "x" * 3000, "".join(rng.choices(BITS, k=6))])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (5, None, "assistant", "first"), (6, 0, "user", "tie"), (6, 0, "user", "tie")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.read_back(df).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})
    formatted = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == {k: len(r.formatted) for k, r in formatted.items()}


def test_empty_table_and_other_columns(spark):
    assert C.read_back(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]", 1), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 2)], SCHEMA + ", id long")
    (r,) = C.read_back(df).collect()
    assert r.n_turns == 2 and r.loss_chars == 21 and r.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
