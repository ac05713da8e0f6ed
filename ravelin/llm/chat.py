r"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures. The language:

    {{ expression }}   {% for x in messages %} .. {% endfor %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}   {# comment #}

Expressions have strings, integers, true, false, none, names, x.field, loop.index0, loop.first, loop.last, == != < <= > >=,
+ ~ (text), and, or, not, brackets, and the filters upper, lower, trim, length and escape. It is a sandbox: a field is a key
of a mapping and never an attribute, nothing can be called, there is no way to loop but over `messages`, and integers
and loops can't multiply. Text between generation markers is the loss mask.

A compiled template takes its messages from an iterator and gives its pieces to a generator, so a conversation of any
length is rendered in the memory of one turn. Conversations are sorted by Spark and streamed through the tasks.

Control strings inside texts are escaped by a backslash behind their first character; one that has backslashes there
gets one more, so that taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}[GEN]{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST] {{ m.text | escape }} [/INST]{% endif %}</s>\n{% endfor %}"
)
_CONTROL = r"/?(?:s>|ROLE\]|INST\]|GEN\])"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})"), re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_LEX = re.compile(r"\s+|(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()])")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)

Piece = tuple[str, bool]


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


FILTERS: dict[str, Callable[[Any], Any]] = {"upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "trim": lambda x: str(x).strip(), "length": lambda x: len(x), "escape": lambda x: escape(_text(x))}
COMPARE: dict[str, Callable[[Any, Any], bool]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
WORDS: dict[str, Any] = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template isn't valid, or a value isn't there."""


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


# ---- expressions: ("const", value) | ("name", n) | ("field", e, n) | ("filter", f, e) | ("not", e) | (op, a, b)


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        """The next token if it is one of those, else nothing."""
        if self.kind() in ("op", "name") and self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def whole(self) -> tuple:
        e = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return e

    LEVELS = (("or",), ("and",), tuple(COMPARE), ("+", "~"))

    def level(self, k: int) -> tuple:
        if k == len(self.LEVELS):
            return self.unit()
        if k == 2 and self.take("not"):
            return ("not", self.level(2))
        e = self.level(k + 1)
        while op := self.take(*self.LEVELS[k]):
            e = (op, e, self.level(k + 1))
        return e

    def unit(self) -> tuple:
        kind, token = self.kind(), self.peek()
        if self.take("("):
            e = self.level(0)
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
        elif kind == "int":
            e = ("const", int(token))
            self.at += 1
        elif kind == "str":
            e = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=re.S))
            self.at += 1
        elif kind == "name":
            e = ("const", WORDS[token]) if token in WORDS else ("name", token)
            self.at += 1
        else:
            raise TemplateError(f"an expression is missing before {token!r}")
        while op := self.take(".", "|"):
            name = self.peek()
            if self.kind() != "name" or op == "|" and name not in FILTERS:
                raise TemplateError(f"{name!r} can't stand behind {op!r}")
            self.at += 1
            e = ("field", e, name) if op == "." else ("filter", name, e)
        return e


def _apply(op: str, a: Any, b: Any) -> Any:
    if op in COMPARE:
        try:
            return COMPARE[op](a, b)
        except TypeError as e:
            raise TemplateError(str(e)) from None
    if op == "~" or isinstance(a, str) or isinstance(b, str):
        return _text(a) + _text(b)
    return a + b


def fold(e: tuple) -> tuple:
    """The expression with everything computed that is known beforehand."""
    match e:
        case ("field", x, name):
            return ("field", fold(x), name)
        case ("filter", name, x):
            x = fold(x)
            return ("const", FILTERS[name](x[1])) if x[0] == "const" else ("filter", name, x)
        case ("not", x):
            x = fold(x)
            return ("const", not x[1]) if x[0] == "const" else ("not", x)
        case ("and" | "or" as op, a, b):
            a, b = fold(a), fold(b)
            if a[0] == "const":
                return b if bool(a[1]) == (op == "and") else a
            return (op, a, b)
        case ("const" | "name", _):
            return e
        case (op, a, b):
            a, b = fold(a), fold(b)
            return ("const", _apply(op, a[1], b[1])) if a[0] == b[0] == "const" else (op, a, b)
    raise TemplateError(f"no such expression: {e[0]}")


Scope = dict[str, Any]


def compile_expression(e: tuple) -> Callable[[Scope], Any]:
    match e:
        case ("const", value):
            return lambda s: value
        case ("name", name):

            def look(s: Scope) -> Any:
                if name not in s:
                    raise TemplateError(f"{name!r} isn't defined")
                return s[name]

            return look
        case ("field", x, name):
            of = compile_expression(x)

            def field(s: Scope) -> Any:
                value = of(s)
                if type(value) is not dict or name not in value:
                    raise TemplateError(f"no field {name!r}")
                return value[name]

            return field
        case ("filter", name, x):
            f, of = FILTERS[name], compile_expression(x)
            return lambda s: f(of(s))
        case ("not", x):
            of = compile_expression(x)
            return lambda s: not of(s)
        case ("and", a, b):
            left, right = compile_expression(a), compile_expression(b)
            return lambda s: left(s) and right(s)
        case ("or", a, b):
            left, right = compile_expression(a), compile_expression(b)
            return lambda s: left(s) or right(s)
        case (op, a, b):
            left, right = compile_expression(a), compile_expression(b)
            return lambda s: _apply(op, left(s), right(s))
    raise TemplateError(f"no such expression: {e[0]}")


# ---- statements: ("text", s) | ("show", e) | ("for", name, body) | ("if", [(e, body), ..]) | ("generation", body)


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    root: list[tuple] = []
    open_: list[tuple[str, Any, list[tuple]]] = [("", None, root)]
    at = 0
    for m in _TAG.finditer(source):
        body = open_[-1][2]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("show", _Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            loops = [x[0] for x in open_].count("for")
            if word == "for" and (found := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)):
                if loops:
                    raise TemplateError("a loop over the messages inside another")
                open_.append(("for", found[1], []))
            elif word == "generation" and not rest:
                if "generation" in [x[0] for x in open_]:
                    raise TemplateError("a generation inside another")
                open_.append(("generation", None, []))
            elif word == "if":
                branches = [(_Expression(rest).whole(), [])]
                open_.append(("if", branches, branches[0][1]))
            elif word in ("elif", "else") and open_[-1][0] == "if":
                branches = open_.pop()[1]
                if branches[-1][0] == ("const", True) and len(branches) > 1:
                    raise TemplateError(f"{word} behind else")
                branches.append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
                open_.append(("if", branches, branches[-1][1]))
            elif word.startswith("end") and word[3:] == open_[-1][0] != "" and not rest:
                kind, what, inner = open_.pop()
                open_[-1][2].append(("if", what) if kind == "if" else ("for", what, inner) if kind == "for" else ("generation", inner))
            else:
                raise TemplateError(f"can't read {m.group()!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]!r} isn't closed")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


def fold_body(body: list[tuple]) -> list[tuple]:
    """Constant expressions become text, branches that can't be taken go, neighbouring texts are joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "show":
            e = fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("show", e))
        elif node[0] == "for":
            add(("for", node[1], fold_body(node[2])))
        elif node[0] == "generation":
            if inner := fold_body(node[1]):
                add(("generation", inner))
        elif node[0] == "if":
            branches: list[tuple[tuple, list[tuple]]] = []
            for e, inner in node[1]:
                e = fold(e)
                if e[0] != "const" or e[1]:
                    branches.append((e, fold_body(inner)))
                if e[0] == "const" and e[1]:
                    break
            if branches and branches[0][0][0] == "const":
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


Render = Callable[[Scope, bool], Iterator[Piece]]


def compile_body(body: list[tuple]) -> Render:
    parts = [_compile(node) for node in body]

    def run(s: Scope, masked: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(s, masked)

    return run


def _compile(node: tuple) -> Render:
    match node:
        case ("text", text):
            return lambda s, masked: iter(((text, masked),))
        case ("show", e):
            value = compile_expression(e)
            return lambda s, masked: iter(((_text(value(s)), masked),))
        case ("generation", body):
            inside = compile_body(body)
            return lambda s, masked: inside(s, True)
        case ("if", branches):
            compiled = [(compile_expression(e), compile_body(b)) for e, b in branches]

            def choose(s: Scope, masked: bool) -> Iterator[Piece]:
                return next((b(s, masked) for e, b in compiled if e(s)), iter(()))

            return choose
        case ("for", name, body):
            inside = compile_body(body)

            def loop(s: Scope, masked: bool) -> Iterator[Piece]:
                rest = iter(s["messages"])
                nothing = object()
                m, k = next(rest, nothing), 0
                while m is not nothing:
                    after = next(rest, nothing)
                    yield from inside(s | {name: m, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": after is nothing}}, masked)
                    m, k = after, k + 1

            return loop
    raise TemplateError(f"no such statement: {node[0]}")


class Template:
    def __init__(self, source: str = TEMPLATE):
        self.tree = fold_body(parse(source))
        self._run = compile_body(self.tree)

    def pieces(self, messages: Iterable[dict[str, Any]]) -> Iterator[Piece]:
        """(text, under the loss mask) one after the other; neighbours can share a mask."""
        return self._run({"messages": messages}, False)

    def render(self, messages: Iterable[dict[str, Any]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and the spans of the loss mask in it."""
        out, spans, at = [], [], 0
        for text, masked in self.pieces(messages):
            if masked and spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            elif masked:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), [x for x in spans if x[0] < x[1]]


class Reader:
    """Reads TEMPLATE's output back, piece by piece; holds one turn at most."""

    END = "</s>\n"
    TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[GEN\](.*)|\[INST\] (.*) \[/INST\])", re.S)

    def __init__(self) -> None:
        self.held: list[str] = []
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        if masked:
            loss = unescape(text)  # a generation holds whole texts
            self.loss_chars += len(loss)
            self.loss_hash.update(loss.encode("utf-8", "surrogatepass"))
        self.held.append(text)
        if self.END in text or len(self.held) > 1 and self.END in self.held[-2][-4:] + text[:4]:
            *whole, rest = "".join(self.held).split(self.END)
            for turn in whole:
                self._turn(turn)
            self.held = [rest]

    def _turn(self, turn: str) -> None:
        m = self.TURN.fullmatch(turn)
        if not m:
            raise ValueError("the output has no turn where one should be")
        role, text = unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])
        self.turns += 1
        self.turn_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict[str, Any]]]]:
    """(id, turns) of one conversation after the other, from rows sorted by id."""

    def rows() -> Iterator[tuple[Any, dict[str, Any]]]:
        for b in batches:
            for own, role, text in zip(b.column("id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                yield own, {"role": role or "", "text": text or ""}

    source, nothing = rows(), object()
    head: Any = next(source, nothing)

    def turns(own: Any) -> Iterator[dict[str, Any]]:
        nonlocal head
        while head is not nothing and head[0] == own:
            yield head[1]
            head = next(source, nothing)

    while head is not nothing:
        own = head[0]
        own_turns = turns(own)
        yield own, own_turns
        for _ in own_turns:  # what the template left
            pass


def _sorted_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted text and the spans of its loss mask (code points).

    Null roles and texts are empty; turns are taken in order of turn (nulls first), then role, then text; repeated rows are
    turns of their own; rows with a null id are one conversation. An empty table gives an empty result. Other columns
    are ignored.
    """
    rows = _sorted_turns(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for own, turns in _streams(batches):
            text, spans = compiled.render(turns)
            yield pa.RecordBatch.from_pylist([{"id": own, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]}], schema=pa.schema([("id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return rows.mapInArrow(run, f"id {kind}, formatted string, loss_spans array<struct<start:long,end:long>>").withColumnRenamed("id", conv_col)


def read_back(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, from TEMPLATE's output as it is read back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Output is made and read turn by turn, so a conversation of any length takes the memory of one turn. Edge cases are
    those of format_conversations.
    """
    rows = _sorted_turns(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(TEMPLATE)
        out: list[tuple] = []
        id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for own, turns in _streams(batches):
            reader = Reader()
            for text, masked in compiled.pieces(turns):
                reader.feed(text, masked)
            if "".join(reader.held):
                raise ValueError("the output ends inside a turn")
            out.append((own, reader.turns, reader.turn_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars))
            if len(out) >= 5000:
                yield batch()
                out.clear()
        yield batch()

    return rows.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", conv_col)
