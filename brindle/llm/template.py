"""Chat formatting by a compiler for a small sandboxed template language.

The language: text; ``{{ expression | filter }}``; ``{% for x in list %}``,
``{% if %} {% elif %} {% else %}``, ``{% set x = expression %}``,
``{% generation %}`` for what the model is to learn, each closed by ``{% end... %}``
(``set`` has no end); ``{#- comments -#}``; a ``-`` inside a mark strips white space
beside it.  Expressions: strings, integers, true, false, none, names, ``a.b``,
``a[b]``, ``+ == != < <= > >= in and or not``, parentheses, filters ``upper lower
trim length escape``, and ``loop.index0 loop.index loop.first loop.last loop.length``.

Source becomes a syntax tree, constants are folded (operators and filters of
constants, branches never taken, neighbouring texts), and the tree becomes Python
closures: nothing is evaluated as Python, an attribute is a key of a dict or
nothing, and there are no calls, so a template reaches only what it is given.

Control strings are what a template marks turns with.  ``escape`` puts a backslash
behind the first character of each control string in a text (one more, where there
are some), so no control string is left there; ``Controls.unescape`` undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """The template does not follow the language."""


class Controls:
    """Control strings, and texts that hold none of them.

    No control string may begin inside itself or another, nor hold a backslash: then
    escaping is exact to undo, and setting texts and control strings side by side makes no new ones.
    """

    def __init__(self, strings: tuple[str, ...]):
        firsts = {s[:1] for s in strings}
        if "" in firsts or any(len(s) < 2 or "\\" in s or any(c in firsts for c in s[1:]) for s in strings):
            raise TemplateError(f"control strings need two characters, no backslash and first characters found nowhere else in them: {strings}")
        each = [(re.escape(s[0]), re.escape(s[1:])) for s in strings]
        self.strings = strings
        self._plain = re.compile("|".join(f"{a}(?=\\\\*{b})" for a, b in each)) if each else None
        self._escaped = re.compile("|".join(f"({a})\\\\(?=\\\\*{b})" for a, b in each)) if each else None

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0] + "\\", text) if self._plain else text

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1], text) if self._escaped else text


# -- syntax tree

@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Get:
    of: object
    key: object


@dataclass
class Apply:
    op: str
    args: list


@dataclass
class Block:
    nodes: list = field(default_factory=list)


@dataclass
class For:
    name: str
    over: object
    body: Block


@dataclass
class If:
    test: object
    then: Block
    other: Block


@dataclass
class Set:
    name: str
    value: object


@dataclass
class Generation:
    body: Block


_MARK = re.compile(r"(\s*)\{([%{#])(-?)(.*?)(-?)([%}#])\}(?:(?<=-[%}#]\})\s*)?", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|"([^"]*)"|'([^']*)'|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>.|()\[\]=]))""")
_PAIRS = {"{": "}", "%": "%", "#": "#"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_COMPARE = ("==", "!=", "<=", ">=", "<", ">", "in")


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:]!r}")
        number, double, single, name, op = m.groups()
        out.append(("const", int(number)) if number else ("const", double) if double is not None else ("const", single) if single is not None else ("name", name) if name else ("op", op))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one mark."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def next_is(self, *values: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.next_is(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> object:
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"not expected: {self.tokens[self.at][1]!r}")
        return e

    def either(self) -> object:
        e = self.both()
        while self.next_is("or"):
            e = Apply("or", [e, self.both()])
        return e

    def both(self) -> object:
        e = self.negated()
        while self.next_is("and"):
            e = Apply("and", [e, self.negated()])
        return e

    def negated(self) -> object:
        return Apply("not", [self.negated()]) if self.next_is("not") else self.compared()

    def compared(self) -> object:
        e = self.added()
        for op in _COMPARE:
            if self.next_is(op):
                return Apply(op, [e, self.added()])
        return e

    def added(self) -> object:
        e = self.filtered()
        while self.next_is("+"):
            e = Apply("+", [e, self.filtered()])
        return e

    def filtered(self) -> object:
        e = self.simple()
        while True:
            if self.next_is("|"):
                e = Apply("|" + self.name(), [e])
            elif self.next_is("."):
                e = Get(e, Const(self.name()))
            elif self.next_is("["):
                e = Get(e, self.either())
                self.need("]")
            else:
                return e

    def simple(self) -> object:
        if self.next_is("("):
            e = self.either()
            self.need(")")
            return e
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Const(_CONSTANTS[value]) if value in _CONSTANTS else Name(value)
        raise TemplateError(f"not expected: {value!r}")


def parse(source: str) -> Block:
    """The syntax tree of a template."""
    top = Block()
    open_: list[tuple[str, Block]] = [("", top)]
    at, strip = 0, False
    for m in _MARK.finditer(source):
        space, kind, left, body, right, end = m.groups()
        if _PAIRS[kind] != end:
            raise TemplateError(f"{m[0]!r} is not closed")
        open_[-1][1].nodes.append(Const(source[at : m.start()] + ("" if left else space)))
        at = m.end()
        if kind == "#":
            continue
        here = open_[-1][1]
        if kind == "{":
            here.nodes.append(_Expression(body).whole())
            continue
        e = _Expression(body)
        word = e.name()
        if word == "for":
            node = For(e.name(), None, Block())
            e.need("in")
            node.over = e.whole()
            here.nodes.append(node)
            open_.append(("endfor", node.body))
        elif word == "if":
            node = If(e.whole(), Block(), Block())
            here.nodes.append(node)
            open_.append(("endif", node.then))
            open_[-1][1].owner = node
        elif word in ("elif", "else") and open_[-1][0] == "endif" and hasattr(here, "owner"):
            node = here.owner
            if word == "elif":
                inner = If(e.whole(), Block(), Block())
                node.other.nodes.append(inner)
                open_[-1] = ("endif", inner.then)
                inner.then.owner = inner
            else:
                open_[-1] = ("endif", node.other)
        elif word == "generation":
            node = Generation(Block())
            here.nodes.append(node)
            open_.append(("endgeneration", node.body))
        elif word == "set":
            name = e.name()
            e.need("=")
            here.nodes.append(Set(name, e.whole()))
        elif word == open_[-1][0] and len(open_) > 1:
            open_.pop()
        else:
            raise TemplateError(f"{word!r} does not belong here")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]!r} is missing")
    top.nodes.append(Const(source[at:]))
    return top


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _less(a: object, b: object) -> bool:
    return a < b if type(a) is type(b) and isinstance(a, (str, int)) else False


def _operators(controls: Controls) -> dict[str, Callable]:
    return {
        "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
        "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
        "<": _less, ">": lambda a, b: _less(b, a), "<=": lambda a, b: a == b or _less(a, b), ">=": lambda a, b: a == b or _less(b, a),
        "in": lambda a, b: a in b if isinstance(b, (list, tuple, dict)) else _text(a) in _text(b),
        "not": lambda a: not a,
        "|upper": lambda a: _text(a).upper(), "|lower": lambda a: _text(a).lower(), "|trim": lambda a: _text(a).strip(),
        "|length": lambda a: len(a) if isinstance(a, (str, list, tuple, dict)) else 0, "|escape": lambda a: controls.escape(_text(a)),
    }


def fold(node: object, ops: dict[str, Callable]) -> object:
    """The tree with all that is constant worked out."""
    match node:
        case Apply(op=("and" | "or") as op, args=[a, b]):
            a, b = fold(a, ops), fold(b, ops)
            if isinstance(a, Const):
                return b if bool(a.value) == (op == "and") else a
            return Apply(op, [a, b])
        case Apply(op=op, args=args):
            args = [fold(a, ops) for a in args]
            if op not in ops:
                raise TemplateError(f"no filter named {op[1:]!r}")
            return Const(ops[op](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Apply(op, args)
        case Get(of=of, key=key):
            return Get(fold(of, ops), fold(key, ops))
        case Block(nodes=nodes):
            out: list = []
            for n in nodes:
                n = fold(n, ops)
                for x in n.nodes if isinstance(n, Block) else [n]:
                    if isinstance(x, Const):
                        if out and isinstance(out[-1], Const):
                            out[-1] = Const(_text(out[-1].value) + _text(x.value))
                            continue
                        if not _text(x.value):
                            continue
                    out.append(x)
            return Block(out)
        case If(test=test, then=then, other=other):
            test = fold(test, ops)
            if isinstance(test, Const):
                return fold(then if test.value else other, ops)
            return If(test, fold(then, ops), fold(other, ops))
        case For(name=name, over=over, body=body):
            return For(name, fold(over, ops), fold(body, ops))
        case Generation(body=body):
            return Generation(fold(body, ops))
        case Set(name=name, value=value):
            return Set(name, fold(value, ops))
    return node


class _Out:
    """What is rendered so far, and where the generation spans lie."""

    def __init__(self) -> None:
        self.parts, self.n, self.spans = [], 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.n += len(s)


def _value(node: object, ops: dict[str, Callable]) -> Callable[[dict], object]:
    match node:
        case Const(value=v):
            return lambda env: v
        case Name(name=name):
            return lambda env: env.get(name)
        case Get(of=of, key=key):
            f, k = _value(of, ops), _value(key, ops)

            def get(env: dict) -> object:
                x, i = f(env), k(env)
                if isinstance(x, dict):
                    return x.get(i)
                return x[i] if isinstance(x, (list, str)) and isinstance(i, int) and -len(x) <= i < len(x) else None

            return get
        case Apply(op="and", args=[a, b]):
            f, g = _value(a, ops), _value(b, ops)
            return lambda env: f(env) and g(env)
        case Apply(op="or", args=[a, b]):
            f, g = _value(a, ops), _value(b, ops)
            return lambda env: f(env) or g(env)
        case Apply(op=op, args=[a]):
            f, u = _value(a, ops), ops[op]
            return lambda env: u(f(env))
        case Apply(op=op, args=[a, b]):
            f, g, u = _value(a, ops), _value(b, ops), ops[op]
            return lambda env: u(f(env), g(env))
    raise TemplateError(f"no value: {node!r}")


def _action(node: object, ops: dict[str, Callable]) -> Callable[[dict, _Out], None]:
    match node:
        case Const(value=v):
            s = _text(v)
            return lambda env, out: out.put(s)
        case Block(nodes=nodes):
            actions = [_action(n, ops) for n in nodes]

            def block(env: dict, out: _Out) -> None:
                for a in actions:
                    a(env, out)

            return block
        case If(test=test, then=then, other=other):
            t, a, b = _value(test, ops), _action(then, ops), _action(other, ops)
            return lambda env, out: a(env, out) if t(env) else b(env, out)
        case For(name=name, over=over, body=body):
            items, a = _value(over, ops), _action(body, ops)

            def loop(env: dict, out: _Out) -> None:
                xs = items(env)
                xs = xs if isinstance(xs, list) else []
                for i, x in enumerate(xs):
                    a({**env, name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i + 1 == len(xs), "length": len(xs)}}, out)

            return loop
        case Generation(body=body):
            a = _action(body, ops)

            def marked(env: dict, out: _Out) -> None:
                start = out.n
                a(env, out)
                out.spans.append((start, out.n))

            return marked
        case Set(name=name, value=value):
            f = _value(value, ops)

            def put(env: dict, out: _Out) -> None:
                env[name] = f(env)

            return put
        case _:
            f = _value(node, ops)
            return lambda env, out: out.put(_text(f(env)))


class Template:
    """A compiled template."""

    def __init__(self, source: str, controls: tuple[str, ...] = ()):
        self.controls = Controls(controls)
        ops = _operators(self.controls)
        self.tree = fold(parse(source), ops)
        self._run = _action(self.tree, ops)

    def render(self, values: dict, generation_prompt: bool = False) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it (code points) that generation marks cover."""
        out = _Out()
        self._run({**values, "add_generation_prompt": generation_prompt}, out)
        return "".join(out.parts), out.spans


#: Turns between control strings; the assistant's texts are what the model learns.
TURNS = """\
{%- for m in messages -%}
[INST]{{ m.role | escape }}[/INST]
{%- if m.role == "assistant" -%}{%- generation -%}{{ m.text | escape }}{%- endgeneration -%}{%- else -%}{{ m.text | escape }}{%- endif -%}
</s>
{%- endfor -%}
{%- if add_generation_prompt -%}[INST]assistant[/INST]{%- endif -%}"""
TURN_CONTROLS = ("[INST]", "[/INST]", "</s>")
_READ = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of what ``TURNS`` has formatted."""
    plain = Controls(TURN_CONTROLS).unescape
    return [(plain(role), plain(text)) for role, text in _READ.findall(formatted)]


def format_conversations(turns: DataFrame, source: str = TURNS, controls: tuple[str, ...] = TURN_CONTROLS) -> DataFrame:
    """Formats each conversation: ``conv_id, formatted, spans array<struct<start, stop>>``.

    turns: has ``conv_id, turn, role, text``; other columns are not read.  Turns go by turn,
    then role and text, nulls first; repeated rows are turns of their own.  Null texts and
    roles count as empty; rows without conv_id are one conversation with a null conv_id; an
    empty table gives no conversations.  Rows come sorted to the task and leave it
    conversation by conversation, so a task holds one conversation, not a partition.
    """
    done = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)
        now, messages, out, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            text, spans = template.render({"messages": messages})
            out.append({"conv_id": now, "formatted": text, "spans": [{"start": a, "stop": b} for a, b in spans]})
            size += len(text)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if messages and conv != now:
                    close()
                    messages = []
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, done)
                        out, size = [], 0
                now = conv
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, done)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(render, "conv_id long, formatted string, spans array<struct<start: long, stop: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What can be read from the formatted texts and their spans alone: a row a conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Controls(TURN_CONTROLS).unescape
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = read_turns(text)
                loss = "".join(plain(text[s["start"] : s["stop"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
