"""Chat formatting with a template compiler.

Templates are parsed into a syntax tree, constants are folded, and each node becomes
a Python closure; rendering runs closures only. The language is sandboxed: names are
those given to it, attributes are keys of mappings, and only the filters below can
be called. It has ``{{ value }}``, ``{# note #}``, ``{% for x in xs %}``, ``{% if %}``
with ``elif`` and ``else``, ``{% set x = value %}`` and ``{% generation %}``, which
marks what a model should learn to write. A minus sign inside a tag's border, as in ``{%- if x -%}``, drops the white
space of the template on that side. What cannot be computed, as a remainder by zero, is an error where it is rendered.

``escape`` makes text safe for a template's control strings: a backslash before
every backslash and one inside every control string, so that none is left in the
text; ``unescape`` takes the text back exactly. ``escape_name`` also guards the end
of a name.

A conversation is rendered while its turns come in, sorted by turn, role and text,
so that one of any length needs no more memory than its longest turn. Null roles and
texts are empty, null turns come first, repeated rows are turns of their own, and rows with a null
conversation key are one conversation.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTROLS = ("### ", "</turn>")
NAME_END = ": "
CHAT = (
    "{% for m in messages %}### {{ m.role | escape_name }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
BATCH = 1 << 20  # letters of rendered pieces that leave a task together


class TemplateError(ValueError):
    pass


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    text = text.replace("\\", "\\\\")
    for control in controls:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "escape_name": lambda x: escape(_text(x), (*CONTROLS, NAME_END)),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x),
}


def _text(value) -> str:
    return "" if value is None else str(value)


def _sum(a, b):
    return a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _text(a) + _text(b)


BINARY: dict[str, tuple[int, Callable]] = {
    "==": (3, operator.eq), "!=": (3, operator.ne), "<": (3, operator.lt), ">": (3, operator.gt), "<=": (3, operator.le),
    ">=": (3, operator.ge), "in": (3, lambda a, b: a in b), "+": (4, _sum), "-": (4, operator.sub), "~": (4, lambda a, b: _text(a) + _text(b)),
    "%": (5, lambda a, b: int(a) % int(b)),
}

WORD = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~%<>.|()\[\]=]))")
TAG = re.compile(r"\{\{(?P<a>-?)(?P<show>.*?)(?P<x>-?)\}\}|\{%(?P<b>-?)(?P<tag>.*?)(?P<y>-?)%\}|\{#(?P<c>-?).*?(?P<z>-?)#\}", re.DOTALL)
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Parser of one expression: trees are ("const", v), ("name", n), ("get", tree, tree), ("call", f, tree, ...), ("and" | "or", a, b)."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = WORD.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "text" else None

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.words) or expected not in (None, self.words[self.at][1]):
            raise TemplateError(f"{expected or 'a value'} is missing")
        self.at += 1
        return self.words[self.at - 1]

    def whole(self):
        tree = self.parse()
        if self.at < len(self.words):
            raise TemplateError(f"{self.words[self.at][1]!r} is left over")
        return tree

    def parse(self, least: int = 0):
        if self.peek() == "not" and least <= 2:
            self.take()
            left = ("call", operator.not_, self.parse(2))
        else:
            left = self.value()
        while (sign := self.peek()) is not None:
            if sign in ("or", "and"):
                level = 0 if sign == "or" else 1
                if level < least:
                    break
                self.take()
                left = (sign, left, self.parse(level + 1))
            elif sign in BINARY and BINARY[sign][0] >= least:
                self.take()
                left = ("call", BINARY[sign][1], left, self.parse(BINARY[sign][0] + 1))
            else:
                break
        return left

    def value(self):
        kind, word = self.take()
        if kind == "text":
            tree = ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        elif kind == "number":
            tree = ("const", int(word))
        elif kind == "name":
            tree = ("const", CONSTANTS[word]) if word in CONSTANTS else ("name", word)
        elif word == "(":
            tree = self.parse()
            self.take(")")
        elif word == "-":
            return ("call", operator.neg, self.value())
        else:
            raise TemplateError(f"{word!r} is no value")
        while self.peek() in (".", "[", "|"):
            _, sign = self.take()
            if sign == ".":
                tree = ("get", tree, ("const", self.take()[1]))
            elif sign == "[":
                tree = ("get", tree, self.parse())
                self.take("]")
            else:
                name = self.take()[1]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                tree = ("call", FILTERS[name], tree)
        return tree


def _get(thing, key):
    """Key of a mapping or place in a list; never an attribute of an object."""
    if isinstance(thing, dict):
        return thing.get(key)
    if isinstance(thing, list) and isinstance(key, int):
        return thing[key]
    return None


def fold(tree):
    """An expression with everything that depends on no name computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "call":
        parts = [fold(x) for x in tree[2:]]
        if all(x[0] == "const" for x in parts):
            try:
                return ("const", tree[1](*[x[1] for x in parts]))
            except (ArithmeticError, TypeError, ValueError):
                pass  # an error only where it is rendered
        return ("call", tree[1], *parts)
    left, right = fold(tree[1]), fold(tree[2])
    if kind == "get":
        return ("const", _get(left[1], right[1])) if left[0] == right[0] == "const" else (kind, left, right)
    if left[0] == "const":
        return right if bool(left[1]) == (kind == "and") else left
    return (kind, left, right)


def _closure(tree) -> Callable[[dict], object]:
    """A function of the names' values."""
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda names: constant
    if kind == "name":
        name = tree[1]
        return lambda names: names.get(name)
    if kind == "call":
        call, parts = tree[1], [_closure(x) for x in tree[2:]]
        if len(parts) == 1:
            one = parts[0]
            return lambda names: call(one(names))
        first, second = parts
        return lambda names: call(first(names), second(names))
    left, right = _closure(tree[1]), _closure(tree[2])
    if kind == "get":
        return lambda names: _get(left(names), right(names))
    if kind == "and":
        return lambda names: left(names) and right(names)
    return lambda names: left(names) or right(names)


def parse(source: str) -> list:
    """Syntax tree: ("text", s), ("show", e), ("set", n, e), ("if", [(e, body)...]), ("for", n, e, body), ("generation", body)."""
    top: list = []
    stack: list[tuple[str, object]] = []
    body, at = top, 0
    trim = False  # the tag before asks for no white space behind it

    def put_text(text: str, before: bool) -> None:
        text = text.lstrip() if trim else text
        text = text.rstrip() if before else text
        if text:
            body.append(("text", text))

    for m in TAG.finditer(source):
        put_text(source[at : m.start()], bool(m["a"] or m["b"] or m["c"]))
        at, trim = m.end(), bool(m["x"] or m["y"] or m["z"])
        if m["show"] is not None:
            body.append(("show", _Expression(m["show"]).whole()))
        elif m["tag"] is not None:
            word, _, rest = m["tag"].strip().partition(" ")
            if word == "for":
                name, found, things = rest.strip().partition(" in ")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read {m[0]!r}")
                node = ("for", name.strip(), _Expression(things).whole(), [])
                body.append(node)
                stack.append((word, body))
                body = node[3]
            elif word == "if":
                node = ("if", [(_Expression(rest).whole(), [])])
                body.append(node)
                stack.append((word, (body, node)))
                body = node[1][-1][1]
            elif word in ("elif", "else"):
                if not stack or stack[-1][0] != "if":
                    raise TemplateError(f"{word} without if")
                node = stack[-1][1][1]
                node[1].append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
                body = node[1][-1][1]
            elif word == "generation":
                node = ("generation", [])
                body.append(node)
                stack.append((word, body))
                body = node[1]
            elif word == "set":
                name, found, value = rest.partition("=")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read {m[0]!r}")
                body.append(("set", name.strip(), _Expression(value).whole()))
            elif word.startswith("end") and stack and word == f"end{stack[-1][0]}":
                kind, outer = stack.pop()
                body = outer[0] if kind == "if" else outer
            else:
                raise TemplateError(f"cannot read {m[0]!r}")
    if stack:
        raise TemplateError(f"{stack[-1][0]} has no end")
    put_text(source[at:], False)
    return top


def folded(body: list) -> list:
    """The tree with constants computed, branches that never run gone, and neighbouring texts joined."""
    out: list = []

    def put(node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "show":
            value = fold(node[1])
            put(("text", _text(value[1])) if value[0] == "const" else ("show", value))
        elif kind == "if":
            branches = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, folded(inner)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    put(inner)
            elif branches:
                put(("if", branches))
        elif kind == "for":
            put(("for", node[1], fold(node[2]), folded(node[3])))
        elif kind == "generation":
            put(("generation", folded(node[1])))
        elif kind == "set":
            put(("set", node[1], fold(node[2])))
        else:
            put(node)
    return out


Pieces = Iterator[tuple[str, bool]]


def _program(body: list) -> Callable[[dict], Pieces]:
    """A generator function of the names' values that gives pieces of text and whether they are generation."""
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict) -> Pieces:
        for step in steps:
            yield from step(names)

    return run


def _step(node) -> Callable[[dict], Pieces]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], False)
        return lambda names: iter((piece,))
    if kind == "show":
        value = _closure(node[1])
        return lambda names: iter(((_text(value(names)), False),))
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def assign(names: dict) -> Pieces:
            names[name] = value(names)
            return iter(())

        return assign
    if kind == "generation":
        inner = _program(node[1])
        return lambda names: ((text, True) for text, _ in inner(names))
    if kind == "if":
        branches = [(_closure(test), _program(inner)) for test, inner in node[1]]

        def choose(names: dict) -> Pieces:
            for test, inner in branches:
                if test(names):
                    return inner(names)
            return iter(())

        return choose
    name, things, inner = node[1], _closure(node[2]), _program(node[3])

    def each(names: dict) -> Pieces:
        coming = iter(things(names) or ())
        end = object()
        thing, number = next(coming, end), 0
        while thing is not end:
            following = next(coming, end)
            own = names | {name: thing, "loop": {"index": number + 1, "index0": number, "first": not number, "last": following is end}}
            yield from inner(own)
            thing, number = following, number + 1

    return each


def compile_template(source: str) -> Callable[..., Pieces]:
    """7. The renderer of a template: called with the names' values, it gives pieces of text and whether each is generation."""
    program = _program(folded(parse(source)))
    return lambda **names: program(dict(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def render(
    conversations: DataFrame, template: str = CHAT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """7. Rendered text of each conversation as pieces in order: ``conversation``, ``piece``, ``text`` and ``loss``, the mask.

    A conversation's pieces are in one partition and sorted.
    """
    columns = [F.col(key).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")]
    rows = conversations.select(*columns).repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")
    kind = rows.schema["conversation"].dataType.simpleString()
    compile_template(template)  # errors show before anything runs

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer = compile_template(template)
        out: list[tuple] = []
        letters = 0

        def batch_of() -> pa.RecordBatch:
            keys, numbers, texts, loss = zip(*out)
            arrays = [pa.array(keys, key_type), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(loss, pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=["conversation", "piece", "text", "loss"])

        key_type = None
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field(0).type

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for conversation, turns in groupby(_rows(all_batches()), key=lambda row: row[0]):
            messages = ({"role": r, "text": t} for _, _, r, t in turns)
            for number, (piece, loss) in enumerate(renderer(messages=messages)):
                out.append((conversation, number, piece, loss))
                letters += len(piece) + 16
                if letters >= BATCH:
                    yield batch_of()
                    out, letters = [], 0
        if out:
            yield batch_of()

    return rows.mapInArrow(rendered, f"conversation {kind}, piece long, text string, loss boolean")


def turns_of(pieces: Iterator[str], opening: str = CONTROLS[0], closing: str = f"{CONTROLS[1]}\n") -> Iterator[tuple[str, str]]:
    """Roles and texts of a conversation, read back from the pieces of its rendered text."""
    held, looked = "", 0
    for piece in pieces:
        held += piece
        while (end := held.find(closing, looked)) >= 0:
            if not held.startswith(opening):
                raise ValueError("a turn does not begin as it should")
            role, found, text = held[len(opening) : end].partition(NAME_END)
            if not found:
                raise ValueError("a turn has no name")
            yield unescape(role), unescape(text)
            held, looked = held[end + len(closing) :], 0
        looked = max(0, len(held) - len(closing))
    if held:
        raise ValueError("a turn has no end")


def read_back(pieces: DataFrame) -> DataFrame:
    """7. Digests of conversations rendered with ``CHAT``, from nothing but pieces and mask.

    ``turns_sha256`` is over role, newline, text, newline of each turn, ``loss_sha256`` over the text under the mask.
    """
    kind = pieces.schema["conversation"].dataType.simpleString()
    names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field(0).type

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for conversation, rows in groupby(_rows(all_batches()), key=lambda row: row[0]):
            loss, loss_chars, chars = hashlib.sha256(), 0, 0
            masked: list[str] = []

            def learned() -> None:
                nonlocal loss_chars
                if masked:
                    plain = unescape("".join(masked))
                    loss.update(plain.encode())
                    loss_chars += len(plain)
                    masked.clear()

            def texts() -> Iterator[str]:
                nonlocal chars
                for _, _, text, under_mask in rows:
                    chars += len(text)
                    if under_mask:
                        masked.append(text)
                    else:
                        learned()
                    yield text
                learned()

            turns, n = hashlib.sha256(), 0
            for role, text in turns_of(texts()):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            values = [conversation, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    schema = f"conversation {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return pieces.mapInArrow(read, schema)
