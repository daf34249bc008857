"""A small sandboxed template language, compiled to closures.

    {{ expression }}                      the value, as text
    {% for x in list %}...{% endfor %}    with loop.first, loop.last, loop.index0
    {% if a %}...{% elif b %}...{% else %}...{% endif %}
    {% set name = expression %}
    {% generation %}...{% endgeneration %}  marks what the model is to learn

Expressions: names, string and integer literals, ``x.key``, ``x['key']``, ``+``, ``==``, ``!=``, ``and``, ``or``,
``not``, parentheses and ``x | filter`` for the filters given to compile. Nothing else can be reached: attributes look
up mapping keys only. Source is parsed to a syntax tree, constant parts of it are folded, and the tree becomes Python
closures. Output is a stream of (text, marked) and loops take their items one at a time, so a list may be an iterator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

#: What closes a tag counts outside string literals only.
_INSIDE = r"((?:'(?:[^'\\]|\\.)*'|[^'])*?)"
_TAG = re.compile(rf"\{{\{{{_INSIDE}\}}\}}|\{{%{_INSIDE}%\}}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|'((?:[^'\\]|\\.)*)'|(==|!=|[|.\[\]()+]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; trees are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, name, string, sign = m.groups()
            if number:
                self.tokens.append(("const", int(number)))
            elif name:
                self.tokens.append(("word", name))
            elif sign:
                self.tokens.append(("sign", sign))
            else:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), string, flags=re.S)))
            at = m.end()
        self.at = 0

    def next_is(self, kind: str, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.disjunction()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def disjunction(self) -> tuple:
        tree = self.conjunction()
        while self.next_is("word", "or"):
            tree = ("or", tree, self.conjunction())
        return tree

    def conjunction(self) -> tuple:
        tree = self.negation()
        while self.next_is("word", "and"):
            tree = ("and", tree, self.negation())
        return tree

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.next_is("word", "not") else self.comparison()

    def comparison(self) -> tuple:
        tree = self.sum()
        while sign := self.next_is("sign", "==", "!="):
            tree = (sign, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.postfix()
        while self.next_is("sign", "+"):
            tree = ("+", tree, self.postfix())
        return tree

    def take_word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def postfix(self) -> tuple:
        tree = self.atom()
        while sign := self.next_is("sign", ".", "[", "|"):
            if sign == ".":
                tree = ("get", tree, ("const", self.take_word()))
            elif sign == "|":
                tree = ("filter", self.take_word(), tree)
            else:
                tree = ("get", tree, self.disjunction())
                if not self.next_is("sign", "]"):
                    raise TemplateError("] is missing")
        return tree

    def atom(self) -> tuple:
        if self.next_is("sign", "("):
            tree = self.disjunction()
            if not self.next_is("sign", ")"):
                raise TemplateError(") is missing")
            return tree
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("const", "word"):
            kind, value = self.tokens[self.at]
            self.at += 1
            return ("const", value) if kind == "const" else ("name", value)
        raise TemplateError("an expression is missing")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of statements."""
    body: list[tuple] = []
    stack: list[tuple[str, list, object]] = [("", body, None)]
    at = 0
    for m in [*_TAG.finditer(source), None]:
        if text := source[at : m.start() if m else None]:
            if "{{" in text or "{%" in text:
                raise TemplateError(f"a tag is not closed: {text!r}")
            stack[-1][1].append(("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        top = stack[-1]
        if word == "for":
            name, _, what = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError("for needs a name")
            node = ("for", name.strip(), _Expression(what).whole(), [])
            top[1].append(node)
            stack.append(("for", node[3], None))
        elif word == "if":
            arms = [(_Expression(rest).whole(), [])]
            top[1].append(("if", arms))
            stack.append(("if", arms[0][1], arms))
        elif word in ("elif", "else") and top[0] == "if":
            top[2].append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            stack[-1] = ("if" if word == "elif" else "if else", top[2][-1][1], top[2])
        elif word == "set":
            name, _, what = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError("set needs a name")
            top[1].append(("set", name.strip(), _Expression(what).whole()))
        elif word == "generation":
            node = ("generation", [])
            top[1].append(node)
            stack.append(("generation", node[1], None))
        elif word in ("endfor", "endif", "endgeneration") and top[0].split()[:1] == [word[3:]]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return body


def _operate(kind: str, values: list, filters: Mapping[str, Callable]) -> object:
    if kind == "get":
        holder, key = values
        return holder.get(key) if isinstance(holder, Mapping) else None
    if kind == "+":
        a, b = ("" if v is None else v for v in values)
        return a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}"
    return values[0] == values[1] if kind == "==" else values[0] != values[1]


def fold(node: tuple, filters: Mapping[str, Callable]) -> tuple:
    """An expression with its constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"no filter {node[1]!r}")
        inner = fold(node[2], filters)
        return ("const", filters[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    parts = [fold(x, filters) for x in node[1:]]
    if kind == "not":
        return ("const", not parts[0][1]) if parts[0][0] == "const" else ("not", parts[0])
    if kind in ("and", "or"):
        if parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        return (kind, *parts)
    if all(p[0] == "const" for p in parts):
        return ("const", _operate(kind, [p[1] for p in parts], filters))
    return (kind, *parts)


def fold_body(body: list[tuple], filters: Mapping[str, Callable]) -> list[tuple]:
    """Statements with constant output turned to text, decided branches resolved and neighbouring texts joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            e = fold(node[1], filters)
            put(("text", "" if e[1] is None else str(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner, filters)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    put(inner)
            elif arms:
                put(("if", arms))
        elif node[0] == "for":
            put(("for", node[1], fold(node[2], filters), fold_body(node[3], filters)))
        elif node[0] == "generation":
            put(("generation", fold_body(node[1], filters)))
        elif node[0] == "set":
            put(("set", node[1], fold(node[2], filters)))
        else:
            put(node)
    return out


def _expression(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "filter":
        return lambda env, f=filters[node[1]], x=_expression(node[2], filters): f(x(env))
    parts = [_expression(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda env, x=parts[0]: not x(env)
    if kind == "and":
        return lambda env, x=parts[0], y=parts[1]: x(env) and y(env)
    if kind == "or":
        return lambda env, x=parts[0], y=parts[1]: x(env) or y(env)
    return lambda env: _operate(kind, [p(env) for p in parts], filters)


def _statements(body: list[tuple], filters: Mapping[str, Callable], marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps = [_statement(node, filters, marked) for node in body]

    def run(env: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env)

    return run


def _statement(node: tuple, filters: Mapping[str, Callable], marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        return lambda env, piece=((node[1], marked),): iter(piece)
    if kind == "out":
        value = _expression(node[1], filters)

        def show(env):
            v = value(env)
            yield ("" if v is None else str(v)), marked

        return show
    if kind == "set":
        value = _expression(node[2], filters)

        def assign(env):
            env[node[1]] = value(env)
            return iter(())

        return assign
    if kind == "generation":
        return _statements(node[1], filters, True)
    if kind == "if":
        arms = [(_expression(test, filters), _statements(inner, filters, marked)) for test, inner in node[1]]

        def choose(env):
            return next((run(env) for test, run in arms if test(env)), iter(()))

        return choose
    items, run = _expression(node[2], filters), _statements(node[3], filters, marked)

    def loop(env):
        rest = iter(items(env) or ())
        none = object()
        now, i = next(rest, none), 0
        while now is not none:
            after = next(rest, none)
            yield from run({**env, node[1]: now, "loop": {"first": i == 0, "last": after is none, "index0": i}})
            now, i = after, i + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A renderer: given names and their values, it yields (text, marked) pieces of the output in order."""
    filters = filters or {}
    return _statements(fold_body(parse(source), filters), filters, False)
