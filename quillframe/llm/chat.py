"""Chat formatting: a compiler for a sandboxed template language.

Source text is cut into tokens, parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield
pieces of output with a flag: whether the piece lies between generation markers. The language has no attribute access to Python
objects, no calls but its own filters, no imports and no unbounded loops.

    {{ expression }}   {% for x in list %} ... {% endfor %}   {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set x = expression %}   {% generation %} ... {% endgeneration %}   {# comment #}
    expressions: 'text', 12, true, false, none, name, a.key, a['key'], == != < <= > >= in, and or not, + - * ~, x | filter, x is defined
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import small_batches


class TemplateError(ValueError):
    """A template that doesn't compile, or that reads what isn't there."""


# --- tokens --------------------------------------------------------------------------------------------------------------------

_PIECE = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~<>|.\[\]()=,]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        kind = m.lastgroup
        value: object = m[kind]
        if kind == "text":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[kind][1:-1], flags=re.S)
        elif kind == "number":
            value = int(m[kind])
        out.append((kind, value))
        at = m.end()
    return out


# --- syntax tree: tuples (kind, ...) ------------------------------------------------------------------------------------------


class _Expression:
    """Recursive descent over the tokens of one expression."""

    LEVELS = (("or",), ("and",))

    def __init__(self, source: str):
        self.items, self.at = tokens(source), 0

    def peek(self, *values) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values

    def take(self, *values):
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.items[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self):
        tree = self.either()
        if self.at != len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.peek("or"):
            self.at += 1
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.peek("and"):
            self.at += 1
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        if self.peek("not"):
            self.at += 1
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        tree = self.sum()
        if self.peek("is"):
            self.at += 1
            invert = self.peek("not") and bool(self.take("not"))
            self.take("defined")
            return ("not", ("defined", tree)) if invert else ("defined", tree)
        if self.peek("not") and self.items[self.at + 1 : self.at + 2] == [("name", "in")]:
            self.at += 2
            return ("not", ("binary", "in", tree, self.sum()))
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            op = self.items[self.at][1]
            self.at += 1
            tree = ("binary", op, tree, self.sum())
        return tree

    def sum(self):
        tree = self.product()
        while self.peek("+", "-", "~"):
            op = self.items[self.at][1]
            self.at += 1
            tree = ("binary", op, tree, self.product())
        return tree

    def product(self):
        tree = self.filtered()
        while self.peek("*"):
            self.at += 1
            tree = ("binary", "*", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.primary()
        while self.peek("|", ".", "["):
            op = self.take("|", ".", "[")
            if op == "|":
                tree = ("filter", self.name(), tree)
            elif op == ".":
                tree = ("item", tree, ("constant", self.name()))
            else:
                tree = ("item", tree, self.either())
                self.take("]")
        return tree

    def primary(self):
        if self.peek("("):
            self.at += 1
            tree = self.either()
            self.take(")")
            return tree
        if self.at >= len(self.items):
            raise TemplateError("expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind in ("text", "number"):
            return ("constant", value)
        if kind == "name":
            return ("constant", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """Statements of a template."""
    parts = _PIECE.split(source)
    for k in range(1, len(parts), 2):
        if parts[k][2:3] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3:-2] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    at = 0

    def body(*ends: str) -> tuple[list[tuple], str, str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            piece, at = parts[at], at + 1
            if at % 2:
                if piece:
                    out.append(("text", piece))
                continue
            if piece.startswith("{#"):
                continue
            inner = piece[2:-2].strip("-").strip()
            if piece.startswith("{{"):
                out.append(("put", _Expression(inner).whole()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return out, word, rest
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError("for wants: for name in list")
                inside, _, _ = body("endfor")
                out.append(("for", m[1], _Expression(m[2]).whole(), inside))
            elif word == "if":
                cases, test = [], _Expression(rest).whole()
                while True:
                    inside, end, rest = body("elif", "else", "endif")
                    cases.append((test, inside))
                    if end == "endif":
                        break
                    test = _Expression(rest).whole() if end == "elif" else ("constant", True)
                out.append(("if", cases))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError("set wants: set name = expression")
                out.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                inside, _, _ = body("endgeneration")
                out.append(("generation", inside))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return out, "", ""

    return body()[0]


# --- constants -----------------------------------------------------------------------------------------------------------------

_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "~": lambda a, b: shown(a) + shown(b),
}


def shown(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {"trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": len, "string": shown}


def fold(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with every operation on constants replaced by its result."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    if kind == "binary":
        a, b = fold(tree[2], filters), fold(tree[3], filters)
        if a[0] == b[0] == "constant":
            try:
                return ("constant", _BINARY[tree[1]](a[1], b[1]))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return ("binary", tree[1], a, b)
    if kind in ("and", "or"):
        a, b = fold(tree[1], filters), fold(tree[2], filters)
        if a[0] == "constant":
            return (b if a[1] else a) if kind == "and" else (a if a[1] else b)
        return (kind, a, b)
    if kind == "not":
        a = fold(tree[1], filters)
        return ("constant", not a[1]) if a[0] == "constant" else ("not", a)
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"no filter {tree[1]}")
        a = fold(tree[2], filters)
        return ("constant", filters[tree[1]](a[1])) if a[0] == "constant" else ("filter", tree[1], a)
    if kind == "item":
        return ("item", fold(tree[1], filters), fold(tree[2], filters))
    return (kind, fold(tree[1], filters))


def folded(statements: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """Statements with folded expressions; decided branches are taken and neighbouring texts joined."""
    out: list[tuple] = []
    for s in statements:
        if s[0] == "put":
            tree = fold(s[1], filters)
            new = [("text", shown(tree[1]))] if tree[0] == "constant" else [("put", tree)]
        elif s[0] == "for":
            new = [("for", s[1], fold(s[2], filters), folded(s[3], filters))]
        elif s[0] == "set":
            new = [("set", s[1], fold(s[2], filters))]
        elif s[0] == "generation":
            new = [("generation", folded(s[1], filters))]
        elif s[0] == "if":
            cases = []
            for test, inside in s[1]:
                test = fold(test, filters)
                if test[0] != "constant" or test[1]:
                    cases.append((test, folded(inside, filters)))
                if test[0] == "constant" and test[1]:
                    break
            new = cases[0][1] if cases and cases[0][0][0] == "constant" else [("if", cases)] if cases else []
        else:
            new = [s]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# --- closures ------------------------------------------------------------------------------------------------------------------


def _value(tree: tuple, filters) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "constant":
        return lambda scope, c=tree[1]: c
    if kind == "name":

        def name(scope, n=tree[1]):
            if n not in scope:
                raise TemplateError(f"{n} isn't defined")
            return scope[n]

        return name
    if kind == "item":
        of, key = _value(tree[1], filters), _value(tree[2], filters)

        def item(scope):
            owner, k = of(scope), key(scope)
            if isinstance(owner, dict):
                return owner.get(k)
            if isinstance(owner, (list, tuple, str)) and isinstance(k, int) and -len(owner) <= k < len(owner):
                return owner[k]
            raise TemplateError(f"no {k!r} here")

        return item
    if kind == "defined":
        inner = tree[1]
        if inner[0] == "name":
            return lambda scope: inner[1] in scope
        got = _value(inner, filters)
        return lambda scope: got(scope) is not None
    if kind == "filter":
        f, of = filters[tree[1]], _value(tree[2], filters)
        return lambda scope: f(of(scope))
    if kind == "not":
        of = _value(tree[1], filters)
        return lambda scope: not of(scope)
    a, b = _value(tree[-2], filters), _value(tree[-1], filters)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    f = _BINARY[tree[1]]
    return lambda scope: f(a(scope), b(scope))


def _block(statements: list[tuple], filters) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_step(s, filters) for s in statements]

    def run(scope, inside):
        for step in steps:
            yield from step(scope, inside)

    return run


def _step(s: tuple, filters):
    if s[0] == "text":
        piece = s[1]
        return lambda scope, inside: ((piece, inside),)
    if s[0] == "put":
        of = _value(s[1], filters)
        return lambda scope, inside: ((shown(of(scope)), inside),)
    if s[0] == "set":
        name, of = s[1], _value(s[2], filters)

        def put(scope, inside):
            scope[name] = of(scope)
            return ()

        return put
    if s[0] == "generation":
        body = _block(s[1], filters)
        return lambda scope, inside: body(scope, True)
    if s[0] == "if":
        cases = [(_value(test, filters), _block(body, filters)) for test, body in s[1]]

        def choose(scope, inside):
            for test, body in cases:
                if test(scope):
                    return body(scope, inside)
            return ()

        return choose
    name, of, body = s[1], _value(s[2], filters), _block(s[3], filters)

    def loop(scope, inside):
        inner = dict(scope)
        for k, x in enumerate(of(scope)):
            inner[name] = x
            inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0}
            yield from body(inner, inside)

    return loop


class Template:
    """A compiled template. pieces(**names) yields (text, in generation); a list that is given may be an iterator, read once."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = folded(parse(source), self.filters)
        self._run = _block(self.tree, self.filters)

    def pieces(self, **names) -> Iterator[tuple[str, bool]]:
        return self._run(dict(names), False)

    def render(self, **names) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans under the loss mask."""
        out, spans, at = [], [], 0
        for piece, inside in self.pieces(**names):
            if inside and piece:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(piece))
                else:
                    spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)
        return "".join(out), spans


# --- control strings -----------------------------------------------------------------------------------------------------------

#: The control strings of the default template. None holds the first character of one but at its start, nor a backslash.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text) -> str:
    """Doubles backslashes and puts one behind the first character of each control string, so that none is left in the text."""
    text = shown(text).replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


TURNS = (
    "{% for m in messages %}<s>[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>{% endfor %}"
)


class Reader:
    """Reads a formatted conversation back, piece by piece: turns, and text under the loss mask. Only one turn is held."""

    def __init__(self):
        self.held: list[str] = []
        self.turns, self.chars, self.loss = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, inside: bool) -> None:
        self.chars += len(piece)
        if inside:
            plain = unescape(piece)
            self.loss += len(plain)
            self.loss_hash.update(plain.encode("utf-8", "surrogatepass"))
        self.held.append(piece)
        if "</s>" in piece:
            *turns, rest = "".join(self.held).split("</s>")
            for turn in turns:
                head, _, text = turn.partition("[/INST]")
                if not head.startswith("<s>[INST]"):
                    raise TemplateError(f"turn begins with {head[:20]!r}")
                self.turns += 1
                self.turn_hash.update(f"{unescape(head[9:])}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            self.held = [rest]


def _format(template_source: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = Template(template_source, {"escape": escape})
        rows = ((c, r, t) for b in batches for c, r, t in zip(b["conv_id"].array, b["role"].array, b["text"].array, strict=True))
        ahead = next(rows, None)
        done: list[tuple] = []
        while ahead is not None:
            key = ahead[0]

            def messages():
                nonlocal ahead
                while ahead is not None and (ahead[0] == key or pd.isna(ahead[0]) and pd.isna(key)):
                    role, text = ("" if x is None or x != x else x for x in ahead[1:])
                    ahead = next(rows, None)
                    yield {"role": role, "text": text}

            reader = Reader()
            for piece, inside in template.pieces(messages=messages()):
                reader.feed(piece, inside)
            if reader.held != [""] and "".join(reader.held):
                raise TemplateError("the last turn isn't closed")
            done.append((None if pd.isna(key) else int(key), reader.turns, reader.turn_hash.hexdigest(), reader.loss, reader.loss_hash.hexdigest(), reader.chars))
            if len(done) >= 5000:
                yield _frame(done)
                done = []
        yield _frame(done)

    return run


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def format_digests(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """Formats conversations (conv_id, turn, role, text) and reads them back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows stream through the template sorted by conversation, so that memory holds one turn, however long a conversation is.
    Turns go by turn, nulls first; ties by role, then text, nulls first; repeated rows are turns of their own. Null role and null
    text are empty; rows with a null conv_id are one conversation with a null conv_id. An empty table gives no rows.
    """
    small_batches(turns.sparkSession, rows=5000)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "turn", "role", "text").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInPandas(_format(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_texts(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """The formatted conversations themselves: conv_id, text, loss_spans (array of start and end). A conversation is one row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Template(template, {"escape": escape})
        for b in batches:
            made = [compiled.render(messages=[{"role": m["role"] or "", "text": m["text"] or ""} for m in ms]) for ms in b["messages"]]
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "text": [m[0] for m in made], "loss_spans": [[list(x) for x in m[1]] for m in made]})

    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return grouped.mapInPandas(run, "conv_id long, text string, loss_spans array<array<long>>")
