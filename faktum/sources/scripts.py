"""Inline scripts as relations: the scripts of pages, their tokens, comments and syntax nodes.

A row of nodes has its place in the tree as an interval (`node` to `last`, by
pre-order), so trees are joined and counted as tables; what is measured over
them is in `faktum.operators.script_metrics`.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faktum.functions.text import bound

#: Nesting beyond which a tree is not followed.
DEPTH = 1000
#: Raw text elements and comments are found from left to right, so neither begins inside the other.
_ELEMENTS = r"(?is)<!--(?:.*?)-->|<(script|style)\b[^>]*>.*?(?=</\1\b|\z)"


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, kind, body): the scripts, styles and comments of markup; a script ends at its end tag alone, whatever its strings hold."""
    whole = F.regexp_extract_all(F.col(html), F.lit(_ELEMENTS), F.lit(0))
    rows = pages.select(F.col(key), F.posexplode(whole).alias("ord", "x"))
    kind = F.when(F.col("x").startswith("<!--"), "comment").otherwise(F.lower(F.substring("x", 2, 6)))
    kind = F.when(kind == "script", "script").when(kind == "comment", "comment").otherwise("style")
    body = F.when(F.col("x").startswith("<!--"), F.regexp_replace("x", r"(?s)\A<!--|-->\z", "")).otherwise(F.regexp_replace("x", r"(?s)\A<[^>]*>", ""))
    return rows.select(key, "ord", kind.alias("kind"), body.alias("body"))


_SIGNS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **".split()
#: White space and one token; what signs begin alone comes before the longer ones.
_TOKEN = re.compile(
    r"\s*+(?:(?P<name>[A-Za-z_][\w$‌‍]*|[#@]?[^\W\d][\w$‌‍]*|\$[\w$]*)|(?P<one>[()\[\]{};,:~`])|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<number>0[xXoObB][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|<!--[^\n]*)|(?P<sign>" + "|".join(map(re.escape, _SIGNS)) + r"|\S))",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)
#: Kinds of tokens that end an operand; a name does unless it is a word before one, of signs only closing brackets.
_OPERANDS = frozenset(("string", "number", "regex"))


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, start), white space left out.  A stack of modes tells a template's text from the expressions in it; a slash begins a regular expression where an operand may stand."""
    out: list[tuple[str, str, int]] = []
    at, braces, operand = 0, [], False  # open braces of each template expression; whether an operand has just ended
    size = len(text)
    while at < size:
        if braces and braces[-1] < 0:  # inside a template's text
            end = _TEMPLATE.match(text, at).end()
            if end > at:
                out.append(("text", text[at:end], at))
            at = end
            if text.startswith("${", at):
                out.append(("open", "${", at))
                braces[-1], at, operand = 1, at + 2, False
            elif at < size:
                out.append(("close", text[at], at))
                braces.pop()
                at, operand = at + 1, True
            continue
        for found in _TOKEN.finditer(text, at):  # up to where another mode begins
            kind = found.lastgroup
            own, start, at = found[kind], found.start(kind), found.end()
            if kind == "one" or kind == "sign":
                kind = "sign"
                if own == "`":
                    out.append(("template", own, start))
                    braces.append(-1)
                    break
                if own[0] == "/" and not operand:
                    regex = _REGEX.match(text, start)
                    if regex:
                        out.append(("regex", regex.group(), start))
                        at, operand = regex.end(), True
                        break
                if braces:
                    braces[-1] += (own == "{") - (own == "}")
                    if braces[-1] == 0:  # the end of an expression in a template
                        out.append(("end", own, start))
                        braces[-1] = -1
                        break
                operand = own == ")" or own == "]"
            elif kind != "comment":
                operand = kind in _OPERANDS or own not in _BEFORE_OPERAND
            out.append((kind, own, start))
        else:  # nothing but white space is left
            break
    return out


class Node:
    __slots__ = ("kind", "op", "name", "children", "start", "end", "flag")

    def __init__(self, kind, start, children=(), op=None, name=None):
        self.kind, self.start, self.children, self.op, self.name, self.end, self.flag = kind, start, list(children), op, name, start, None


_LEVELS = (("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
_POWER = {sign: 4 + k for k, own in enumerate(_LEVELS) for sign in own}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("! ~ + - ++ -- typeof void delete await yield ...".split())
_COMMA, _SET, _CHOICE, _UNARY = 1, 2, 3, 17
#: What an expression may go on with.
_GO_ON = _ASSIGN | _POWER.keys() | frozenset(". ?. ( [ ++ -- ? ,".split())


class Parser:
    """Statements by their first word, expressions by operator precedence.  What fits nowhere is left out, so every text gives a tree."""

    def __init__(self, found: list[tuple[str, str, int]], size: int):
        self.t = [x for x in found if x[0] != "comment"] + [("end", "", size)]
        self.words = [own if kind == "sign" or kind == "name" else "" for kind, own, _ in self.t]
        self.ends = [at + len(own) for _, own, at in self.t]
        self.i, self.level, self.end = 0, 0, len(self.t) - 1

    def now(self) -> str:
        return self.words[self.i]

    def take(self) -> tuple[str, str, int]:
        out = self.t[self.i]
        if self.i < self.end:
            self.i += 1
        return out

    def eat(self, sign: str) -> bool:
        hit = self.words[self.i] == sign
        self.i += hit
        return hit

    def done(self) -> bool:
        return self.i == self.end

    def closed(self, node: Node) -> Node:
        end = self.ends[self.i - 1 if self.i else 0]
        node.end = end if end > node.start else node.start
        return node

    def many(self, until: str, item) -> list[Node]:
        """Items up to a closing sign; each takes a token at least."""
        out = []
        while self.i != self.end and self.words[self.i] != until and self.t[self.i][0] != "end":
            before = self.i
            node = item()
            if node is not None:
                out.append(node)
            if self.i == before:
                self.take()
        self.eat(until)
        return out

    def statement(self) -> Node | None:
        word, start = self.now(), self.t[self.i][2]
        if word in ("{", ";"):
            self.take()
            return self.closed(Node("block", start, self.many("}", self.statement))) if word == "{" else None
        if word in ("if", "while", "for", "switch", "with", "catch"):
            self.take()
            kind = "loop" if word in ("while", "for") else "branch"
            self.eat("await")
            head = self.many(")", self.clause) if self.eat("(") else []
            own = Node(kind, start, [Node("head", start, head)], word)
            own.flag = self.endless(word, own.start)
            body = self.statement() if not self.done() and self.now() != "}" else None
            own.children += [body] if body else []
            return self.closed(own)
        if word in ("else", "try", "finally", "do", "export", "default"):
            self.take()
            if self.eat(":"):
                return None
            return self.statement() if not self.done() else None
        if word in ("return", "throw"):
            self.take()
            value = [] if self.now() in (";", "}") or self.done() else [self.expression(_COMMA)]
            self.eat(";")
            return self.closed(Node(word, start, [x for x in value if x]))
        if word in ("var", "let", "const") and self.t[self.i + 1][0] in ("name", "sign") and self.t[self.i + 1][1] not in ("=", ".", "(", ";", ","):
            self.take()
            return self.closed(Node("declaration", start, self.declared()))
        if word == "case":
            self.take()
            value = self.expression(_COMMA)
            self.eat(":")
            return value
        if word in ("break", "continue"):
            self.take()
            return self.closed(Node("jump", start))
        value = self.expression(_COMMA)
        self.eat(";")
        return self.closed(Node("statement", start, [value])) if value else None

    def clause(self) -> Node | None:
        if self.now() in ("var", "let", "const"):
            start = self.take()[2]
            return self.closed(Node("declaration", start, self.declared()))
        if self.eat(";"):
            return None
        value = self.expression(_COMMA)
        if self.eat("of"):
            other = self.expression(_COMMA)
            return Node("of", value.start if value else 0, [x for x in (value, other) if x])
        return value

    def declared(self) -> list[Node]:
        out = []
        while True:
            start = self.t[self.i][2]
            target = self.expression(_SET + 1)
            if target is None:
                break
            own = [target]
            if self.eat("="):
                value = self.expression(_SET)
                own += [value] if value else []
            elif self.eat("of"):
                value = self.expression(_SET)
                own = [target, *([value] if value else [])]
                out += own
                break
            out.append(self.closed(Node("declare", start, own, "=", target.name if len(own) == 2 else None)))
            if not self.eat(","):
                break
        self.eat(";")
        return out

    def endless(self, word: str, start: int) -> str | None:
        if word != "for" and word != "while":
            return None
        first = self.i  # of the tokens behind the head's word
        while first and self.t[first - 1][2] > start:
            first -= 1
        inner = re.sub(r"\A\(+|\)+\Z", "", "".join(own for _, own, _ in self.t[first : self.i]))
        return "endless" if (word == "for" and inner == ";;") or (word == "while" and inner in ("true", "True", "1", "!![]", "!0", "1==1", "1===1")) else None

    def function(self, start: int, name: str | None, kind: str = "function") -> Node:
        params = self.many(")", lambda: None if self.eat(",") else self.expression(_SET)) if self.eat("(") else []
        body = self.statement() if self.now() == "{" else None
        return self.returning(self.closed(Node(kind, start, [Node("params", start, params), *([body] if body else [])], None, name)))

    def returning(self, node: Node) -> Node:
        """Marks a function that only gives back its own parameter, a fixed string, or (without parameters) one word or constant."""
        params, body = node.children[0], node.children[-1] if len(node.children) > 1 else None
        if body is not None and body.kind == "block":
            only = body.children[0] if len(body.children) == 1 and body.children[0].kind == "return" else None
            body = only.children[0] if only is not None and only.children else None
        if body is None:
            return node
        flags = []
        names = [(p.children[0] if p.children else p).name for p in params.children]
        if body.kind == "identifier" and body.name in names:
            flags.append("identity")
        if body.kind == "string" or (body.kind == "template" and not body.children):
            flags.append("string")
        if not params.children and body.kind in ("string", "number", "constant", "identifier"):
            flags.append("constant")
        node.flag = ",".join(flags) or None
        return node

    def arrow(self) -> bool:
        """Whether the parenthesis here closes before an arrow."""
        depth, k = 0, self.i
        while k < len(self.t) - 1:
            own = self.t[k][1] if self.t[k][0] == "sign" else ""
            depth += (own in ("(", "[", "{")) - (own in (")", "]", "}"))
            k += 1
            if depth == 0:
                return self.t[k][0] == "sign" and self.t[k][1] == "=>"
        return False

    def operand(self) -> Node | None:
        kind, own, start = self.t[self.i]
        if kind in ("number", "string", "regex"):
            self.take()
            return self.closed(Node(kind, start, (), None, own[1:-1] if kind == "string" and len(own) > 1 and own[-1] == own[0] else own))
        if kind == "template":
            self.take()
            parts, text = [], []
            while self.t[self.i][0] in ("text", "open"):
                kind, piece, _ = self.take()
                if kind == "open":
                    parts += self.many("\0", lambda: self.expression(_COMMA))
                    if self.t[self.i][0] == "end" and not self.done():
                        self.take()
                else:
                    text.append(piece)
            if self.t[self.i][0] == "close":
                self.take()
            return self.closed(Node("template", start, parts, name="".join(text)))
        if own in _PREFIX and kind in ("sign", "name"):
            self.take()
            value = self.expression(_UNARY)
            return self.closed(Node("unary", start, [value] if value else [], own))
        if kind == "name":
            self.take()
            if own == "async" and self.now() == "function":
                self.take()
                own = "function"
            if own == "function":
                self.eat("*")
                name = self.take()[1] if self.t[self.i][0] == "name" else None
                return self.function(start, name)
            if own == "class":
                while not self.done() and self.now() != "{":
                    self.take()
                self.eat("{")
                return self.closed(Node("class", start, self.many("}", self.member)))
            if own == "new":
                value = self.expression(_UNARY)
                return self.closed(Node("new", start, [value] if value else []))
            if self.now() == "=>":
                return self.body(start, [self.closed(Node("identifier", start, name=own))])
            return self.closed(Node("constant" if own in ("true", "false", "null") else "identifier", start, name=own))
        if own == "(":
            if self.arrow():
                self.take()
                return self.body(start, self.many(")", lambda: None if self.eat(",") else self.expression(_SET)))
            self.take()
            return self.closed(Node("group", start, self.many(")", lambda: self.expression(_COMMA))))
        if own == "[":
            self.take()
            return self.closed(Node("array", start, self.many("]", lambda: None if self.eat(",") else self.expression(_SET))))
        if own == "{":
            self.take()
            return self.closed(Node("object", start, self.many("}", self.member)))
        return None

    def body(self, start: int, params: list[Node]) -> Node:
        self.eat("=>")
        value = self.statement() if self.now() == "{" else self.expression(_SET)
        return self.returning(self.closed(Node("function", start, [Node("params", start, params), *([value] if value else [])])))

    def member(self) -> Node | None:
        """A pair, a method or a shorthand of an object or class."""
        if self.eat(",") or self.eat(";"):
            return None
        start = self.t[self.i][2]
        while self.now() in ("get", "set", "static", "async", "*") and self.t[self.i + 1][1] not in (":", ",", "(", "}", "="):
            self.take()
        key = self.expression(_UNARY + 1) if self.now() != "(" else None
        if key is not None and key.kind == "call":  # a method's name was read with its parameters
            name, params = key.children[0], key.children[1:]
            block = self.statement() if self.now() == "{" else None
            return self.returning(self.closed(Node("function", start, [Node("params", start, params), *([block] if block else [])], None, name.name)))
        if self.eat(":") or self.eat("="):
            value = self.expression(_SET)
            return self.closed(Node("pair", start, [x for x in (key, value) if x]))
        return key

    def expression(self, least: int) -> Node | None:
        self.level += 1
        try:
            if self.level > DEPTH:
                return self.skipped()
            left = self.operand()
            while left is not None:
                more = self.longer(left, least)
                if more is None:
                    break
                left = self.closed(more)
            return left
        finally:
            self.level -= 1

    def skipped(self) -> Node:
        start, depth = self.t[self.i][2], 0
        while not self.done():
            own = self.now()
            if depth == 0 and own in (")", "]", "}", ";"):
                break
            depth += (own in ("(", "[", "{")) - (own in (")", "]", "}"))
            self.take()
        return self.closed(Node("capped", start))

    def longer(self, left: Node, least: int) -> Node | None:
        """The expression that goes on from `left`, or null."""
        sign, start = self.words[self.i], left.start
        if sign not in _GO_ON and self.t[self.i][0] != "template":
            return None
        if self.t[self.i][0] == "template":
            return Node("tagged", start, [left, self.operand()])
        if sign in (".", "?.") and self.t[self.i + 1][0] == "name":
            self.take()
            own = self.take()[1]
            return Node("member", start, [left], sign, f"{left.name}.{own}" if left.name and left.kind in _CHAINS else None)
        if sign == "?.":
            self.take()
            sign = self.now()
        if sign == "(":
            self.take()
            args = self.many(")", lambda: None if self.eat(",") else self.expression(_SET))
            return Node("call", start, [left, *args], None, f"{left.name}()" if left.name and left.kind in _CHAINS else None)
        if sign == "[":
            self.take()
            inner = self.many("]", lambda: self.expression(_COMMA))
            fixed = left.name and left.kind in _CHAINS and len(inner) == 1 and inner[0].kind == "string"
            return Node("subscript", start, [left, *inner], None, f"{left.name}.{inner[0].name}" if fixed else None)
        if sign in ("++", "--"):
            self.take()
            return Node("unary", start, [left], sign)
        power = _POWER.get(sign)
        if power is not None and power >= least:
            self.take()
            right = self.expression(power if sign == "**" else power + 1)
            return Node("binary", start, [x for x in (left, right) if x], sign)
        if sign in _ASSIGN and least <= _SET:
            self.take()
            right = self.expression(_SET)
            return Node("assign", start, [x for x in (left, right) if x], sign, left.name if left.kind in _CHAINS else None)
        if sign == "?" and least <= _CHOICE:
            self.take()
            yes = self.expression(_SET)
            self.eat(":")
            no = self.expression(_SET)
            return Node("choice", start, [x for x in (left, yes, no) if x])
        if sign == "," and least <= _COMMA:
            own = [left]
            while self.eat(","):
                more = self.expression(_SET)
                own += [more] if more else []
            return Node("sequence", start, own)
        return None


_CHAINS = frozenset(("identifier", "member", "subscript", "call"))


def _terms(node: Node) -> int:
    """Operands of a tree of binary operations."""
    n, open_ = 0, [node]
    while open_:
        own = open_.pop()
        if own.kind == "binary":
            open_ += own.children
        else:
            n += 1
    return n


def tree(text: str) -> list[tuple]:
    """(node, parent, last, depth, kind, op, name, arity, start, size, flag, terms) in pre-order; `last` is a node's last
    descendant, `terms` the operands of a chain of binary operations that begins with an addition, at its first node."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 12 * DEPTH))
    try:
        parser = Parser(tokens(text), len(text))
        root = Node("program", 0)
        while not parser.done():
            root.children += parser.many("\0", parser.statement)
            if not parser.done():
                parser.take()
        root.end = len(text)
    finally:
        sys.setrecursionlimit(limit)
    out: list[list] = []
    stack = [(root, -1, 0)]
    while stack:
        node, parent, depth = stack.pop()
        number, own = len(out), node.children
        flag = terms = None
        if node.kind == "binary":
            if len(own) == 2 and node.op not in ("!=", "!=="):
                left, right = (text[x.start : x.end].strip() for x in own)
                flag = "same" if left == right else None
            if node.op == "+" and (parent < 0 or out[parent][4] != "binary"):
                terms = _terms(node)
        else:
            flag = node.flag
        out.append([number, parent, number, depth, node.kind, node.op, node.name, len(own), node.start, node.end - node.start, flag, terms])
        if own:
            depth += 1
            stack += [(x, number, depth) for x in reversed(own)]
    for x in reversed(out):  # in pre-order a node comes before what lies below it
        above = out[x[1]]
        if x[1] >= 0 and above[2] < x[2]:
            above[2] = x[2]
    return [tuple(x) for x in out]


#: Fields of a node; `numbers` is how many numbers are its children, `fresh` whether its name is the first of its kind (identifier, or chain of members) in its tree.
FIELDS = {x: pa.string() if x in ("kind", "op", "name", "flag") else pa.bool_() if x == "fresh" else pa.int32() for x in "node parent last depth kind op name arity start size flag terms numbers fresh".split()}
_PLACES = {x: k for k, x in enumerate("node parent last depth kind op name arity start size flag terms".split())}
#: Nodes of a batch that Python gives out, about.
TOGETHER = 1 << 14


def _more(rows: list[tuple], name: str) -> list:
    """The values of a field that isn't in the rows of a tree."""
    if name == "numbers":
        out = [0] * len(rows)
        for x in rows:
            if x[4] == "number" and x[1] >= 0:
                out[x[1]] += 1
        return out
    seen: set = set()
    out = []
    for x in rows:
        key = (x[4] == "identifier", x[6]) if x[6] is not None and x[4] in ("identifier", "member", "subscript") else None
        out.append(key is not None and key not in seen)
        seen.add(key)
    return out


def tree_batches(keys: list[str], body: str, read: Callable[[str], list[tuple]], places: dict[str, int], fields: dict[str, pa.DataType], kinds: frozenset | None, more: Callable = _more) -> Callable[[Iterator], Iterator]:
    """What turns batches of texts into batches of the nodes of their trees, of the given kinds alone if any are; a batch ends when it has TOGETHER nodes."""

    def run(batches):
        for batch in batches:
            texts = batch.column(body)
            own, sizes, first = {x: [] for x in fields}, [], 0

            def out(end):
                places_ = pa.array(np.repeat(np.arange(first, end), sizes))
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(places_) for k in keys), *(pa.array(own[x], t) for x, t in fields.items())], names=[*keys, *fields])

            for k in range(len(texts)):
                rows = read(texts[k].as_py() or "")
                added = {x: more(rows, x) for x in fields if x not in places}
                shown = range(len(rows)) if kinds is None else [i for i, x in enumerate(rows) if x[4] in kinds]
                rows = rows if kinds is None else [rows[i] for i in shown]
                for x in fields:
                    own[x] += [v[places[x]] for v in rows] if x in places else [added[x][i] for i in shown]
                sizes.append(len(rows))
                if len(next(iter(own.values()))) >= TOGETHER:
                    yield out(k + 1)
                    own, sizes, first = {x: [] for x in fields}, [], k + 1
            if sizes:
                yield out(len(texts))

    return run


def tree_schema(rows: DataFrame, keys: list[str], fields: dict[str, pa.DataType]) -> T.StructType:
    names = {pa.string(): T.StringType(), pa.bool_(): T.BooleanType(), pa.int32(): T.IntegerType()}
    return T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(x, names[t]) for x, t in fields.items())])


#: Numbers that no letter follows.  Which they are decides nothing about kinds and places of nodes, so scripts that differ by them alone share their names' places.
_NUMBERS = re.compile(r"([0-9]++(?![\w$]))")
#: What stands for them; other zeros have a letter or digit behind.
_NUMBER = re.compile(r"0(?![\w$])")
#: What statements can be cut by: brackets and semicolons outside comments, strings and plain templates; behind `open` nothing is cut.
_MARKS = re.compile(
    r"//[^\n]*+|/\*.*?(?:\*/|\Z)|<!--[^\n]*+|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|`(?:\\.|\$\{[\w\s.]*\}|\$(?!\{)|[^`\\$])*+`|(?P<open>[/`]|class(?![\w$]))|(?P<mark>[()\[\]{};])", re.DOTALL
)
_CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
#: Scripts and statements whose names are kept, and their greatest length.
KEPT, KEPT_SIZE = 1 << 13, 1 << 12


def statements(text: str) -> list[str]:
    """A script cut behind semicolons outside all brackets, where the parser begins a statement whatever stands before; what can't be cut is the last piece."""
    out, at, open_ = [], 0, []
    for found in _MARKS.finditer(text):
        if found.lastgroup is None:
            continue
        own = found.group()
        if own in _CLOSED_BY:
            open_.append(_CLOSED_BY[own])
        elif own != ";":
            if not open_ or open_.pop() != own:  # also what is `open`
                break
        elif not open_:
            out.append(text[at : found.end()])
            at = found.end()
    return [*out, text[at:]]


_DIGITS = re.compile(r"([0-9]+)")


def _alone(line: str) -> bool:
    """Whether a line that begins where a statement may is whole statements and comments."""
    open_, rest = [], 0
    for found in _MARKS.finditer(line):
        own = found.group()
        if found.lastgroup is None:
            if own.startswith("/*") and (len(own) < 4 or not own.endswith("*/")):
                return False
            if not open_ and own.startswith(("//", "/*", "<!--")) and not line[rest : found.start()].strip():
                rest = found.end()
        elif own in _CLOSED_BY:
            open_.append(_CLOSED_BY[own])
        elif own != ";":
            if not open_ or open_.pop() != own:  # also what is `open`
                return False
        elif not open_:
            rest = found.end()
    return not open_ and not line[rest:].strip()


_kept_alone = lru_cache(KEPT)(_alone)


def pieces(text: str) -> list[str]:
    """A script cut between statements, its numbers but 0 and 1 replaced by 2, 3, ... in order, equal ones by the same.

    Lines that are whole statements are pieces; from the first other one on, statements are.
    """
    parts = _DIGITS.split(text)
    if len(parts) > 1:
        known = {"0": "0", "1": "1"}
        for k in range(1, len(parts), 2):
            own = parts[k]
            parts[k] = known.get(own) or known.setdefault(own, str(len(known)))
        text = "".join(parts)
    rows = text.split("\n")
    for k, row in enumerate(rows):
        if not (_kept_alone if len(row) <= KEPT_SIZE else _alone)(row):
            return rows[:k] + statements("\n".join(rows[k:]))
    return rows


def _places_of(text: str, kind: str) -> list[tuple[int, str]]:
    """(start, name) of the nodes of a kind that have names."""
    return [(x[8] + (kind == "string" and x[9] > len(x[6])), x[6]) for x in tree(text) if x[4] == kind and x[6] is not None]


_kept_places = lru_cache(KEPT)(_places_of)


def _names_of(text: str, kind: str) -> tuple[dict[str, int], list[tuple[int, list[str]]]]:
    """Names of a kind with their counts, and those that hold numbers as (place of the first number, the text around them)."""
    ends = [x.start() for x in _NUMBER.finditer(text)]
    fixed, varied, at = Counter(), [], 0
    for piece in statements(text):
        for start, name in (_kept_places if len(piece) <= KEPT_SIZE else _places_of)(piece, kind):
            start += at
            first, behind = bisect_left(ends, start), bisect_left(ends, start + len(name))
            if first == behind:
                fixed[name] += 1
            else:
                cuts = [k - start for k in ends[first:behind]]
                varied.append((first, [name[a:b] for a, b in zip([0, *(k + 1 for k in cuts)], [*cuts, len(name)], strict=True)]))
        at += len(piece)
    return dict(fixed), varied


_kept_names = lru_cache(KEPT)(_names_of)


def names_of(text: str, kind: str) -> dict[str, int]:
    """How often each name of nodes of a kind (`identifier`, `string`) is in a script: what `tree` gives, without a tree for statements that are known but for their numbers."""
    parts = _NUMBERS.split(text)
    shape, numbers = "0".join(parts[::2]), parts[1::2]
    fixed, varied = (_kept_names if len(shape) <= KEPT_SIZE else _names_of)(shape, kind)
    out = dict(fixed)
    for first, around in varied:
        name = around[0] + numbers[first] + around[1]
        for k in range(2, len(around)):
            name += numbers[first + k - 1] + around[k]
        out[name] = out.get(name, 0) + 1
    return out


def names(scripts: DataFrame, keys: list[str], body: str, kind: str) -> DataFrame:
    """(keys, name, n): the names of a script's nodes of a kind, and how often each is there."""

    def run(batches):
        for batch in batches:
            own, n, sizes, first = [], [], [], 0
            texts = batch.column(body)

            def out(end):
                places = pa.array(np.repeat(np.arange(first, end), sizes))
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(places) for k in keys), pa.array(own, pa.string()), pa.array(n, pa.int64())], names=[*keys, "name", "n"])

            for k in range(len(texts)):
                found = names_of(texts[k].as_py() or "", kind)
                own += found.keys()
                n += found.values()
                sizes.append(len(found))
                if len(own) >= TOGETHER:
                    yield out(k + 1)
                    own, n, sizes, first = [], [], [], k + 1
            if sizes:
                yield out(len(texts))

    schema = T.StructType([*(scripts.schema[k] for k in keys), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    return scripts.select(*keys, body).mapInArrow(run, schema)


#: Comments and what they can't begin in.  A template whose expressions are plain names and numbers is one piece; any other, and a slash that may begin a regular expression, is `open`, and left to `tokens`.
_PIECES = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|<!--[^\n]*)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|\$\{[\w\s.]*\}|\$(?!\{)|[^`\\$])*`|(?P<open>[/`])", re.DOTALL
)


def comments_of(text: str) -> list[str]:
    """The comments of a script with their marks."""
    out = []
    for found in _PIECES.finditer(text):
        kind = found.lastgroup
        if kind == "open":
            return [own for kind, own, _ in tokens(text) if kind == "comment"]
        if kind == "comment":
            out.append(found.group())
    return out


def _comments(values: pd.Series) -> pd.Series:
    def bare(x: str) -> str:
        if not x.startswith("/*"):
            return x[4:] if x.startswith("<!--") else x[2:]
        return x[2:-2] if x.endswith("*/") and len(x) >= 4 else x[2:-1]

    return pd.Series([[bare(own) for own in comments_of(v or "")] for v in values], dtype=object)


def nodes(scripts: DataFrame, keys: list[str], body: str, fields: list[str] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The syntax nodes of scripts: keys and the FIELDS, or those asked for, of all nodes or those of some kinds."""
    own = {x: FIELDS[x] for x in fields or FIELDS}
    run = tree_batches(keys, body, tree, _PLACES, own, None if kinds is None else frozenset(kinds))
    return scripts.select(*keys, body).mapInArrow(run, tree_schema(scripts, keys, own))


#: _PIECES for Spark's expressions; possessive, so that long pieces need no stack.
_PIECES_SQL = r"""(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|<!--[^\n]*+|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|`(?:\\.|\$\{[\w\s.]*+\}|\$(?!\{)|[^`\\$])*+`|[/`]"""


def plain_comments(body: Column) -> Column:
    """What comment_bodies gives, by Spark's expressions; null for a script that needs the lexer."""

    def bare(x: Column) -> Column:
        closed = x.endswith("*/") & (F.length(x) >= 4)
        return F.when(x.startswith("//"), F.substr(x, F.lit(3))).when(x.startswith("<!--"), F.substr(x, F.lit(5))).when(x.startswith("/*"), F.substr(x, F.lit(3), F.length(x) - F.when(closed, 4).otherwise(3)))

    def of(pieces: Column) -> Column:
        return F.when(~F.exists(pieces, lambda x: x.isin("/", "`")), F.filter(F.transform(pieces, bare), lambda x: x.isNotNull()))

    return bound(F.regexp_extract_all(body, F.lit(_PIECES_SQL), F.lit(0)), of)


def comment_bodies(body: Column) -> Column:
    """The comments of a script in order; marks inside strings, templates and regular expressions begin none."""
    return F.pandas_udf(_comments, "array<string>")(body)
