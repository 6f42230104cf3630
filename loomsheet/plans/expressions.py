"""Expressions of the document query language: text to tree to Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.functions import values
from loomsheet.functions.document import NUMBERS, Val, call, kind_of

TOKEN = re.compile(
    r"""\s+|--[^\n]*|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")"""
    r"""|(?P<param>@[A-Za-z_]\w*|@\d+)|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>=>|!=|<>|>=|<=|[@%/*+\-=<>(),.:;{}\[\]])"""
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


class Tokens:
    def __init__(self, text: str):
        self.items: list[Token] = []
        place = 0
        while place < len(text):
            m = TOKEN.match(text, place)
            if not m:
                raise ValueError(f"unexpected {text[place : place + 10]!r}")
            if m.lastgroup:
                self.items.append(Token(m.lastgroup, m.group()))
            place = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> Token:
        at = self.at + ahead
        return self.items[at] if at < len(self.items) else Token("end", "")

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def accept(self, *texts: str) -> bool:
        token = self.peek()
        if token.text in texts and token.kind != "str" or token.word in texts:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise ValueError(f"expected {text}, found {self.peek().text!r}")


@dataclass
class Node:
    op: str
    args: list = field(default_factory=list)
    value: object = None


PREDICATES = ("=", "!=", "<>", ">", ">=", "<", "<=", "LIKE", "BETWEEN", "IN")
LAMBDAS = ("MAP", "FILTER", "SORT")


class Parser:
    """Standard precedence; ``legacy`` binds each of ``% / * + -`` in this order, one after the other."""

    def __init__(self, tokens: Tokens, legacy: bool = False):
        self.t, self.legacy = tokens, legacy

    def expression(self) -> Node:
        left = self.conjunction()
        while self.t.accept("OR"):
            left = Node("OR", [left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.predicate()
        while self.t.accept("AND"):
            left = Node("AND", [left, self.predicate()])
        return left

    def predicate(self) -> Node:
        left = self.arithmetic()
        while True:
            token = self.t.peek()
            form = ""
            if token.word in ("ANY", "ALL") and (self.t.peek(1).text in PREDICATES or self.t.peek(1).word in PREDICATES):
                form = token.word
                self.t.next()
                token = self.t.peek()
            op = token.word or token.text
            if op not in PREDICATES or token.kind in ("str", "num"):
                return left
            self.t.next()
            right = [self.arithmetic()]
            if op == "BETWEEN":
                self.t.expect("AND")
                right.append(self.arithmetic())
            left = Node("compare", [left, *right], ("!=" if op == "<>" else op, form))

    def arithmetic(self) -> Node:
        items: list = [self.primary()]
        while self.t.peek().kind == "op" and self.t.peek().text in ("%", "/", "*", "+", "-"):
            items += [self.t.next().text, self.primary()]
        levels = (("%",), ("/",), ("*",), ("+",), ("-",)) if self.legacy else (("%", "/", "*"), ("+", "-"))
        for ops in levels:
            at = 1
            while at < len(items):
                if items[at] in ops:
                    items[at - 1 : at + 2] = [Node("arith", [items[at - 1], items[at + 1]], items[at])]
                else:
                    at += 2
        return items[0]

    def primary(self) -> Node:
        t = self.t
        token = t.next()
        if token.kind == "num":
            number = float(token.text) if re.search(r"[.eE]", token.text) else int(token.text)
            return Node("lit", value=number)
        if token.kind == "str":
            body = token.text[1:-1]
            return Node("lit", value=re.sub(r"\\(.)|''", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]) if m[1] else "'", body))
        if token.text == "-" and token.kind == "op":
            return Node("arith", [Node("lit", value=0), self.primary()], "-")
        if token.kind == "param":
            return self.path(Node("key")) if token.text == "@key" else Node("param", value=token.text[1:])
        if token.text == "@":
            return self.path(Node("current"))
        if token.text == "*":
            return self.path(Node("source"))
        if token.text == "(":
            inner = self.expression()
            t.expect(")")
            return self.path(inner)
        if token.text == "{":
            pairs: list[tuple[str, Node]] = []
            while not t.accept("}"):
                name = t.next()
                key = name.text[1:-1] if name.kind == "str" else name.text
                pairs.append((key, self.expression() if t.accept(":") else Node("field", [Node("root")], key)))
                t.accept(",")
            return self.path(Node("doc", [n for _, n in pairs], [k for k, _ in pairs]))
        if token.text == "[":
            items = []
            while not t.accept("]"):
                items.append(self.expression())
                t.accept(",")
            return Node("array", items)
        if token.kind == "word":
            if token.word in ("TRUE", "FALSE", "NULL"):
                return Node("lit", value={"TRUE": True, "FALSE": False}.get(token.word))
            if token.text == "$":
                return self.path(Node("root"))
            if t.peek().text == "(":
                t.next()
                args: list[Node] = []
                if token.word in LAMBDAS:
                    args.append(self.expression())
                    t.expect("=>")
                while not t.accept(")"):
                    args.append(self.expression())
                    t.accept(",")
                return self.path(Node("lambda" if token.word in LAMBDAS else "call", args, token.word))
            return self.path(Node("field", [Node("root")], token.text))
        raise ValueError(f"unexpected {token.text!r}")

    def path(self, node: Node) -> Node:
        t = self.t
        while True:
            if t.peek().text == "." and t.peek().kind == "op":
                t.next()
                name = t.next()
                node = Node("field", [node], name.text[1:-1] if name.kind == "str" else name.text)
            elif t.peek().text == "[" and t.peek().kind == "op":
                t.next()
                if t.peek().text == "*" and t.peek(1).text == "]":
                    t.next()
                    node = Node("items", [node])
                elif t.peek().kind == "str" and t.peek(1).text == "]":
                    node = Node("field", [node], t.next().text[1:-1])
                else:
                    node = Node("index", [node, self.expression()])
                t.expect("]")
            else:
                return node


def parse(text: str, legacy: bool = False) -> Node:
    tokens = Tokens(text)
    node = Parser(tokens, legacy).expression()
    if tokens.peek().kind != "end":
        raise ValueError(f"unexpected {tokens.peek().text!r}")
    return node


class Builder:
    """Trees to Columns over one DataFrame, whose schema gives the kinds of fields."""

    def __init__(self, df: DataFrame, parameters: dict | None = None, key: Val | None = None):
        self.schema, self.parameters, self.key = df.schema, parameters or {}, key

    def build(self, node: Node, current: Val | None = None) -> Val:
        return getattr(self, "_" + node.op.lower())(node, current)

    def _lit(self, node: Node, current) -> Val:
        v = node.value
        kind = "boolean" if isinstance(v, bool) else "int32" if isinstance(v, int) and abs(v) < 2**31 else "int64" if isinstance(v, int) else "double" if isinstance(v, float) else "string" if isinstance(v, str) else "null"
        return Val(F.lit(v), kind, literal=v)

    def _param(self, node: Node, current) -> Val:
        return self._lit(Node("lit", value=self.parameters[node.value]), current) if not isinstance(self.parameters[node.value], list) else Val(F.array(*map(F.lit, self.parameters[node.value])), "array", literal=self.parameters[node.value])

    def _key(self, node: Node, current) -> Val:
        if self.key is None:
            raise ValueError("@key needs GROUP BY")
        return self.key

    def _root(self, node: Node, current) -> Val:
        return Val(F.struct(*[F.col(f"`{f.name}`") for f in self.schema.fields]), "document", dtype=self.schema)

    def _current(self, node: Node, current: Val | None) -> Val:
        return current if current is not None else self._root(node, None)

    def _source(self, node: Node, current) -> Val:
        return Val(F.struct(*[F.col(f"`{f.name}`") for f in self.schema.fields]), "document", "src", self.schema)

    def _field(self, node: Node, current) -> Val:
        owner = node.args[0]
        parent = self.build(owner, current)
        dtype = parent.dtype
        if isinstance(dtype, T.StructType):
            found = next((f for f in dtype.fields if f.name.lower() == node.value.lower()), None)
            if found is None:
                return Val(F.lit(None), "null", parent.shape)  # a missing field reads as null
            if parent.shape == "seq":
                col = F.transform(parent.col, lambda x: x.getField(found.name))
            elif owner.op in ("root", "source") and dtype is self.schema:
                col = F.col(f"`{found.name}`")
            else:
                col = parent.col.getField(found.name)
            return Val(col, kind_of(found.dataType), parent.shape, found.dataType)
        if parent.kind == "variant":
            return Val(F.try_variant_get(parent.col, f"$.{node.value}", "variant"), "variant", parent.shape, dtype)
        return Val(parent.col.getField(node.value), "unknown", parent.shape)

    @staticmethod
    def _element(v: Val) -> T.DataType | None:
        return v.dtype.elementType if isinstance(v.dtype, T.ArrayType) else None

    def _items(self, node: Node, current) -> Val:
        v = self.build(node.args[0], current)
        if v.shape == "src":
            return v
        element = self._element(v)
        if v.shape == "seq":
            return Val(F.flatten(v.col), kind_of(element), "seq", element)
        return Val(v.col, kind_of(element), "seq", element)

    def _index(self, node: Node, current) -> Val:
        v = self.build(node.args[0], current)
        element = v.dtype if v.shape == "seq" else self._element(v)
        place = node.args[1]
        if place.op == "lit" or place.op == "param" or (place.op == "arith" and place.args[0].op == "lit"):
            at = self.build(place, current)
            number = at.literal if isinstance(at.literal, int) else -place.args[1].value
            return Val(F.get(v.col, F.lit(number)) if number >= 0 else F.try_element_at(v.col, F.lit(number)), kind_of(element), "scalar", element)
        kept = F.filter(v.col, lambda x: self.build(place, Val(x, kind_of(element), "scalar", element)).col)
        return Val(kept, kind_of(element), "seq", element)

    def _doc(self, node: Node, current) -> Val:
        parts = [self.build(n, current) for n in node.args]
        return Val(F.struct(*[p.col.alias(k) for k, p in zip(node.value, parts, strict=True)]), "document", dtype=None, literal=list(zip(node.value, parts, strict=True)))

    def _array(self, node: Node, current) -> Val:
        parts = [self.build(n, current) for n in node.args]
        literals = [p.literal for p in parts]
        return Val(F.array(*[p.col for p in parts]), "array", literal=literals if all(p.literal is not None for p in parts) else None)

    def _call(self, node: Node, current) -> Val:
        return call(node.value, [self.build(a, current) for a in node.args])

    def _lambda(self, node: Node, current) -> Val:
        v = self.build(node.args[0], current)
        if v.shape == "src":
            raise ValueError(f"{node.value} over the source is SELECT, WHERE or ORDER BY")
        v = v if v.shape == "seq" else Val(v.seq() if v.kind != "array" else v.col, kind_of(self._element(v)), "seq", self._element(v))

        def inner(x: Column) -> Val:
            return self.build(node.args[1], Val(x, v.kind, "scalar", v.dtype))

        if node.value == "FILTER":
            return Val(F.filter(v.col, lambda x: inner(x).col), v.kind, "seq", v.dtype)
        if node.value == "MAP":
            made = inner(F.lit(None))
            return Val(F.transform(v.col, lambda x: inner(x).col), made.kind, "seq", made.dtype)
        order = node.args[2].value if len(node.args) > 2 else 1
        down = order in (-1, "desc", "DESC")
        keyed = F.transform(v.col, lambda x, i: F.struct(inner(x).col.alias("k"), i.alias("i"), x.alias("x")))
        return Val(F.transform(F.sort_array(keyed, not down), lambda s: s.getField("x")), v.kind, "seq", v.dtype)

    def _and(self, node: Node, current) -> Val:
        a, b = (self.build(n, current) for n in node.args)
        return Val(a.col & b.col, "boolean")

    def _or(self, node: Node, current) -> Val:
        a, b = (self.build(n, current) for n in node.args)
        return Val(a.col | b.col, "boolean")

    def _arith(self, node: Node, current) -> Val:
        a, b = (self.build(n, current) for n in node.args)
        shape = "src" if "src" in (a.shape, b.shape) else "scalar"
        op = node.value
        if op == "+" and "string" in (a.kind, b.kind):
            return Val(F.concat(F.coalesce(a.col.cast("string"), F.lit("")), F.coalesce(b.col.cast("string"), F.lit(""))), "string", shape)
        if op in "+-" and a.kind == "datetime" and b.kind in NUMBERS:  # ticks of 100 ns
            micros = (F.unix_micros(a.col) + (b.col if op == "+" else -b.col) / 10).cast("bigint")
            return Val(F.timestamp_micros(micros), "datetime", shape)
        known = {a.kind, b.kind} <= {*NUMBERS, "unknown", "variant"}
        if not known:
            return Val(F.lit(None), "null", shape)
        if op == "/":
            exact = "decimal" in (a.kind, b.kind)
            x, y = (a.col, b.col) if exact else (a.col.cast("double"), b.col.cast("double"))
            quotient = F.try_divide(x, y)
            if not exact:  # as doubles divide: infinity or not a number
                quotient = F.when(y == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))).otherwise(quotient)
            return Val(quotient, "decimal" if exact else "double", shape)
        if op == "%":
            return Val(F.try_mod(a.col, b.col), a.kind, shape)
        kind = next((k for k in ("decimal", "double", "int64") if k in (a.kind, b.kind)), a.kind)
        return Val({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], kind, shape)

    def _compare(self, node: Node, current) -> Val:
        op, form = node.value
        left = self.build(node.args[0], current)
        rights = [self.build(n, current) for n in node.args[1:]]
        text = left.kind == "string" or any(r.kind == "string" for r in rights)

        def test(x: Column) -> Column:
            y = rights[0]
            if op == "=":
                return values.equal(x, y.col, text)
            if op == "!=":
                return values.not_equal(x, y.col, text)
            if op == ">":
                return x > y.col if y.literal is not None else values.greater(x, y.col)
            if op == ">=":
                return x >= y.col if y.literal is not None else values.greater_equal(x, y.col)
            if op == "<":
                return x.isNull() | (x < y.col) if y.literal is not None else values.less(x, y.col)
            if op == "<=":
                return x.isNull() | (x <= y.col) if y.literal is not None else values.less_equal(x, y.col)
            if op == "LIKE":
                return values.like(x, y.col)
            if op == "BETWEEN":
                return values.between(x, y.col, rights[1].col, text)
            if y.kind != "array":
                return values.equal(x, y.col, text)
            if isinstance(y.literal, list):
                items = [v.lower() if isinstance(v, str) else v for v in y.literal]
                return F.coalesce((F.lower(x) if any(isinstance(v, str) for v in items) else x).isin(*items), F.lit(False))
            return F.coalesce(F.array_contains(y.col, x), F.lit(False))

        if form == "ANY":
            return Val(F.coalesce(F.exists(left.seq() if left.shape == "seq" or left.kind != "array" else left.col, test), F.lit(False)), "boolean")
        if form == "ALL":
            return Val(F.coalesce(F.forall(left.seq() if left.shape == "seq" or left.kind != "array" else left.col, test), F.lit(True)), "boolean")
        condition = test(left.col)
        if op in (">", ">=") and rights[0].literal is not None:
            condition = F.coalesce(condition, F.lit(False)) if left.dtype is None else condition
        return Val(condition, "boolean", left.shape)
