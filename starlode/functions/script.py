"""Script functions of native queries as columns: no interpreter, no Python worker.

Understood is what a column can say: ``function(a, b) { ... }`` whose body declares variables, branches
by ``if`` and returns; arithmetic, comparisons, logic, conditionals, concatenation, the text methods in
``METHODS``, ``Math``, ``parseInt``, ``parseFloat``, ``Number``, ``String`` and ``isNaN``. Loops,
assignments, objects and everything else raise ``Unsupported``.

Where columns differ from scripts: null arguments give null instead of being 0 or 'null', and compare as
false to everything but null; what isn't a number (NaN) is null; characters are code points, and texts
are ordered by them.

An aggregator's first parameter is the running value. It may only be added to or go through ``Math.max`` or
``Math.min``, perhaps under a condition, which makes the function a sum, maximum or minimum that Spark
aggregates partially before it shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Unsupported(ValueError):
    """A native specification that can't be said in columns."""


TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_$][\w$]*)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<sign>===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:().,;={}]))""")
NUMBER, TEXT, TRUTH, NOTHING, RUNNING = "number", "text", "truth", "nothing", "running"
LEVELS = [("||",), ("&&",), ("===", "!==", "==", "!="), ("<=", ">=", "<", ">"), ("+", "-"), ("*", "/", "%")]


@dataclass(frozen=True)
class Value:
    """A column and its script type. Of a running value: what ``how`` (none yet: unchanged) aggregates."""

    column: Column | None
    kind: str
    how: str | None = None
    literal: float | None = None


def number(v: Value) -> Column:
    if v.kind == NUMBER:
        return v.column
    if v.kind == TEXT:
        return F.when(F.trim(v.column) == "", F.lit(0.0)).otherwise(F.trim(v.column).try_cast("double"))
    if v.kind == TRUTH:
        return v.column.cast("int").cast("double")
    raise Unsupported(f"a {v.kind} value isn't a number")


def text(v: Value) -> Column:
    if v.kind == TEXT:
        return v.column
    if v.kind == NUMBER:  # whole numbers have no decimal point
        whole = (v.column == F.floor(v.column)) & (F.abs(v.column) < 1e15)
        return F.when(whole, v.column.try_cast("bigint").cast("string")).otherwise(v.column.cast("string"))
    if v.kind == TRUTH:
        return v.column.cast("string")
    raise Unsupported(f"a {v.kind} value isn't a text")


def truth(v: Value) -> Column:
    if v.kind == TRUTH:
        return v.column
    if v.kind == NOTHING:
        return F.lit(False)
    if v.kind == RUNNING:
        raise Unsupported("a running value can't be a condition")
    return F.coalesce(v.column != (0.0 if v.kind == NUMBER else ""), F.lit(False))


def _sure(c: Column) -> Value:
    return Value(F.coalesce(c, F.lit(False)), TRUTH)


def _position(v: Value) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1 << 30), F.floor(number(v)))).cast("int")


def _substring(c: Column, a: Value, b: Value | None = None) -> Value:
    start, end = _position(a), F.length(c) if b is None else _position(b)
    return Value(F.substring(c, F.least(start, end) + 1, F.abs(end - start)), TEXT)


#: Methods of texts.
METHODS: Mapping[str, Callable[..., Value]] = {
    "toUpperCase": lambda c: Value(F.upper(c), TEXT),
    "toLowerCase": lambda c: Value(F.lower(c), TEXT),
    "trim": lambda c: Value(F.trim(c), TEXT),
    "toString": lambda c: Value(c, TEXT),
    "charAt": lambda c, i: Value(F.substring(c, _position(i) + 1, F.lit(1)), TEXT),
    "substring": _substring,
    "substr": lambda c, i, n=None: Value(F.substring(c, _position(i) + 1, F.length(c) if n is None else _position(n)), TEXT),
    "indexOf": lambda c, x: Value((F.instr(c, text(x)) - 1).cast("double"), NUMBER),
    "startsWith": lambda c, x: _sure(F.startswith(c, text(x))),
    "endsWith": lambda c, x: _sure(F.endswith(c, text(x))),
    "includes": lambda c, x: _sure(F.contains(c, text(x))),
    "concat": lambda c, *x: Value(F.concat(c, *map(text, x)), TEXT),
}
MATH: Mapping[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "pow": F.pow, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"), "round": lambda c: F.floor(c + 0.5).cast("double"),
}
LEADING = {"parseInt": r"^[+-]?[0-9]+", "parseFloat": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"}


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


class Script:
    """A function's parameters and, by ``value``, what it returns for given arguments."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise Unsupported(f"not understood in a script: {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.take("function")
        if self.tokens[self.at][0] == "name":
            self.at += 1
        self.take("(")
        self.parameters: list[str] = []
        while not self.has(")"):
            self.parameters.append(self.name())
            self.has(",")
        self.take("{")
        self.body = self.at

    def value(self, *arguments: Value) -> Value:
        self.at, self.known = self.body, dict(zip(self.parameters, arguments))
        if len(arguments) < len(self.parameters):
            raise Unsupported(f"a script wants {len(self.parameters)} arguments, not {len(arguments)}")
        out = self.block()
        if out is None or self.at != len(self.tokens):
            raise Unsupported("a script must end by returning a value")
        return out

    # --- reading

    def peek(self, k: int = 0) -> str | None:
        kind, word = self.tokens[self.at + k] if self.at + k < len(self.tokens) else (None, None)
        return None if kind == "text" else word

    def has(self, word: str) -> bool:
        found = self.peek() == word
        self.at += found
        return found

    def take(self, word: str) -> None:
        if not self.has(word):
            raise Unsupported(f"a script has {self.peek()!r} where {word!r} is understood")

    def name(self) -> str:
        if self.peek() is None or self.tokens[self.at][0] != "name":
            raise Unsupported("a script lacks a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    # --- statements

    def block(self) -> Value | None:
        """What statements up to "}" return; those after a return have no effect."""
        out = None
        while not self.has("}"):
            found = self.statement()
            out = found if out is None else out
        return out

    def statement(self) -> Value | None:
        if self.has(";"):
            return None
        if self.peek() in ("var", "let", "const"):
            self.at += 1
            name = self.name()
            self.take("=")
            self.known[name] = self.conditional()
            self.has(";")
            return None
        if self.has("return"):
            out = self.conditional()
            self.has(";")
            return out
        if self.has("if"):
            self.take("(")
            condition = truth(self.conditional())
            self.take(")")
            yes = self.branch()
            no = self.branch() if self.has("else") else None
            if no is None:  # what follows is the other branch; the end of the block stays
                while self.peek() not in ("}", None) and no is None:
                    no = self.statement()
            if yes is None or no is None:
                raise Unsupported("both ways of an if must return")
            return choose(condition, yes, no)
        raise Unsupported(f"a script's statement begins with {self.peek()!r}")

    def branch(self) -> Value | None:
        outer, self.known = self.known, dict(self.known)
        out = self.block() if self.has("{") else self.statement()
        self.known = outer
        return out

    # --- expressions

    def conditional(self) -> Value:
        out = self.binary(0)
        if not self.has("?"):
            return out
        yes = self.conditional()
        self.take(":")
        return choose(truth(out), yes, self.conditional())

    def binary(self, level: int) -> Value:
        if level == len(LEVELS):
            return self.unary()
        out = self.binary(level + 1)
        while self.peek() in LEVELS[level]:
            sign = self.peek()
            self.at += 1
            out = combine(sign, out, self.binary(level + 1))
        return out

    def unary(self) -> Value:
        if self.has("!"):
            return Value(~truth(self.unary()), TRUTH)
        if self.has("-"):
            v = self.unary()
            return Value(-number(v), NUMBER, literal=None if v.literal is None else -v.literal)
        if self.has("+"):
            return Value(number(self.unary()), NUMBER)
        out = self.primary()
        while self.has("."):
            name = self.name()
            if name == "length" and self.peek() != "(":
                out = Value(F.length(text(out)).cast("double"), NUMBER)
                continue
            if name not in METHODS:
                raise Unsupported(f"the method '{name}' isn't understood")
            try:
                out = METHODS[name](text(out), *self.arguments())
            except TypeError:
                raise Unsupported(f"'{name}' has other arguments than are understood") from None
        return out

    def arguments(self) -> list[Value]:
        self.take("(")
        out: list[Value] = []
        while not self.has(")"):
            if out:
                self.take(",")
            out.append(self.conditional())
        return out

    def primary(self) -> Value:
        if self.has("("):
            out = self.conditional()
            self.take(")")
            return out
        if self.at >= len(self.tokens):
            raise Unsupported("a script ends too early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(word)), NUMBER, literal=float(word))
        if kind == "text":
            return Value(F.lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])), TEXT)
        if word in self.known:
            return self.known[word]
        if word in ("true", "false"):
            return Value(F.lit(word == "true"), TRUTH)
        if word in ("null", "undefined"):
            return Value(F.lit(None), NOTHING)
        if word == "Infinity":
            return Value(F.lit(float("inf")), NUMBER, literal=float("inf"))
        if word == "Math" and self.has("."):
            return self.math(self.name())
        if word in LEADING:
            found = F.regexp_extract(F.trim(text(self.arguments()[0])), LEADING[word], 0)
            return Value(F.nullif(found, F.lit("")).try_cast("double"), NUMBER)
        if word in ("Number", "String", "isNaN") and self.peek() == "(":
            (v,) = self.arguments()
            return Value(number(v), NUMBER) if word == "Number" else Value(text(v), TEXT) if word == "String" else Value(number(v).isNull(), TRUTH)
        raise Unsupported(f"'{word}' isn't understood in a script")

    def math(self, name: str) -> Value:
        values = self.arguments()
        if name in ("max", "min"):
            if any(v.kind == RUNNING for v in values):
                return extreme(name, values)
            given = [number(v) for v in values]
            missing = reduce(Column.__or__, (c.isNull() for c in given), F.lit(False))
            best = given[0] if len(given) == 1 else (F.greatest if name == "max" else F.least)(*given)
            return Value(F.when(~missing, best), NUMBER)
        if name not in MATH:
            raise Unsupported(f"'Math.{name}' isn't understood")
        return Value(MATH[name](*map(number, values)), NUMBER)


def extreme(how: str, values: Sequence[Value]) -> Value:
    """The running value's maximum or minimum with others."""
    own = [v for v in values if v.kind == RUNNING]
    if len(own) != 1 or own[0].how not in (None, how):
        raise Unsupported("a running value must be kept in one way")
    given = [number(v) for v in values if v.kind != RUNNING] + ([own[0].column] if own[0].how else [])
    best = given[0] if len(given) == 1 else (F.greatest if how == "max" else F.least)(*given)
    return Value(best, RUNNING, how)


def choose(condition: Column, a: Value, b: Value) -> Value:
    if RUNNING in (a.kind, b.kind):
        if a.kind != b.kind or (a.how and b.how and a.how != b.how):
            raise Unsupported("a running value must be kept in one way")
        if not (how := a.how or b.how):
            return a
        rest = F.lit(0.0) if how == "sum" else F.lit(None).cast("double")
        return Value(F.when(condition, a.column if a.how else rest).otherwise(b.column if b.how else rest), RUNNING, how)
    if NOTHING in (a.kind, b.kind):
        kind = b.kind if a.kind == NOTHING else a.kind
        return Value(F.when(condition, a.column).otherwise(b.column), kind)
    if a.kind != b.kind:  # as a column has one type, texts
        a, b = Value(text(a), TEXT), Value(text(b), TEXT)
    return Value(F.when(condition, a.column).otherwise(b.column), a.kind)


def combine(sign: str, a: Value, b: Value) -> Value:
    if RUNNING in (a.kind, b.kind):
        own, other = (a, b) if a.kind == RUNNING else (b, a)
        if sign != "+" and not (sign == "-" and own is a) or other.kind == RUNNING or own.how not in (None, "sum"):
            raise Unsupported("a running value may only be added to, or go through Math.max or Math.min")
        c = F.coalesce(number(other), F.lit(0.0))
        c = -c if sign == "-" else c
        return Value(c if own.how is None else own.column + c, RUNNING, "sum")
    if sign in ("&&", "||"):
        if a.kind == b.kind == TRUTH:
            return Value(a.column & b.column if sign == "&&" else a.column | b.column, TRUTH)
        return choose(truth(a), b, a) if sign == "&&" else choose(truth(a), a, b)
    if sign in ("==", "===", "!=", "!=="):
        if NOTHING in (a.kind, b.kind):
            same = Value((b if a.kind == NOTHING else a).column.isNull(), TRUTH)
        elif a.kind == b.kind:
            same = _sure(a.column == b.column)
        else:
            same = Value(F.lit(False), TRUTH) if len(sign) == 3 else _sure(number(a) == number(b))
        return same if sign[0] == "=" else Value(~same.column, TRUTH)
    if sign in ("<", "<=", ">", ">="):
        x, y = (a.column, b.column) if a.kind == b.kind == TEXT else (number(a), number(b))
        return _sure({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign])
    if sign == "+" and TEXT in (a.kind, b.kind):
        return Value(F.concat(text(a), text(b)), TEXT)
    x, y = number(a), number(b)
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y), "%": lambda: F.try_mod(x, y)}[sign](), NUMBER)


# --- the four places where native queries have scripts


def of_text(source: str, c: Column) -> Column:
    """An extraction's function of a dimension's value: a text."""
    return text(Script(source).value(Value(c.cast("string"), TEXT)))


def holds(source: str, c: Column) -> Column:
    """A filter's function of a dimension's value."""
    return truth(Script(source).value(Value(c.cast("string"), TEXT)))


def of_numbers(source: str, columns: Sequence[Column]) -> Column:
    """A post-aggregation's function of aggregates: a number."""
    return number(Script(source).value(*(Value(c.cast("double"), NUMBER) for c in columns)))


def aggregated(spec: Mapping, columns: Sequence[Column], only: Callable[[Column], Column]) -> Column:
    """An aggregator of three functions: ``fnAggregate`` of the running value and a row's numbers,
    ``fnCombine`` of two running values, ``fnReset``, where it begins."""
    out = Script(spec["fnAggregate"]).value(Value(None, RUNNING), *(Value(c.cast("double"), NUMBER) for c in columns))
    if out.kind != RUNNING or out.how is None:
        raise Unsupported("a script aggregation must keep a running value")
    if "fnCombine" in spec:
        both = Script(spec["fnCombine"]).value(Value(None, RUNNING), Value(F.lit(0.0), NUMBER))
        if (both.kind, both.how) != (RUNNING, out.how):
            raise Unsupported("a script aggregation must combine as it aggregates")
    begin = Script(spec["fnReset"]).value().literal if "fnReset" in spec else 0.0 if out.how == "sum" else None
    if out.how == "sum":
        if begin != 0:
            raise Unsupported("a script's sum must begin with 0: partial sums begin there, too")
        return F.coalesce(F.sum(only(out.column)), F.lit(0.0))
    best = (F.max if out.how == "max" else F.min)(only(out.column))
    return best if begin is None else (F.greatest if out.how == "max" else F.least)(best, F.lit(begin))
