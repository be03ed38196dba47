"""Row predicates: a small boolean language over one field and one literal at a time, turned into a Column.

``or := and ('||' and)*``, ``and := unary ('&&' unary)*``, ``unary := '!' unary | '(' or ')' | field op value``.
The type of the field decides how its literal is read; everything wrong is reported when the plan is made.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import c, find_field, is_number

_CONDITION = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(==|!=|>=|<=|>|<|(?:contains|startswith|endswith|matches)(?=[\s\"']))\s*(.*?)\s*$", re.IGNORECASE | re.DOTALL)
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


class PredicateError(ValueError):
    pass


#: A part of a predicate: its Column, or that of its negation.
Node = Callable[[bool], Column]


def _joined(a: Node, b: Node, plain: Callable, negative: Callable) -> Node:
    return lambda negated: (negative if negated else plain)(a(negated), b(negated))


class _Parser:
    def __init__(self, text: str, schema: T.StructType):
        self.text, self.at, self.schema = text, 0, schema

    def whole(self) -> Column:
        """Positive conditions stay bare, so that scans can take them over; under a negation null counts as false."""
        if not self.text.strip():
            raise PredicateError("the predicate is empty")
        out = self.either()
        if self.rest():
            raise PredicateError(f"unexpected '{self.rest()}' in predicate '{self.text}'")
        return out(False)

    def rest(self) -> str:
        return self.text[self.at :].strip()

    def take(self, token: str) -> bool:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def either(self) -> Node:
        out = self.both()
        while self.take("||"):
            out = _joined(out, self.both(), or_, and_)
        return out

    def both(self) -> Node:
        out = self.unary()
        while self.take("&&"):
            out = _joined(out, self.unary(), and_, or_)
        return out

    def unary(self) -> Node:
        if self.take("!"):
            inner = self.unary()
            return lambda negated: inner(not negated)
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise PredicateError(f"a parenthesis is not closed in '{self.text}'")
            return out
        col = self.condition()
        return lambda negated: ~F.coalesce(col, F.lit(False)) if negated else col

    def condition(self) -> Column:
        begin, quote = self.at, ""
        while self.at < len(self.text):
            ch = self.text[self.at]
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'":
                quote = ch
            elif ch == ")" or self.text.startswith(("&&", "||"), self.at):
                break
            self.at += 1
        if quote:
            raise PredicateError(f"a quote is not closed in '{self.text}'")
        part = self.text[begin : self.at]
        m = _CONDITION.match(part)
        if not m:
            raise PredicateError(f"'{part.strip()}' is not of the form: field operator value")
        field, op, value = m[1], m[2].lower(), m[3]
        if not value:
            raise PredicateError(f"'{part.strip()}' has no value")
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        try:
            found = find_field(self.schema, field)
        except ValueError as e:
            raise PredicateError(str(e)) from e
        return compare(found, op, value)


def compare(field: T.StructField, op: str, value: str) -> Column:
    col = c(field.name)
    if is_number(field.dataType):
        if op not in _COMPARE:
            raise PredicateError(f"operator '{op}' does not fit the number field '{field.name}'")
        try:
            number = float(value.replace(",", ""))
            whole = isinstance(field.dataType, T.IntegralType) and number.is_integer() and abs(number) < 1 << 53
            return _COMPARE[op](col, F.lit(int(number))) if whole else _COMPARE[op](col.cast("double"), F.lit(number))
        except ValueError as e:
            raise PredicateError(f"'{value}' is no number for field '{field.name}'") from e
    if isinstance(field.dataType, T.BooleanType):
        if op not in ("==", "!="):
            raise PredicateError(f"operator '{op}' does not fit the boolean field '{field.name}'")
        if value.strip().lower() not in ("true", "false"):
            raise PredicateError(f"'{value}' is no boolean for field '{field.name}'")
        return _COMPARE[op](col, F.lit(value.strip().lower() == "true"))
    if isinstance(field.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        raise PredicateError(f"field '{field.name}' cannot be compared")
    low, want = F.lower(col.cast("string")), value.lower()
    if op == "==":
        return low == want
    if op == "!=":
        return low != want
    if op == "contains":
        return F.contains(low, F.lit(want))
    if op == "startswith":
        return F.startswith(low, F.lit(want))
    if op == "endswith":
        return F.endswith(low, F.lit(want))
    if op == "matches":
        return col.cast("string").rlike(f"(?i){value}")
    raise PredicateError(f"operator '{op}' does not fit the text field '{field.name}'")


def predicate(text: str, schema: T.StructType) -> Column:
    """The Column of a predicate, for filters and branches: null counts as false."""
    return _Parser(text, schema).whole()
