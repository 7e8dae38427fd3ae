"""Equality of mathematical answers by value: both become rational functions with exact coefficients.

An answer is a number, an expression (fractions, products, powers with whole exponents, square roots, letters), or a
tuple, interval or set of such; `x = ...` counts as its right side. Two values are equal if their difference is
the zero polynomial over a common denominator. What is no such answer, or passes LIMITS, compares as text, as
`normalize_answer` does. Letters and Greek names are free variables; a square root of a rational number is its
square-free part.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

#: Characters of an answer, digits of a number, size of an exponent, terms of a polynomial.
LIMITS = {"text": 1000, "digits": 60, "power": 40, "terms": 400}
LARGEST = 10 ** (LIMITS["power"] * LIMITS["digits"])  # of a coefficient's two parts

TOKEN = re.compile(r"\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\d])|\d+\.\d+|\.\d+|\d+\.?|\\[a-zA-Z]+|\\[{}%]|[a-zA-Z]|.)", re.S)
DROPPED = re.compile(r"\\left|\\right|\\[,;:! ]|\\text\s*\{[^{}]*\}|\\mathrm\s*\{[^{}]*\}|\^\s*\{?\s*\\circ\s*\}?|\$|\\displaystyle|\\ ")
PLAIN = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\%": "%", "−": "-", "·": "*", "×": "*", "÷": "/", "π": "\\pi", "\\lbrace": "\\{", "\\rbrace": "\\}"}
#: Words are no products of letters: an answer of letters only, or three letters in a row.
WORDS = re.compile(r"(?<![a-zA-Z\\])[a-zA-Z]{3,}|^[^\w\\]*[a-zA-Z][a-zA-Z\s]*[a-zA-Z][^\w\\]*$")
#: A plain number, far below the limits.
DECIMAL = re.compile(r"[0-9]{1,20}(?:\.[0-9]{1,20})?")
CLOSING = {"(": ")", "[": "]", "{": "}", "\\{": "\\}"}


class Unreadable(ValueError):
    pass


# A polynomial maps monomials (sorted pairs of a letter and its exponent; an int letter is a square root) to ints and Fractions.


def _monomial(x: tuple, y: tuple) -> tuple[int, tuple]:
    powers: dict = {}
    factor, root = 1, 1
    for name, n in (*x, *y):
        if isinstance(name, int):  # roots of square-free numbers: one root is left
            both = _gcd(root, name)
            factor, root = factor * both, root * name // (both * both)
        else:
            powers[name] = powers.get(name, 0) + n
    if max(powers.values(), default=0) > LIMITS["power"]:
        raise Unreadable
    return factor, tuple(sorted(powers.items())) + (((root, 1),) if root > 1 else ())


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def plus(x: dict, y: dict, sign: int = 1) -> dict:
    out = dict(x)
    for m, c in y.items():
        out[m] = out.get(m, 0) + sign * c
        if not out[m]:
            del out[m]
    return out


def times(x: dict, y: dict) -> dict:
    out: dict = {}
    if len(x) * len(y) > LIMITS["terms"] ** 2:
        raise Unreadable
    if len(x) == 1 and () in x:
        x, y = y, x
    if len(y) == 1 and () in y:  # by a number, which leaves the monomials as they are
        d = y[()]
        out = x if d == 1 else {m: c * d for m, c in x.items()}
    else:
        for a, c in x.items():
            for b, d in y.items():
                f, m = _monomial(a, b)
                out[m] = out.get(m, 0) + f * c * d
        out = {m: c for m, c in out.items() if c}
    if len(out) > LIMITS["terms"] or any(max(abs(c.numerator), c.denominator) > LARGEST for c in out.values()):
        raise Unreadable
    return out


ONE: dict = {(): 1}


class Value:
    """A rational function: two polynomials."""

    def __init__(self, top: dict, bottom: dict = ONE):
        if not bottom:
            raise Unreadable
        self.top, self.bottom = top, bottom

    def __add__(self, other: Value) -> Value:
        if self.bottom == other.bottom:
            return Value(plus(self.top, other.top), self.bottom)
        return Value(plus(times(self.top, other.bottom), times(other.top, self.bottom)), times(self.bottom, other.bottom))

    def __neg__(self) -> Value:
        return Value({m: -c for m, c in self.top.items()}, self.bottom)

    def __mul__(self, other: Value) -> Value:
        return Value(times(self.top, other.top), times(self.bottom, other.bottom))

    def over(self, other: Value) -> Value:
        return self * Value(other.bottom, other.top)

    def same(self, other: Value) -> bool:
        return times(self.top, other.bottom) == times(other.top, self.bottom)

    def rational(self) -> Fraction:
        if self.top.keys() <= {()} and self.bottom.keys() == {()}:
            return Fraction(self.top.get((), 0)) / self.bottom[()]
        raise Unreadable

    def power(self, n: int) -> Value:
        if abs(n) > LIMITS["power"]:
            raise Unreadable
        out = reduce(lambda a, _: a * self, range(abs(n)), Value(ONE))
        return out if n >= 0 else Value(ONE).over(out)


def root(x: Fraction) -> Value:
    """The square root of a rational number that is not negative."""
    n, outside, k = x.numerator * x.denominator, 1, 2
    if n < 0 or n > 10**12:
        raise Unreadable
    while k * k <= n:
        while n % (k * k) == 0:
            n, outside = n // (k * k), outside * k
        k += 1
    return Value({((n, 1),) if n > 1 else (): Fraction(outside, x.denominator)} if n else {})


class Parser:
    def __init__(self, text: str):
        if len(text) > LIMITS["text"]:
            raise Unreadable
        text = DROPPED.sub(" ", text)
        if WORDS.search(text):
            raise Unreadable
        found = [PLAIN.get(t, t) for t in TOKEN.findall(text.strip().rstrip("."))]
        self.tokens, self.at = [t for t in found if t.strip()], 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        t = self.peek()
        if not t or expected is not None and t != expected:
            raise Unreadable
        self.at += 1
        return t

    def sum(self) -> Value:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + (self.product() if self.take() == "+" else -self.product())
        return out

    def product(self) -> Value:
        out = self.signed()
        while True:
            t = self.peek()
            if t == "*" or t == "/":
                self.take()
                out = out * self.signed() if t == "*" else out.over(self.signed())
            elif t and (t in ("(", "{", "\\frac", "\\sqrt", "\\pi") or t[0].isalpha() or t[0] == "\\" and t[1:2].isalpha()):
                mixed = t == "\\frac" and self.tokens[self.at - 1].isdigit()  # 2 1/2 with a stacked fraction
                out = out + self.raised() if mixed else out * self.raised()
            else:
                return out

    def signed(self) -> Value:
        if self.peek() in ("+", "-"):
            return self.signed() if self.take() == "+" else -self.signed()
        return self.raised()

    def raised(self) -> Value:
        out = self.atom()
        while self.peek() in ("^", "%"):
            if self.take() == "%":
                out = out * Value({(): Fraction(1, 100)})
                continue
            n = (self.group() if self.peek() == "{" else self.signed()).rational()
            if n.denominator != 1:
                raise Unreadable
            out = out.power(n.numerator)
        return out

    def group(self) -> Value:
        closing = CLOSING[self.take()]
        out = self.sum()
        self.take(closing)
        return out

    def argument(self) -> Value:
        """In braces, or one digit or letter."""
        if self.peek() == "{":
            return self.group()
        t = self.take()
        if t[0].isdigit() and len(t) > 1 and t.isdigit():  # \frac12: digits one by one
            self.tokens.insert(self.at, t[1:])
            t = t[0]
        self.at -= 1
        self.tokens[self.at] = t
        return self.atom()

    def atom(self) -> Value:
        t = self.peek()
        if t in ("(", "{"):
            return self.group()
        t = self.take()
        if t == "\\frac":
            top = self.argument()
            return top.over(self.argument())
        if t == "\\sqrt":
            return root(self.argument().rational())
        if t[0].isdigit() or t[0] == ".":
            if len(t) > LIMITS["digits"]:
                raise Unreadable
            digits = t.replace(",", "").rstrip(".")
            number = Fraction(digits) if "." in digits else int(digits)
            return Value({(): number} if number else {})
        if t[0].isalpha() or t[0] == "\\" and t[1:2].isalpha():
            return Value({((t, 1),): 1})
        raise Unreadable

    def answer(self):
        """A Value, or (opening bracket, closing bracket, list of answers)."""
        if len(self.tokens) > 2 and self.tokens[1] == "=" and self.tokens[0].isalpha():
            self.at = 2
        start, opening = self.at, self.peek()
        if opening in ("(", "[", "\\{"):
            try:
                self.take()
                parts = [self.sum()]
                while self.peek() == ",":
                    self.take()
                    parts.append(self.sum())
                closing = self.take()
                if closing in (")", "]", "\\}") and self.at == len(self.tokens) and (len(parts) > 1 or opening == "\\{"):
                    return opening, closing, parts
            except Unreadable:
                pass
            self.at = start
        out = self.sum()
        if self.at < len(self.tokens):
            raise Unreadable
        return out


def read_answer(text: str):
    """The answer's value, or None if it is no such answer."""
    if DECIMAL.fullmatch(text):
        whole, _, rest = text.partition(".")
        return Value({k: v for k, v in {(): Fraction(int(whole + rest), 10 ** len(rest))}.items() if v})
    try:
        return Parser(text).answer()
    except (Unreadable, RecursionError):
        return None


def _plain(text: str) -> str:
    return re.sub(r"\s+", "", text).rstrip(".").lower()


def same_answer(a: str | None, b: str | None, known: dict | None = None) -> bool:
    """known: answers read before, with their values."""
    if a is None or b is None:
        return False
    known = {} if known is None else known
    for t in (a, b):
        if t not in known:
            known[t] = read_answer(t)
    x, y = known[a], known[b]
    try:
        if isinstance(x, Value) and isinstance(y, Value):
            return x.same(y)
        if isinstance(x, tuple) and isinstance(y, tuple):
            if x[:2] != y[:2] or len(x[2]) != len(y[2]):
                return False
            if x[0] != "\\{":
                return all(p.same(q) for p, q in zip(x[2], y[2]))
            return all(any(p.same(q) for q in y[2]) for p in x[2]) and all(any(p.same(q) for p in x[2]) for q in y[2])
    except Unreadable:
        pass
    return _plain(a) == _plain(b)


@pandas_udf(BooleanType())
def _equivalent(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}  # of one batch: a gold answer comes with many predictions
    return pd.Series([same_answer(x, y, known) for x, y in zip(a, b)], dtype="bool")


def equivalent(predicted: Column, gold: Column) -> Column:
    """Whether two answers have one value; a missing one has none."""
    return _equivalent(predicted, gold)
