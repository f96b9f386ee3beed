"""Units in which base qualities are recorded, read from texts by a grammar.

A recorded value is a linear map of a product of powers of the error probability p and of 1 - p, or of its logarithm: an exponent vector
over DIMENSIONS with a scale and an offset. Words and formulas build it up: factors add vectors and multiply scales, quotients subtract
vectors, log and percent and the like act on what they govern. A text is read clause by clause:

    text      := sentence {("." | ";" | "!" | "?") sentence}
    sentence  := {negation | encoding | scale | expression | any other word}
    negation  := ("not" | "no" | "without") words up to the next comma, "but" or end of the sentence
    encoding  := ("origin" | "offset" | "ascii" | "from" | "at" ...) (33 | 64 | quoted character) | (33 | 64) "added" | "sanger" | "fastq" | "numbers" ...
    scale     := "percent" | "%" | "permille" | "per" number | "ppm" | "unit" number | 1 "/" number
    expression := term {("+" | "-") term}
    term      := factor {["*" | "x" | "times" | "/" | "divided by"] factor}
    factor    := number | "(" expression ")" | log factor | quantity
    log       := "log10" | "common logarithm" | "ln" | "natural log" | "log2" ... ["of" ["the"]]
    quantity  := "phred" | "solexa" | "log-odds" | "accuracy" | probability ["of", "that" ...] ("error" | "correct" ...) | "error" probability | "p"

"phred + 33" is an origin of characters. A text whose quantities contradict each other, or make up no known unit, names none.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

#: An exponent for a logarithm (0 or 1), the error probability p, and 1 - p.
DIMENSIONS = ("log", "error", "right")
#: -10 log10 p, 10 log10 ((1 - p) / p), and p.
LEVEL, ODDS, ERROR = (1, 1, 0), (1, -1, 1), (0, 1, 0)
_RIGHT, _NONE = (0, 0, 1), (0, 0, 0)


@dataclass(frozen=True)
class Unit:
    """Dimension vector, affine map to its canonical unit (canonical = scale * value + offset), and origin (None: written as numbers)."""

    vector: tuple[int, int, int]
    scale: float = 1.0
    offset: float = 0.0
    origin: int | None = None

    @property
    def name(self) -> str:
        kind = "*".join(f"{d}^{e}" if e != 1 else d for d, e in zip(DIMENSIONS, self.vector, strict=True) if e) or "1"
        return f"{kind}:{self.scale:g}:{self.offset:g}:{'num' if self.origin is None else self.origin}"


@dataclass(frozen=True)
class Value:
    """a * Q + b, where Q is the product of powers of the vector, or its common logarithm."""

    vector: tuple[int, int, int]
    a: float = 1.0
    b: float = 0.0

    def times(self, o: Value, sign: int = 1) -> Value | None:
        """The product, or with sign -1 the quotient."""
        if o.vector == _NONE:
            k = o.a if sign > 0 else (1 / o.a if o.a else None)
            return k and replace(self, a=self.a * k, b=self.b * k)
        if self.vector == _NONE and sign > 0:
            return o.times(self)
        if self.vector[0] or o.vector[0] or self.b or o.b or not o.a:
            return None
        return Value(tuple(x + sign * y for x, y in zip(self.vector, o.vector, strict=True)), self.a * o.a**sign)

    def plus(self, o: Value, sign: int = 1) -> Value | None:
        """The sum, or with sign -1 the difference."""
        if o.vector == _NONE:
            got = replace(self, a=self.a + sign * o.a) if self.vector == _NONE else replace(self, b=self.b + sign * o.a)
        elif self.vector == _NONE:
            got = replace(o, a=sign * o.a, b=self.a + sign * o.b)
        elif self.vector[0] and o.vector[0] and self.a == o.a:
            got = Value((1, *(x + sign * y for x, y in zip(self.vector[1:], o.vector[1:], strict=True))), self.a, self.b + sign * o.b)
        else:
            return None
        if got.vector in (ERROR, _RIGHT) and got.a == -got.b:  # k - k p
            return Value(_RIGHT if got.vector == ERROR else ERROR, got.b)
        return got

    def log(self, base: float) -> Value | None:
        if self.vector[0] or self.b or self.a <= 0:
            return None
        k = 1 / math.log10(base)
        return Value((1, *self.vector[1:]), k, k * math.log10(self.a)) if self.vector != _NONE else Value(_NONE, k * math.log10(self.a))

    def unit(self) -> Unit | None:
        """The unit of values that are recorded so, or None where that is none of qualities."""
        log, e, r = self.vector
        if not self.a:
            return None
        if log and e and not r:
            return Unit(LEVEL, -10 / (self.a * e), 10 * self.b / (self.a * e) + 0.0)
        if log and e and r == -e:
            return Unit(ODDS, 10 / (self.a * r), -10 * self.b / (self.a * r) + 0.0)
        if self.vector == ERROR:
            return Unit(ERROR, 1 / self.a, -self.b / self.a + 0.0)
        if self.vector == _RIGHT:
            return Unit(ERROR, -1 / self.a, 1 + self.b / self.a)
        return None


_PHRED, _SOLEXA = Value((1, 1, 0), -10.0), Value((1, -1, 1), 10.0)
_TOKEN = re.compile(r"""(?P<char>'[!@;]'|"[!@;]")|(?P<num>\d+(?:\.\d+)?(?:e-?\d+)?)|(?P<word>log10|log2|[a-z]+)|(?P<sign>[-+*×/^()%‰=,:.;!?−–\n])""")
_PROBABILITY = {"probability", "probabilities", "prob", "chance", "chances", "rate", "rates", "fraction", "likelihood"}
_WRONG = {"error", "errors", "wrong", "incorrect", "miscall", "miscalled", "false"}
_CORRECT = {"correct", "right", "true"}
_FILL = {"of", "that", "the", "a", "an", "any", "call", "calls", "base", "bases", "is", "was", "are", "for", "each", "every", "being", "to", "be", "per", "called", "(", "in"}
_PARTS = {"hundred": 100.0, "cent": 100.0, "mille": 1000.0, "mill": 1000.0, "thousand": 1000.0, "million": 1e6, "billion": 1e9}
_FIRST = {"!": 33, "@": 64, ";": 64}
_BEFORE_ORIGIN = {"origin", "offset", "ascii", "base", "starting", "start", "starts", "at", "from", "of", "is", "=", ":", ",", "+", "(", "code", "codes", "characters", "character"}


class _Reader:
    """Tokens of a text with a position; the methods return what they read, or None and stay where they were."""

    def __init__(self, text: str) -> None:
        low = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", text.lower())
        self.t = [(m.lastgroup, m[0].strip("'\"") if m.lastgroup == "char" else m[0]) for m in _TOKEN.finditer(low)]
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if 0 <= self.i + k < len(self.t) and self.t[self.i + k][0] != "char" else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if 0 <= self.i + k < len(self.t) else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def number(self) -> float | None:
        if self.kind() != "num":
            return None
        x = float(self.peek())
        self.i += 1
        if self.peek() == "^":
            sign = -1 if self.peek(1) in "-−–" and self.kind(1) == "sign" else 1
            k = 2 if sign < 0 else 1
            if self.kind(k) == "num":
                x = x ** (sign * float(self.peek(k)))
                self.i += k + 1
        return x

    def scale(self) -> float | None:
        """How many recorded units make one."""
        w = self.peek()
        if w in ("%", "percent", "percentage", "percents"):
            self.i += 1
            return 100.0
        if w in ("‰", "permille", "promille"):
            self.i += 1
            return 1000.0
        if w in ("ppm", "ppb"):
            self.i += 1
            return 1e6 if w == "ppm" else 1e9
        at = self.i
        if self.take("parts", "per") or self.take("per") or self.take("in", "a") or self.take("out", "of"):
            if self.peek() in _PARTS:
                self.i += 1
                return _PARTS[self.t[self.i - 1][1]]
            x = self.number()
            if x and x >= 10:
                return x
        elif self.take("units", "of") or self.take("unit", "of") or self.take("unit") or self.take("units"):
            x = self.number()
            if x is not None and self.take("/"):
                y = self.number()
                x = x / y if y else None
            if x:
                return 1 / x
        elif self.kind() == "num" and self.peek() == "1" and self.peek(1) == "/" and self.kind(2) == "num" and float(self.peek(2)) >= 10:
            x = float(self.peek(2))
            self.i += 3
            return x
        self.i = at
        return None

    def origin(self) -> int | None:
        """The character that stands for 0."""
        at = self.i
        if self.kind() == "num" and self.peek() in ("33", "64") and self.peek(1) == "added":
            self.i += 2
            return int(self.t[at][1])
        if self.peek() in _BEFORE_ORIGIN and self.kind() == "word" and self.peek() not in ("of", "is", "base"):
            while self.peek() in _BEFORE_ORIGIN:
                self.i += 1
            if self.kind() == "num" and self.peek() in ("33", "64") or self.kind() == "char":
                self.i += 1
                c = self.t[self.i - 1][1]
                return _FIRST.get(c) or int(c)
        self.i = at
        return None

    def logarithm(self) -> float | None:
        at = self.i
        base = None
        if self.take("log10") or self.take("lg"):
            base = 10.0
        elif self.take("log2"):
            base = 2.0
        elif self.take("ln"):
            base = math.e
        else:
            named = 10.0 if self.take("common") or self.take("decadic") else math.e if self.take("natural") else None
            if self.take("log") or self.take("logarithm") or self.take("logs") or self.take("logarithms"):
                base = named or 10.0
                if named is None and self.take("to", "base"):
                    base = self.number() or 0
        if not base or base == 1:
            self.i = at
            return None
        if self.take("of"):
            for w in ("the", "each", "an", "a"):
                self.take(w)
        return base

    def quantity(self, deep: bool) -> Value | None:
        at, w = self.i, self.peek()
        if self.kind() != "word":
            return None
        if self.take("phred"):
            return _PHRED
        if self.take("solexa") or self.take("log", "odds") or self.take("logodds") or self.take("odds"):
            while self.take("odds") or self.take("log", "odds"):
                pass
            return _SOLEXA
        if w in ("accuracy", "accuracies"):
            self.i += 1
            return Value(_RIGHT)
        if w in _PROBABILITY or w == "p":
            self.i += 1
            for k in range(8):
                x = self.peek(k)
                if x in _WRONG or x in _CORRECT:
                    opened = any(self.peek(n) == "(" for n in range(k))
                    self.i += k + 1
                    if opened:
                        self.take(")")
                    return Value(ERROR if x in _WRONG else _RIGHT)
                if x not in _FILL:
                    break
            if w == "p" and deep:
                return Value(ERROR)
        elif w in _WRONG or w in _CORRECT:
            self.i += 1
            v = Value(ERROR if w in _WRONG else _RIGHT)
            if self.peek() in _PROBABILITY:
                self.i += 1
                return v
            before, here = (self.t[at - 1][1] if at else ""), self.i
            while self.peek() in ("(", "in", "as"):
                self.i += 1
            scaled = self.scale() is not None
            self.i = here
            if deep or scaled or before in ("%", "‰", "percent", "permille", "ppm", "expected", "fraction"):
                return v
        self.i = at
        return None

    def factor(self, deep: bool) -> Value | None:
        at = self.i
        if (x := self.number()) is not None:
            return Value(_NONE, x)
        if self.take("("):
            v = self.expression(True)
            if v is not None and self.take(")"):
                return v
            self.i = at
            return None
        if self.peek() == "log" and self.peek(1) == "odds":
            return self.quantity(deep)
        if (base := self.logarithm()) is not None:
            if self.peek() in "-−–" and self.peek(1) in _WRONG:  # log10-error
                self.i += 1
            v = Value((0, -1, 1)) if self.take("odds") else self.factor(True)
            v = v and v.log(base)
            if v is None:
                self.i = at
            return v
        return self.quantity(deep)

    def term(self, deep: bool) -> Value | None:
        v = self.factor(deep)
        while v is not None:
            at = self.i
            sign = 1 if self.take("*") or self.take("×") or self.take("x") or self.take("times") or self.take("multiplied", "by") else -1 if self.take("/") or self.take("divided", "by") or self.take("over") else 0
            if not sign:
                # 10 log10 p: a number in front of what it multiplies
                nearby = v.vector == _NONE and (self.peek() in ("log10", "log2", "ln", "lg", "(") or self.peek() in ("log", "natural", "common") and self.peek(1) != "odds")
                if not nearby:
                    return v
                sign = 1
            o = self.factor(True)
            got = o and v.times(o, sign)
            if got is None:
                self.i = at
                return v
            v = got
        return v

    def expression(self, deep: bool = False) -> Value | None:
        at = self.i
        minus = self.kind() == "sign" and self.peek() in "-−–" or self.peek() in ("minus", "negative") and self.peek(1) in ("log10", "log", "ln", "natural", "common", "logarithm", "10")
        if minus:
            self.i += 1
        v = self.term(deep or minus)
        if v is None:
            self.i = at
            return None
        if minus:
            v = replace(v, a=-v.a, b=-v.b)
        while self.peek() and (self.peek() in "+-−–" and self.kind() == "sign" or self.peek() in ("plus", "minus")):
            here = self.i
            sign = 1 if self.peek() in ("+", "plus") else -1
            self.i += 1
            o = self.term(True)
            got = o and v.plus(o, sign)
            if got is None:
                self.i = here
                break
            v = got
        return v


def parse_unit(text: str | None) -> Unit | None:
    """The unit that a text names, or None where it names none, or several that differ.

    Null, empty and unrelated texts name no unit. Log-odds without a way of writing are characters of origin 64; a Phred level without one
    is none, as the characters must tell the origin; characters of an origin and no quantity are Phred levels."""
    if not text:
        return None
    r = _Reader(text)
    values: list[Value] = []
    origins: set[int] = set()
    numbers = fastq = False
    first, scale = 0, 1.0  # values before this one belong to sentences before; product of the scales of this sentence

    def close() -> None:
        nonlocal first, scale
        if scale != 1.0:
            values[first:] = [replace(v, a=v.a * scale, b=v.b * scale) if not v.vector[0] else v for v in values[first:]]
        first, scale = len(values), 1.0

    while r.i < len(r.t):
        if r.kind() == "sign" and r.peek() in ".;!?\n":
            close()
            r.i += 1
        elif r.peek() in ("not", "no", "without", "never"):
            while r.i < len(r.t) and not (r.kind() == "sign" and r.peek() in ",.;!?)\n") and r.peek() != "but":
                r.i += 1
        elif (o := r.origin()) is not None:
            origins.add(o)
        elif (s := r.scale()) is not None:
            scale *= s
        elif r.peek() in ("sanger", "fastq"):
            fastq = True
            r.i += 1
        elif r.peek() in ("number", "numbers", "integer", "integers", "decimal", "decimals", "spelled"):
            numbers = True
            r.i += 1
        else:
            at = r.i
            v = r.expression()
            if v is None or v.vector == _NONE:
                r.i = at + 1
            elif v.vector[0] and v.b in (33.0, 64.0):
                origins.add(int(v.b))
                values.append(replace(v, b=0.0))
            else:
                values.append(v)
                if v.vector[0] and r.peek() in ("33", "64"):
                    origins.add(int(r.peek()))
                    r.i += 1
    close()
    units = {v.unit() for v in values}
    if len({u and u.vector for u in units}) == 1:  # a name and its formula: what is scaled tells more
        units = {u for u in units if u and (u.scale, u.offset) != (1.0, 0.0)} or units
    if len(units) > 1 or None in units or len(origins) > 1:
        return None
    origin = next(iter(origins), 33 if fastq else None)
    unit = next(iter(units), None)
    if unit is None:
        return Unit(LEVEL, origin=origin) if origin is not None else None
    if unit.vector == ERROR:
        return unit
    if origin is not None and not (numbers and not origins):
        return replace(unit, origin=origin)
    if numbers or (unit.scale, unit.offset) != (1.0, 0.0):
        return unit
    return replace(unit, origin=64) if unit.vector == ODDS else None
