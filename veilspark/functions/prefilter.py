"""Cheap necessary conditions of a pattern, tested before its regular expression.

From the pattern's parse tree: whether every match holds a digit, and a set of
literals of which every match holds at least one (in lower case). Most texts
fail these, and then the expression never runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives that are followed before a literal is cut.
MOST = 64


@dataclass(frozen=True)
class Gate:
    digit: bool
    words: tuple[str, ...]

    def column(self, low: Column, digit: Column) -> Column | None:
        """The condition over the lowered text and whether it has a digit (None: always)."""
        tests = [digit] if self.digit else []
        if self.words:
            tests.append(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in self.words)))
        return reduce(lambda a, b: a & b, tests) if tests else None


    def sql(self, low: str, digit: str, quote) -> str:
        """The same by names of columns (empty: always)."""
        words = " OR ".join(f"contains({low}, {quote(w)})" for w in self.words)
        return " AND ".join(x for x in (digit if self.digit else "", f"({words})" if words else "") if x)


def lowered(text: Column) -> Column:
    """Lower case as patterns fold it: the long s is an s."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def _good(words: frozenset[str]) -> int:
    """How telling a set of literals is; 0: not at all."""
    if not words or any(not w for w in words):
        return 0
    least = min(words, key=len)
    return len(least) if len(least) > 1 else int(not least.isalnum() and least not in " -.,:;")


def _sequence(items) -> tuple[frozenset[str] | None, frozenset[str], bool]:
    """The strings a sequence matches (None: not listed), a set of literals of which it holds one, and whether it holds a digit."""
    run, best, whole, digit = frozenset([""]), frozenset(), True, False
    for op, arg in items:
        exact, found, has = _node(op, arg)
        digit |= has
        best = max(best, found, key=_good)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
        else:
            best, whole, run = max(best, run, key=_good), False, frozenset([""])
    best = max(best, run, key=_good)
    return (run if whole else None), best, digit


def _node(op, arg) -> tuple[frozenset[str] | None, frozenset[str], bool]:
    nothing = frozenset()
    if op is sre.LITERAL:
        c = chr(arg)
        return frozenset([c.lower()]), frozenset([c.lower()]), c in "0123456789"
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg):
            chars = frozenset(chr(a).lower() for _, a in arg)
            return chars, chars, all(c in "0123456789" for c in chars)
        return None, nothing, all((o is sre.RANGE and 48 <= a[0] and a[1] <= 57) or (o is sre.LITERAL and 48 <= a <= 57) or (o is sre.CATEGORY and a is sre.CATEGORY_DIGIT) for o, a in arg)
    if op is sre.CATEGORY:
        return None, nothing, arg is sre.CATEGORY_DIGIT
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        exact = frozenset().union(*(e for e, _, _ in parts)) if all(e is not None for e, _, _ in parts) else None
        best = frozenset().union(*(b for _, b, _ in parts)) if all(_good(b) for _, b, _ in parts) else nothing
        return exact if exact is not None and len(exact) <= MOST else None, best, all(d for _, _, d in parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, found, digit = _sequence(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, nothing, False
        if exact is not None and low == high == 1:
            return exact, found, digit
        return None, found if low else nothing, digit and low > 0
    if op is sre.AT:
        return frozenset([""]), nothing, False
    return None, nothing, False


@lru_cache(maxsize=512)
def gate(pattern: str) -> Gate:
    _, words, digit = _sequence(parser.parse(pattern))
    return Gate(digit, tuple(sorted(words)) if _good(words) else ())
