"""RE2-shaped patterns for Java's engine, which Spark uses.

Differences that matter: word boundaries and white space are ASCII only, letters
fold over all of Unicode, ``$`` means the end of the text, and the dot stops at
line feeds only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_SPACE = r"\t\n\f\r "


_CLASS = r"\[(?:[0-9A-Za-z]-[0-9A-Za-z]|[0-9A-Za-z_]|\\d)+\]"


def _word_next(rest: str) -> bool:
    """Whether what follows must start with an ASCII word character."""
    m = re.match(rf"(?:[0-9A-Za-z_]|\\d|{_CLASS})(?![?*]|\{{0)", rest)
    return bool(m)


def _word_before(done: str) -> bool:
    """Whether what precedes must end with one."""
    m = re.search(rf"(?:(?<!\\)[0-9A-Za-z_]|\\d|{_CLASS})(?:\+|\{{[1-9][0-9]*(?:,[0-9]*)?\}})?$", done)
    return bool(m) and "|" not in done[m.start() :]


def java(pattern: str) -> str:
    """The same language for ``java.util.regex``."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            if two == r"\b" and not inside:
                # beside a character that is known to be of a word, one look is enough
                out.append("(?<![0-9A-Za-z_])" if _word_next(pattern[i + 2 :]) else "(?![0-9A-Za-z_])" if _word_before(pattern[:i]) else _BOUNDARY)
            elif two == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{_SPACE}]")
            elif two == r"\W" and not inside:
                out.append("[^0-9A-Za-z_]")
            elif two == r"\d":
                out.append("0-9" if inside else "[0-9]")
            else:
                out.append(two)
            i += 2
            continue
        c = pattern[i]
        if inside and c == "[":
            out.append(r"\[")  # Java nests classes
        elif inside and c == "&":
            out.append(r"\&")
        else:
            if c == "[":
                inside = True
                if pattern[i + 1 : i + 2] == "^":
                    out.append("[^")
                    i += 2
                    if pattern[i : i + 1] == "]":
                        out.append(r"\]")
                        i += 1
                    continue
            elif c == "]":
                inside = False
            out.append(r"\z" if c == "$" and not inside and "(?m)" not in pattern else c)
        i += 1
    text = "".join(out)
    flags = "(?d)"
    while m := re.match(r"\(\?([im]+)\)", text):
        flags += "(?iu)" if "i" in m[1] else "(?m)"
        text = text[m.end() :]
    return flags + text


def groups(pattern: str) -> list[int]:
    """Places of the opening brackets of all capture groups."""
    found, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += pattern[i + 1 : i + 2] == "^"
            i += pattern[i + 1 : i + 2] == "]"
        elif c == "(" and pattern[i + 1 : i + 2] != "?":
            found.append(i)
        i += 1
    return found


def split_group(pattern: str, group: int) -> str:
    """The pattern with two capture groups: what precedes the given one within the match, and that one.

    Group 1 of the result then tells where the value starts, which Spark's functions do not.
    """
    flags = re.match(r"(?:\(\?[im]+\))*", pattern)[0]
    at = groups(pattern)[group - 1]
    before = list(pattern[len(flags) : at])
    for p in reversed([g for g in groups(pattern) if g < at]):
        before.insert(p - len(flags) + 1, "?:")
    rest = list(pattern[at + 1 :])
    for p in reversed([g for g in groups(pattern) if g > at]):
        rest.insert(p - at, "?:")
    return f"{flags}({''.join(before)})({''.join(rest)}"


def literal(text: Column) -> Column:
    """A column's text quoted for a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quoted(text: Column) -> Column:
    """The same as a pattern by itself, in either case."""
    return F.concat(F.lit("(?iu)"), literal(text))
