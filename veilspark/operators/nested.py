"""Nested and encoded values: JSON, Base64 and URL escapes, to any depth.

A value's leaves are taken out as rows, so that they are redacted like any
other column, and put back where they were, encoded as they were. Two Arrow
steps frame the native pipeline; nothing recursive runs per row in it.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import java

_EMBEDDED = re.compile(r"[A-Za-z0-9+/=]{20,}")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def _decoded(s: str) -> str | None:
    """The text that a strict, padded or unpadded Base64 string stands for, or None."""
    body = s.replace("\r", "").replace("\n", "")
    bare = body.rstrip("=")
    if not re.fullmatch(r"[A-Za-z0-9+/]+", bare) or len(bare) % 4 == 1 or (len(body) != len(bare) and len(body) % 4):
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4)).decode()
    except (ValueError, UnicodeDecodeError):
        return None


def _json(value) -> str:
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def walk(value, leaf: Callable[[str], str]):
    """Rebuilds a value with every leaf text mapped; keys and other kinds stay.

    Layers are unwrapped however many there are: each is shorter than the one around it. They are kept on a stack of
    this function's own, so depth is no matter. JSON too deep for the parser is a text like any other.
    """
    stack, made = [_walk(value, leaf)], None
    while stack:
        try:
            step = stack[-1].send(made)
        except StopIteration as done:
            stack.pop()
            made = done.value
        else:
            stack.append(step)
            made = None
    return made


def _walk(value, leaf: Callable[[str], str]):
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            out[k] = yield _walk(v, leaf)
        return out
    if isinstance(value, list):
        out = []
        for v in value:
            out.append((yield _walk(v, leaf)))
        return out
    if not isinstance(value, str):
        return value
    if len(value.encode()) > 8 and (inner := _decoded(value)) is not None:
        return base64.b64encode((yield _inner(inner, leaf)).encode()).decode()
    if "%" in value and not _BAD_ESCAPE.search(value) and (plain := unquote_plus(value)) != value:
        return quote_plus((yield _inner(plain, leaf)), safe="~")
    return (yield _inner(value, leaf))


def _inner(text: str, leaf: Callable[[str], str]):
    """A text that may be JSON, or may hold Base64 runs."""
    stripped = text.strip()
    if stripped[:1] in "{[" and stripped[-1:] in "}]" and stripped:
        try:
            value = json.loads(stripped)
            _json(value)  # what cannot be written again is no JSON here
        except (ValueError, RecursionError):
            pass
        else:
            return _json((yield _walk(value, leaf)))
    # runs stay out of the text's own leaf: what is between them is one leaf each
    pieces, at = [], 0
    for m in _EMBEDDED.finditer(text):
        inner = _decoded(m[0])
        if inner:
            pieces += [leaf(text[at : m.start()]), base64.b64encode((yield _inner(inner, leaf)).encode()).decode()]
            at = m.end()
    return "".join([*pieces, leaf(text[at:])])


def _top(text: str) -> object:
    try:
        value = json.loads(text)
        _json(value)
    except (ValueError, RecursionError):
        return text
    return value if isinstance(value, (dict, list)) else text


#: A string of a JSON text, with the colon that makes it a key; or space between tokens.
_SPELT = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:)?|\s+', re.DOTALL)


def mapped(text: str, leaf: Callable[[str], str], spelt: bool = False) -> str:
    """A value with every leaf text mapped. JSON is written anew with sorted keys, or, ``spelt``, with its keys in their order
    (repeated ones too) and its numbers as they were written; JSON texts within its strings are sorted either way."""
    top = _top(text)
    if not spelt or isinstance(top, str):
        made = walk(top, leaf)
        return made if isinstance(made, str) else _json(made)

    def one(m: re.Match) -> str:
        if m[1] is None:
            return ""
        value = json.loads(m[1], strict=False)
        return _json(value) + ":" if m[2] else _json(walk(value, leaf))

    return _SPELT.sub(one, text)


def leaves(spelt: bool = False):
    """All leaf texts of values."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            found: list[str] = []
            if t is not None:
                mapped(t, lambda s: found.append(s) or s, spelt)
            return found

        return texts.map(one, na_action=None)

    return run


def rebuilt(spelt: bool = False):
    """Values with leaves replaced."""

    def one(t, a, b):
        if t is None:
            return None
        known = dict(zip(a if a is not None else (), b if b is not None else (), strict=True))
        return mapped(t, lambda s: known.get(s, s), spelt)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([one(t, a, b) for t, a, b in zip(texts, old, new, strict=True)], dtype=object)

    return run


def redact(df: DataFrame, text: str, inner: Callable[[DataFrame], DataFrame], out: str = "redacted", spelt: bool = False) -> DataFrame:
    """Redacts the leaves of values. ``inner`` maps a frame with a column ``text`` to one with ``redacted`` besides.
    ``spelt`` keeps the order of keys and the spelling of numbers.

    Leaves that repeat are redacted once; the result is joined back by the value's digest.
    """
    df = df.withColumn("_k", F.sha2(F.coalesce(text, F.lit("")), 256))
    values = df.select("_k", F.col(text).alias("_v")).where("_v IS NOT NULL").dropDuplicates(["_k"])
    parts = values.select("_k", F.explode(F.array_distinct(leaves(spelt)("_v"))).alias("text"))
    done = inner(parts.select("text").distinct()).select("text", "redacted")
    maps = parts.join(done, "text").groupBy("_k").agg(F.collect_list(F.struct("text", "redacted")).alias("_p"))
    pairs = F.filter("_p", lambda p: ~p["text"].eqNullSafe(p["redacted"]))
    return df.join(maps, "_k", "left").withColumn(out, F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, F.col(text)).otherwise(rebuilt(spelt)(text, F.transform(pairs, lambda p: p["text"]), F.transform(pairs, lambda p: p["redacted"])))).drop("_k", "_p")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def valid_utf8(raw: Column) -> Column:
    """Text of bytes with the invalid ones left out."""
    return F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))


def url_unescaped(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def base64_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(java(_EMBEDDED.pattern)), F.lit(0))


def pretty(c: Column) -> Column:
    """JSON with line breaks and indents; other texts stay."""
    return F.coalesce(F.to_json(F.try_parse_json(c), {"pretty": "true"}), c)
