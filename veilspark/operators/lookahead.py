"""The two steps of the structural tier that look ahead of a match. They work on one text at a time."""

from __future__ import annotations

import hashlib
import hmac
import re

from ..functions.spans import TOKEN

_WORD = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\b", _WORD))


def _patterns() -> dict[str, re.Pattern]:
    from .detect import CAPITALISED, CONJUNCTION, POSSESSIVE, TITLES

    return {"title": _compiled(TITLES), "capital": _compiled(CAPITALISED), "possessive": _compiled(POSSESSIVE), "and": _compiled(CONJUNCTION), "token": re.compile(TOKEN), "word": re.compile(r"\S+")}


def _token(entity: str, value: str, key: bytes) -> str:
    return f"[{entity}_{hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:16]}]"


def titles(text: str, key: bytes) -> tuple[str, list[str], list[str]]:
    """A title before capitalised words becomes a token whose value is the title with these words.

    The words themselves stay for the next step; each title looks at what follows it.
    """
    p = _patterns()
    out, at, values = [], 0, []
    for m in p["title"].finditer(text):
        words = []
        for w in p["word"].finditer(text, m.end()):
            if not p["capital"].search(w[0]):
                break
            words.append(w[0])
        if words:
            values.append(" ".join([m[0], *words]))
            out += [text[at : m.start()], _token("HEALTH_ENTITY", values[-1], key)]
            at = m.end()
    return "".join([*out, text[at:]]), ["HEALTH_ENTITY"] * len(values), values


def neighbours(text: str, key: bytes) -> tuple[str, list[str], list[str]]:
    """A token takes in the capitalised words, possessives and conjunctions with such words that follow it."""
    p = _patterns()
    out, at, entities, values = [], 0, [], []
    for m in p["token"].finditer(text):
        if m.start() < at:
            continue
        end, words = m.end(), iter(p["word"].finditer(text, m.end()))
        pending = next(words, None)
        while pending is not None:
            w = pending
            pending = next(words, None)
            if p["and"].search(w[0]) and pending is not None and p["capital"].search(pending[0]):
                end, pending = pending.end(), next(words, None)
            elif p["capital"].search(w[0]) or p["possessive"].search(w[0]):
                end = w.end()
            else:
                break
        out.append(text[at : m.start()])
        if end > m.end():
            entities.append(m[0].strip("[]").split("_")[0])
            values.append(text[m.start() : end])
            out.append(_token(entities[-1], values[-1], key))
        else:
            out.append(m[0])
        at = end
    return "".join([*out, text[at:]]), entities, values


STEPS = {"titles": titles, "neighbours": neighbours}
