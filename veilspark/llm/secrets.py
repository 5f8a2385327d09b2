"""Secret scans by a trigram inverted index.

Each rule is a regular expression. From its parse tree follows a Boolean query
of the trigrams that every match must contain; per block of texts an inverted
index gives, for each trigram that some rule needs, the posting list of texts
that hold it. Queries intersect and unite postings, and only the candidates
are verified with the expression itself. A rule without mandatory trigrams is
verified on every text.

Trigrams are of lower-cased ASCII bytes, so that rules in either case share
them. The index covers whole texts; blocks bound its memory and make it as
parallel as the scan, with no shuffle.

Defined cases: null and empty texts have no spans; offsets are code points,
end exclusive; matches of one rule never overlap, those of different rules may;
a match that fails its rule's length is dropped and its text is not searched
again by that rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import sha256, slices, small_batches

try:  # the standard library's own parser of regular expressions
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match must have. ``fold``: letters match in either case (ASCII only)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Published shapes of further credentials.
MORE = (
    # to the END line, or else over the base64 lines that follow
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x09-\x0d\x20]+[A-Za-z0-9+/=]{16,})*)"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~-]*:[^\x00-\x20/@\x22\x27\x7f-\U0010ffff]{3,}@"),
)
RULES = BASE + MORE

# A query is True (all texts), or ("and" | "or", queries), or a trigram of bytes.
Query = bool | bytes | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or":
        return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


#: Alternatives of a string set that are followed before it is cut.
MOST = 64


def _trigrams(strings: frozenset[str]) -> Query:
    """What holds for a text with at least one of the strings."""
    options = []
    for s in sorted(strings):
        raw = s.encode().lower()
        options.append(_both("and", [raw[i : i + 3] for i in range(len(raw) - 2)]))
    return _both("or", options)


def _analyse(items) -> tuple[frozenset[str] | None, Query]:
    """The exact strings that a sequence matches (None: too many) and the query of what it must contain besides."""
    run: frozenset[str] = frozenset([""])
    known, queries = True, []

    def close() -> None:
        nonlocal run
        queries.append(_trigrams(run))
        run = frozenset([""])

    for op, arg in items:
        exact, query = _node(op, arg)
        queries.append(query)
        if exact is not None and len(exact) * len(run) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
        else:
            close()
            known = False
            if exact is not None and len(exact) <= MOST:
                run = exact
    if known:
        return run, _both("and", queries)
    close()
    return None, _both("and", queries)


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower() if arg < 128 else chr(arg)]), True
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        chars: set[str] = set()
        for o, a in arg:
            low, high = (a, a) if o is sre.LITERAL else a
            if high - low >= MOST:
                return None, True
            chars |= {chr(c).lower() if c < 128 else chr(c) for c in range(low, high + 1)}
        return (frozenset(chars) if len(chars) <= MOST else None), True
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        found = [_analyse(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and len(exact := frozenset().union(*(e for e, _ in found))) <= MOST:
            return exact, _both("or", [q for _, q in found])
        return None, _both("or", [_both("and", [q, _trigrams(e) if e is not None else True]) for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _analyse(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, True
        if low and exact is not None and low == high and len(exact) ** low <= MOST:
            out = frozenset([""])
            for _ in range(low):
                out = frozenset(a + b for a in out for b in exact)
            return out, query
        return None, _both("and", [query, _trigrams(exact) if exact is not None else True]) if low else True
    if op is sre.AT:
        return frozenset([""]), True
    return None, True


def trigram_query(pattern: str) -> Query:
    """The Boolean query of trigrams that every match of ``pattern`` satisfies."""
    exact, query = _analyse(sre_parse.parse(pattern))
    return _both("and", [query, _trigrams(exact) if exact is not None else True])


def needed(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(needed, query[1]))


class Index:
    """Posting lists of a block of texts, for the trigrams in ``vocabulary``."""

    def __init__(self, texts: list[bytes], vocabulary: list[bytes], table: np.ndarray):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        self.rows, self.postings = len(texts), {}
        found = np.zeros(0, np.int64)
        if len(data) >= 3:
            code = data[:-2].astype(np.uint32)
            code <<= 8
            code |= data[1:-1]
            code <<= 8
            code |= data[2:]
            number = table[code]
            at = np.flatnonzero(number)
            row = np.searchsorted(np.cumsum(sizes), at, side="right")
            inside = row == np.searchsorted(np.cumsum(sizes), at + 2, side="right")
            found = np.unique(number[at[inside]].astype(np.int64) << 32 | row[inside])
        lists = np.split(found & 0xFFFFFFFF, np.searchsorted(found >> 32, np.arange(2, len(vocabulary) + 1)))
        self.postings = dict(zip(vocabulary, lists, strict=False)) if vocabulary else {}

    def rows_of(self, query: Query) -> np.ndarray:
        """Rows that satisfy the query, in order."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        if kind == "or":
            return np.unique(np.concatenate([self.rows_of(p) for p in parts]))
        out = None
        for p in parts:
            out = self.rows_of(p) if out is None else np.intersect1d(out, self.rows_of(p), assume_unique=True)
            if not len(out):
                break
        return out


@lru_cache(maxsize=4)
def plan(rules: tuple[Rule, ...]) -> tuple[list, list[bytes], np.ndarray]:
    """Compiled rules with their queries, the trigrams they need, and the numbers of these (from 1) by code."""
    queries = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
    vocabulary = sorted(set().union(*(needed(q) for _, _, q in queries)))
    table = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(vocabulary):
        table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    return queries, vocabulary, table


def _quick(rule: Rule, pattern: re.Pattern) -> re.Pattern:
    """For a single repeated class, failing matches are short maximal runs: the length can go into the expression."""
    tree = list(sre_parse.parse(rule.pattern))
    if rule.group == 0 and rule.least and len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and tree[0][1][0] <= rule.least and tree[0][1][1] is sre.MAXREPEAT and rule.pattern.endswith("+"):
        return re.compile(rule.pattern[:-1] + "{%d,}" % rule.least, pattern.flags)
    return pattern


def spans_of(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text the (start, number of the rule, end) of all matches that hold, in order."""
    queries, vocabulary, table = plan(rules)
    index = Index([t.encode() for t in texts], vocabulary, table)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, query) in enumerate(queries):
        search = _quick(rule, pattern)
        for i in index.rows_of(query).tolist():
            for m in search.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for x in out:
        x.sort()
    return out


def _map(df: DataFrame, text: str, made: str, rows) -> DataFrame:
    names = [x.strip().split()[0] for x in made.split(";")]
    keep = [f for f in df.schema if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            columns = zip(*(rows(t, s) for t, s in zip(texts, spans_of(texts), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(c) for c in columns], names=[f.name for f in keep] + names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + made.split(";")))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_<kind> for the base kinds, the digest of the base spans, and all spans as text."""

    def rows(t: str, spans: list[tuple[int, int, int]]) -> tuple:
        tell = lambda some: ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in some)
        own = [x for x in spans if x[1] < len(BASE)]
        return (*(sum(x[1] == k for x in own) for k in range(len(BASE))), sha256(tell(own).encode()), tell(spans))

    return _map(df, text, "n_assign long;n_access long;n_hex long;base_sha256 string;spans string", rows)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", out: str = "redacted") -> DataFrame:
    """Adds the text with every span (overlapping ones united) replaced by ``mark``, and the number of united spans."""

    def rows(t: str, spans: list[tuple[int, int, int]]) -> tuple:
        done, parts, n, end = 0, [], 0, -1
        for s, _, e in spans:
            if s >= end:
                parts += [t[done:s], mark]
                n += 1
            end = done = max(end, e)
        return "".join([*parts, t[done:]]), n

    return _map(df, text, f"{out} string;n_secrets long", rows)
