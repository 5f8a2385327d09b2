"""Spans of text as columns: find, verify, resolve, guard, replace.

A span is a struct of entity, value, start and end (characters, end exclusive)
with the rule's ordinal; arrays of spans are ordinary columns, so all of this
is planned as projections and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksums
from .dialect import java, split_group
from .prefilter import gate
from .rules import HEAVY, Rule

#: Tokens as they stand in text. Types may hold digits here, so that such tokens are guarded as well.
TOKEN = r"\[[A-Z_][A-Z_0-9]*_[0-9a-f]+\]"
SPAN = "struct<entity:string,value:string,start:int,end:int,rule:int>"


def none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_sql(column: str, pattern: str, group: int = 0, entity: str = "", ordinal: int = 0) -> str:
    """``find`` for a column by name, as SQL: one text is built far faster than its many calls to the JVM."""
    text, p = f"`{column}`", quote(java(split_group(pattern, group) if group else pattern))
    lead, value = (f"regexp_extract_all({text}, {p}, 1)", f"regexp_extract_all({text}, {p}, 2)") if group else ("array('')", f"regexp_extract_all({text}, {p}, 0)")
    # arrays that are not columns are zipped by number: the match, the gap before it, what stands before the group, the group
    at, before = "acc.at + char_length(m.`1`)", "char_length(m.`2`)" if group else "0"
    span = f"struct({quote(entity)} AS entity, m.`3` AS value, {at} + {before} AS start, {at} + {before} + char_length(m.`3`) AS end, {ordinal} AS rule)"
    parts = f"arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), {lead}, {value})"
    step = f"struct({at} + char_length(m.`0`) AS at, CASE WHEN coalesce(m.`3`, '') = '' THEN acc.out ELSE concat(acc.out, array({span})) END AS out)"
    none_ = f"CAST(array() AS array<{SPAN}>)"
    found = f"aggregate(filter({parts}, m -> m.`0` IS NOT NULL), struct(0 AS at, {none_} AS out), (acc, m) -> {step}, acc -> acc.out)"
    return f"CASE WHEN regexp_like({text}, {p}) THEN {found} ELSE {none_} END"


def rule_sql(column: str, rule: Rule) -> str:
    """One rule's spans that are long enough, if the text (lowered in ``_low``, its having a digit in ``_digit``) meets its necessary conditions."""
    found = f"filter({find_sql(column, rule.pattern, rule.group, rule.entity, rule.ordinal)}, s -> octet_length(s.value) >= {rule.least})"
    test = gate(rule.pattern).sql("_low", "_digit", quote)
    return f"CASE WHEN {test} THEN {found} ELSE CAST(array() AS array<{SPAN}>) END" if test else found


def find(text: Column, pattern: str | Column, group: int = 0, entity: str | Column = "", ordinal: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern, in RE2 syntax; of one capture group where given.

    Matches and the gaps between them give all offsets in one fold.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(java(split_group(pattern, group) if group else pattern))
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    lead = F.regexp_extract_all(text, p, F.lit(1)) if group else F.transform(whole, lambda _: F.lit(""))
    value = F.regexp_extract_all(text, p, F.lit(2)) if group else whole
    parts = F.arrays_zip(whole.alias("whole"), gaps.alias("gap"), lead.alias("lead"), value.alias("value"))
    entity = entity if isinstance(entity, Column) else F.lit(entity)

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.char_length(m["gap"])
        start = at + F.char_length(m["lead"])
        span = F.struct(entity.alias("entity"), m["value"].alias("value"), start.alias("start"), (start + F.char_length(m["value"])).alias("end"), F.lit(ordinal).alias("rule"))
        return F.struct((at + F.char_length(m["whole"])).alias("at"), F.when(F.coalesce(m["value"], F.lit("")) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none().alias("out"))
    found = F.aggregate(F.filter(parts, lambda m: m["whole"].isNotNull()), start, step, lambda acc: acc["out"])
    # most texts hold no match: one test decides
    return F.when(F.regexp_like(text, p), found).otherwise(none())


def verified(spans: Column, rule: Rule) -> Column:
    """Those long enough (in bytes) that pass the rule's checksum."""
    ok = lambda s: F.octet_length(s["value"]) >= rule.least
    return F.filter(spans, (lambda s: ok(s) & passes(rule)(s)) if rule.check else ok)


def passes(rule: Rule) -> Callable[[Column], Column]:
    """The rule's checksum as a test of a span."""
    return lambda s: checksums.check(rule.check, checksums.tidy(s["value"]) if rule.tidy else s["value"])


def by_rule(text: Column, rule: Rule, low: Column | None = None, digit: Column | None = None) -> Column:
    """One rule's spans. With the lowered text and whether it has a digit, its necessary conditions go first."""
    return gated(verified(find(text, rule.pattern, rule.group, rule.entity, rule.ordinal), rule), rule.pattern, low, digit)


def gated(found: Column, pattern: str, low: Column | None, digit: Column | None) -> Column:
    test = gate(pattern).column(low, digit) if low is not None else None
    return found if test is None else F.when(test, found).otherwise(none())


def resolve(spans: Column) -> Column:
    """Greedy choice without overlaps: by start, then longest, then weight, then the rules' order."""
    keyed = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("a"), (-s["end"]).alias("b"), F.when(s["entity"].isin(*HEAVY), 0).otherwise(1).alias("c"), s["rule"].alias("d"), s.alias("span")
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc: Column, k: Column) -> Column:
        s = k["span"]
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(keyed, start, step, lambda acc: acc["out"])).otherwise(none())


def apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda t: (s["start"] < t["end"]) & (s["end"] > t["start"])))


def outside(spans: Column, others: Column) -> Column:
    """Spans that do not lie wholly within one of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda t: (s["start"] >= t["start"]) & (s["end"] <= t["end"])))


def tokens(text: Column) -> Column:
    return find(text, TOKEN, 0, "TOKEN")


def splice(text: Column, spans: Column, token: Callable[[Column], Column]) -> Column:
    """The text with every span (in order, not overlapping) replaced by its token."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"]), token(s)).alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def fully_tokenised(text: Column) -> Column:
    """Whether only punctuation and space, at least one character of it, stands beside tokens."""
    rest = F.regexp_replace(text, java(TOKEN), "")
    return rest.rlike(r"^[\t\n\f\r \p{P}\p{Z}>*_|\-=+#@~]+\z")


def byte_range(text: Column, s: Column) -> Column:
    """The span's place in bytes, as ``start-end``."""
    at = F.octet_length(F.substring(text, F.lit(1), s["start"]))
    return F.concat_ws("-", at.cast("string"), (at + F.octet_length(s["value"])).cast("string"))
