"""SQL for DuckDB that reproduces the queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

import re

from ..functions import checksums as C
from ..functions.rules import HEAVY, RULES, Rule
from ..functions.spans import TOKEN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    def one(v) -> str:
        if isinstance(v, str):
            return q(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return "NULL" if v is None else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS f({columns})"


def split_group(pattern: str, group: int) -> str:
    """Two capture groups: what precedes the wanted one, and that one. Found by counting brackets."""
    flags = re.match(r"(\(\?[im]+\))*", pattern)[0]
    body, out, seen, depth_class, i = pattern[len(flags) :], [], 0, False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            out.append(body[i : i + 2])
            i += 2
            continue
        if depth_class:
            depth_class = c != "]"
        elif c == "[":
            depth_class = True
            if body[i + 1 : i + 3] in ("^]",) or body[i + 1 : i + 2] == "]":
                out.append(body[i : i + 2])
                i += 2
                continue
        elif c == "(" and body[i + 1 : i + 2] != "?":
            seen += 1
            out.append(")(" if seen == group else "(?:")
            i += 1
            continue
        out.append(c)
        i += 1
    return f"{flags}({''.join(out)}"


def spans(source: str, key: str, text: str, pattern: str, group: int = 0, entity: str = "X", rule: int = 0, extra: str = "") -> str:
    """(key, entity, value, s, e, rule) of all matches, from matches and the gaps between them."""
    wide = split_group(pattern, group) if group else pattern
    lead = f"regexp_extract_all({text}, {q(wide)}, 1)" if group else f"[('') FOR x IN regexp_extract_all({text}, {q(wide)})]"
    val = f"regexp_extract_all({text}, {q(wide)}, {2 if group else 0})"
    return f"""SELECT {key}, {q(entity)} AS entity, val[i] AS value, begins AS s, begins + length(val[i]) AS e, {rule} AS rule, txt FROM (
      SELECT *, (list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN whole[1:i-1]]), 0) + length(lead[i]))::INT AS begins FROM (
        SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
          SELECT {key}, {text} AS txt, regexp_extract_all({text}, {q(wide)}) AS whole, string_split_regex({text}, {q(wide)}) AS gaps, {lead} AS lead, {val} AS val
          FROM {source} WHERE regexp_matches({text}, {q(pattern)})))) WHERE val[i] <> ''{extra}"""


# ---------------------------------------------------------------- checksums


def tidy(v: str) -> str:
    return f"translate(upper({v}), ' -.', '')"


def _chars(v: str) -> str:
    return f"string_split({v}, '')"


def _dot(v: str, weights) -> str:
    return "(" + " + ".join(f"substr({v}, {i + 1}, 1)::INT * {w}" for i, w in enumerate(weights)) + ")"


def _safe(v: str, shape: str, test: str) -> str:
    return f"CASE WHEN regexp_full_match({v}, {q(shape)}) THEN {test} ELSE false END"


def luhn(v: str, low: int = 9) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    total = f"list_sum([CASE WHEN nth % 2 = 0 THEN (substr(reverse({d}), nth, 1)::INT * 2) // 10 + (substr(reverse({d}), nth, 1)::INT * 2) % 10 ELSE substr(reverse({d}), nth, 1)::INT END FOR nth IN range(1, length({d}) + 1)])"
    return f"CASE WHEN length({d}) BETWEEN {low} AND 19 THEN {total} % 10 = 0 ELSE false END"


def iban(v: str) -> str:
    n = tidy(v)
    number = f"array_to_string([CASE WHEN c >= 'A' THEN (ascii(c) - 55)::VARCHAR ELSE c END FOR c IN {_chars(f'substr({n}, 5) || left({n}, 4)')}], '')"
    # the number is too long for an integer: halves of it are reduced one after the other
    rest = f"((substr({number}, 1, 17)::HUGEINT % 97)::VARCHAR || substr({number}, 18, 17))::HUGEINT % 97"
    rest = f"(({rest})::VARCHAR || substr({number}, 35, 17))::HUGEINT % 97"
    rest = f"(({rest})::VARCHAR || substr({number}, 52))::HUGEINT % 97"
    return _safe(n, "[A-Z0-9]{15,34}", f"{rest} = 1")


def _cf(n: str) -> str:
    letters = "".join(C.IT_ODD)
    odd = "[" + ", ".join(map(str, C.IT_ODD.values())) + "]"
    even = "[" + ", ".join(str(i if i < 10 else i - 10) for i in range(36)) + "]"
    return " + ".join(f"{odd if i % 2 else even}[strpos('{letters}', substr({n}, {i}, 1))]" for i in range(1, 16))


def _steuer(n: str) -> str:
    return f"list_reduce([10] || [substr({n}, nth, 1)::INT FOR nth IN range(1, 11)], lambda r, d: (CASE WHEN (r + d) % 10 = 0 THEN 10 ELSE (r + d) % 10 END * 2) % 11)"


def _verhoeff(n: str) -> str:
    d = [list(map(int, r)) for r in "0123456789 1234067895 2340178956 3401289567 4012395678 5987604321 6598710432 7659821043 8765932104 9876543210".split()]
    p = [list(map(int, r)) for r in "0123456789 1576283094 5803796142 8916043527 9453126870 4286573901 2793806415 7046913258".split()]
    turned = f"[{p}[(nth % 8) + 1][substr(reverse({n}), nth + 1, 1)::INT + 1] FOR nth IN range(0, 12)]"
    return f"list_reduce([0] || {turned}, lambda c, x: {d}[c + 1][x + 1]) = 0"


def checksum(name: str, v: str) -> str:
    n = tidy(v)
    digits = lambda k: f"substr({n}, {k}, 1)"
    if name in ("luhn", "luhn_strict"):
        return luhn(v, 9 if name == "luhn" else 13)
    if name == "iban":
        return iban(v)
    if name == "es_dni":
        return _safe(n, "[XYZ0-9][0-9]{7}[A-Z]", f"substr('{C.ES_DNI}', (translate(left({n}, 1), 'XYZ', '012') || substr({n}, 2, 7))::INT % 23 + 1, 1) = {digits(9)}")
    if name == "it_cf":
        return _safe(n, "[A-Z0-9]{16}", f"chr(65 + ({_cf(n)}) % 26) = {digits(16)}")
    if name == "nl_bsn":
        z = f"lpad({n}, 9, '0')"
        return _safe(n, "[0-9]{8,9}", f"{_dot(z, (9, 8, 7, 6, 5, 4, 3, 2, -1))} <> 0 AND {_dot(z, (9, 8, 7, 6, 5, 4, 3, 2, -1))} % 11 = 0")
    if name == "pl_pesel":
        return _safe(n, "[0-9]{11}", f"(10 - {_dot(n, C.PL_WEIGHTS)} % 10) % 10 = {digits(11)}::INT")
    if name == "de_steuer_id":
        return _safe(n, "[0-9]{11}", f"CASE WHEN 11 - {_steuer(n)} = 10 THEN 0 ELSE 11 - {_steuer(n)} END = {digits(11)}::INT")
    if name == "dk_cpr":
        return _safe(n, "[0-9]{10}", f"{_dot(n, C.DK_WEIGHTS)} % 11 = 0")
    if name == "fi_hetu":
        return _safe(v, "[0-9]{6}.[0-9]{3}[0-9A-Z]", f"substr('{C.FI_HETU}', (left({v}, 6) || substr({v}, 8, 3))::BIGINT % 31 + 1, 1) = substr({v}, 11, 1)")
    if name == "se_pin":
        short = f"CASE WHEN length({n}) = 12 THEN substr({n}, 3) ELSE {n} END"
        return f"CASE WHEN length({short}) = 10 THEN {luhn(f'({short})')} ELSE false END"
    if name == "br_cpf":
        check = lambda k: f"(({_dot(n, range(k, 1, -1))} * 10) % 11) % 10"
        return _safe(n, "[0-9]{11}", f"len(list_distinct({_chars(n)})) > 1 AND {check(10)} = {digits(10)}::INT AND {check(11)} = {digits(11)}::INT")
    if name == "cl_rut":
        total = f"list_sum([substr(reverse({n}), nth + 2, 1)::INT * (nth % 6 + 2) FOR nth IN range(0, length({n}) - 1)])"
        return _safe(n, "[0-9]{7,8}[0-9K]", f"CASE 11 - {total} % 11 WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE (11 - {total} % 11)::VARCHAR END = right({n}, 1)")
    if name == "es_cif":
        twice = " + ".join(f"({digits(i)}::INT * 2) // 10 + ({digits(i)}::INT * 2) % 10" if i % 2 == 0 else f"{digits(i)}::INT" for i in range(2, 9))
        control = f"((10 - ({twice}) % 10) % 10)"
        number, letter = f"{digits(9)} = {control}::VARCHAR", f"{digits(9)} = substr('ABCDEFGHIJ', {control} + 1, 1)"
        return _safe(n, ".[0-9]{7}.", f"CASE WHEN {digits(1)} IN ('P','Q','R','S','W') THEN {letter} WHEN {digits(1)} BETWEEN 'A' AND 'H' THEN {number} ELSE {number} OR {letter} END")
    if name == "in_aadhaar":
        return _safe(n, "[0-9]{12}", _verhoeff(n))
    if name == "sg_id":
        u = f"upper({v})"
        total = " + ".join(f"substr({u}, {i + 2}, 1)::INT * {w}" for i, w in enumerate(C.SG_WEIGHTS))
        cases = " ".join(f"WHEN '{k}' THEN substr('{C.SG_LETTERS[k]}', ({total} + {C.SG_OFFSET[k]}) % 11 + 1, 1)" for k in C.SG_OFFSET)
        return _safe(u, "[STFGM][0-9]{7}[A-Z]", f"CASE left({u}, 1) {cases} END = right({u}, 1)")
    raise KeyError(name)


# --------------------------------------------------------------------- rules


def rule_spans(source: str, key: str, text: str, rules: list[Rule] = RULES) -> str:
    parts = []
    for r in rules:
        value = "val[i]"
        extra = f" AND octet_length(encode({value})) >= {r.least}"
        if r.check:
            extra += f" AND {checksum(r.check, tidy(value) if r.tidy else value)}"
        parts.append(spans(source, key, text, r.pattern, r.group, r.entity, r.ordinal, extra))
    return "\nUNION ALL\n".join(parts)


def resolved(source: str, key: str, text: str, rules: list[Rule] = RULES) -> str:
    """Greedy choice by a recursive walk over the spans in order; card numbers must pass the stricter test, tokens in the text are guarded."""
    heavy = ", ".join(map(q, HEAVY))
    strict = luhn("value", 13)
    return f"""WITH RECURSIVE found AS ({rule_spans(source, key, text, rules)}),
    marks AS ({spans(source, key, text, TOKEN)}),
    guarded AS (SELECT * FROM found f WHERE (entity <> 'CREDIT_CARD' OR {strict}) AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.{key} = f.{key} AND f.s < m.e AND f.e > m.s)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s, -(e - s), CASE WHEN entity IN ({heavy}) THEN 0 ELSE 1 END, rule) AS rn FROM guarded),
    walk AS (
      SELECT {key}, entity, value, s, e, rn, true AS kept, e AS last FROM ranked WHERE rn = 1
      UNION ALL
      SELECT r.{key}, r.entity, r.value, r.s, r.e, r.rn, r.s >= w.last, CASE WHEN r.s >= w.last THEN r.e ELSE w.last END FROM walk w JOIN ranked r ON r.{key} = w.{key} AND r.rn = w.rn + 1)"""


# -------------------------------------------------------------------- tokens


def blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


def hmac_sql(v: str, key: bytes) -> str:
    inner, outer = bytes(b ^ 0x36 for b in key.ljust(64, b"\0")), bytes(b ^ 0x5C for b in key.ljust(64, b"\0"))
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || encode({v}))))"


def token_sql(entity: str, v: str, key: bytes) -> str:
    return f"'[' || {entity} || '_' || left({hmac_sql(v, key)}, 16) || ']'"


def splice_sql(text: str, pattern: str, entity: str, key: bytes) -> str:
    """The text with every match replaced by its token."""
    return f"array_to_string([x[1] || coalesce(x[2], '') FOR x IN list_zip(string_split_regex({text}, {q(pattern)}), [{token_sql(q(entity), 'm', key)} FOR m IN regexp_extract_all({text}, {q(pattern)})])], '')"
