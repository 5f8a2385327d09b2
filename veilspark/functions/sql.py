"""SQL functions of the engine.

``register`` adds functions for values, and the table function ``pii_spans``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules
from .tokens import Keys


def _compiled() -> list:
    import re

    word = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    return [(r, re.compile(r.pattern.replace(r"\b", word).replace(r"\s", r"\t\n\f\r ") if "[" not in r.pattern else r.pattern.replace(r"\b", word))) for r in rules.RULES if not r.check]


@F.udtf(returnType=T.StructType([T.StructField("entity", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
class PiiSpans:
    """Spans of the rules that need no checksum, for use in SQL: SELECT * FROM pii_spans('text')."""

    def __init__(self):
        self.rules = _compiled()

    def eval(self, text: str):
        for rule, pattern in self.rules:
            for m in pattern.finditer(text or ""):
                if m.start(rule.group) >= 0 and len(m[rule.group].encode()) >= rule.least:
                    yield rule.entity, m[rule.group], m.start(rule.group), m.end(rule.group)


def register(spark: SparkSession, keys: Keys) -> None:
    pads = [bytes(b ^ x for b in keys.digest.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    inner = f"unhex(sha2(concat(unhex('{pads[0]}'), encode(value, 'UTF-8')), 256))"
    # the keyed hash, as ``tokens.token`` has it, in SQL alone
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_token(entity STRING, value STRING) RETURNS STRING RETURN concat('[', entity, '_', substr(sha2(concat(unhex('{pads[1]}'), {inner}), 256), 1, 16), ']')")
    spark.udtf.register("pii_spans", PiiSpans)
