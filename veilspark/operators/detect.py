"""The ordered detection pipeline over a column of text.

Every tier sees what the one before has left, tokens included, so tiers are
projections one after the other and are never merged. Rules, dictionary,
phones, addresses, names and structural words are column expressions; only the
two look-ahead steps and a named-entity model, if one is plugged in, run as
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums, spans
from ..functions.dialect import java, literal, quoted
from ..functions.prefilter import lowered
from ..functions.rules import RULES, Rule
from ..functions.tokens import Keys, hmac_sha256, mint

HIT = "struct<entity:string,value:string,pii_hash:string,token:string,source:string>"

# Aliases of entities in other catalogues.
ALIASES = {
    "IBAN": "IBAN_CODE", "CREDIT_CARD": "CREDIT_CARD_NUMBER", "EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "ADDRESS": "LOCATION", "PERSON": "PERSON_NAME",
    "URL": "URL", "ACCOUNT_NUMBER": "FINANCIAL_ACCOUNT_NUMBER", "FR_NIR": "FRANCE_NIR", "DE_STEUER_ID": "GERMANY_TAXPAYER_IDENTIFICATION_NUMBER",
    "IT_CODICE_FISCALE": "ITALY_FISCAL_CODE", "NL_BSN": "NETHERLANDS_BSN_NUMBER", "UK_NINO": "UK_NATIONAL_INSURANCE_NUMBER", "UK_NHS": "UK_NATIONAL_HEALTH_SERVICE_NUMBER",
    "PL_PESEL": "POLAND_PESEL_NUMBER", "ES_DNI_NIE": "SPAIN_DNI_NUMBER", "SSN": "US_SOCIAL_SECURITY_NUMBER", "CREDENTIAL": "PASSWORD", "SECRET": "AUTH_TOKEN",
    "AWS_KEY": "AWS_CREDENTIALS", "AWS_SECRET": "AWS_CREDENTIALS", "GCP_SERVICE_ACCOUNT": "GCP_SERVICE_ACCOUNT", "HEALTH_ENTITY": "MEDICAL_TERM", "VAT_NUMBER": "VAT_NUMBER",
    "BIC": "SWIFT_CODE", "IP_ADDRESS": "IP_ADDRESS", "SE_PIN": "SWEDEN_PERSONAL_IDENTITY_NUMBER", "DK_CPR": "DENMARK_CPR_NUMBER", "FI_HETU": "FINLAND_NATIONAL_ID_NUMBER",
}

# Patterns of the tiers beyond the rules.
PHONE = r"(?:(?:\+|00)\s*)?(\d(?:[\s\-\.()]*\d){7,16})"
PHONE_SHAPE = r"^(?:\+|00)?[\d\s\-\.\(\)]{7,20}$"
NOT_PHONE = [r"\d+ \d+-\d+$", r"^\d{4}[-/.]?\d{2}[-/.]\d{2}", r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", r"^(?:19|20)\d{2}[\s/]"]
NOT_BEFORE_PHONE = r"(?i)\b(?:tva|vat|siret|siren|iban|fibre|fiber|r[eé]f[eé]rence|identifiant|abonn[eé]|account|compte|registr[ae]|rang|percentile|subtest|brut|standard|quotient|composite|[eé]chelle|s[ae]m\b|note\b|vitesse|m[eé]moire|comp[eé]tence|processus)"
PHONE_CONTEXT = 120
SENTINEL = r"__KII_[0-9a-f]+_\d+__"
ADDRESSES = [
    r"(?i)(?:^|\W)((?:calle|carrera|cra\.?|avenida|av\.?|diagonal|transversal)\s+(?:[a-záéíóúñ0-9\-]+\s+){0,2}[a-záéíóúñ0-9\-]+\s*#\s*\d+\s*-\s*\d+)(?:$|\W)",
    r"(?i)(?:^|\W)(\d{1,4}[a-z]?,?\s+(?:rue|avenue|boulevard|blvd|chemin|all[eé]e|place)\s+(?:[a-záéíóúñß\-]+\s+){0,5}[a-záéíóúñß\-]+(?:[\s,•·]+\d{4,5})?)(?:$|\W)",
    r"(?i)(?:^|\W)([a-záéíóúñß\-]{2,30}\s?(?:strasse|straße|str\.?)\s+\d{1,4}[a-z]?(?:[\s,]+\d{4,5})?)(?:$|\W)",
    r"(?i)(?:^|\W)((?:calle|paseo|plaza)\s+(?:[a-záéíóúñß\-]+\s+){0,2}[a-záéíóúñß\-]+\s+\d{1,4}(?:[\s,]+\d{4,5})?)(?:$|\W)",
    r"(?i)(?:^|\W)(\d{1,5}\s+(?:[a-z\-]+\s+){1,3}(?:street|st\.?|avenue|ave\.?|road|rd\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?)(?:[\s,]+[a-z\-]+){0,2}(?:[\s,]+[a-z]{2})?(?:[\s,]+\d{5}(?:-\d{4})?)?)(?:$|\W)",
    r"(?i)(?:^|\W)(grenoble|bogot[áa]|buenos aires|mallifaud|paris|madrid|berlin|london|new york|los angeles)(?:$|\W)",
]
ADDRESS_WORDS = ("rue", "calle", "street", "ave", "road", "str.")
NAMES = [
    r"(?i)(?:Regards|Best|Cheers|Bonjour|Hello|Hi|Dear|Sincerely|Cordialement)[,.-]*\s+([A-ZÀ-Ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-Ÿ][a-zà-ÿ]+){0,2})\b",
    r"(?i)\b(?:my name is|i am|call me|this is)\s+([A-ZÀ-Ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-Ÿ][a-zà-ÿ]+){0,2})\b",
    r"(?i)\b(?:where(?:\s+does)?|who(?:\s+is)?|about|contact|find|email|call|meet)\s+([A-ZÀ-Ÿ][a-zà-ÿ\-]{1,20}(?:\s+[A-ZÀ-Ÿ][a-zà-ÿ\-]{1,20}){1,3})\b",
]
TRIGGERS = r"(?i)\b(DIVORCE|MARIAGE|WEDDING|AVOCAT|LAWYER|HOSPITAL|CLINIQUE|TREATMENT|TRAITEMENT|CAMPAIGN|POLITICAL|CAMPAGNE|PEA)\b"
TITLES = r"(?i)\b(DR|DOCTEUR|PROF|MME|MLLE|SR|SRA|HR|FR|MAÎTRE|AVOCAT)\b"
CAPITALISED = r"\b[A-ZÀ-Ÿ][A-ZÀ-Ÿa-zà-ÿ\-]{1,20}\b"
POSSESSIVE = r"(?i)\b[A-ZÀ-Ÿ][a-zà-ÿ\-]{1,20}['’]s\b"
CONJUNCTION = r"(?i)\b(ET|AND|Y|UND|CON|WITH|&)\b"
BLOCKED_LABELS = (
    "siret", "siren", "tva", "vat", "iban", "bic", "facture", "invoice", "ref", "date", "total", "psychologue", "psychologist", "docteur", "doctor", "monsieur",
    "madame", "mr", "mme", "ms",
)
EMBEDDED_BASE64 = r"[A-Za-z0-9+/=]{20,}"

ANSWERS = "map<string,array<string>>"

#: A model: texts to, for each, labels with the values found.
Scanner = Callable[[list[str]], list[dict[str, list[str]]]]


@dataclass(frozen=True)
class Config:
    """``dictionary``: (entity, term) in order. ``entities``: (token id, name) pairs of the registry in order.
    ``scanner``: a named-entity model, unless ``scanners`` has one for the ``domain``; ``degrade``: go on without it if it fails."""

    keys: Keys
    rules: tuple[Rule, ...] = tuple(RULES)
    dictionary: tuple[tuple[str, str], ...] = ()
    entities: tuple[tuple[str, str], ...] = ()
    scanner: Scanner | None = None
    scanners: dict[str, Scanner] = field(default_factory=dict)
    domain: str = ""
    degrade: bool = False
    structural: bool = True
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))

    @property
    def active(self) -> Scanner | None:
        return self.scanners.get(self.domain, self.scanner) if self.domain not in ("", "standard") else self.scanner


# ---------------------------------------------------------------- scanning


def _ready(df: DataFrame, text: Column) -> DataFrame:
    """What the necessary conditions of patterns are tested on."""
    return df.withColumns({"_low": lowered(text), "_digit": text.rlike("[0-9]")})


def candidates(text: Column, rules=RULES, low: Column | None = None, digit: Column | None = None) -> Column:
    """Spans of all rules, by rule and then by place; they may overlap."""
    return F.concat(spans.none(), *[spans.by_rule(text, r, low, digit) for r in rules])


def _candidates_of(name: str, rules) -> Column:
    """``candidates`` for a column by name. Rules are SQL texts, for which the JVM is called once, and only checksums are built call by call."""
    from pyspark import SparkContext

    key = (id(SparkContext._active_spark_context), name, tuple(rules))
    if key not in _built:
        if len(_built) > 16:
            _built.clear()
        parts, plain = [spans.none()], []
        for r in rules:
            if r.check:
                parts += [F.expr(f"concat({', '.join(plain)})")] * bool(plain) + [F.filter(F.expr(spans.rule_sql(name, r)), spans.passes(r))]
                plain = []
            else:
                plain.append(spans.rule_sql(name, r))
        _built[key] = F.concat(*parts, *[F.expr(f"concat({', '.join(plain)})")] * bool(plain))
    return _built[key]


_built: dict[tuple, Column] = {}


def _settled(c: Column) -> Column:
    """The same value behind an expression that the optimizer neither copies nor pushes filters through.

    Tiers use their text many times over; inlined into each other they would grow without bounds.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def alias(entity: Column, aliases: dict[str, str]) -> Column:
    pairs = [x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), entity) if pairs else F.lit(None).cast("string")


def scan(df: DataFrame, text: str = "text", rules=RULES, aliases: dict[str, str] | None = None, out: str = "detections") -> DataFrame:
    """Adds all detections of a text, with the plain SHA-256 of each value and its place in bytes."""
    checked = [r.ordinal for r in rules if r.check]
    t = F.col(text)
    found = _ready(df, t).withColumn("_spans", _candidates_of(text, rules)).drop("_low", "_digit")
    one = lambda s: F.struct(
        s["entity"].alias("entity"), alias(s["entity"], ALIASES if aliases is None else aliases).alias("canonical_type"), s["value"].alias("value"), F.sha2(s["value"], 256).alias("value_hash"),
        F.lit(1.0).alias("confidence"), F.when(s["rule"].isin(*checked), F.array(F.lit("regex"), F.lit("checksum"))).otherwise(F.array(F.lit("regex"))).alias("method"),
        spans.byte_range(t, s).alias("location"), s["start"].alias("start"), s["end"].alias("end"),
    )
    return found.withColumn(out, _settled(F.transform("_spans", one))).drop("_spans")


def winners(df: DataFrame, text: str = "text", rules=RULES, out: str = "spans") -> DataFrame:
    """Adds the spans that are left after overlaps are resolved and tokens are guarded."""
    t = F.col(text)
    return _ready(df, t).withColumn("_all", _candidates_of(text, rules)).drop("_low", "_digit").withColumn(out, _settled(spans.resolve(F.when(F.size("_all") > 0, spans.apart(_strict(F.col("_all")), spans.tokens(t))).otherwise(F.col("_all"))))).drop("_all")


def _strict(found: Column) -> Column:
    """Cards must pass the stricter test before they are replaced."""
    return F.filter(found, lambda s: (s["entity"] != "CREDIT_CARD") | checksums.luhn_strict(s["value"]))


# ------------------------------------------------------------------ tiers


def _hit(s: Column, keys: Keys, source: str) -> Column:
    digest = hmac_sha256(s["value"], keys.digest)
    return F.struct(s["entity"].alias("entity"), s["value"].alias("value"), digest.alias("pii_hash"), mint(s["entity"], digest).alias("token"), F.lit(source).alias("source"))


def _replace(df: DataFrame, found: Column, keys: Keys, source: str) -> DataFrame:
    """One tier: its spans, then text and hits."""
    df = df.withColumn("_s", found)
    hits = F.transform("_s", lambda s: _hit(s, keys, source))
    some = F.size("_s") > 0
    return df.withColumns({
        "_t": F.when(some, spans.splice(F.col("_t"), F.col("_s"), lambda s: mint(s["entity"], hmac_sha256(s["value"], keys.digest)))).otherwise(F.col("_t")),
        "_h": F.when(some, F.concat("_h", hits)).otherwise(F.col("_h")),
    }).drop("_s")


def _literals(df: DataFrame, wanted: Column, keys: Keys, source: str, protect: Column | None = None) -> DataFrame:
    """Replaces every occurrence of the (entity, term) structs in ``wanted``, one after the other, in either case.

    Terms of fewer than three bytes are left out. The keyed hash is of the casing found.
    """

    def step(acc: Column, w: Column) -> Column:
        text, term = acc["t"], F.btrim(w["term"])
        found = spans.find(text, quoted(term), entity=w["entity"])
        free = spans.outside(found, spans.tokens(text))
        if protect is not None:
            free = spans.outside(free, F.concat(*[spans.find(text, r.pattern, r.group) for r in RULES if r.entity in ("EMAIL", "URL")]))
        use = (F.octet_length(term) >= 3) & F.contains(F.lower(text), F.lower(term))
        done = F.transform(F.array(free), lambda f: F.struct(spans.splice(text, f, lambda s: mint(s["entity"], hmac_sha256(s["value"], keys.digest))).alias("t"), F.concat(acc["h"], F.transform(f, lambda s: _hit(s, keys, source))).alias("h")))
        return F.when(use, F.element_at(done, 1)).otherwise(acc)

    df = df.withColumn("_w", wanted)
    state = F.aggregate("_w", F.struct(F.col("_t").alias("t"), F.col("_h").alias("h")), step)
    df = df.withColumn("_x", F.when(F.size("_w") > 0, state).otherwise(F.struct(F.col("_t").alias("t"), F.col("_h").alias("h"))))
    return df.withColumns({"_t": F.col("_x.t"), "_h": F.col("_x.h")}).drop("_w", "_x")


def dictionary_tier(df: DataFrame, cfg: Config) -> DataFrame:
    terms = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(t).alias("term")) for e, t in cfg.dictionary])
    return _literals(df, terms, cfg.keys, "dictionary", protect=F.lit(True))


def registry_tier(df: DataFrame, cfg: Config) -> DataFrame:
    """Registered names, whole words in either case, become their entity's token."""
    edge = r"(?![0-9A-Za-z_])"
    names = F.array(*[F.struct(F.lit(f"[{i}]").alias("token"), F.lit(n.strip()).alias("name")) for i, n in cfg.entities if len(n.strip().encode()) >= 2])

    def step(t: Column, n: Column) -> Column:
        # a boundary stands between a word character and another one, on either side
        first, last = n["name"].rlike("^[0-9A-Za-z_]"), n["name"].rlike(r"[0-9A-Za-z_]\z")
        left = F.when(first, F.lit("(?<![0-9A-Za-z_])")).otherwise(F.lit("(?<=[0-9A-Za-z_])"))
        right = F.when(last, F.lit(edge)).otherwise(F.lit("(?=[0-9A-Za-z_])"))
        pattern = F.concat(F.lit("(?iu)"), left, quoted(n["name"]), right)
        return F.when(F.contains(F.lower(t), F.lower(n["name"])), F.regexp_replace(t, pattern, n["token"])).otherwise(t)

    return df.withColumn("_t", F.aggregate(names, F.col("_t"), step)) if cfg.entities else df


def rule_tier(df: DataFrame, cfg: Config) -> DataFrame:
    df = winners(df, "_t", cfg.rules, "_r")
    return _replace(df, F.col("_r"), cfg.keys, "rules").drop("_r")


def phones(text: Column) -> Column:
    """Spans of digits in the shape of a phone number whose surroundings do not speak against it."""
    found = spans.apart(spans.find(text, PHONE, 0, "PHONE"), spans.find(text, SENTINEL))
    before = lambda s: F.lower(F.substring(text, F.greatest(s["start"] - PHONE_CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(PHONE_CONTEXT))))
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    good = lambda s: (
        ~F.substring(text, s["end"] + 1, F.lit(2)).rlike("^[;:,][0-9]")
        & ~s["value"].rlike("|".join(f"(?:{java(p)})" for p in NOT_PHONE))
        & digits(s).between(7, 15) & F.btrim(s["value"]).rlike(java(PHONE_SHAPE)) & ~before(s).rlike(java(NOT_BEFORE_PHONE))
    )
    return F.filter(found, good)


def phone_tier(df: DataFrame, cfg: Config) -> DataFrame:
    t = F.col("_t")
    return _replace(df, F.when(t.rlike("[0-9]") & ~spans.fully_tokenised(t), _in_order(spans.apart(phones(t), spans.tokens(t)))).otherwise(spans.none()), cfg.keys, "phone")


def addresses(text: Column, low: Column | None = None, digit: Column | None = None) -> Column:
    """Spans of six kinds of street address and some cities, without closing punctuation."""
    found = F.concat(*[spans.gated(spans.find(text, p, 1, "ADDRESS", i), p, low, digit) for i, p in enumerate(ADDRESSES)])
    cut = lambda s: F.rtrim(s["value"], F.lit("., "))
    return F.transform(found, lambda s: F.struct(s["entity"].alias("entity"), cut(s).alias("value"), s["start"].alias("start"), (s["start"] + F.char_length(cut(s))).alias("end"), s["rule"].alias("rule")))


def _in_order(found: Column) -> Column:
    """By start and pattern; of overlapping spans the first."""
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), s["rule"].alias("b"), s["end"].alias("c"), s.alias("span"))))
    start = F.struct(F.lit(0).alias("at"), spans.none().alias("out"))
    step = lambda acc, k: F.when(k["a"] >= acc["at"], F.struct(k["c"].alias("at"), F.concat(acc["out"], F.array(k["span"])).alias("out"))).otherwise(acc)
    return F.aggregate(keyed, start, step, lambda acc: acc["out"])


def address_tier(df: DataFrame, cfg: Config) -> DataFrame:
    t = F.col("_t")
    df, low, digit = _ready(df, t), F.col("_low"), F.col("_digit")
    words = low.rlike("|".join(w.replace(".", r"\.") for w in ADDRESS_WORDS))
    use = (F.octet_length(t) > 10) & (digit | words)
    return _replace(df, F.when(use, _in_order(spans.apart(addresses(t, low, digit), spans.tokens(t)))).otherwise(spans.none()), cfg.keys, "address")


def greeting_tier(df: DataFrame, cfg: Config) -> DataFrame:
    """Names after a greeting, an introduction or a question, and wherever else they stand; of overlapping ones the leftmost."""
    t = F.col("_t")
    df = _ready(df, t)
    found = F.concat(*[spans.gated(spans.find(t, p, 1, "PERSON", i), p, F.col("_low"), F.col("_digit")) for i, p in enumerate(NAMES)])
    names = F.array_distinct(F.transform(F.filter(found, lambda s: ~F.startswith(s["value"], F.lit("["))), lambda s: F.btrim(s["value"])))
    df = df.withColumn("_n", F.filter(names, lambda n: F.octet_length(n) >= 3))
    # one pass for all names, the first found first; a text may hold very many
    every = F.concat(F.lit("(?iu)(?:"), F.array_join(F.transform("_n", literal), "|"), F.lit(")"))
    where = F.when(F.size("_n") > 0, spans.outside(spans.find(t, every, entity="PERSON"), spans.tokens(t))).otherwise(spans.none())
    return _replace(df, where, cfg.keys, "greeting").drop("_n")


def label(c: Column) -> Column:
    return F.upper(F.replace(F.btrim(c), F.lit(" "), F.lit("_")))


def blocked(item: Column) -> Column:
    """Structural words, and beginnings and ends of them, are no values."""
    low = F.lower(F.btrim(item))
    return F.exists(F.array(*[F.lit(x) for x in BLOCKED_LABELS]), lambda b: F.startswith(b, low) | F.endswith(b, low))


def ner_tier(df: DataFrame, cfg: Config, prescan: str | None = None) -> DataFrame:
    """Values that a model finds in the text, tokens blanked; or those of a map column of the whole record, where it is not null."""
    if prescan is None and cfg.active is None:
        return df
    found = F.col(prescan) if prescan else F.lit(None).cast(ANSWERS)
    if cfg.active is not None:
        blank = F.regexp_replace("_t", java(spans.TOKEN), " ")
        ask = found.isNull() & (F.octet_length(F.btrim(blank)) > 15) & ~spans.fully_tokenised(F.col("_t"))
        df = df.withColumn("_n", model(cfg.active, cfg.degrade)(F.when(ask, blank)))
        found = F.coalesce(found, "_n")
    pairs = F.flatten(F.transform(F.array_sort(F.map_entries(found)), lambda e: F.transform(e["value"], lambda v: F.struct(label(e["key"]).alias("entity"), v.alias("term")))))
    wanted = F.coalesce(F.filter(pairs, lambda w: (F.octet_length(w["term"]) >= 3) & ~blocked(w["term"])), F.array().cast("array<struct<entity:string,term:string>>"))
    return _literals(df, wanted, cfg.keys, "model").drop("_n")


def model(scanner: Scanner, degrade: bool = False):
    """A scanner as a column function from text to a map of labels; null for null texts, which are not asked about, and for failures gone on from."""

    @F.pandas_udf(ANSWERS)
    def ask(texts: pd.Series) -> pd.Series:
        asked = texts[texts.notna()]
        try:
            answers = scanner(asked.tolist()) if len(asked) else []
        except Exception:
            if not degrade:
                raise
            answers = [None for _ in asked]
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        for i, a in zip(asked.index, answers, strict=True):
            out[i] = a if a is None else {k: list(dict.fromkeys(v)) for k, v in a.items()}
        return out

    return ask.asNondeterministic()


def answered(content: Column) -> Column:
    """The map of labels that a chat model's answer holds between its first ``[`` and last ``]``; values of fewer than three bytes go.
    Null where that is no array of entities."""
    array = F.regexp_extract(content, r"(?s)\[.*\]", 0)
    found = F.from_json(F.when(array != "", array).otherwise(F.btrim(content)), "array<struct<entity_type:string,value:string>>", {"mode": "PERMISSIVE"})
    kept = F.filter(F.transform(found, lambda e: F.struct(F.coalesce(e["entity_type"], F.lit("")).alias("k"), F.btrim(e["value"]).alias("v"))), lambda e: F.octet_length(e["v"]) > 2)
    kinds = F.array_distinct(F.transform(kept, lambda e: e["k"]))
    of = lambda k: F.transform(F.filter(kept, lambda e: e["k"] == k), lambda e: e["v"])
    return F.map_from_arrays(kinds, F.transform(kinds, of))


def redact_records(df: DataFrame, columns: list[str], cfg: Config) -> DataFrame:
    """Redacts columns of a record in place, with ``<column>_hits`` besides. A model is asked once for a record of over 50 bytes
    that is not all tokens, and its answer serves every column; otherwise, or if that fails, columns are asked about one by one."""
    if cfg.active is not None:
        whole = F.to_json(F.struct(*columns))
        df = df.withColumn("_record", model(cfg.active, cfg.degrade)(F.when((F.octet_length(whole) > 50) & ~spans.fully_tokenised(whole), whole)))
    for c in columns:
        df = redact(df, cfg, c, c, f"{c}_hits", None if cfg.active is None else "_record")
    return df.drop("_record")


def boundary_tier(df: DataFrame) -> DataFrame:
    """Up to three characters glued to a token are the rest of a word and go."""
    mark, glue = r"\[[A-Za-z_]+_[0-9a-f]+\]", r"""[^\t\n\f\r \[\]"'{}(),.:;]{1,3}"""
    edge = r"""[\t\n\f\r \[\]"'{}(),.:;]"""
    t = F.regexp_replace("_t", f"({mark})(?:{glue})({edge}|\\z)", "$1$2")
    return df.withColumn("_t", F.regexp_replace(t, f"({edge}|^)(?:{glue})({mark})", "$1$2"))


def structural_tier(df: DataFrame, cfg: Config) -> DataFrame:
    """Sensitive events, titles with names, possessives, and capitalised words beside tokens."""
    df = _ready(df, F.col("_t"))
    df = _replace(df, spans.gated(spans.find(F.col("_t"), TRIGGERS, 0, "SENSITIVE_EVENT"), TRIGGERS, F.col("_low"), F.col("_digit")), cfg.keys, "structural")
    df = _look_ahead(df, "titles", cfg.keys)
    df = _ready(df, F.col("_t"))
    df = _replace(df, spans.gated(spans.find(F.col("_t"), POSSESSIVE, 0, "PERSON"), POSSESSIVE, F.col("_low"), F.col("_digit")), cfg.keys, "structural")
    return _look_ahead(df, "neighbours", cfg.keys)


def _look_ahead(df: DataFrame, how: str, keys: Keys) -> DataFrame:
    from .lookahead import STEPS

    step = STEPS[how]

    @F.pandas_udf("struct<text:string,entity:array<string>,value:array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [step(t, keys.digest) if t is not None else (None, [], []) for t in texts]
        return pd.DataFrame({"text": [m[0] for m in made], "entity": [m[1] for m in made], "value": [m[2] for m in made]})

    # most texts need no look-ahead: those are not sent to Python's side of the work
    need = F.col("_t").rlike(java(TITLES if how == "titles" else spans.TOKEN))
    df = df.withColumn("_l", run.asNondeterministic()(F.when(need, F.col("_t"))))
    hits = F.transform(F.arrays_zip("_l.entity", "_l.value"), lambda s: _hit(s, keys, "structural"))
    return df.withColumns({"_t": F.when(need, F.col("_l.text")).otherwise(F.col("_t")), "_h": F.when(need, F.concat("_h", hits)).otherwise(F.col("_h"))}).drop("_l")


def redact(df: DataFrame, cfg: Config, text: str = "text", out: str = "redacted", hits: str = "hits", prescan: str | None = None) -> DataFrame:
    """All tiers in order. Texts of fewer than three bytes, blanks aside, stay. Null stays null.

    Any failing expression fails the query: a text is never passed on unredacted because of an error.
    """
    df = df.withColumns({"_t": F.coalesce(text, F.lit("")), "_h": F.array().cast(f"array<{HIT}>")})
    if cfg.dictionary:
        df = dictionary_tier(df, cfg)
    df = registry_tier(df, cfg)
    for tier in (rule_tier, phone_tier, address_tier, greeting_tier):
        df = tier(df, cfg)
    df = boundary_tier(ner_tier(df, cfg, prescan))
    if cfg.structural:
        df = structural_tier(df, cfg)
    short = (F.octet_length(F.coalesce(text, F.lit(""))) < 3) | (F.octet_length(F.btrim(F.coalesce(text, F.lit("")))) < 3)
    return df.withColumns({out: F.when(F.col(text).isNull() | short, F.col(text)).otherwise(_settled(F.col("_t"))), hits: F.when(short, F.array().cast(f"array<{HIT}>")).otherwise(F.col("_h"))}).drop("_t", "_h", "_low", "_digit")


# Fixed value: marks lines with health data.
HEALTH_TAG = "[ART9_HEALTH_RECORD]"


def prescrub(df: DataFrame, keys: Keys, text: str = "text", rules=RULES, out: str = "scrubbed", tag: str = HEALTH_TAG) -> DataFrame:
    """All rules over whole documents, lines with health entities tagged; tokens already there are not guarded."""
    t = F.col(text)
    df = _ready(df, t).withColumn("_all", _settled(_candidates_of(text, rules))).drop("_low", "_digit")
    lines_of = F.transform(F.filter("_all", lambda s: s["entity"] == "HEALTH_ENTITY"), lambda s: F.size(F.split(F.substring(t, F.lit(1), s["start"]), "\n")) - 1)
    df = df.withColumn("_s", spans.resolve(F.col("_all"))).withColumn("_lines", lines_of)
    done = spans.splice(t, F.col("_s"), lambda s: mint(s["entity"], hmac_sha256(s["value"], keys.digest)))
    tagged = F.transform(F.split(done, "\n"), lambda x, i: F.when(F.array_contains("_lines", i) & ~F.startswith(x, F.lit(tag)), F.concat(F.lit(f"{tag} "), x)).otherwise(x))
    return df.withColumn(out, F.when(F.size("_lines") > 0, F.array_join(tagged, "\n")).otherwise(done)).drop("_all", "_s", "_lines")


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of the key: the same ones on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
