"""All registered queries and the SQL that reproduces them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prepare
from ..functions import checksums, spans
from ..functions.dialect import java
from ..functions.rules import RULES
from ..functions.tokens import Keys, bucket, decrypt, encrypt, hmac_sha256, shift_digits, token
from ..operators import audit, detect, nested, report, risk, vault
from ..sources import extract, files
from ..streaming import state
from . import fixtures as X
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A demonstration key; real keys come from the caller.
KEYS = Keys.derive(b"demonstration secret", b"salt")
EMAIL = next(r for r in RULES if r.entity == "EMAIL").pattern


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            prepare(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if name in TEXTS and len(df.inputFiles()) < (cores := spark.sparkContext.defaultParallelism):
        # a few files with few row groups would keep most cores idle; tables of many files are read as they lie
        df = df.repartition(cores)
    return df


#: Tables whose rows cost much more to scan than to move.
TEXTS = ("documents", "pages")


def _fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(X.TEXTS)), "id int, text string")


FIXTURE = O.values(list(enumerate(X.TEXTS)), "id, text")

# ------------------------------------------------------- detection, section 2.4 to 2.8


@query()
def redact_documents(spark, d):
    """All tiers over documents."""
    cfg = detect.Config(KEYS, dictionary=(("PROJECT", "license"),), entities=(("ORG_1", "CC BY"),))
    return detect.redact(_t(spark, d, "documents"), cfg).select("doc_id", "redacted", F.transform("hits", lambda h: h["token"]).alias("tokens"))


@query(f"SELECT doc_id, entity, value, sha256(value) AS value_hash, s AS span_start, e AS span_end, octet_length(encode(left(txt, s))) || '-' || octet_length(encode(left(txt, e))) AS location FROM ({O.rule_spans('documents', 'doc_id', 'text')})")
def scan_documents(spark, d):
    found = detect.scan(_t(spark, d, "documents").select("doc_id", "text"))
    return report.hits(found).select("doc_id", "entity", "value", "value_hash", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "location")


@query(f"SELECT id, entity, value, s AS span_start, e AS span_end FROM ({O.rule_spans(FIXTURE, 'id', 'text')})")
def scan_fixtures(spark, d):
    return report.hits(detect.scan(_fixture(spark)), "id").select("id", "entity", "value", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(O.resolved("documents", "doc_id", "text") + " SELECT doc_id, entity, value, s AS span_start, e AS span_end FROM walk WHERE kept")
def resolve_documents(spark, d):
    found = detect.winners(_t(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.inline("spans")).select("doc_id", "entity", "value", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(O.resolved(FIXTURE, "id", "text") + " SELECT id, entity, value, s AS span_start, e AS span_end FROM walk WHERE kept")
def resolve_fixtures(spark, d):
    return detect.winners(_fixture(spark)).select("id", F.inline("spans")).select("id", "entity", "value", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(f"SELECT doc_id, {O.splice_sql('text', EMAIL, 'EMAIL', KEYS.digest)} AS redacted, len(regexp_extract_all(text, {O.q(EMAIL)})) AS n_hits FROM documents")
def redact_emails(spark, d):
    t = F.col("text")
    df = _t(spark, d, "documents").select("doc_id", "text").withColumn("s", spans.find(t, EMAIL, 0, "EMAIL"))
    return df.select("doc_id", spans.splice(t, F.col("s"), lambda s: token(s["entity"], s["value"], KEYS)).alias("redacted"), F.size("s").cast("long").alias("n_hits"))


_PHONE_SQL = f"""SELECT {{key}}, value, s AS span_start, e AS span_end FROM ({O.spans('{source}', '{key}', 'text', detect.PHONE, 0, 'PHONE')})
WHERE NOT regexp_matches(substr(txt, e + 1, 2), '^[;:,][0-9]') AND NOT regexp_matches(value, {O.q('|'.join(f'(?:{p})' for p in detect.NOT_PHONE))})
AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND regexp_matches(trim(value), {O.q(detect.PHONE_SHAPE)})
AND NOT regexp_matches(lower(substr(txt, greatest(s - 120, 0) + 1, least(s, 120))), {O.q(detect.NOT_BEFORE_PHONE)})"""


def _phone_sql(source: str, key: str) -> str:
    return _PHONE_SQL.replace("{source}", source).replace("{key}", key)


@query(_phone_sql("documents", "doc_id"))
def scan_phones(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.inline(detect.phones(F.col("text")))).select("doc_id", "value", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(_phone_sql(FIXTURE, "id"))
def scan_phones_fixtures(spark, d):
    return _fixture(spark).select("id", F.inline(detect.phones(F.col("text")))).select("id", "value", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query("SELECT id, rtrim(value, '., ') AS value, s AS span_start, rule AS parser FROM (" + " UNION ALL ".join(O.spans(FIXTURE, "id", "text", p, 1, "ADDRESS", i) for i, p in enumerate(detect.ADDRESSES)) + ")")
def scan_addresses(spark, d):
    return _fixture(spark).select("id", F.inline(detect.addresses(F.col("text")))).select("id", "value", F.col("start").alias("span_start"), F.col("rule").alias("parser"))


@query("SELECT id, value, s AS span_start, rule AS pattern FROM (" + " UNION ALL ".join(O.spans(FIXTURE, "id", "text", p, 1, "PERSON", i) for i, p in enumerate(detect.NAMES)) + ")")
def scan_names(spark, d):
    found = F.concat(*[spans.find(F.col("text"), p, 1, "PERSON", i) for i, p in enumerate(detect.NAMES)])
    return _fixture(spark).select("id", F.inline(found)).select("id", "value", F.col("start").alias("span_start"), F.col("rule").alias("pattern"))


@query("SELECT doc_id, rtrim(value, '., ') AS value, s AS span_start, rule AS parser FROM (" + " UNION ALL ".join(O.spans("documents", "doc_id", "text", p, 1, "ADDRESS", i) for i, p in enumerate(detect.ADDRESSES)) + ")")
def scan_addresses_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.inline(detect.addresses(F.col("text")))).select("doc_id", "value", F.col("start").alias("span_start"), F.col("rule").alias("parser"))


@query("SELECT doc_id, value, s AS span_start, rule AS pattern FROM (" + " UNION ALL ".join(O.spans("documents", "doc_id", "text", p, 1, "PERSON", i) for i, p in enumerate(detect.NAMES)) + ")")
def scan_names_documents(spark, d):
    found = F.concat(*[spans.find(F.col("text"), p, 1, "PERSON", i) for i, p in enumerate(detect.NAMES)])
    return _t(spark, d, "documents").select("doc_id", F.inline(found)).select("doc_id", "value", F.col("start").alias("span_start"), F.col("rule").alias("pattern"))


@query()
def prescrub_documents(spark, d):
    return detect.prescrub(_t(spark, d, "documents").select("doc_id", "text"), KEYS).select("doc_id", "scrubbed")


@query()
def redact_fixtures(spark, d):
    """All tiers, a stand-in for a model included."""

    def scanner(texts: list[str]) -> list[dict[str, list[str]]]:
        return [{"private person": ["Cafe Central"]} if "Cafe Central" in t else {} for t in texts]

    cfg = detect.Config(KEYS, dictionary=(("CITY", "Springfield"),), entities=(("PERSON_1", "Mary Ann"),), scanner=scanner)
    return detect.redact(_fixture(spark), cfg).select("id", "redacted", F.transform("hits", lambda h: F.concat_ws("=", h["entity"], h["value"])).alias("found"))


@query()
def prescrub_fixtures(spark, d):
    """Whole-document scrub with tagged health lines."""
    return detect.prescrub(_fixture(spark), KEYS).select("id", "scrubbed")


_LICENSE = r"(?i)licensed under"


@query(f"SELECT doc_id, {O.splice_sql('text', _LICENSE, 'PHRASE', KEYS.digest)} AS redacted FROM documents")
def redact_dictionary(spark, d):
    df = _t(spark, d, "documents").select("doc_id", "text", F.col("text").alias("_t"), F.array().cast(f"array<{detect.HIT}>").alias("_h"))
    return detect.dictionary_tier(df, detect.Config(KEYS, dictionary=(("PHRASE", "licensed under"),))).select("doc_id", F.col("_t").alias("redacted"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\bCC BY\\b', '[ORG_1]', 'g'), '(?i)\\bthe\\b', '[WORD_1]', 'g') AS redacted FROM documents")
def redact_registry(spark, d):
    df = _t(spark, d, "documents").select("doc_id", F.col("text").alias("_t"))
    return detect.registry_tier(df, detect.Config(KEYS, entities=(("ORG_1", "CC BY"), ("WORD_1", "the")))).select("doc_id", F.col("_t").alias("redacted"))


@query("SELECT o_orderkey, regexp_matches(regexp_replace(t, '\\[[A-Z_][A-Z_0-9]*_[0-9a-f]+\\]', '', 'g'), '^[\\t\\n\\f\\r \\p{P}\\p{Z}>*_|\\-=+#@~]+$') AS done FROM (SELECT o_orderkey, '[KEY_' || lower(to_hex(o_orderkey)) || ']' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' - ' WHEN 2 THEN ' x' ELSE '.' END AS t FROM orders)")
def fully_tokenised(spark, d):
    end = F.element_at(F.array(F.lit(""), F.lit(" - "), F.lit(" x"), F.lit(".")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("[KEY_"), F.lower(F.hex("o_orderkey")), F.lit("]"), end)
    return _t(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", spans.fully_tokenised(F.col("t")).alias("done"))


@query(f"SELECT source, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS total_pii FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({O.rule_spans('documents', 'doc_id', 'text')}) GROUP BY 1) USING (doc_id) GROUP BY 1")
def pii_heatmap(spark, d):
    return report.heat_map(detect.scan(_t(spark, d, "documents")), ["source"])


@query(f"SELECT entity, count(*) AS n FROM ({O.rule_spans('documents', 'doc_id', 'text')}) GROUP BY 1 ORDER BY n DESC, entity LIMIT 5")
def hits_topk(spark, d):
    found = report.hits(detect.scan(_t(spark, d, "documents")))
    return report.top(found.groupBy("entity").agg(F.count("*").alias("n")), 5)


@query(f"SELECT 'scan' AS mode, (SELECT count(*) FROM documents) AS files_scanned, count(*) AS total_pii_count, count(*) > 0 AS blocking FROM ({O.rule_spans('documents', 'doc_id', 'text')})")
def hits_report(spark, d):
    return report.hits_report(detect.scan(_t(spark, d, "documents")))


_ALIAS_SQL = "CASE entity " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in detect.ALIASES.items()) + " END"
_REG_SQL = "CASE entity " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v[0])}" for k, v in report.REGULATIONS.items()) + " ELSE 'GENERAL_PII' END"


@query(f"SELECT regulation, canonical_type, count(*) AS n FROM (SELECT {_REG_SQL} AS regulation, {_ALIAS_SQL} AS canonical_type FROM ({O.rule_spans(FIXTURE, 'id', 'text')})) GROUP BY ALL")
def compliance_mapping(spark, d):
    found = report.hits(detect.scan(_fixture(spark)), "id")
    return found.groupBy(report.regulation(F.col("entity")).alias("regulation"), "canonical_type").agg(F.count("*").alias("n"))


@query(f"SELECT regulation, canonical_type, count(*) AS n FROM (SELECT {_REG_SQL} AS regulation, {_ALIAS_SQL} AS canonical_type FROM ({O.rule_spans('documents', 'doc_id', 'text')})) GROUP BY ALL")
def compliance_documents(spark, d):
    found = report.hits(detect.scan(_t(spark, d, "documents").select("doc_id", "text")))
    return found.groupBy(report.regulation(F.col("entity")).alias("regulation"), "canonical_type").agg(F.count("*").alias("n"))


_ANSWER = """CASE event_id % 4 WHEN 0 THEN 'no entities' WHEN 1 THEN '[]' ELSE 'Found: [{"entity_type":"NAME","value":" user ' || user_id || ' "},{"entity_type":"CODE","value":"' || user_id % 20 || '"},{"entity_type":"NAME","value":"' || event_type || '"}] done' END"""


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'NAME=user ' || user_id || ',' || event_type END AS found FROM events")
def model_answers(spark, d):
    """Answers of a chat model: text around the array, values too short, nothing found, no array at all."""
    labels = detect.answered(F.expr(_ANSWER))
    each = F.transform(F.map_entries(labels), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))
    return _t(spark, d, "events").select("event_id", F.coalesce(F.array_join(each, ";"), F.lit("none")).alias("found"))


# ---------------------------------------------------------------- checksums, section 2.7

_SHAPES = {
    "luhn": ("lpad((o_orderkey * 7919 + 13)::VARCHAR, 16, '4532015')", lambda k: F.lpad((k * 7919 + 13).cast("string"), 16, "4532015")),
    "luhn_strict": ("lpad((o_orderkey * 31)::VARCHAR, 9 + (o_orderkey % 9)::INT, '73')", lambda k: F.lpad((k * 31).cast("string"), (k % 9 + 9).cast("int"), F.lit("73"))),
    "iban": ("'FR' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' ' || lpad((o_orderkey * 104729)::VARCHAR, 18, '30006') || 'aB'", lambda k: F.concat(F.lit("FR"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" "), F.lpad((k * 104729).cast("string"), 18, "30006"), F.lit("aB"))),
    "es_dni": ("CASE o_orderkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'z' ELSE '1' END || lpad((o_orderkey * 37 % 10000000)::VARCHAR, 7, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', (o_orderkey % 23 + 1)::INT, 1)", lambda k: F.concat(F.element_at(F.array(F.lit("X"), F.lit("z"), F.lit("1")), (k % 3 + 1).cast("int")), F.lpad((k * 37 % 10000000).cast("string"), 7, "0"), F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (k % 23 + 1).cast("int"), F.lit(1)))),
    "it_cf": ("'RSSMRA' || lpad((o_orderkey % 97)::VARCHAR, 2, '0') || 'T10A' || lpad((o_orderkey * 11 % 1000)::VARCHAR, 3, '0') || chr((65 + o_orderkey % 26)::INT)", lambda k: F.concat(F.lit("RSSMRA"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit("T10A"), F.lpad((k * 11 % 1000).cast("string"), 3, "0"), F.char((k % 26 + 65).cast("int")))),
    "nl_bsn": ("lpad((o_orderkey * 101)::VARCHAR, 8 + (o_orderkey % 2)::INT, '12345')", lambda k: F.lpad((k * 101).cast("string"), (k % 2 + 8).cast("int"), F.lit("12345"))),
    "pl_pesel": ("lpad((o_orderkey * 10007)::VARCHAR, 11, '44051')", lambda k: F.lpad((k * 10007).cast("string"), 11, "44051")),
    "de_steuer_id": ("lpad((o_orderkey * 10009)::VARCHAR, 11, '86095')", lambda k: F.lpad((k * 10009).cast("string"), 11, "86095")),
    "dk_cpr": ("lpad((o_orderkey * 1009)::VARCHAR, 6, '07') || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')", lambda k: F.concat(F.lpad((k * 1009).cast("string"), 6, "07"), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0"))),
    "fi_hetu": ("lpad((o_orderkey % 1000000)::VARCHAR, 6, '131052') || '-308' || substr('0123456789ABCDEFHJKLMNPRSTUVWXY', (o_orderkey * 7 % 31 + 1)::INT, 1)", lambda k: F.concat(F.lpad((k % 1000000).cast("string"), 6, "131052"), F.lit("-308"), F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (k * 7 % 31 + 1).cast("int"), F.lit(1)))),
    "se_pin": ("CASE WHEN o_orderkey % 2 = 0 THEN '19' ELSE '' END || lpad((o_orderkey * 17)::VARCHAR, 10, '8112289874')", lambda k: F.concat(F.when(k % 2 == 0, "19").otherwise(""), F.lpad((k * 17).cast("string"), 10, "8112289874"))),
    "br_cpf": ("CASE WHEN o_orderkey % 50 = 0 THEN '222.222.222-22' ELSE lpad((o_orderkey * 10037)::VARCHAR, 11, '11144') END", lambda k: F.when(k % 50 == 0, "222.222.222-22").otherwise(F.lpad((k * 10037).cast("string"), 11, "11144"))),
    "cl_rut": ("lpad((o_orderkey * 103)::VARCHAR, 7 + (o_orderkey % 2)::INT, '12345') || '-' || substr('0123456789kK', (o_orderkey % 12 + 1)::INT, 1)", lambda k: F.concat(F.lpad((k * 103).cast("string"), (k % 2 + 7).cast("int"), F.lit("12345")), F.lit("-"), F.substring(F.lit("0123456789kK"), (k % 12 + 1).cast("int"), F.lit(1)))),
    "es_cif": ("substr('ABCDEFGHJNPQRSUVW', (o_orderkey % 17 + 1)::INT, 1) || lpad((o_orderkey * 107 % 10000000)::VARCHAR, 7, '58') || substr('0123456789ABCDEFGHIJ', (o_orderkey % 20 + 1)::INT, 1)", lambda k: F.concat(F.substring(F.lit("ABCDEFGHJNPQRSUVW"), (k % 17 + 1).cast("int"), F.lit(1)), F.lpad((k * 107 % 10000000).cast("string"), 7, "58"), F.substring(F.lit("0123456789ABCDEFGHIJ"), (k % 20 + 1).cast("int"), F.lit(1)))),
    "in_aadhaar": ("lpad((o_orderkey * 10039)::VARCHAR, 12, '234123')", lambda k: F.lpad((k * 10039).cast("string"), 12, "234123")),
    "sg_id": ("substr('STFGMstx', (o_orderkey % 8 + 1)::INT, 1) || lpad((o_orderkey * 109 % 10000000)::VARCHAR, 7, '0') || chr((65 + o_orderkey % 26)::INT)", lambda k: F.concat(F.substring(F.lit("STFGMstx"), (k % 8 + 1).cast("int"), F.lit(1)), F.lpad((k * 109 % 10000000).cast("string"), 7, "0"), F.char((k % 26 + 65).cast("int")))),
}


def _checksum(name: str, make) -> Query:
    def run(spark, d):
        df = _t(spark, d, "orders").select("o_orderkey", make(F.col("o_orderkey")).alias("value"))
        return df.select("o_orderkey", "value", checksums.check(name, F.col("value")).alias("valid"))

    run.__name__ = f"checksum_{name}"
    return run


for _name, (_sql, _make) in _SHAPES.items():
    query(f"SELECT o_orderkey, value, {O.checksum(_name, 'value')} AS valid FROM (SELECT o_orderkey, {_sql} AS value FROM orders)")(_checksum(_name, _make))

# -------------------------------------------------- tokens and masking, section 2.9


@query(f"SELECT c_custkey, {O.hmac_sql('c_name', KEYS.digest)} AS pii_hash, {O.token_sql(O.q('PERSON'), 'c_name', KEYS.digest)} AS token FROM customer")
def tokenize_customers(spark, d):
    digest = hmac_sha256(F.col("c_name"), KEYS.digest)
    return _t(spark, d, "customer").select("c_custkey", digest.alias("pii_hash"), token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token"))


@query("SELECT c_custkey, c_name AS opened, true AS sealed FROM customer")
def encrypt_round_trip(spark, d):
    df = _t(spark, d, "customer").select("c_custkey", encrypt(F.col("c_name"), KEYS).alias("c"))
    return df.select("c_custkey", decrypt(F.col("c"), KEYS).alias("opened"), F.col("c").rlike("^[0-9a-f]{58,}$").alias("sealed"))


@query("SELECT c_custkey, (v // 500) * 500 || '-' || ((v // 500) * 500 + 500) AS band FROM (SELECT c_custkey, trunc(c_acctbal)::BIGINT AS v FROM customer)")
def bucket_acctbal(spark, d):
    return _t(spark, d, "customer").select("c_custkey", bucket(F.col("c_acctbal").cast("long").cast("string"), 500).alias("band"))


@query()
def mask_digits(spark, d):
    """Digits shifted by a keystream; not expressible without AES."""
    return _t(spark, d, "customer").select("c_custkey", shift_digits(F.col("c_name"), KEYS).alias("masked"))


# ----------------------------------------------------- vault and registry, section 2.10


def _vault(spark, d, most: int) -> DataFrame:
    c = _t(spark, d, "customer").where(F.col("c_nationkey") < most)
    return c.select(hmac_sha256(F.col("c_name"), KEYS.digest).alias("pii_hash"), token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token"), encrypt(F.col("c_name"), KEYS).alias("encrypted_pii"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 60).alias("created_at"))


_HASH, _TOKEN = O.hmac_sql("c_name", KEYS.digest), O.token_sql(O.q("PERSON"), "c_name", KEYS.digest)


@query(f"SELECT {_HASH} AS pii_hash, {_TOKEN} AS token, c_name AS value FROM customer WHERE c_nationkey >= 10")
def vault_insert_ignore(spark, d):
    c = _t(spark, d, "customer")
    hits = c.unionByName(c).select(hmac_sha256(F.col("c_name"), KEYS.digest).alias("pii_hash"), token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token"), F.col("c_name").alias("value"))
    return vault.new_rows(_vault(spark, d, 10), hits)


@query(f"SELECT {_TOKEN} AS token FROM customer WHERE c_custkey * 60 + 1700000000 >= 1700003000")
def vault_purge(spark, d):
    return vault.purge(_vault(spark, d, 99), F.timestamp_seconds(F.lit(1_700_003_000))).select("token")


@query(f"SELECT {_TOKEN} AS token, CASE WHEN c_nationkey < 10 THEN 'DELETED' ELSE 'NOT_FOUND' END AS status FROM customer WHERE c_custkey % 3 = 0")
def vault_erase_status(spark, d):
    asked = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token"))
    return vault.erased(_vault(spark, d, 10), asked)


@query(f"SELECT {_TOKEN} AS token FROM customer WHERE c_nationkey < 10 AND c_custkey % 3 <> 0")
def vault_erase(spark, d):
    asked = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token"))
    return vault.erase(_vault(spark, d, 10), asked).select("token")


@query(f"SELECT {_HASH} AS pii_hash, CASE WHEN c_nationkey < 10 THEN {_TOKEN} END AS token FROM customer")
def vault_lookup(spark, d):
    asked = _t(spark, d, "customer").select(hmac_sha256(F.col("c_name"), KEYS.digest).alias("pii_hash"))
    return vault.lookup(_vault(spark, d, 10), asked)


@query("SELECT count(*) AS entries, count(*) * 256 AS approx_bytes FROM customer WHERE c_nationkey < 10")
def vault_stats(spark, d):
    return vault.stats(_vault(spark, d, 10))


@query(f"SELECT {_TOKEN} AS token, CASE WHEN c_nationkey < 10 THEN c_name ELSE 'ERR_NOT_FOUND' END AS value FROM customer UNION ALL SELECT '[NATION_' || n_nationkey || ']', n_name FROM nation")
def reveal_tokens(spark, d):
    names = _t(spark, d, "nation").select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("NATION").alias("entity_type"), F.col("n_name").alias("canonical_name"))
    asked = _t(spark, d, "customer").select(token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token")).unionByName(names.select(F.concat(F.lit("["), "id", F.lit("]")).alias("token")))
    return vault.reveal(asked, _vault(spark, d, 10), names, KEYS)


@query("SELECT doc_id, sha256(text) AS restored_hash FROM documents")
def rehydrate_documents(spark, d):
    """Redacted e-mail addresses put back: the text is what it was."""
    t = F.col("text")
    df = _t(spark, d, "documents").select("doc_id", "text").withColumn("s", spans.find(t, EMAIL, 0, "EMAIL"))
    hits = df.select(F.explode("s").alias("s")).select(hmac_sha256(F.col("s.value"), KEYS.digest).alias("pii_hash"), token(F.lit("EMAIL"), F.col("s.value"), KEYS).alias("token"), F.col("s.value").alias("value"))
    stored = vault.sealed(hits.dropDuplicates(["pii_hash"]), KEYS)
    redacted = df.select("doc_id", spans.splice(t, F.col("s"), lambda s: token(s["entity"], s["value"], KEYS)).alias("text"))
    return vault.rehydrate(redacted, stored, KEYS, passes=1).select("doc_id", F.sha2("restored", 256).alias("restored_hash"))


def _seeds(spark, d) -> DataFrame:
    return _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit(" org"), (F.col("s_nationkey") % 3).cast("string"), F.lit(" ")).alias("entity_type"), F.when(F.col("s_suppkey") % 7 == 0, F.lit(" ")).otherwise(F.upper("n_name")).alias("canonical_name"),
        F.array(F.col("s_name"), F.concat(F.lit("v"), (F.col("s_suppkey") % 4).cast("string"))).alias("variants"),
    )


_SEEDS = "(SELECT s_suppkey AS ord, 'ORG' || s_nationkey % 3 AS entity_type, upper(n_name) AS canonical_name, [s_name, 'v' || s_suppkey % 4] AS variants FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0)"
_IDS = f"(SELECT canonical_name, entity_type, entity_type || '_' || row_number() OVER (PARTITION BY entity_type ORDER BY ord, lower(canonical_name)) AS id FROM (SELECT canonical_name, arg_min(entity_type, ord) AS entity_type, min(ord) AS ord FROM {_SEEDS} GROUP BY 1))"
_OWNERS = f"(SELECT v AS variant_name, arg_min(id, ord * 10 + place) AS canonical_id FROM (SELECT s.ord, i.id, unnest(s.variants) AS v, generate_subscripts(s.variants, 1) AS place FROM {_SEEDS} s JOIN {_IDS} i USING (canonical_name)) GROUP BY 1)"


def _registered(spark, d) -> tuple[DataFrame, DataFrame]:
    none = spark.createDataFrame([], vault.ENTITIES), spark.createDataFrame([], vault.VARIANTS)
    return vault.register(*none, _seeds(spark, d))


@query(f"SELECT id, entity_type, canonical_name FROM {_IDS}")
def entity_sequence(spark, d):
    return _registered(spark, d)[0].select("id", "entity_type", "canonical_name")


@query(f"SELECT id, entity_type, canonical_name, coalesce(array_to_string(list_sort(list(variant_name) FILTER (WHERE variant_name IS NOT NULL)), ','), '') AS variants FROM {_IDS} LEFT JOIN {_OWNERS} ON canonical_id = id GROUP BY 1, 2, 3")
def entity_list(spark, d):
    return vault.listed(*_registered(spark, d)).withColumn("variants", F.array_join("variants", ","))


@query(f"SELECT s_name AS name, '[' || canonical_id || ']' AS token FROM supplier LEFT JOIN {_OWNERS} ON variant_name = s_name")
def variant_lookup(spark, d):
    return vault.resolve_names(_t(spark, d, "supplier").select(F.lower("s_name").alias("name")), *_registered(spark, d)).join(_t(spark, d, "supplier").select(F.lower("s_name").alias("name"), "s_name"), "name").select(F.col("s_name").alias("name"), "token")


# ------------------------------------------------------------ risk, sections 2.13 and 2.20

_QI, _SA = ["nation", "segment"], ["salary", "phone"]
_PEOPLE = "(SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey % 5 END AS nation, c_mktsegment AS segment, (c_acctbal / 1000)::INT AS salary, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey % 3 END AS phone FROM customer)"


def _people(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select(
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey") % 5).alias("nation"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") / 1000).cast("int").alias("salary"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string"))).alias("phone"),
    )


_PEOPLE = _PEOPLE.replace("(c_acctbal / 1000)::INT", "(sign(c_acctbal) * floor(abs(c_acctbal / 1000) + 0.5))::INT")
_GROUPS = f"(SELECT coalesce(nation::VARCHAR, '*') AS nation, segment, count(*) AS size, count(DISTINCT concat_ws('|', salary::VARCHAR, phone)) AS kinds FROM {_PEOPLE} GROUP BY 1, 2)"
_ANON = f"(SELECT sum(size)::BIGINT AS records, min(size) AS k, min(kinds) AS l, coalesce(sum(size) FILTER (WHERE size < 3), 0)::BIGINT AS violating, min(size) >= 3 AND min(kinds) >= 2 AS compliant FROM {_GROUPS})"
_SCORES = f"""(SELECT *, least(overall / 10, 1.0) AS dataset_score, CASE WHEN overall <= 1 THEN 'MINIMAL' WHEN overall <= 2.5 THEN 'LOW' WHEN overall <= 5 THEN 'MODERATE' WHEN overall <= 7.5 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_label FROM (
 SELECT *, 0.0::DOUBLE + identifiability * 0.35::DOUBLE + financial * 0.25::DOUBLE + reidentification * 0.25::DOUBLE + readiness * 0.15::DOUBLE AS overall FROM (
 SELECT *, (CASE WHEN k <= 0 THEN 10 WHEN k = 1 THEN 9.5 WHEN k = 2 THEN 7 WHEN k = 3 THEN 4 WHEN k <= 5 THEN 2.5 ELSE 1 END)::DOUBLE AS identifiability, least(violating::DOUBLE / records * 12, 10) AS financial,
 (CASE WHEN k <= 1 THEN 5 WHEN k < 3 THEN 3 ELSE 0 END + CASE WHEN l <= 1 THEN 5 ELSE 0 END)::DOUBLE AS reidentification, CASE WHEN compliant THEN 1.5::DOUBLE ELSE least(violating::DOUBLE / records * 10, 10) END AS readiness FROM {_ANON})))"""


@query(f"SELECT * FROM {_GROUPS}")
def risk_groups(spark, d):
    return risk.groups(_people(spark, d), _QI, _SA)


@query(f"SELECT * FROM {_ANON}")
def k_anonymity(spark, d):
    return risk.anonymity(_people(spark, d), _QI, _SA)


_R = lambda cols: ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in cols)
_RC = lambda cols: [F.round(c, 6).alias(c) for c in cols]


@query(f"SELECT k, l, risk_label, {_R(['identifiability', 'financial', 'reidentification', 'readiness', 'overall', 'dataset_score'])} FROM {_SCORES}")
def risk_scores(spark, d):
    one = risk.scores(risk.anonymity(_people(spark, d), _QI, _SA))
    return one.select("k", "l", "risk_label", *_RC(["identifiability", "financial", "reidentification", "readiness", "overall", "dataset_score"]))


_VAR = f"""(SELECT *, (regulatory_min + operational_min) * multiplier_min AS var_min, (regulatory_max + operational_max) * multiplier_max AS var_max FROM (
 SELECT *, (CASE WHEN records < 200 THEN records * 50.0 ELSE 10000 END)::DOUBLE * dataset_score AS regulatory_min, (CASE WHEN records < 200 THEN records * 500.0 ELSE 100000 END)::DOUBLE * dataset_score AS regulatory_max,
 records * 100.0::DOUBLE AS operational_min, records * 300.0::DOUBLE AS operational_max, CASE WHEN k <= 1 THEN 1.5 WHEN k < 3 THEN 1.3 WHEN l <= 1 THEN 1.2 ELSE 1.0 END::DOUBLE AS multiplier_min,
 CASE WHEN k <= 1 THEN 2.0 WHEN k < 3 THEN 1.5 WHEN l <= 1 THEN 1.5 ELSE 1.2 END::DOUBLE AS multiplier_max FROM {_SCORES}))"""
_VAR_COLUMNS = ["regulatory_min", "regulatory_max", "operational_min", "operational_max", "multiplier_min", "multiplier_max", "var_min", "var_max"]


@query(f"SELECT {_R(_VAR_COLUMNS).replace(', 6)', ', 3)')} FROM {_VAR}")
def value_at_risk(spark, d):
    one = risk.exposure(risk.scores(risk.anonymity(_people(spark, d), _QI, _SA)))
    return one.select(*[F.round(c, 3).alias(c) for c in _VAR_COLUMNS])


_READY = f"(SELECT *, CASE WHEN compliant AND k >= 5 THEN 'ALLOW' WHEN compliant OR k >= 3 THEN 'SANITIZE_FIRST' ELSE 'BLOCK' END AS ai_status, CASE WHEN compliant AND k >= 5 THEN CASE WHEN violating::DOUBLE / records > 0.05 THEN 'MODERATE' ELSE 'LOW' END WHEN compliant OR k >= 3 THEN 'MEDIUM' ELSE 'CRITICAL' END AS llm_exposure, compliant AND k >= 5 AS rag_safe FROM {_VAR})"


@query(f"SELECT k, compliant, ai_status, llm_exposure, rag_safe FROM {_READY}")
def ai_readiness(spark, d):
    return risk.report(_people(spark, d), _QI, _SA).select("k", "compliant", "ai_status", "llm_exposure", "rag_safe")


_PHASE = "SELECT {0} AS phase, round(overall * {1}, 6) AS score_min, round(overall * {2}, 6) AS score_max, round({3}, 3) AS var_min, round({4}, 3) AS var_max, {5} AS ai_status FROM " + _READY


@query(f"SELECT *, CASE WHEN score_max <= 1 THEN 'MINIMAL' WHEN score_max <= 2.5 THEN 'LOW' WHEN score_max <= 5 THEN 'MODERATE' WHEN score_max <= 7.5 THEN 'HIGH' ELSE 'CRITICAL' END AS label FROM ({_PHASE.format(chr(39) + 'before' + chr(39), 1, 1, 'var_min', 'var_max', 'ai_status')} UNION ALL {_PHASE.format(chr(39) + 'after' + chr(39), '0.05::DOUBLE', '0.15::DOUBLE', 'var_min * 0.02::DOUBLE', 'var_min * 0.08::DOUBLE', chr(39) + 'ALLOW' + chr(39))})")
def risk_scenario(spark, d):
    one = risk.readiness(risk.exposure(risk.scores(risk.anonymity(_people(spark, d), _QI, _SA))))
    return risk.scenario(one).select("phase", *[F.round(c, 6).alias(c) for c in ("score_min", "score_max")], *[F.round(c, 3).alias(c) for c in ("var_min", "var_max")], "ai_status", "label")


@query("SELECT 'salary' AS attribute, 'GDPR (Financial)' AS regulation, 'Art. 6' AS article, 'MEDIUM' AS severity UNION ALL SELECT 'phone', 'GDPR', 'Art. 4(1)', 'LOW'")
def risk_findings(spark, d):
    return risk.report(_people(spark, d), _QI, _SA).select(F.inline("findings"))


# ------------------------------------------------------- audit and reports, sections 2.13 to 2.16


def _log(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("EMAIL", "PHONE", "CREDIT_CARD", "URL")]), (F.col("user_id") % 4 + 1).cast("int"))
    result = F.when(F.col("event_id") % 10 == 0, F.lit("odd")).otherwise(F.concat(F.lit("["), kind, F.lit("_"), F.lower(F.hex("event_id")), F.lit("]")))
    action = F.element_at(F.array(F.lit("matched"), F.lit("vaulted"), F.lit("revealed")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", "ts", F.col("user_id"), action.alias("action"), result.alias("result"))


_LOG = "(SELECT event_id, ts, user_id, ['matched', 'vaulted', 'revealed'][(event_id % 3 + 1)::INT] AS action, CASE WHEN event_id % 10 = 0 THEN 'UNKNOWN_TOKEN' ELSE ['EMAIL', 'PHONE', 'CREDIT_CARD', 'URL'][(user_id % 4 + 1)::INT] END AS entity FROM events)"
_OWN = f"(SELECT entity, entity IN ('EMAIL', 'PHONE', 'URL', 'ADDRESS', 'PERSON_FOUNDER') AS first FROM {_LOG} WHERE action <> 'revealed')"


@query(f"SELECT *, tier1 * 100.0::DOUBLE / total AS tier1_rate_raw FROM (SELECT count(*) AS total, count(*) FILTER (WHERE first) AS tier1, count(*) FILTER (WHERE NOT first) AS tier2 FROM {_OWN})".replace("*, tier1 * 100.0::DOUBLE / total AS tier1_rate_raw", "total, tier1, tier2, round(tier1::DOUBLE / total * 100, 6) AS tier1_rate, round(tier2::DOUBLE / total * 100, 6) AS tier2_rate"))
def audit_metrics(spark, d):
    return report.log_metrics(_log(spark, d)).withColumns({"tier1_rate": F.round("tier1_rate", 6), "tier2_rate": F.round("tier2_rate", 6)})


@query(f"SELECT entity, count(*) AS n FROM {_OWN} GROUP BY 1 ORDER BY n DESC, entity LIMIT 5")
def audit_top(spark, d):
    return report.top(report.categories(_log(spark, d)), 5)


@query(f"SELECT event_id, action FROM {_LOG} ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_tail(spark, d):
    return report.tail(_log(spark, d), 20, "ts", "event_id").select("event_id", "action")


def _chain(spark, d) -> DataFrame:
    """A log per user whose entries name the hash of the one before; some are spoilt."""
    from pyspark.sql import Window

    e = _t(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("seq")
    base = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("user_id").cast("string"), "event_type")
    rows = e.select(F.col("event_id").alias("seq"), "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.lit("").alias("resource"), F.lit("ok").alias("status"), F.lit("").alias("details"), base.alias("b"))
    # two entries of a chain are enough to show a link: odd places name the genesis, even ones their predecessor
    own = rows.withColumn("odd", F.row_number().over(w) % 2 == 1)
    first = F.concat_ws("|", "timestamp", "actor", "action", "resource", "status", "details", F.lit(audit.GENESIS))
    prev = F.when(F.col("odd"), F.lit(audit.GENESIS)).otherwise(F.sha2(F.lag(first).over(w), 256))
    own = own.withColumn("prev_hash", F.when(F.col("seq") % 50 == 49, F.lit("spoilt")).otherwise(prev))
    return own.withColumn("log", F.concat_ws("-", F.col("user_id").cast("string"), F.floor((F.row_number().over(w) - 1) / 2).cast("string")))


@query("""WITH r AS (SELECT event_id AS seq, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || user_id || '|' || event_type || '||ok||' AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
p AS (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM r)
SELECT seq, CASE WHEN seq % 50 = 49 THEN false WHEN n % 2 = 1 THEN true ELSE before % 50 <> 49 END AS linked FROM p""")
def hash_chain_verify(spark, d):
    return audit.verify(_chain(spark, d), by="log").select("seq", "linked")


@query("SELECT event_id, floor(coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500)::BIGINT AS segment FROM (SELECT event_id, user_id, octet_length(encode('{\"seq\":' || event_id || ',\"user_id\":' || user_id || ',\"action\":\"' || event_type || '\"}')) + 1 AS size FROM events)")
def audit_segments(spark, d):
    log = _t(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("action"))
    return audit.segments(log, 500, "user_id").select(F.col("seq").alias("event_id"), "segment")


@query(f"""SELECT o.o_orderkey AS ord, CASE WHEN c.c_nationkey < 10 OR o.o_orderkey <> min(o.o_orderkey) OVER (PARTITION BY o.o_custkey) THEN 'matched' ELSE 'vaulted' END AS action,
{_TOKEN} AS result, 'GENERAL_PII' AS compliance_mapping FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def audit_events(spark, d):
    """What is logged when every order names its customer and some customers are stored already."""
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hits = o.select(F.col("o_orderkey").alias("ord"), F.lit("PERSON").alias("entity"), hmac_sha256(F.col("c_name"), KEYS.digest).alias("pii_hash"), token(F.lit("PERSON"), F.col("c_name"), KEYS).alias("token"))
    return audit.events(_vault(spark, d, 10), hits)


@query("""SELECT (SELECT count(*) FROM customer WHERE c_nationkey < 10) AS vault_entries, """ + str(len(X.POLICIES)) + """ AS policies_active,
(SELECT string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FROM (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)) AS last""")
def evidence_snapshot(spark, d):
    rules = spark.createDataFrame(X.POLICIES, "ord int, name string, entities array<string>, min_confidence double, action string")
    log = _t(spark, d, "events").select(F.struct("ts", "event_id").alias("timestamp"), F.col("event_type").alias("action"))
    one = report.evidence(_vault(spark, d, 10), rules, log, {"dictionary": True, "rules": True, "model": False}, "1")
    return one.select("vault_entries", "policies_active", F.array_join(F.transform("audit_log_tail", lambda e: e["timestamp"]["event_id"].cast("string")), ",").alias("last"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def audit_expire(spark, d):
    log = _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    return audit.expire(log, F.to_timestamp(F.lit("2024-01-20T00:00:00Z"))).select("event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_limit_window(spark, d):
    return state.recent_calls(_t(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@query()
def rate_limited(spark, d):
    """Exact: denied calls are not counted, which takes a state machine."""
    calls = _t(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("user_id", (F.col("us") / 1e6).alias("at"))
    return state.rate_limited(calls, "user_id", limit=3, window=86400.0)


@query()
def circuit_breakers(spark, d):
    calls = _t(spark, d, "events").select(F.col("event_type").alias("endpoint"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double").alias("at"), (F.col("value") > 20).alias("ok"))
    return state.breakers(calls)


# ----------------------------------------------------------- policy and evaluation


_HITS = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, s) - 1 AS pos FROM ({O.rule_spans('documents', 'doc_id', 'text')}))"


@query(f"SELECT doc_id, bool_or(name IS NOT NULL) AS blocked, arg_min(name, pos * 100 + ord) FILTER (WHERE name IS NOT NULL) AS policy_name, arg_min(entity, pos * 100 + ord) FILTER (WHERE name IS NOT NULL) AS blocked_entity FROM {_HITS} LEFT JOIN {O.values([(o, n, e, m, a) for o, n, e, m, a in X.POLICIES if a == 'block'], 'ord, name, entities, least, act')} ON least <= 1.0 AND (list_contains(entities, '*') OR list_contains([upper(x) FOR x IN entities], entity)) GROUP BY 1")
def policy_decision(spark, d):
    found = detect.scan(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode("detections").alias("pos", "h")).select("doc_id", "pos", "h.entity", "h.confidence")
    rules = spark.createDataFrame(X.POLICIES, "ord int, name string, entities array<string>, min_confidence double, action string")
    return report.decide(found, rules, "doc_id")


def _marks(spark, d) -> tuple[DataFrame, DataFrame]:
    """True and predicted spans over line items: neighbours of orders that partly overlap."""
    o = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("entity"), (F.col("l_linenumber") * 10).alias("start"), F.col("l_quantity").cast("int").alias("n"), "l_linenumber")
    truth = o.select("doc", "entity", "start", (F.col("start") + 5).alias("end"))
    return truth, o.where("n % 3 <> 0").select("doc", "entity", (F.col("start") + F.col("n") % 8).alias("start"), (F.col("start") + F.col("n") % 8 + 3).alias("end"))


_TRUTH = "(SELECT row_number() OVER () AS id, l_orderkey AS doc, l_returnflag AS entity, l_linenumber * 10 AS s, l_linenumber * 10 + 5 AS e FROM lineitem)"
_PRED = "(SELECT row_number() OVER () AS id, l_orderkey AS doc, l_returnflag AS entity, l_linenumber * 10 + l_quantity::INT % 8 AS s, l_linenumber * 10 + l_quantity::INT % 8 + 3 AS e FROM lineitem WHERE l_quantity::INT % 3 <> 0)"
_CONFUSION = f"""(SELECT entity, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp FROM (
 SELECT entity, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fn, 0 AS fp FROM (SELECT t.entity, EXISTS (SELECT 1 FROM {_PRED} p WHERE p.doc = t.doc AND p.entity = t.entity AND t.s < p.e AND p.s < t.e) AS hit FROM {_TRUTH} t) GROUP BY 1
 UNION ALL SELECT entity, 0, 0, count(*) FILTER (WHERE NOT hit) FROM (SELECT p.entity, EXISTS (SELECT 1 FROM {_TRUTH} t WHERE p.doc = t.doc AND p.entity = t.entity AND t.s < p.e AND p.s < t.e) AS hit FROM {_PRED} p) GROUP BY 1) GROUP BY ROLLUP (entity))"""


@query(f"SELECT entity, tp, fn, fp FROM {_CONFUSION}")
def overlap_eval(spark, d):
    return report.confusion(*_marks(spark, d), "doc")


@query(f"SELECT entity, tp, fn, fp FROM {_CONFUSION}".replace("p.doc = t.doc AND p.entity = t.entity AND t.s < p.e AND p.s < t.e) AS hit FROM " + _PRED, "p.doc = t.doc AND t.s < p.e AND p.s < t.e) AS hit FROM " + _PRED))
def overlap_lenient(spark, d):
    """False are only predictions that overlap no true span of any type."""
    return report.lenient_confusion(*_marks(spark, d), "doc")


@query(f"SELECT entity, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 6) AS f1 FROM {_CONFUSION}")
def precision_recall_f1(spark, d):
    return report.accuracy(report.confusion(*_marks(spark, d), "doc")).select("entity", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT round(sum(w * fn) / sum(w * (fn + tp)), 6) AS remaining_risk FROM (SELECT *, CASE entity WHEN 'A' THEN 3.0 WHEN 'R' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM {_CONFUSION} WHERE entity IS NOT NULL)")
def remaining_risk(spark, d):
    return report.remaining_risk(report.confusion(*_marks(spark, d), "doc"), {"A": 3.0, "R": 2.0}).select(F.round("remaining_risk", 6).alias("remaining_risk"))


@query("SELECT count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + ", round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events")
def latency_percentiles(spark, d):
    one = report.latencies(_t(spark, d, "events"), "value")
    return one.select("n", *[F.round(c, 6).alias(c) for c in one.columns if c != "n"])


@query("SELECT round(avg(quality), 6) AS rate, round(avg(doc_id), 6) AS mean_ms FROM labels")
def detection_rate(spark, d):
    return report.detection_rate(_t(spark, d, "labels").select(F.col("quality").alias("found"), F.col("doc_id").alias("ms"))).select(F.round("rate", 6).alias("rate"), F.round("mean_ms", 6).alias("mean_ms"))


_IP = "((o_orderkey * 7) % 256) || '.' || ((o_orderkey * 13) % 256) || '.' || (o_orderkey % 256) || '.1'"


@query(f"SELECT o_orderkey, a = 10 OR a = 127 OR a = 0 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239 AS private FROM (SELECT o_orderkey, (o_orderkey * 7) % 256 AS a, (o_orderkey * 13) % 256 AS b FROM orders)")
def private_addresses(spark, d):
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", (k * 7 % 256).cast("string"), (k * 13 % 256).cast("string"), (k % 256).cast("string"), F.lit("1"))
    return _t(spark, d, "orders").select("o_orderkey", report.private_address(ip).alias("private"))


@query("SELECT * FROM " + O.values([(u, "api.example.com" in u, "localhost" in u or "127.0.0.1" in u) for u in X.URLS], "url, approved, loopback"))
def url_predicates(spark, d):
    u = F.col("url")
    return spark.createDataFrame([(x,) for x in X.URLS], "url string").select("url", report.approved(u, ["API.example.com"]).alias("approved"), report.loopback(u).alias("loopback"))


@query("SELECT event_id, (b LIKE '%\\%7B%' ESCAPE '\\' AND b LIKE '%\\%22%' ESCAPE '\\') OR (starts_with(b, 'ey') AND NOT contains(b, ' ') AND octet_length(encode(b)) > 50) AS obfuscated FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN url_encode(props) WHEN 1 THEN 'ey' || repeat(event_type, 8) ELSE props END AS b FROM events)")
def obfuscated_bodies(spark, d):
    k = F.col("event_id") % 3
    b = F.when(k == 0, F.url_encode("props")).when(k == 1, F.concat(F.lit("ey"), F.repeat("event_type", 8))).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", b.alias("b")).select("event_id", report.obfuscated(F.col("b")).alias("obfuscated"))


@query(f"SELECT c_custkey, regexp_replace({_TOKEN} || ' and [EMAIL_0a]', '\\[PERSON_[0-9a-f]+\\]', '[STRIPPED_PERSON]', 'g') AS stripped FROM customer")
def strip_categories(spark, d):
    t = F.concat(token(F.lit("PERSON"), F.col("c_name"), KEYS), F.lit(" and [EMAIL_0a]"))
    return _t(spark, d, "customer").select("c_custkey", report.strip_categories(t, ["PERSON"]).alias("stripped"))


@query(f"SELECT event_id, abs(epoch(ts)::BIGINT - 1704067200) <= 86400 AND event_id % 2 = 0 AS accepted FROM events".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def signed_webhooks(spark, d):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    good = F.concat(F.lit("v0="), hmac_sha256(F.concat(F.lit("v0:"), at.cast("string"), F.lit(":"), F.col("props")), b"signing key"))
    sig = F.when(F.col("event_id") % 2 == 0, good).otherwise(F.lit("v0=00"))
    return _t(spark, d, "events").select("event_id", report.signed(F.col("props"), at, sig, b"signing key", F.lit(1704067200), 86400).alias("accepted"))


_BODY = """CASE event_id % 5 WHEN 0 THEN '{"type":"url_verification","challenge":"c"}' WHEN 1 THEN 'broken' ELSE '{"type":"event_callback","event":{"type":"' || CASE event_type WHEN 'error' THEN 'reaction' ELSE 'message' END || '","text":"' || CASE WHEN user_id % 7 = 0 THEN '' ELSE 'hello ' || event_id END || '","user":"U' || user_id || '","channel":"C1","ts":"' || event_id || '"' || CASE WHEN event_id % 5 = 2 THEN ',"bot_id":"B1"' ELSE '' END || '}}' END"""


@query("SELECT event_id, 'U' || user_id AS user, 'hello ' || event_id AS text FROM events WHERE event_id % 5 IN (3, 4) AND event_type <> 'error' AND user_id % 7 <> 0")
def webhook_messages(spark, d):
    return report.messages(_t(spark, d, "events").select("event_id", F.expr(_BODY).alias("body"))).select("event_id", "user", "text")


# --------------------------------------------- decoding, sources and streams, 2.1 to 2.3, 2.18


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_html(spark, d):
    return _t(spark, d, "pages").select("page_id", nested.strip_html(F.col("html")).alias("text"))


@query("SELECT c_custkey, translate(upper(c_name || ' x-y.z'), ' -.', '') AS tidied FROM customer")
def normalise_values(spark, d):
    return _t(spark, d, "customer").select("c_custkey", checksums.tidy(F.concat("c_name", F.lit(" x-y.z"))).alias("tidied"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9+/=]{20,}'), ' ') AS runs FROM documents")
def base64_runs(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(nested.base64_runs(F.col("text")), " ").alias("runs"))


@query()
def redact_nested(spark, d):
    """Events' JSON with an encoded address inside, leaf by leaf."""
    body = F.concat(F.lit('{"b":"'), F.base64(F.encode(F.concat(F.lit("mail user"), F.col("event_id").cast("string"), F.lit("@example.com now")), "UTF-8")), F.lit('","p":'), "props", F.lit("}"))
    df = _t(spark, d, "events").select("event_id", body.alias("body"))
    rules = tuple(r for r in RULES if r.entity in ("EMAIL", "IP_ADDRESS"))
    inner = lambda x: detect.redact(x, detect.Config(KEYS, rules=rules, structural=False))
    return nested.redact(df, "body", inner).select("event_id", "redacted")


@query("""SELECT event_id, '{"z":' || event_id || '.50,"b":"user ***","a":[1e3,"***"],"b":"' || event_type || '"}' AS redacted FROM events""")
def redact_spelt(spark, d):
    """Keys stay in order and repeated, numbers as they are written."""
    body = F.expr("""'{ "z": ' || event_id || '.50, "b" : "user secret", "a":[1e3, "secret"], "b":"' || event_type || '"}'""")
    inner = lambda x: x.withColumn("redacted", F.regexp_replace("text", "secret", "***"))
    return nested.redact(_t(spark, d, "events").select("event_id", body.alias("body")), "body", inner, spelt=True).select("event_id", "redacted")


@query("SELECT path, text FROM " + O.values([("a.txt", "plain é"), ("b.pdf", "Hello (World) AB")], "path, text"))
def extract_files(spark, d):
    rows = [("a.txt", "plain é".encode()), ("b.pdf", b"%PDF (Hello \\(World\\)) Tj <4142> << /X >>".replace(b"\\(", b"(").replace(b"\\)", b")"))]
    return extract.extracted(spark.createDataFrame(rows, "path string, content binary")).select("path", "text")


@query("SELECT id, text FROM " + O.values([(1, "--- Record 1 ---\nname: Ann\nage: 3\n\n--- Record 2 ---\nname: Bo, Jr\nage: 4\n\n"), (2, "no records")], "id, text"))
def csv_records(spark, d):
    rows = [(1, 'name,age\nAnn,3\n"Bo, Jr",4\n'), (2, "no records")]
    return spark.createDataFrame(rows, "id int, t string").select("id", extract.csv_records("t").alias("text"))


@query("SELECT path, wanted FROM " + O.values([("/a/b.TXT", True), ("/a/node_modules/b.txt", False), ("/a/b.bin", False), ("/.git/x.md", False), ("/v/x.pdf", True)], "path, wanted"))
def crawl_filter(spark, d):
    rows = [("/a/b.TXT",), ("/a/node_modules/b.txt",), ("/a/b.bin",), ("/.git/x.md",), ("/v/x.pdf",)]
    return spark.createDataFrame(rows, "path string").select("path", files.wanted(F.col("path")).alias("wanted"))


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS text_hash FROM conversations GROUP BY 1")
def recut_streams(spark, d):
    """Turns as the pieces of a stream: nothing is lost by holding back."""
    c = _t(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"))
    cut = state.token_streams(c.join(last, "conv_id").select("conv_id", "turn", "text", (F.col("turn") == F.col("m")).alias("end")), "conv_id", "turn", "text", "end")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return cut.groupBy("conv_id").agg(F.sha2(whole, 256).alias("text_hash"))


def _expected_deltas() -> list[tuple]:
    out, streams = [], {}
    for s, i, x in X.DELTAS:
        out.append((s, i, streams.setdefault(s, state.TokenStream()).push(x)))
    return out


@query("SELECT stream, seq, text FROM " + O.values([(0, 0, "Hello "), (0, 1, "world"), (1, 0, "a "), (1, 1, "[PERSON_ab3c12ef4d5e6f70] b"), (2, 0, ""), (2, 1, "[x](url) "), (2, 2, "[EMAIL_0123456789abcdef]"), (3, 0, "end "), (4, 0, "[lower"), (4, 1, " case]"), (5, 0, ""), (5, 1, ""), (5, 2, ""), (5, 3, "[A_0123456789abcdef] [B_0123456789abcdef]")], "stream, seq, text"))
def recut_fixtures(spark, d):
    return state.token_streams(spark.createDataFrame(X.DELTAS, "stream int, seq long, delta string"), "stream")


@query("SELECT provider, text FROM " + O.values([("openai", "Hello"), ("claude", "Bonjour"), ("gemini", "Hola"), ("local", "ok")], "provider, text"))
def event_streams(spark, d):
    parts = [spark.createDataFrame([(p, b)], "provider string, body string").select("provider", F.array_join(state.deltas(F.col("body"), p), "").alias("text")) for p, b in X.EVENTS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT conv_id, turn, len(string_split_regex(text, '\\n')) AS n FROM conversations")
def line_counts(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", "\n")).cast("long").alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
