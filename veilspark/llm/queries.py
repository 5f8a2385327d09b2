"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, bpe, chat, crf, decontam, flac, paragraphs, secrets, simhash, suffixes, tokencount


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(base.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(base.table(spark, sf_dir, "conversations"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(base.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(base.table(spark, sf_dir, "documents"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(base.table(spark, sf_dir, "documents"))


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.report(base.table(spark, sf_dir, "documents"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_token_counts": op3_token_counts,
    "op4_flac_media": op4_flac_media,
    "op5_paragraph_minhash": op5_paragraph_minhash,
    "op6_quality_crf": op6_quality_crf,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_simhash_near_dup": op10_simhash_near_dup,
}


def _secrets_sql() -> str:
    """All spans by the patterns themselves on every text, with no index."""
    from ..plans.oracles import q, spans

    parts = []
    for k, r in enumerate(secrets.RULES):
        pattern = ("(?i)" if r.fold else "") + r.pattern.replace(r"\U0010ffff", r"\x{10FFFF}")
        own = f"regexp_extract(val[i], {q(pattern)}, {r.group})"
        parts.append(spans("(SELECT doc_id, coalesce(text, '') AS text FROM documents)", "doc_id", "text", pattern, 0, r.kind, k, f" AND length({own}) >= {r.least}"))
    told = "string_agg(entity || ':' || s || ':' || e, ',' ORDER BY s, rule)"
    return f"""WITH found AS ({' UNION ALL '.join(parts)})
    SELECT doc_id, count(*) FILTER (WHERE entity = 'assign') AS n_assign, count(*) FILTER (WHERE entity = 'access') AS n_access, count(*) FILTER (WHERE entity = 'hex') AS n_hex,
      sha256(coalesce({told} FILTER (WHERE rule < {len(secrets.BASE)}), '')) AS base_sha256, coalesce({told} FILTER (WHERE entity IS NOT NULL), '') AS spans
    FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
seen AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM wanted))),
hit AS (SELECT doc_id, item_id, n, i FROM seen JOIN wanted USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES: dict[str, str] = {"op2_chat_perspectives": chat.SQL, "op8_secret_scan": _secrets_sql(), "op9_decontamination": _CONTAMINATION_SQL}
