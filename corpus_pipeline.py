"""A corpus pipeline: rate, de-duplicate, decontaminate, redact, encode.

Each stage works on all that the one before kept:

1. ``quality``: documents that the line classifier rejects go.
2. ``near_duplicates``: of each group that SimHash links, the document with the
   smallest id stays.
3. ``decontamination``: documents of which a twentieth or more are benchmark
   n-grams go.
4. ``secrets``: credentials are replaced by a mark, and ``n_chars`` follows.
5. ``encoding``: texts become byte-level BPE ids, with the digests of the ids
   and of the bytes that they decode to.

The first four return the columns of ``documents``, further ones included, and
names of their own never clash with these. The last returns doc_id, those of
lang, source and n_chars that there are, and what it makes; further columns end
there. Null and empty texts pass through all stages as empty ones; repeated rows
are copies, of which one stays; very long texts are worked on whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import base, bpe, crf, decontam, secrets, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.accepted(docs, base.table(spark, sf_dir, "labels"), base.table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, base.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text"))
    changed = F.col("n_secrets") > 0
    new = {"text": F.when(changed, F.col("redacted")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    coded = bpe.digests(docs.select("doc_id", "text", *own), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids="ids")
    return coded.select("doc_id", *own, "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("encoding", encoding),
]

#: Model scores, fingerprints, spans and ids have no form in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            folder = base.shared_folder(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
