"""Hash-chained audit logs: verification in parallel, appending in order, rotation and expiry."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges

FIELDS = ("timestamp", "actor", "action", "resource", "status", "details", "prev_hash")
SCHEMA = "seq long, timestamp string, actor string, action string, resource string, status string, details string, prev_hash string, signature string"
GENESIS = "0" * 64


def payload(row: dict | None = None):
    """The signed text of an entry: its seven fields, joined; as a column, or of one row."""
    if row is None:
        return F.concat_ws("|", *[F.coalesce(F.col(f), F.lit("")) for f in FIELDS])
    return "|".join(row.get(f) or "" for f in FIELDS)


def append(rows: list[dict], key: bytes, last: str = GENESIS) -> list[dict]:
    """Chains and signs entries (HMAC-SHA256) on the driver; a log's writer works in order."""
    out = []
    for row in rows:
        row = {**row, "prev_hash": last}
        text = payload(row).encode()
        out.append({**row, "signature": hmac.new(key, text, hashlib.sha256).hexdigest()})
        last = hashlib.sha256(text).hexdigest()
    return out


def rotate(rows: list[dict], key: bytes, most: int, path: str, last: str = GENESIS) -> list[list[dict]]:
    """Chains entries into files. A file that has reached ``most`` bytes (none if 0) is closed by a signed checkpoint, and the next begins with another.

    The chain runs on across files: the checkpoint that goes on names the hash of the one that closed.
    """
    out, size = [[]], 0

    def put(row: dict) -> None:
        nonlocal last, size
        out[-1] += append([row], key, last)
        last = hashlib.sha256(payload(out[-1][-1]).encode()).hexdigest()
        size += len(json.dumps(out[-1][-1], ensure_ascii=False, separators=(",", ":")).encode()) + 1

    for row in rows:
        put(row)
        if 0 < most <= size:
            mark = {"timestamp": row.get("timestamp"), "actor": "system", "status": "ALLOW"}
            put({**mark, "action": "CHECKPOINT_ROTATE", "resource": path, "details": "rotating audit log"})
            out.append([])
            size = 0
            put({**mark, "action": "CHECKPOINT_CONTINUE", "resource": f"{path}.{len(out) - 1}.archived", "details": "continuing audit log after rotation"})
    return out


def purge_archives(spark: SparkSession, path: str, cutoff_ms: int) -> list[str]:
    """Deletes closed files of a log that were last written before the cutoff; the open file stays."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{path}.*.archived")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.globStatus(base) or [] if s.getModificationTime() < cutoff_ms]
    for p in old:
        fs.delete(p, False)
    return sorted(p.getName() for p in old)


def events(vault: DataFrame, hits: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, action, result, compliance_mapping) for hits (ord, entity, pii_hash, token): ``matched`` where the value was stored
    before, by the vault or an earlier hit, otherwise ``vaulted``. A stored value keeps its token."""
    from .report import regulation

    first = hits.groupBy("pii_hash").agg(F.min_by(F.struct(F.col(order).alias("o"), "token"), order).alias("_first"))
    known = first.join(vault.select("pii_hash", F.col("token").alias("_kept")), "pii_hash", "left")
    done = hits.join(known, "pii_hash", "left")
    new = F.col("_kept").isNull() & (F.col(order) == F.col("_first.o"))
    return done.select(order, F.when(new, "vaulted").otherwise("matched").alias("action"), F.coalesce("_kept", "_first.token").alias("result"), regulation(F.col("entity")).alias("compliance_mapping"))


def verify(log: DataFrame, key: bytes | None = None, by: str | None = None) -> DataFrame:
    """Adds ``linked`` (the entry names the hash of the one before, or the genesis) and ``signed``.

    Logs are verified in parallel by ``by``; one long log by ranges of ``seq``, each with the last hash of the range before.
    """
    out = log.withColumn("_hash", F.sha2(payload(), 256))
    if by:
        out = out.withColumn("_carried", F.lit(None).cast("string"))
        own = Window.partitionBy(by).orderBy("seq")
    else:
        out = ranges.ranged(out, "seq")
        out = ranges.carried(out, F.max_by("_hash", "seq"), F.last)
        own = Window.partitionBy("_part").orderBy("seq")
    before = F.coalesce(F.lag("_hash").over(own), "_carried", F.lit(GENESIS))
    out = out.withColumn("linked", F.col("prev_hash") == before).drop("_hash", "_carried", "_part")
    if key is not None:
        from ..functions.tokens import hmac_sha256

        out = out.withColumn("signed", F.col("signature") == hmac_sha256(payload(), key))
    return out


def segments(log: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """Adds the number of the file that an entry lies in if files are cut at ``most`` bytes."""
    out = log.withColumn("_size", F.octet_length(F.to_json(F.struct(*[F.col(c) for c in log.columns]))) + 1)
    if by:
        out = out.withColumn("_carried", F.lit(0))
        own = Window.partitionBy(by)
    else:
        out = ranges.ranged(out, "seq")
        out = ranges.carried(out, F.sum("_size"), F.sum)
        own = Window.partitionBy("_part")
    before = F.coalesce(F.sum("_size").over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return out.withColumn("segment", F.floor(before / most).cast("long")).drop("_size", "_carried", "_part")


def expire(log: DataFrame, cutoff: Column, at: str = "timestamp") -> DataFrame:
    """Entries that are not older than the cutoff."""
    return log.where(F.to_timestamp(at) >= cutoff)
