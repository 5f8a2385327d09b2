"""Reports over hits and audit logs, policy decisions, and accuracy of detection."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

# Entities counted as first tier; regulations of entities.
TIER1 = ("EMAIL", "PHONE", "URL", "ADDRESS", "PERSON_FOUNDER")
REGULATIONS = {
    "EMAIL": ("GDPR", "Art. 4(1)"), "ADDRESS": ("GDPR", "Art. 4(1)"), "EU_ADDRESS": ("GDPR", "Art. 4(1)"), "PHONE": ("GDPR", "Art. 4(1)"), "URL": ("GDPR", "Art. 4(1)"),
    "PATIENT_ID": ("HIPAA", "164.514(b)"), "MEDICAL_RECORD": ("HIPAA", "164.514(b)"), "PERSON_VIP": ("BUSINESS_SECRETS", "Internal"), "INTERNAL_PROJECT": ("BUSINESS_SECRETS", "Internal"),
    "PERSON_FOUNDER": ("BUSINESS_SECRETS", "Internal"), "TRANSACTION_CODE": ("BUSINESS_SECRETS", "Internal"), "CREDIT_CARD": ("PCI_DSS", "Sec. 3"), "SSN": ("GDPR", "Art. 6"),
    "IBAN": ("GDPR", "Art. 32"), "EU_VAT": ("GDPR", "Art. 4(1)"), "FR_NIR": ("GDPR", "Art. 9"), "ES_DNI": ("GDPR", "Art. 4(1)"), "DE_STEUER_ID": ("GDPR", "Art. 4(1)"),
    "IT_CODICE_FISCALE": ("GDPR", "Art. 4(1)"), "NL_BSN": ("GDPR", "Art. 4(1)"), "UK_NINO": ("UK GDPR", "Art. 4(1)"), "UK_NHS": ("UK GDPR", "Art. 9"),
}
DEFAULT_REGULATION = "GENERAL_PII"
LOG = "timestamp string, user string, action string, result string, compliance_mapping string"


def regulation(entity: Column) -> Column:
    """The regulation of an entity."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in REGULATIONS.items() for x in (F.lit(k), F.lit(v[0]))]), entity), F.lit(DEFAULT_REGULATION))


def article(entity: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in REGULATIONS.items() for x in (F.lit(k), F.lit(v[1]))]), entity)


# --------------------------------------------------------------------- hits


def hits_report(df: DataFrame, detections: str = "detections", mode: str = "scan") -> DataFrame:
    """One row: files scanned, number of hits, whether that blocks. The hits themselves stay a table (``hits``)."""
    return df.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum(F.size(detections)), F.lit(0)).cast("long").alias("total_pii_count")).select(F.lit(mode).alias("mode"), "files_scanned", "total_pii_count", (F.col("total_pii_count") > 0).alias("blocking"))


def hits(df: DataFrame, key: str = "doc_id", detections: str = "detections") -> DataFrame:
    return df.select(key, F.inline(detections))


def heat_map(df: DataFrame, by: list[str], detections: str = "detections") -> DataFrame:
    """Files and exposures by any columns."""
    return df.groupBy(*by).agg(F.count("*").alias("files"), F.sum(F.size(detections)).cast("long").alias("total_pii"))


def top(counts: DataFrame, k: int, by: str = "n", name: str = "entity") -> DataFrame:
    return counts.orderBy(F.desc(by), name).limit(k)


# --------------------------------------------------------------------- logs


def token_type(result: Column) -> Column:
    found = F.regexp_extract(result, r"^\[([A-Z_]+)_[a-f0-9]+.*\]\z", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "UNKNOWN_TOKEN").otherwise(found)


def categories(log: DataFrame) -> DataFrame:
    """Protected values by type."""
    return log.where(F.col("action").isin("vaulted", "matched")).groupBy(token_type(F.col("result")).alias("entity")).agg(F.count("*").alias("n"))


def log_metrics(log: DataFrame) -> DataFrame:
    """total, tier counts and tier rates of protected values."""
    kind = token_type(F.col("result"))
    own = log.where(F.col("action").isin("vaulted", "matched")).select(kind.isin(*TIER1).alias("first"))
    one = own.agg(F.count("*").alias("total"), F.count_if("first").alias("tier1"), F.count_if(~F.col("first")).alias("tier2"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0)
    return one.withColumns({"tier1_rate": rate("tier1"), "tier2_rate": rate("tier2")})


def tail(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n entries, newest first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def html(metrics: dict, tops: list[tuple[str, int]], title: str = "Privacy compliance report") -> str:
    """A page for one row of metrics."""
    from html import escape

    rows = "".join(f"<tr><td>{escape(k)}</td><td>{v}</td></tr>" for k, v in metrics.items())
    most = "".join(f"<li>{escape(k)}: {n}</li>" for k, n in tops)
    return f"<!doctype html><html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{rows}</table><ol>{most}</ol></body></html>"


def markdown(report: dict, title: str = "Dataset risk report") -> str:
    lines = [f"# {title}", "", "| measure | value |", "| --- | --- |"]
    lines += [f"| {k} | {v:.2f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in report.items() if k != "findings"]
    return "\n".join([*lines, "", *[f"- {f['attribute']}: {f['regulation']} {f['article']} ({f['severity']})" for f in report.get("findings") or []]])


# ------------------------------------------------------------------- policy


def decide(hits: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """(key, blocked, policy_name, blocked_entity): the first hit, and for it the first blocking policy, that match.

    ``hits``: key, pos, entity, confidence. ``policies``: ord, name, entities, min_confidence, action. Hits and policies
    meet on the entity or on ``*``, by an equality, so a set of policies may be of any size.
    """
    rules = policies.where("action = 'block'").select("ord", "name", "min_confidence", F.explode(F.transform("entities", lambda e: F.upper(e))).alias("_rule"))
    asked = hits.withColumn("_asked", F.explode(F.array(F.upper("entity"), F.lit("*"))))
    met = asked.join(rules, (F.col("_asked") == F.col("_rule")) & (F.col("confidence") >= F.col("min_confidence")), "left")
    first = F.min_by(F.struct("name", "entity"), F.when(F.col("_rule").isNotNull(), F.struct("pos", "ord")))
    return met.groupBy(key).agg(first.alias("f")).select(key, F.col("f").isNotNull().alias("blocked"), F.col("f.name").alias("policy_name"), F.col("f.entity").alias("blocked_entity"))


def allowed_model(models: Column, model: Column) -> Column:
    return (F.size(models) == 0) | F.array_contains(models, model)


def within_size(length: Column, most: Column) -> Column:
    return (most == 0) | (length <= most)


def strip_categories(text: Column, categories: list[str]) -> Column:
    for c in categories:
        text = F.regexp_replace(text, rf"\[{c}_[0-9a-f]+\]", f"[STRIPPED_{c}]")
    return text


def approved(url: Column, domains: list[str]) -> Column:
    """Whether the host is listed; an empty list allows nothing."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*[d.lower() for d in domains]), F.lit(False)) if domains else F.lit(False)


def private_address(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is unspecified, loopback, link-local, multicast or private."""
    n = [F.regexp_extract(ip, r"^([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\z", i).try_cast("int") for i in (1, 2, 3, 4)]
    four = (n[0] == 10) | (n[0] == 127) | (n[0] == 0) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 169) & (n[1] == 254)) | n[0].between(224, 239)
    six = F.lower(ip).rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)\z")
    mapped = F.regexp_extract(F.lower(ip), r"^::ffff:([0-9.]+)\z", 1)
    return F.when(ip.contains(":"), six | F.when(mapped != "", F.lit(True) & mapped.rlike(r"^(?:10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.")).otherwise(False)).otherwise(F.coalesce(four, F.lit(False)))


def loopback(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin("localhost", "[::1]") | host.rlike(r"^127(?:\.[0-9]{1,3}){3}\z"), F.lit(False))


def obfuscated(body: Column) -> Column:
    """Escaped JSON or a long run that looks like an encoded object."""
    return (body.contains("%7B") & body.contains("%22")) | (F.startswith(body, F.lit("ey")) & ~body.contains(" ") & (F.octet_length(body) > 50))


def signed(body: Column, timestamp: Column, signature: Column, key: bytes, now: Column, window: int = 300) -> Column:
    """A webhook's signature over version, time and body, no older or newer than the window."""
    from ..functions.tokens import hmac_sha256

    want = F.concat(F.lit("v0="), hmac_sha256(F.concat(F.lit("v0:"), timestamp.cast("string"), F.lit(":"), body), key))
    return (signature == want) & (F.abs(now - timestamp) <= window)


ENVELOPE = "type string, challenge string, event struct<type string, text string, user string, channel string, ts string, bot_id string>"


def messages(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds channel, user, ts and text of event envelopes that hold a person's message; bots, other events, empty texts and broken bodies go."""
    e = F.col("_e.event")
    people = (F.col("_e.type") == "event_callback") & (e["type"] == "message") & (F.coalesce(e["bot_id"], F.lit("")) == "") & (F.coalesce(e["text"], F.lit("")) != "")
    return df.withColumn("_e", F.from_json(body, ENVELOPE)).where(people).withColumns({c: e[c] for c in ("channel", "user", "ts", "text")}).drop("_e")


def challenges(df: DataFrame, body: str = "body") -> DataFrame:
    """What to answer to envelopes that verify an address."""
    return df.withColumn("_e", F.from_json(body, ENVELOPE)).where("_e.type = 'url_verification'").withColumn("challenge", F.col("_e.challenge")).drop("_e")


def evidence(vault: DataFrame, policies: DataFrame, log: DataFrame, tiers: dict[str, bool], version: str, order: str = "timestamp", n: int = 10) -> DataFrame:
    """One row: what is stored, the policies in force, the tiers that run and the last entries of the log, oldest first."""
    last = tail(log, n, order).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in log.columns if c != order]))).alias("t"))
    rules = policies.agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in policies.columns if c != "ord"]))).alias("p"))
    return vault.agg(F.count("*").alias("vault_entries")).select(
        F.lit("1").alias("schema_version"), F.current_timestamp().alias("generated_at"), F.lit(version).alias("engine_version"), "vault_entries",
        F.size(rules.scalar()).alias("policies_active"), rules.scalar().alias("policy_snapshot"),
        F.struct(*[F.lit(v).alias(k) for k, v in tiers.items()]).alias("tiers_active"), last.scalar().alias("audit_log_tail"),
    )


def report_id(c: Column) -> Column:
    return c.rlike(r"^[A-F0-9]+\z")


# --------------------------------------------------------------- evaluation


def overlaps(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of one text and type that overlap."""
    t = truth.select(key, F.col("entity"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    p = predicted.select(key, F.col("entity"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return t.join(p, [key, "entity"]).where("t_start < p_end AND p_start < t_end")


def met(own: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """(entity, hit): whether one of the other spans overlaps a span, within equal ``by``.

    No pairs are made: in order of place, the farthest end of the spans that begin before a span's end tells. Rows are
    dealt by ranges of that order, so one text may hold very many spans. Spans without a value in ``by`` meet none.
    """
    keys = list(dict.fromkeys([*by, "entity"]))
    mine = own.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_at"), F.lit(None).cast("long").alias("_far"), F.lit(0).alias("_kind"))
    theirs = other.select(*keys, F.lit(None).cast("long").alias("_s"), F.col("start").alias("_at"), F.col("end").cast("long").alias("_far"), F.lit(1).alias("_kind"))
    rows = ranges.carried(ranges.ranged(mine.unionByName(theirs), *by, "_at", "_kind"), F.max("_far"), F.max, tuple(by))
    far = F.max("_far").over(Window.partitionBy(*by, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    known = reduce(and_, [F.col(c).isNotNull() for c in by])
    return rows.withColumn("_far", F.greatest(far, "_carried")).where("_kind = 0").select("entity", (known & F.coalesce(F.col("_far") > F.col("_s"), F.lit(False))).alias("hit"))


def _counted(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    both = truth.withColumn("true", F.lit(True)).unionByName(predicted.withColumn("true", F.lit(False)))
    return both.rollup("entity").agg(F.count_if(F.col("true") & F.col("hit")).alias("tp"), F.count_if(F.col("true") & ~F.col("hit")).alias("fn"), F.count_if(~F.col("true") & ~F.col("hit")).alias("fp"))


def confusion(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """tp, fn, fp by type and, under null, overall. A prediction may serve several true spans."""
    return _counted(met(truth, predicted, [key, "entity"]), met(predicted, truth, [key, "entity"]))


def lenient_confusion(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """As ``confusion``, but a prediction is false only if it overlaps no true span of any type."""
    return _counted(met(truth, predicted, [key, "entity"]), met(predicted, truth, [key]))


def accuracy(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1, zero where undefined."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    return out.withColumn("f1", safe(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def remaining_risk(counts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weight of the missed spans over that of all true ones."""
    w = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), "entity"), F.lit(1.0))
    own = counts.where("entity IS NOT NULL")
    return own.agg(F.coalesce(F.try_divide(F.sum(w * F.col("fn")), F.sum(w * (F.col("fn") + F.col("tp")))), F.lit(0.0)).alias("remaining_risk"))


def latencies(df: DataFrame, ms: str = "ms") -> DataFrame:
    """Exact percentiles, interpolated, and count, mean and maximum, in one row; missing values count in ``n`` only.

    Values are counted first, and ranks run over ranges of them, so no task holds all values.
    """
    counts = df.groupBy(F.col(ms).alias("v")).agg(F.count("*").alias("c")).withColumn("k", F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0))
    rows = ranges.carried(ranges.ranged(counts, "v"), F.sum("k"), F.sum)
    upto = F.sum("k").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_carried", F.lit(0))
    rows = rows.withColumn("upto", upto).withColumn("last", counts.agg((F.sum("k") - 1).alias("last")).scalar())
    pick = lambda at: F.min(F.when(F.col("upto") > at, F.col("v")))

    def percentile(q: float) -> Column:
        at = F.col("last") * q
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        return (low + (high - low) * F.max(at - F.floor(at))).alias(f"p{round(q * 100)}")

    mean = F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("k")).alias("mean")
    return rows.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[percentile(q) for q in (0.5, 0.9, 0.95, 0.99)], mean, F.max("v").alias("max"))


def detection_rate(df: DataFrame, found: str = "found", ms: str = "ms") -> DataFrame:
    return df.agg(F.avg(F.col(found).cast("int")).alias("rate"), F.avg(ms).alias("mean_ms"))
