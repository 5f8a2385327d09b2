import json
import os
import random

import numpy as np
from pyspark.sql import functions as F

from veilspark.functions.tokens import Keys
from veilspark.operators import audit, detect, nested, ranges, report, vault

KEYS = Keys.derive(b"secret", b"salt")
SPAN = "doc int, entity string, start int, end int"


def test_ranges_agree_in_every_branch(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("seq"), F.repeat(F.lit("x"), 30).alias("wide"), (F.col("id") % 7).alias("n")).repartition(9)
    rows = ranges.carried(ranges.ranged(df, "seq"), F.sum("n"), F.sum)
    one = rows.groupBy("_part").agg(F.sum("n").alias("n"), F.max("_carried").alias("before"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.max("wide")).orderBy("_part").collect()
    assert len(one) == 4 and [r.before or 0 for r in one] == list(np.cumsum([0] + [r.n for r in one])[:-1])
    assert all(a.high < b.low for a, b in zip(one, one[1:], strict=False))
    assert ranges.ranged(df.limit(0), "seq").count() == 0
    ties = ranges.ranged(spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "k string"), "k").collect()
    assert len({r._part for r in ties if r.k == "a"}) == 1 and min(ties, key=lambda r: r._part).k is None


def test_long_log(spark):
    n = 30_000
    fields = {"timestamp": "t", "actor": "a", "action": "x", "resource": "r", "status": "ok"}
    rows = audit.append([{**fields, "details": str(i)} for i in range(n)], b"k")
    data = [(i, *[r.get(f) for f in audit.FIELDS], r["signature"]) for i, r in enumerate(rows)]
    log = spark.createDataFrame(data, audit.SCHEMA).withColumn("more", F.repeat(F.col("signature"), 3)).repartition(11)
    assert audit.verify(log, b"k").where("linked AND signed").count() == n
    assert {r.seq for r in audit.verify(log.where("seq <> 20000"), b"k").where("NOT linked").collect()} == {20001}


def test_rotation(spark, tmp_path):
    rows = [{"timestamp": str(i), "actor": "a", "action": "x", "resource": "r", "status": "ok", "details": ""} for i in range(40)]
    parts = audit.rotate(rows, b"k", 2000, "audit.log")
    assert len(parts) > 3 and all(p[-1]["action"] == "CHECKPOINT_ROTATE" for p in parts[:-1]) and all(p[0]["action"] == "CHECKPOINT_CONTINUE" for p in parts[1:])
    whole = [r for p in parts for r in p]
    df = spark.createDataFrame([(i, *[r.get(f) for f in audit.FIELDS], r["signature"]) for i, r in enumerate(whole)], audit.SCHEMA)
    assert audit.verify(df, b"k").where("linked AND signed").count() == len(whole) == 40 + 2 * (len(parts) - 1)
    assert audit.rotate(rows, b"k", 0, "audit.log") == [audit.append(rows, b"k")] and audit.rotate([], b"k", 9, "x") == [[]]
    for i, name in enumerate(["a.log.1.archived", "a.log.2.archived", "a.log", "b.log.1.archived"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 * (i + 1), 1000 * (i + 1)))
    assert audit.purge_archives(spark, str(tmp_path / "a.log"), 1_500_000) == ["a.log.1.archived"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.log", "a.log.2.archived", "b.log.1.archived"]


def test_events_of_hits(spark):
    stored = spark.createDataFrame([("h1", "[EMAIL_1]")], "pii_hash string, token string")
    hits = spark.createDataFrame([(1, "EMAIL", "h1", "[X_1]"), (2, "SSN", "h2", "[SSN_2]"), (3, "PERSON", "h2", "[PERSON_2]")], "ord int, entity string, pii_hash string, token string")
    got = [tuple(r) for r in audit.events(stored, hits).orderBy("ord").collect()]
    assert got == [(1, "matched", "[EMAIL_1]", "GDPR"), (2, "vaulted", "[SSN_2]", "GDPR"), (3, "matched", "[SSN_2]", "GENERAL_PII")]


def test_envelopes(spark):
    message = {"type": "message", "text": "hi", "user": "U", "channel": "C", "ts": "1"}
    bodies = [{"type": "event_callback", "event": message}, {"type": "event_callback", "event": {**message, "bot_id": "B"}}, {"type": "event_callback", "event": {**message, "text": ""}},
              {"type": "event_callback"}, {"type": "url_verification", "challenge": "c"}, {"type": "other", "event": message}]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("{broken",), (None,), ("",)], "body string")
    assert [(r.channel, r.user, r.ts, r.text) for r in report.messages(df).collect()] == [("C", "U", "1", "hi")]
    assert [r.challenge for r in report.challenges(df).collect()] == ["c"]


def _overlap(a, b):
    return a[0] == b[0] and a[2] < b[3] and b[2] < a[3]


def test_confusion_against_pairs(spark):
    rnd = random.Random(5)
    make = lambda n: [(rnd.randrange(4), rnd.choice("AB"), s := rnd.randrange(60), s + rnd.randrange(0, 9)) for _ in range(n)]
    truth, pred = make(60), make(60)
    t, p = spark.createDataFrame(truth, SPAN), spark.createDataFrame(pred, SPAN)
    for how, loose in ((report.confusion, False), (report.lenient_confusion, True)):
        tp = sum(any(_overlap(x, y) and x[1] == y[1] for y in pred) for x in truth)
        fp = sum(not any(_overlap(x, y) and (loose or x[1] == y[1]) for x in truth) for y in pred)
        got = {r.entity: (r.tp, r.fn, r.fp) for r in how(t, p, "doc").collect()}
        assert got[None] == (tp, len(truth) - tp, fp) and set(got) == {None, "A", "B"}
    none = spark.createDataFrame([(None, "A", 0, 5)], SPAN)
    assert report.confusion(none, none, "doc").where("entity = 'A'").first()[1:] == (0, 1, 1)
    assert report.confusion(t.limit(0), p.limit(0), "doc").where("entity IS NOT NULL").count() == 0


def test_latencies(spark):
    rnd = random.Random(1)
    ms = [rnd.choice([rnd.random() * 100, 7.0]) for _ in range(5001)]
    r = report.latencies(spark.createDataFrame([(x,) for x in ms] + [(None,)], "ms double").repartition(5)).first()
    assert r.n == 5002 and r.max == max(ms) and abs(r.mean - np.mean(ms)) < 1e-9
    assert np.allclose([r.p50, r.p90, r.p95, r.p99], np.percentile(ms, [50, 90, 95, 99]))
    empty = report.latencies(spark.createDataFrame([], "ms double")).first()
    assert empty.n == 0 and empty.p50 is None and empty.mean is None
    assert report.latencies(spark.createDataFrame([(None,), (None,)], "ms double")).first().n == 2


def test_policies(spark):
    hits = spark.createDataFrame([(1, 0, "EMAIL", 1.0), (1, 1, "IBAN", 1.0), (2, 0, "EMAIL", 0.2), (3, 0, None, 1.0)], "doc int, pos int, entity string, confidence double")
    rules = spark.createDataFrame([(1, "audit", ["*"], 0.0, "audit"), (3, "mail", ["email"], 0.5, "block"), (2, "all", ["*"], 0.9, "block")], "ord int, name string, entities array<string>, min_confidence double, action string")
    got = {r.doc: (r.blocked, r.policy_name, r.blocked_entity) for r in report.decide(hits, rules, "doc").collect()}
    assert got == {1: (True, "all", "EMAIL"), 2: (False, None, None), 3: (True, "all", None)}
    assert report.decide(hits, rules.limit(0), "doc").where("blocked").count() == 0


def test_evidence(spark):
    rules = spark.createDataFrame([(1, "a", "block")], "ord int, name string, action string")
    log = spark.createDataFrame([(f"{i:02}", "u", "vaulted") for i in range(15)], "timestamp string, user string, action string")
    r = report.evidence(spark.createDataFrame([("h",)], "pii_hash string"), rules, log, {"rules": True}, "9").first()
    assert (r.vault_entries, r.policies_active, r.engine_version, r.tiers_active.rules) == (1, 1, "9", True)
    assert [e.timestamp for e in r.audit_log_tail] == [f"{i:02}" for i in range(5, 15)]
    bare = report.evidence(spark.createDataFrame([], "pii_hash string"), rules.limit(0), log.limit(0), {"rules": False}, "9").first()
    assert (bare.vault_entries, bare.policies_active, bare.audit_log_tail) == (0, 0, [])


def test_model_answers(spark):
    texts = ['```json\n[{"entity_type":"NAME","value":" Ann Lee "},{"entity_type":"NAME","value":"Bo"},{"entity_type":"CITY","value":"Rome"}]\n```', "[]", "no array", None]
    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(detect.answered(F.col("t")).alias("a")).collect()]
    assert got == [{"NAME": ["Ann Lee"], "CITY": ["Rome"]}, {}, None, None]


def test_records_are_asked_about_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.write_text("")

    def scanner(texts):
        with open(log, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return [{"person": ["Zed Omega"]} for _ in texts]

    def down(texts):
        raise RuntimeError("down")

    rows = [("Zed Omega wrote this long remark to somebody", "and zed omega answered"), ("ab", None)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    cfg = detect.Config(KEYS, rules=(), structural=False, scanner=down, scanners={"bank": scanner}, domain="bank")
    got = detect.redact_records(df, ["a", "b"], cfg).collect()
    assert "Omega" not in got[0].a and "omega" not in got[0].b and (got[1].a, got[1].b) == ("ab", None)
    assert [json.loads(x) for x in log.read_text().splitlines()] == [json.dumps({"a": rows[0][0], "b": rows[0][1]}, separators=(",", ":"))]
    off = detect.Config(KEYS, rules=(), structural=False, scanner=down, degrade=True)
    assert detect.redact_records(df, ["a", "b"], off).first().a == rows[0][0]
    assert detect.redact_records(df, ["a"], detect.Config(KEYS, rules=(), structural=False)).first().a == rows[0][0]


def test_spelt_json(spark):
    inner = lambda df: df.withColumn("redacted", F.regexp_replace("text", "secret", "***"))
    texts = ['{"b": "a secret", "a" : [1.50, 1E3, "x\\"secret"], "b":"twice \\u0073ecret", "secret":null, "j":"{\\"z\\":1,\\"a\\":\\"secret\\"}"}', "plain secret text", '["secret", {}]', None]
    got = {r.v: r.redacted for r in nested.redact(spark.createDataFrame([(t,) for t in texts], "v string"), "v", inner, spelt=True).collect()}
    assert got[texts[0]] == '{"b":"a ***","a":[1.50,1E3,"x\\"***"],"b":"twice ***","secret":null,"j":"{\\"a\\":\\"***\\",\\"z\\":1}"}'
    assert (got[texts[1]], got[texts[2]], got[None]) == ("plain *** text", '["***",{}]', None)


def test_numbers_run_on_whatever_the_rows(spark):
    seeds = spark.range(20_000).select(F.col("id").alias("ord"), F.lit("person").alias("entity_type"), F.concat(F.lit("Name "), F.xxhash64("id").cast("string")).alias("canonical_name"), F.array().cast("array<string>").alias("variants"))
    empty = spark.createDataFrame([], vault.ENTITIES), spark.createDataFrame([], vault.VARIANTS)
    made, _ = vault.register(*empty, seeds.repartition(7))
    one = made.select(F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("n")).agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(one) == (20_000, 1, 20_000)
