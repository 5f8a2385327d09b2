import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.functions import tokens
from veilspark.functions.tokens import Keys
from veilspark.operators import audit, detect, nested, report, risk, vault
from veilspark.sources import extract, files
from veilspark.streaming import state

KEYS = Keys.derive(b"secret", b"salt")
RULES = tuple(r for r in detect.RULES if r.entity in ("EMAIL", "SSN", "CREDIT_CARD", "BIC"))


def test_redact_all_tiers(spark):
    cfg = detect.Config(KEYS, rules=RULES, dictionary=(("PROJECT", "Blue Falcon"),), entities=(("PERSON_1", "Jane Roe"),))
    texts = ["mail john.doe@example.com, +33 6 12 34 56 78; Hello John Smith, blue falcon, JANE ROE", "Dr House met Anna's friend", None, "ok", "", "card 4532 0151 1283 0366"]
    rows = {r.id: r for r in detect.redact(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), cfg).collect()}
    assert "john.doe" not in rows[0].redacted and "612" not in rows[0].redacted.replace(" ", "") and "Smith" not in rows[0].redacted
    assert "[PERSON_1]" in rows[0].redacted and "falcon" not in rows[0].redacted
    assert "House" not in rows[1].redacted.split("]")[-1] and "Anna" not in rows[1].redacted
    assert [rows[i].redacted for i in (2, 3, 4)] == [None, "ok", ""]
    assert [h.entity for h in rows[5].hits] == ["CREDIT_CARD"]
    one = detect.redact(spark.createDataFrame([(texts[0],)], "text string").repartition(1), cfg).first().redacted
    assert one == rows[0].redacted  # whatever the partitions


def test_model_tier(spark):
    calls = []

    def scanner(texts):
        return [{"private person": ["Zed Omega"], "x": ["mr"]} for _ in texts]

    def broken(texts):
        raise RuntimeError("down")

    df = spark.createDataFrame([("a long text with zed omega plus mr x",)], "text string")
    got = detect.redact(df, detect.Config(KEYS, rules=(), scanner=scanner, structural=False)).first()
    assert got.redacted.startswith("a long text with [PRIVATE_PERSON_") and [h.value for h in got.hits] == ["zed omega"] and not calls
    with pytest.raises(Exception, match="down"):
        detect.redact(df, detect.Config(KEYS, rules=(), scanner=broken)).collect()
    assert detect.redact(df, detect.Config(KEYS, rules=(), scanner=broken, degrade=True, structural=False)).first().redacted == df.first().text


def test_rehydrate_nested_tokens(spark):
    cfg = detect.Config(KEYS, rules=RULES)
    df = spark.createDataFrame([(1, "write to a.b@example.com Martin Smith today"), (2, "nothing")], "doc_id int, text string")
    done = detect.redact(df, cfg)
    stored = vault.sealed(vault.new_rows(spark.createDataFrame([], vault.VAULT), done.select(F.explode("hits").alias("h")).select("h.pii_hash", "h.token", "h.value")), KEYS)
    back = {r.doc_id: r.restored for r in vault.rehydrate(done.select("doc_id", F.col("redacted").alias("text")), stored, KEYS).collect()}
    assert back == {1: "write to a.b@example.com Martin Smith today", 2: "nothing"}


def test_store(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path / "s"), KEYS)
    hits = spark.createDataFrame([("h1", "[A_1]", "x"), ("h1", "[B_1]", "x"), ("h2", "[A_2]", "y")], "pii_hash string, token string, value string")
    store.add_hits(hits)
    store.add_hits(hits)
    assert sorted(r.token for r in store.read("vault").collect()) == ["[A_1]", "[A_2]"]
    seeds = spark.createDataFrame([(1, " person", "Ann Lee", ["A. Lee", "Annie"]), (2, "PERSON", "ann lee", ["AL"]), (3, "org", "Acme", ["Annie"]), (4, "", "x", [])], "ord int, entity_type string, canonical_name string, variants array<string>")
    store.seed(seeds)
    store.seed(spark.createDataFrame([(1, "person", "Bob", [])], "ord int, entity_type string, canonical_name string, variants array<string>"))
    got = {r.id: (r.canonical_name, r.variants) for r in vault.listed(store.read("entities"), store.read("variants")).collect()}
    assert got == {"PERSON_1": ("Ann Lee", ["A. Lee", "AL", "Annie"]), "ORG_1": ("Acme", []), "PERSON_2": ("Bob", [])}
    names = vault.resolve_names(spark.createDataFrame([("ANNIE",), ("bob",), ("q",)], "name string"), store.read("entities"), store.read("variants"))
    assert {r.name: r.token for r in names.collect()} == {"ANNIE": "[PERSON_1]", "bob": "[PERSON_2]", "q": None}
    told = store.forget(spark.createDataFrame([("[A_1]",), ("[Z_9]",)], "token string"))
    assert {r.token: r.status for r in told.collect()} == {"[A_1]": "DELETED", "[Z_9]": "NOT_FOUND"}
    assert store.sweep(90) == 0 and store.read("vault").count() == 1
    left = [f for f in (tmp_path / "s" / "vault").rglob("*.parquet")]
    assert len({f.parent for f in left}) == 1 and spark.read.parquet(str(tmp_path / "s" / "vault" / "*")).select("token").collect() == [("[A_2]",)]
    spark.createDataFrame([("h3", "[A_3]", "00", None)], vault.VAULT).selectExpr("pii_hash", "token", "encrypted_pii", "timestamp'2001-01-01' AS created_at").write.parquet(str(tmp_path / "old"))
    store.write("vault", store.read("vault").unionByName(spark.read.parquet(str(tmp_path / "old"))))
    assert store.sweep(90) == 1 and len({f.parent for f in (tmp_path / "s" / "vault").rglob("*.parquet")}) == 1
    other = vault.Store(spark, str(tmp_path / "t"), KEYS)
    store.migrate(other)
    store.migrate(other)
    assert other.read("vault").count() == 1


def test_risk_examples(spark):
    rows = [("30", "75", "flu"), ("30", "75", "cold"), ("30", "75", "flu"), ("40", "69", "flu"), ("40", "69", "cold"), ("40", "69", "cold")]
    df = spark.createDataFrame(rows, "age string, zip string, disease string")
    one = risk.report(df, ["age", "zip"], ["disease"]).first()
    assert (one.k, one.l, one.compliant, one.violating) == (3, 2, True, 0)
    worse = risk.report(df.unionByName(spark.createDataFrame([("50", None, "flu")], df.schema)), ["age", "zip"], ["disease"]).first()
    assert (worse.k, worse.compliant, worse.ai_status) == (1, False, "BLOCK")
    none = risk.report(df.limit(0), ["age"], ["disease"]).first()
    assert none.records == 0 and none.overall is None
    assert "| k | 3 |" in report.markdown(one.asDict())


def test_log_metrics(spark):
    log = [("vaulted", "[EMAIL_1a2b]"), ("matched", "[EMAIL_1a2b]"), ("vaulted", "[PHONE_ff]"), ("vaulted", "[SSN_0]"), ("revealed", "[SSN_0]")]
    df = spark.createDataFrame(log, "action string, result string")
    m = report.log_metrics(df).first()
    assert (m.total, m.tier1, m.tier2) == (4, 3, 1) and report.top(report.categories(df), 1).first() == ("EMAIL", 2)
    assert "<li>EMAIL: 2</li>" in report.html(m.asDict(), [("EMAIL", 2)])


def test_audit_chain(spark):
    rows = audit.append([{"timestamp": str(i), "actor": "a", "action": "x", "resource": "r", "status": "ok"} for i in range(5)], b"k")
    df = spark.createDataFrame([(i, r["timestamp"], r["actor"], r["action"], r["resource"], r["status"], None, r["prev_hash"], r["signature"]) for i, r in enumerate(rows)], audit.SCHEMA)
    assert all(r.linked and r.signed for r in audit.verify(df, b"k").collect())
    long = audit.append([{"timestamp": str(i), "actor": "a", "action": "x", "resource": "r" * (i % 7), "status": "ok"} for i in range(300)], b"k")
    log = spark.createDataFrame([(i, r["timestamp"], r["actor"], r["action"], r["resource"], r["status"], None, r["prev_hash"], r["signature"]) for i, r in enumerate(long)], audit.SCHEMA).repartition(7)
    assert audit.verify(log, b"k").where("linked AND signed").count() == 300
    assert [r.seq for r in audit.verify(log.where("seq <> 150"), b"k").where("NOT linked").collect()] == [151]
    log = log.withColumn("all", F.lit(1))
    one, two = ({r.seq: r.segment for r in audit.segments(log, 1000, by).collect()} for by in (None, "all"))
    assert one == two and max(one.values()) > 10
    bad = df.withColumn("actor", F.when(F.col("seq") == 2, "b").otherwise(F.col("actor")))
    assert [(r.linked, r.signed) for r in audit.verify(bad, b"k").orderBy("seq").collect()] == [(True, True), (True, True), (True, False), (False, True), (True, True)]


def test_nested(spark):
    import base64
    import json

    inner = lambda df: df.withColumn("redacted", F.regexp_replace("text", "secret", "***"))
    b = base64.b64encode(b"my secret words").decode()
    v = json.dumps({"z": ["a secret", 1, None], "secret": {"b": b}, "u": "a%20secret%21", "j": '{"k":"secret<"}', "mixed": f"see {b} and secret"})
    got = nested.redact(spark.createDataFrame([(v,), ("plain secret",), (None,), ("",)], "v string"), "v", inner).collect()
    one = json.loads(next(r.redacted for r in got if r.v == v))
    assert one["z"] == ["a ***", 1, None] and "secret" in one and base64.b64decode(one["secret"]["b"]) == b"my *** words"
    assert one["u"] == "a+%2A%2A%2A%21" and one["j"] == '{"k":"***\\u003c"}'
    assert one["mixed"] == f"see {base64.b64encode(b'my *** words').decode()} and ***"
    assert {r.v: r.redacted for r in got if r.v != v} == {"plain secret": "plain ***", None: None, "": ""}


def test_extractors(spark):
    def archive(name, body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, body)
        return out.getvalue()

    x = '<w:d xmlns:w="u"><w:t>Hello</w:t><w:x>no</w:x><w:t>World</w:t></w:d>'
    rows = [("a.docx", archive("word/document.xml", x)), ("b.pptx", archive("ppt/slides/slide1.xml", x)), ("c.docx", b"not a zip"), ("d.txt", b"t"), ("e.pdf", b"(a\\)b) <48 49> <<x>>")]
    got = {r.path: r for r in extract.extracted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"].text == got["b.pptx"].text == "Hello World" and got["c.docx"].error and got["d.txt"].text == "t"
    assert got["e.pdf"].text == "a\\)b HI"
    doc = spark.createDataFrame([('<w>Title</w>\n\\o "1-3" \\h\n 12 \n PAGEREF _Toc123 done',)], "t string")
    assert doc.select(extract.clean_document(F.col("t"))).first()[0] == "Title\ndone"


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "d" / "b.csv").write_text('a,"b,c"\n,\n1,2,3\n"two\nlines",x\n"bad"cell\nend')
    (tmp_path / "d" / "c.json").write_text('["x", {"y": 1}]')
    (tmp_path / "d" / "node_modules").mkdir()
    (tmp_path / "d" / "node_modules" / "z.txt").write_text("no")
    (tmp_path / "d" / "log.json").write_text('{"action":"vaulted","result":"[A_1]"}\nbroken\n')
    p = f"{tmp_path}/d"
    assert [r.text for r in files.lines(spark, f"{p}/a.txt").collect()] == ["one", "", "two"]
    assert files.lines(spark, f"{p}/a.txt", blank=False).count() == 2
    assert [r.text for r in files.body(spark, f"{p}/a.txt").orderBy("line").collect()] == ["one", "", "two"]
    assert [r.cells for r in files.ragged_csv(spark, f"{p}/b.csv").collect()] == [["a", "b,c"], ["1", "2", "3"], ["two\nlines", "x"], ["end"]]
    assert [r.row for r in files.ragged_csv(spark, f"{p}/b.csv").collect()][2] == '"two\nlines",x'
    assert [r.value for r in files.json_values(spark, f"{p}/c.json").orderBy("ord").collect()] == ["x", '{"y":1}']
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.crawl(spark, p).collect()) == ["a.txt", "b.csv", "c.json", "log.json"]
    assert files.audit_log(spark, f"{p}/log.json").count() == 1


def test_state_machines(spark):
    s = state.TokenStream()
    assert [s.push(x) for x in ("a [PER", "SON_0123456789abcdef] [", "x]")] == ["a ", "[PERSON_0123456789abcdef] ", "[x]"]
    lim = state.Limiter(2, 10)
    assert [lim.call(t) for t in (0, 1, 2, 10.5, 11.5)] == [True, True, False, True, True]
    b = state.Breaker()
    assert [b.outcome(t, ok) for t, ok in ((0, False), (1, False), (2, False), (3, True), (33, True), (34, True), (35, False))] == ["closed", "closed", "open", "open", "half-open", "closed", "closed"]
    df = spark.createDataFrame([("a [X",), ("[md] x",), ("[A_0123456789abcdef]",), ("plain",)], "t string")
    assert [(r[0].safe, r[0].held) for r in df.select(state.hold(F.col("t"))).collect()] == [("a ", "[X"), ("[md] x", ""), ("[A_0123456789abcdef]", ""), ("plain", "")]


def test_streaming_tokens(spark, tmp_path):
    kind = "stream_id int, seq long, delta string"
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, 0, "x [A_0123"), (2, 0, "hi")], kind).coalesce(1).write.mode("append").parquet(src)
    out = state.token_streams(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src))
    q = out.writeStream.format("memory").queryName("recut").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 1, "456789abcdef] y")], kind).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {(r.stream_id, r.seq): r.text for r in spark.table("recut").collect()}
    assert got == {(1, 0): "x ", (2, 0): "hi", (1, 1): "[A_0123456789abcdef] y"}


def test_sql_functions(spark):
    from veilspark.functions import sql

    sql.register(spark, KEYS)
    r = spark.sql("SELECT entity, value FROM pii_spans('mail a.b@example.com') WHERE entity = 'EMAIL'").collect()
    assert [tuple(x) for x in r] == [("EMAIL", "a.b@example.com")]
    got = spark.sql("SELECT pii_token('X', v) AS t, v, pii_token('X', NULL) AS n FROM VALUES ('é v'), ('') AS x(v)").select("t", "n", tokens.token(F.lit("X"), F.col("v"), KEYS).alias("w")).collect()
    assert all(r.t == r.w and r.t.startswith("[X_") and r.n is None for r in got)


def test_prescrub_and_sample(spark):
    df = spark.createDataFrame([(1, "line one\nvisit the Pharmacie du Centre\nmail a.b@example.com"), (2, "nothing"), (3, None)], "id int, text string")
    got = {r.id: r.scrubbed for r in detect.prescrub(df, KEYS, rules=tuple(r for r in detect.RULES if r.entity in ("HEALTH_ENTITY", "EMAIL"))).collect()}
    first, second, third = got[1].split("\n")
    assert first == "line one" and second.startswith(f"{detect.HEALTH_TAG} visit the [HEALTH_ENTITY_") and third.startswith("mail [EMAIL_")
    assert got[2] == "nothing" and got[3] is None
    assert detect.sample(df, 2, "id").collect() == detect.sample(df.repartition(3), 2, "id").collect()


def test_long_lines_are_passed_on(spark, tmp_path):
    (tmp_path / "long.txt").write_text("a\n" + "x" * ((1 << 20) + 1) + "\nb\n")
    assert sorted(len(r.text) for r in files.lines(spark, str(tmp_path / "long.txt")).collect()) == [1, 1, (1 << 20) + 1]


def test_nested_without_bounds(spark):
    import base64
    import json

    def wrapped(text, n):
        for _ in range(n):
            text = base64.b64encode(text.encode()).decode()
        return text

    deep = wrapped("my secret words", 20)
    objects = "secret"
    for _ in range(50):
        objects = json.dumps({"k": objects}) if _ % 5 == 0 else {"k": objects}
    far = json.loads("[" * 400 + '"a secret"' + "]" * 400)
    texts = [deep, json.dumps(objects), json.dumps(far), "[" * 200_000, '{"a":' * 3000 + '"secret"' + "}" * 3000]
    inner = lambda df: df.withColumn("redacted", F.regexp_replace("text", "secret", "***"))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string")
    got = {r.id: r.redacted for r in nested.redact(df, "v", inner).collect()}
    assert got[0] == wrapped("my *** words", 20)
    assert "secret" not in got[1] and "***" in got[1] and "secret" not in got[2] and got[2].count("[") == 400
    assert got[3] == texts[3] and "secret" not in got[4] and "***" in got[4]


def test_restoring_rows_without_a_key(spark):
    known = vault.sealed(spark.createDataFrame([("h1", "[A_1a]", "x")], "pii_hash string, token string, value string"), KEYS)
    df = spark.createDataFrame([(None, "see [A_1a]"), (1, "[A_1a] [B_2b]"), (1, "[A_1a]"), (2, "no")], "doc_id int, text string")
    assert sorted(r.restored for r in vault.rehydrate(df, known, KEYS).collect()) == ["no", "see x", "x", "x [B_2b]"]
