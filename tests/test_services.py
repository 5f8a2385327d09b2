import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from veilspark.sources import files, services


@pytest.fixture(scope="module")
def site():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            here = f"http://127.0.0.1:{self.server.server_port}"
            token = self.headers.get("Authorization") or self.headers.get("X-API-Key") or ""
            pages = {
                "/plain": ("text/plain", "hello " + token),
                "/big": ("text/plain", "x" * 2000),
                "/chat": ("application/json", json.dumps({"messages": [{"ts": "1", "user": "U1", "type": "message", "text": "hi"}, {"ts": "2", "bot_id": "B", "type": "message", "text": "beep"}], "auth": token})),
                "/drive": ("application/json", json.dumps({"value": [{"id": "1", "name": "a.txt", "size": 3, "file": {}}], "@odata.nextLink": here + "/drive2"})),
                "/drive2": ("application/json", json.dumps({"value": [{"id": "2", "name": "old", "deleted": {}}], "@odata.deltaLink": here + "/drive3"})),
                "/drive3": ("application/json", json.dumps({"value": []})),
            }
            kind, body = pages.get(self.path.split("?")[0], ("", ""))
            self.send_response(200 if kind else 404)
            self.send_header("Content-Type", kind or "text/plain")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest(spark, site):
    services.register(spark)
    rows = spark.read.format("rest").option("auth", "bearer").option("secret", "s").load(f"{site}/plain,{site}/drive3").collect()
    assert {(r.content_type, bytes(r.body)) for r in rows} == {("text/plain", b"hello Bearer s"), ("application/json", b'{"value": []}')}
    key = spark.read.format("rest").option("auth", "api_key").option("secret", "k").load(f"{site}/plain").first()
    assert bytes(key.body) == b"hello k"
    for path, options in ((f"{site}/big", {"max_bytes": "100"}), (f"{site}/none", {}), ("file:///etc/hostname", {})):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.format("rest").options(**options).load(path).collect()


def test_chat_history(spark, site):
    services.register(spark)
    rows = spark.read.format("chat_history").option("secret", "s").load(f"{site}/chat").orderBy("ts").collect()
    assert [(r.user, r.bot_id, r.text) for r in rows] == [("U1", None, "hi"), (None, "B", "beep")]


def test_file_listing(spark, site, tmp_path):
    services.register(spark)
    stream = spark.readStream.format("file_listing").load(f"{site}/drive")
    q = stream.writeStream.format("memory").queryName("listing").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            if q.awaitTermination(0.3) or spark.table("listing").count() >= 2:
                break
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("listing").collect()) == [("1", "a.txt", 3, False, True), ("2", "old", None, True, False)]


def test_datagrams():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    reader = services._DatagramReader({"port": str(port), "wait": "0.2"})
    assert list(reader.read({"n": 5})[0]) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
        for m in (b"one", b"\xff\xfe", b"two"):
            out.sendto(m, ("127.0.0.1", port))
    rows, end = reader.read({"n": 5})
    assert list(rows) == [(5, "one"), (6, "two")] and end == {"n": 7}
    reader.socket.close()


def test_sinks_and_terms(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "a"), ("2024-02-01T00:00:00Z", "b")], "timestamp string, text string")
    files.write_log(df, str(tmp_path / "log"))
    old = files.expired_days(spark, str(tmp_path / "log"), "2024-01-15")
    assert [f.rsplit("/", 1)[1] for f in old] == ["day=2024-01-01"]
    files.delete(spark, old)
    assert [r.text for r in spark.read.json(str(tmp_path / "log")).collect()] == ["b"]
    files.write_text(df, str(tmp_path / "text"))
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_json(df, str(tmp_path / "json"))
    files.write_json(df, str(tmp_path / "json"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["a", "b"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["timestamp", "text"] and spark.read.json(str(tmp_path / "json")).count() == 4
    (tmp_path / "terms.json").write_text('["Blue Falcon", " ", "Old", "Blue Falcon"]')
    known = spark.createDataFrame([("PROJECT", "Old")], "entity string, term string")
    assert [tuple(r) for r in files.terms(spark, str(tmp_path / "terms.json"), "PROJECT", known).collect()] == [("PROJECT", "Blue Falcon")]
    (tmp_path / "audit.jsonl").write_text('{"timestamp":"t","user":"u","action":"vaulted","result":"[A_1]"}\nbroken\n{"x":1}\n')
    assert files.audit_log(spark, str(tmp_path / "audit.jsonl")).select(F.col("action")).collect() == [("vaulted",)]
