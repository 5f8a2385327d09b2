"""Python data sources for services: REST, chat history, file listings with change tokens, and datagrams.

Register with ``register(spark)``; then ``spark.read.format("rest")`` and so on.
"""

from __future__ import annotations

import json
import socket
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Bytes of a response at most, unless the option ``max_bytes`` says otherwise.
LARGEST = 5 << 20


def fetch(url: str, options: dict) -> tuple[str, bytes]:
    """(content type, body) of a GET with bearer, key or no authorisation, and query parameters as ``param.<name>``."""
    query = {k[6:]: v for k, v in options.items() if k.startswith("param.")}
    if query:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(query)
    if not url.startswith(("http://", "https://")):
        raise ValueError("only http and https are read")
    request = urllib.request.Request(url)
    auth = options.get("auth", "none")
    if auth == "bearer":
        request.add_header("Authorization", f"Bearer {options['secret']}")
    elif auth == "api_key":
        request.add_header(options.get("header", "X-API-Key"), options["secret"])
    most = int(options.get("max_bytes", LARGEST))
    with urllib.request.urlopen(request, timeout=float(options.get("timeout", 30))) as response:  # noqa: S310
        body = response.read(most + 1 if most else -1)
        if most and len(body) > most:
            raise ValueError("the response is larger than the policy allows")
        return response.headers.get_content_type(), body


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Url(u) for u in self.options["path"].split(",")]

    def read(self, partition) -> Iterator[tuple]:
        kind, body = fetch(partition.url, self.options)
        yield partition.url, kind, body


class Rest(DataSource):
    """One row per URL (several are comma-separated and read in parallel)."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "url string, content_type string, body binary"

    def reader(self, schema):
        return _RestReader(dict(self.options))


class _ChatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        _, body = fetch(self.options["path"], {**self.options, "auth": "bearer", "param.limit": self.options.get("limit", "20")})
        for m in json.loads(body).get("messages", []):
            yield m.get("ts"), m.get("user"), m.get("bot_id"), m.get("type"), m.get("text")


class ChatHistory(DataSource):
    """The latest messages of a channel's history endpoint."""

    @classmethod
    def name(cls) -> str:
        return "chat_history"

    def schema(self) -> str:
        return "ts string, user string, bot_id string, type string, text string"

    def reader(self, schema):
        return _ChatReader(dict(self.options))


class _ListingReader(SimpleDataSourceStreamReader):
    """Pages are followed by ``next``; ``delta`` is where the next poll starts."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"url": self.options["path"]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, url, delta = [], start["url"], None
        while url:
            page = json.loads(fetch(url, self.options)[1])
            rows += [(x.get("id"), x.get("name"), x.get("size"), x.get("deleted") is not None, "file" in x) for x in page.get("value", [])]
            url, delta = page.get("@odata.nextLink"), page.get("@odata.deltaLink", delta)
        return iter(rows), {"url": delta or start["url"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]


class FileListing(DataSource):
    """A stream of changed files of a drive with change links; poll it with ``trigger(processingTime="30 seconds")``."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "id string, name string, size long, deleted boolean, is_file boolean"

    def simpleStreamReader(self, schema):
        return _ListingReader(dict(self.options))


class _DatagramReader(SimpleDataSourceStreamReader):
    """Reads what has arrived at a port; what cannot be decoded is dropped."""

    def __init__(self, options: dict):
        self.options = options
        self.socket = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind((self.options.get("host", "127.0.0.1"), int(self.options["port"])))
            self.socket.settimeout(float(self.options.get("wait", 0.2)))
        rows = []
        try:
            while len(rows) < int(self.options.get("batch", 10_000)):
                try:
                    rows.append((start["n"] + len(rows), self.socket.recv(65536).decode()))
                except UnicodeDecodeError:
                    continue
        except TimeoutError:
            pass
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([])  # datagrams do not come again


class Datagrams(DataSource):
    """Log datagrams at a UDP port, at most once."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "n long, text string"

    def simpleStreamReader(self, schema):
        return _DatagramReader(dict(self.options))


SOURCES = (Rest, ChatHistory, FileListing, Datagrams)


def register(spark: SparkSession, *more) -> None:
    for source in (*SOURCES, *more):
        spark.dataSource.register(source)
