"""Stateful streams: tokens that arrive in pieces, rate limits, circuit breakers, retention.

Each operator is a state machine over one key. The machines are plain Python
classes with a one-string state, so they are tested without a stream, and the
same machine serves the batch form, which folds a key's rows in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_WHOLE = re.compile(r"\[[A-Z_]+_[0-9a-f]{16}\]")
_OPEN = re.compile(r"\[[A-Z_]*(?:_[0-9a-f]{0,16})?\Z")


def hold(text: Column) -> Column:
    """(safe, held): the end that may be the start of a token is held back."""
    at = F.char_length(text) - F.instr(F.reverse(text), "[") + 1
    tail = F.substring(text, at, F.char_length(text))
    waits = text.contains("[") & ~tail.rlike(r"^\[[A-Z_]+_[0-9a-f]{16}\]") & tail.rlike(r"^\[[A-Z_]*(_[0-9a-f]{0,16})?\z")
    return F.struct(F.when(waits, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("safe"), F.when(waits, tail).otherwise("").alias("held"))


class TokenStream:
    """Emits what cannot be part of an unfinished token."""

    def __init__(self, state: str = ""):
        self.held = state

    def push(self, delta: str) -> str:
        text = self.held + delta
        at = text.rfind("[")
        if at >= 0 and not _WHOLE.match(text, at) and _OPEN.match(text, at):
            self.held = text[at:]
            return text[:at]
        self.held = ""
        return text

    def flush(self) -> str:
        out, self.held = self.held, ""
        return out


class Limiter:
    """At most ``limit`` allowed calls in any ``window`` seconds; denied calls do not count."""

    def __init__(self, limit: int = 30, window: float = 60.0, state: str = "[]"):
        self.limit, self.window, self.times = limit, window, json.loads(state)

    def call(self, at: float) -> bool:
        self.times = [t for t in self.times if t > at - self.window]
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


class Breaker:
    """Closed until three failures in a row; open for 30 s; then one probe at a time until two successes."""

    def __init__(self, failures: int = 3, pause: float = 30.0, successes: int = 2, state: str = ""):
        self.failures, self.pause, self.successes = failures, pause, successes
        self.name, self.count, self.since = json.loads(state) if state else ("closed", 0, 0.0)

    def state(self) -> str:
        return json.dumps([self.name, self.count, self.since])

    def allows(self, at: float) -> bool:
        if self.name == "open" and at - self.since >= self.pause:
            self.name, self.count = "half-open", 0
        return self.name != "open"

    def outcome(self, at: float, ok: bool) -> str:
        if not self.allows(at):
            return self.name
        if ok:
            self.count = self.count + 1 if self.name == "half-open" else 0
            if self.name == "half-open" and self.count >= self.successes:
                self.name, self.count = "closed", 0
        elif self.name == "half-open" or self.count + 1 >= self.failures:
            self.name, self.count, self.since = "open", 0, at
        else:
            self.count += 1
        return self.name


def _stateful(df: DataFrame, key: str, order: str, made: str, machine, outputs: str) -> DataFrame:
    """Rows of a key in order through a machine whose state is one string."""
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable") if not state.hasTimedOut else pd.DataFrame()
        out, new = machine(state.get[0] if state.exists else "", rows)
        state.update((new,))
        yield pd.DataFrame([(k[0], *r) for r in out], columns=[key, *[x.split()[0] for x in made.split(", ")]])

    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {made}", "state string", outputs, GroupStateTimeout.NoTimeout)


def _batch(df: DataFrame, key: str, order: str, made: str, machine) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def fold(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = machine("", rows.sort_values(order, kind="stable"))
        return pd.DataFrame([(k[0], *r) for r in out], columns=[key, *[x.split()[0] for x in made.split(", ")]])

    return df.groupBy(key).applyInPandas(fold, f"`{key}` {kind}, {made}")


def _run(df: DataFrame, key: str, order: str, made: str, machine) -> DataFrame:
    return _stateful(df, key, order, made, machine, "append") if df.isStreaming else _batch(df, key, order, made, machine)


def token_streams(df: DataFrame, key: str = "stream_id", seq: str = "seq", delta: str = "delta", last: str | None = None) -> DataFrame:
    """(key, seq, text): deltas of each stream re-cut so that no token is split. ``last`` marks the end of a stream.

    Put values back afterwards with ``vault.rehydrate``: a stream-static join.
    """

    def machine(state: str, rows: pd.DataFrame):
        stream, out = TokenStream(state), []
        for r in rows.to_dict("records"):
            text = stream.push(r[delta] or "")
            if last is not None and r[last]:
                text += stream.flush()
            out.append((r[seq], text))
        return out, stream.held

    return _run(df, key, seq, f"{seq} long, text string", machine)


def rate_limited(df: DataFrame, key: str, at: str = "at", limit: int = 30, window: float = 60.0) -> DataFrame:
    """(key, at, allowed) for calls at seconds ``at``."""

    def machine(state: str, rows: pd.DataFrame):
        own = Limiter(limit, window, state or "[]")
        return [(float(t), own.call(float(t))) for t in rows[at]] if len(rows) else [], json.dumps(own.times)

    return _run(df, key, at, "at double, allowed boolean", machine)


def breakers(df: DataFrame, key: str = "endpoint", at: str = "at", ok: str = "ok") -> DataFrame:
    """(key, at, state) after every outcome."""

    def machine(state: str, rows: pd.DataFrame):
        own = Breaker(state=state)
        out = [(float(t), own.outcome(float(t), bool(o))) for t, o in zip(rows[at], rows[ok], strict=True)] if len(rows) else []
        return out, own.state()

    return _run(df, key, at, "at double, state string", machine)


def recent_calls(df: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """Adds the calls of the same key in the window up to each call: an upper bound of what a limiter counts."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.unix_timestamp(F.col(at).cast("timestamp"))).rangeBetween(-seconds + 1, 0)
    return df.withColumn("recent", F.count("*").over(w))


def retention(days: int, store):
    """A ``foreachBatch`` function that sweeps the store whenever a trigger fires."""

    def sweep(batch: DataFrame, epoch: int) -> None:
        store.sweep(days)

    return sweep


def into_vault(store):
    """A ``foreachBatch`` function that stores the hits of a batch; repeats are ignored, so replays are harmless."""

    def add(batch: DataFrame, epoch: int) -> None:
        store.add_hits(batch.select("pii_hash", "token", "value"))

    return add


def redacted_lines(lines: DataFrame, cfg, text: str = "value") -> DataFrame:
    """Continuous redaction of a stream of lines."""
    from ..operators import detect

    return detect.redact(lines, cfg, text)


def deltas(body: Column, provider: str = "openai") -> Column:
    """Text deltas of a server-sent event body, in order."""
    data = F.transform(F.filter(F.split(body, "\r?\n"), lambda x: F.startswith(x, F.lit("data: "))), lambda x: F.substring(x, F.lit(7), F.char_length(x)))
    path = {"openai": "$.choices[0].delta.content", "local": "$.choices[0].delta.content", "claude": "$.delta.text", "gemini": "$.candidates[0].content.parts[0].text"}[provider]
    done = F.array_position(data, "[DONE]")
    kept = F.when(done > 0, F.slice(data, F.lit(1), (done - 1).cast("int"))).otherwise(data)
    return F.filter(F.transform(kept, lambda x: F.get_json_object(x, path)), lambda x: x.isNotNull())
