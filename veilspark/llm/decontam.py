"""Benchmark decontamination by a broadcast set of hashed n-grams.

Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing
A-Z. Each benchmark item gives its windows of 13 consecutive words, or one
window of all its words if it has fewer. Training texts are scanned window by
window against the hashes of these; every hit is then verified word by word.

The broadcast set is bounded: windows are dealt into blocks of at most
``BLOCK_BYTES`` and the texts pass through one scan per block. Between scans
the rows with what was found so far go to the checkpoint folder and the block
is destroyed, so a larger benchmark costs more passes, never more memory, and
nothing is shuffled. An ordinary benchmark is one block and one pass.

Defined cases: null and empty texts have no words; an item without words has no
windows; items with equal windows are all found; a null item_id marks words as
hit but is not listed; repeated documents are scanned each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices, small_batches, with_checkpoints

WINDOW = 13
#: Bytes of benchmark words that one broadcast block holds at most (a longer item is a block by itself).
BLOCK_BYTES = 16 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class Words:
    """Word boundaries and hashes in a block of lower-cased texts."""

    def __init__(self, texts: list[bytes]):
        # one separator after each text: words never cross texts
        self.data = b"\n".join([*texts, b""]).lower()
        raw = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[raw], [False]]).astype(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        self.first = np.searchsorted(self.start, ends - sizes)
        self.last = np.searchsorted(self.start, ends)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)])
            back = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
            self.hash = _mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that cross texts mean nothing."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(count, np.uint64)
            for i in range(n):
                total += self.hash[i : i + count] * np.uint64(pow(_STEP, i + 1, 1 << 64))
        return _mix(total)

    def words(self, i: int, n: int) -> bytes:
        return b" ".join([self.data[s:e] for s, e in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True)])


def blocks_of(items: Iterator[tuple], most: int = BLOCK_BYTES) -> Iterator[dict]:
    """Broadcastable blocks: {"sizes": {n: sorted hashes}, "items": {(n, words): item ids}}."""
    found: dict[tuple[int, bytes], list] = {}
    hashes: dict[int, set[int]] = {}
    held = 0

    def block() -> dict:
        return {"sizes": {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in hashes.items()}, "items": dict(found)}

    for item, text in items:
        w = Words([(text or "").encode()])
        n = min(WINDOW, len(w.start))
        if not n:
            continue
        for i, h in enumerate(w.windows(n).tolist()):
            key = (n, w.words(i, n))
            ids = found.setdefault(key, [])
            if not ids or ids[-1] != item:
                ids.append(item)
                held += len(key[1]) + 64
            hashes.setdefault(n, set()).add(h)
        if held >= most:
            yield block()
            found, hashes, held = {}, {}, 0
    if found:
        yield block()


def hits(words: Words, block: dict) -> list[tuple[int, int, list]]:
    """Verified (first word, number of words, item ids) within one text each."""
    out = []
    for n, known in block["sizes"].items():
        h = words.windows(n)
        if not len(h):
            continue
        # a bit per hash value's low bits turns most windows away before the search
        seen = np.zeros(1 << 20, bool)
        seen[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
        at = at[np.searchsorted(words.last, at, side="right") == np.searchsorted(words.last, at + n - 1, side="right")]
        for i in at.tolist():
            if ids := block["items"].get((n, words.words(i, n))):
                out.append((i, n, ids))
    return out


_MADE = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "hit_spans": "array<struct<start:long,end:long>>", "hit_runs": "array<struct<start:long,end:long>>"}


def _pass(df: DataFrame, block, text: str) -> DataFrame:
    """One scan for one block; runs and items that earlier passes found are kept."""
    keep = [f for f in df.schema if f.name not in _MADE]
    more = "hit_runs" in df.columns
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
        return edge[::2].tolist(), edge[1::2].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
            w = Words(texts)
            mask = np.zeros(len(w.start) + 1, np.int32)
            ids: list[set] = [set(x) for x in batch.column("item_ids").to_pylist()] if more else [set() for _ in texts]
            if more:
                for k, x in enumerate(batch.column("hit_runs").to_pylist()):
                    for r in x:
                        mask[w.first[k] + r["start"]] += 1
                        mask[w.first[k] + r["end"]] -= 1
            for i, n, found in hits(w, block.value):
                mask[i] += 1
                mask[i + n] -= 1
                ids[int(np.searchsorted(w.last, i, side="right"))].update(x for x in found if x is not None)
            hit = np.cumsum(mask[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
            spans, words = [], []
            for k, (a, b) in enumerate(zip(w.first.tolist(), w.last.tolist(), strict=True)):
                s, e = runs(hit[a:b]) if total[a] != total[b] else ([], [])
                words.append([{"start": x, "end": y} for x, y in zip(s, e, strict=True)])
                spans.append([{"start": int(w.start[a + x] - offsets[k]), "end": int(w.end[a + y - 1] - offsets[k])} for x, y in zip(s, e, strict=True)])
            columns = [pa.array(w.last - w.first, pa.int64()), pa.array(total[w.last] - total[w.first], pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(pa.string())), pa.array(spans, pairs), pa.array(words, pairs)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + columns, names=[*(f.name for f in keep), *_MADE])

    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{k} {v}" for k, v in _MADE.items()]))


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``hit_spans`` (first and past-the-last byte of each maximal hit run of words), n_words, n_hit and the found item ids."""
    spark = df.sparkSession
    small_batches(spark)
    source = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    # the driver reads the items one after the other and holds one block of them
    blocks = blocks_of(((r.item, r.text) for r in source.toLocalIterator()), block_bytes)
    df = df.drop(*_MADE)
    block = next(blocks, {"sizes": {}, "items": {}})
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        df = _pass(df, sent, text)
        block = next(blocks, None)
        if block is not None:  # a further pass: what this one found is written before its block goes
            with_checkpoints(spark)
            df = df.checkpoint()
            sent.destroy()
    return df.drop("hit_runs")


def contaminated() -> "F.Column":
    """The rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(df: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id with counts, the number and digest of the items found, and the verdict."""
    found = scan(df.select("doc_id", "text"), benchmark, **kw)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(df: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = [f"`{c}`" for c in df.columns]
    inner = df.select(F.struct(*names).alias("row"), F.col("text"))
    return scan(inner, benchmark, **kw).where(~contaminated()).select("row.*")


def cut(df: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """All documents, with the hit spans taken out of their texts."""
    names = [f"`{c}`" for c in df.columns]
    inner = df.select(F.struct(*names).alias("row"), F.col("text"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))
    piece = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["kept"], F.substring(raw, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("kept"))
    done = lambda acc: F.decode(F.concat(acc["kept"], F.substring(raw, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))), "UTF-8")
    text = F.when(F.size("hit_spans") > 0, F.aggregate("hit_spans", start, piece, done)).otherwise(F.col("text"))
    found = scan(inner, benchmark, **kw)
    return found.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in df.columns])
