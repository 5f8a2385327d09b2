"""Exact removal of repeated 200-byte strings with logarithmic families of suffix arrays.

1. *Anchors.* In every 200-byte window the k-gram of least hash (the leftmost
   of equals) is the window's anchor; consecutive windows with one anchor are a
   segment, cut in two where the anchor passes the middle of the window. Equal
   windows have their anchors at the same place, so they share the anchor and the
   80 bytes before it, or the 81 after it; these are the key of their segments.
2. *Counts.* Segments are counted by key, then by key and content. A key seen
   once has no repeated window. Where all segments of a key are equal, all
   their windows repeat. Only keys with different segments are left.
3. *Suffix arrays.* One representative of each different segment goes to its
   key's range. Batch after batch, the suffixes that start windows are sorted
   (a suffix array to depth 200), merge-scanned against the existing levels of
   the range's index family for matches of full depth, and added as a level;
   levels of like size merge, so a suffix is merged a logarithmic number of
   times.
4. *Removal.* Windows found go back to their documents, which drop the bytes
   that these cover.

Keys with more than ``HOT`` different segments (the edges of a passage that
very many documents share) are dealt by whole windows instead: every window is
counted by a 128-bit hash, with partial sums before the shuffle, so that no
task receives such a key. A suffix array needs all suffixes of its key in one
place, and of one passage in a third of all documents these are unbounded; so
are the copies of one segment, which are counted by a 128-bit hash as well.

Defined cases: null texts count as empty; matches never cross documents but
may overlap and lie in one document; repeated rows are repetitions of each
other; ties of equal hashes go to the left; texts under 200 bytes keep all
bytes; very long texts are worked on in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import kept, sha256, shared_folder, slices, small_batches

LENGTH = 200
GRAM = 40
HOT = 2048
#: Windows of a piece of a long text; windows of a key range that one index family holds (one key at least).
PIECE = 4 << 20
RANGE = 200_000
#: Windows of a batch that a family takes in.
BATCH = 25_000

_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any pieces of a block of bytes, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, n), out=self.sums[1:])
        self.back = _power(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size] + np.uint64(size))


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(v)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor minus first window, key, content hash) of every segment."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    hashes = Hashes(data)
    h = hashes.every(gram)
    place = np.uint64((1 << 32) - 1)
    least = _sliding_least(h & ~place | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (least & place).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    window = np.arange(len(anchor))
    inside = window + length <= ends[text]
    window, anchor, text = window[inside], anchor[inside], text[inside]
    if not len(window):
        return segments([], length, gram)
    # windows with ``left`` bytes or more before the anchor hold these, the others hold ``right`` bytes after it
    left = (length - gram) // 2
    right = length - gram - left + 1
    early = anchor - window >= left
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (early[1:] != early[:-1])]))
    run = np.diff(np.append(first, len(window)))
    low, at, early = window[first], anchor[first], early[first]
    content = hashes.of(low, low + run - 1 + length)
    content = _mix(content ^ (at - low).astype(np.uint64) * np.uint64(_BASE))
    key = _mix(hashes.of(np.where(early, at - left, at), at + gram + np.where(early, 0, right)) + early)
    return text[first], low - (ends - sizes)[text[first]], run, at - low, key, content


# place of a segment in its text: first window (36 bits), windows (20 bits), anchor minus first window (8 bits)
def _pack(low: np.ndarray, run: np.ndarray, off: np.ndarray) -> np.ndarray:
    return low << 28 | run << 8 | off


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 28, p >> 8 & 0xFFFFF, p & 0xFF


def _places(docs: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """(doc_id, th, key, content, place, n) of segments. What repeats within a block counts as n = 2 once,
    and its other places are runs of known repetitions, each under a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, th = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("th").to_numpy()
            pieces, owner, shift = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                raw = (t or "").encode()
                for s in range(0, max(1, len(raw) - length + 1), piece):
                    pieces.append(raw[s : s + piece + length - 1])
                    owner.append(i)
                    shift.append(s)
            owner, shift = np.array(owner), np.array(shift)
            done = 0
            while done < len(pieces):
                upto, held = done, 0
                while upto < len(pieces) and (upto == done or held + len(pieces[upto]) <= PIECE + length):
                    held += len(pieces[upto])
                    upto += 1
                made = _rows(pieces[done:upto], owner[done:upto], shift[done:upto], th, length, gram)
                done = upto
                who = made[0]
                ids = pa.array(doc[who], from_pandas=True).cast(batch.schema.field("doc_id").type) if batch.column("doc_id").null_count else pa.array(doc[who])
                yield pa.RecordBatch.from_arrays([ids, pa.array(th[who]), *(pa.array(x) for x in made[1:])], names=["doc_id", "th", "key", "content", "place", "n"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, key long, content long, place long, n int")


def _rows(pieces: list[bytes], owner: np.ndarray, shift: np.ndarray, th: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    text, low, run, off, key, content = segments(pieces, length, gram)
    low = low + shift[text] if len(text) else low
    # 128 bits: that of the anchor and that of the bytes and the anchor's place
    order = np.lexsort((content, key))
    a, b = key[order], content[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    count = np.bincount(group, minlength=1)
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    n = np.minimum(count[group], 2).astype(np.int32) if len(order) else np.zeros(0, np.int32)
    rest = np.flatnonzero(~first)
    # runs of known repetitions: neighbours in one text are joined
    if len(rest):
        gap = np.concatenate([[True], (text[rest][1:] != text[rest][:-1]) | (low[rest][1:] != (low + run)[rest][:-1])])
        start = rest[gap]
        stop = rest[np.append(np.flatnonzero(gap)[1:] - 1, len(rest) - 1)]
        whole = (low + run)[stop] - low[start]
        # a run has 20 bits: longer ones are cut
        parts = [(text[s], l + c, min(w - c, 0xFFFFF)) for s, l, w in zip(start.tolist(), low[start].tolist(), whole.tolist()) for c in range(0, w, 0xFFFFF)]
        t2, l2, r2 = (np.array(x, np.int64) for x in zip(*parts))
    else:
        t2 = l2 = r2 = np.zeros(0, np.int64)
    f = np.flatnonzero(first)
    place = np.concatenate([_pack(low[f], run[f], off[f]), _pack(l2, r2, np.zeros_like(r2))])
    # the keys of known runs only need to be spread
    own = _mix(th[owner[t2]].view(np.uint64) ^ l2.astype(np.uint64) * np.uint64(_BASE2)) if len(t2) else np.zeros(0, np.uint64)
    return (
        owner[np.concatenate([text[f], t2])] if len(place) else np.zeros(0, np.int64),
        np.concatenate([key[f], own]).view(np.int64), np.concatenate([content[f], np.zeros(len(l2), np.uint64)]).view(np.int64), place,
        np.concatenate([n[f], np.full(len(l2), -1, np.int32)]),
    )


class Level:
    """Sorted different suffixes with the windows that own them; ``hit``: the owner is known to be repeated."""

    def __init__(self, suffix: np.ndarray, owner: np.ndarray, hit: np.ndarray):
        self.suffix, self.owner, self.hit = suffix, owner, hit


class IndexFamily:
    """Suffix arrays in levels whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.found: list[np.ndarray] = []
        self.merges = 0

    def add(self, suffix: np.ndarray, owner: np.ndarray) -> None:
        """Takes in a batch of window prefixes (fixed-size byte strings) with their owners' numbers."""
        order = np.argsort(suffix, kind="stable")
        suffix, owner = suffix[order], owner[order]
        new = np.concatenate([[True], suffix[1:] != suffix[:-1]])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(suffix)))
        self.found.append(owner[~new])
        level = Level(suffix[head], owner[head], count > 1)
        fresh = np.ones(len(head), bool)
        for old in self.levels:
            at = np.minimum(np.searchsorted(old.suffix, level.suffix), len(old.suffix) - 1)
            same = old.suffix[at] == level.suffix
            old.hit[at[same]] = True
            self.found.append(level.owner[same])
            fresh &= ~same
        level = Level(level.suffix[fresh], level.owner[fresh], level.hit[fresh])
        while self.levels and len(self.levels[-1].suffix) <= 2 * len(level.suffix):
            level = self._merge(self.levels.pop(), level)
        if len(level.suffix):
            self.levels.append(level)

    def _merge(self, a: Level, b: Level) -> Level:
        """Levels have no suffix in common."""
        self.merges += 1
        place = np.searchsorted(a.suffix, b.suffix) + np.arange(len(b.suffix))
        from_b = np.zeros(len(a.suffix) + len(b.suffix), bool)
        from_b[place] = True
        out = []
        for x, y in ((a.suffix, b.suffix), (a.owner, b.owner), (a.hit, b.hit)):
            z = np.empty(len(from_b), x.dtype)
            z[from_b], z[~from_b] = y, x
            out.append(z)
        return Level(*out)

    def repeated(self) -> np.ndarray:
        """Owners of all suffixes that occurred more than once."""
        return np.concatenate([*self.found, *(x.owner[x.hit] for x in self.levels), np.zeros(0, np.int64)])


def _match(rows: DataFrame, length: int) -> DataFrame:
    """Index families over ranges of keys: (doc_id, th, place) of repeated windows of segments with n = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pa.compute.sum(batch.column("windows")).as_py() or 0
            if size >= RANGE:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                # the last key may go on in the next batch
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from family(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = pa.compute.sum(table.column("windows").slice(cut)).as_py()
        if held:
            yield from family(pa.Table.from_batches(held).combine_chunks())

    def family(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, count, _ = _unpack(table.column("place").to_numpy())
        body = table.column("body").to_pylist()
        n = table.column("n").to_numpy()
        index, start = IndexFamily(), 0
        begin = np.concatenate([[0], np.cumsum(count)])
        while start < len(body):
            stop = start + 1
            while stop < len(body) and begin[stop + 1] - begin[start] <= BATCH:
                stop += 1
            parts = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), length) for b in body[start:stop]]
            suffix = np.ascontiguousarray(np.concatenate(parts)).view(f"S{length}").ravel()
            index.add(suffix, np.arange(begin[start], begin[stop]))
            start = stop
        flag = np.zeros(begin[-1], np.int8)
        flag[index.repeated()] = 1
        which = np.repeat(np.arange(len(body)), count)
        flag[n[which] != 1] = 0
        # runs within a segment
        edge = np.flatnonzero(flag & np.concatenate([[1], (flag[:-1] == 0) | (which[1:] != which[:-1])]).astype(np.int8))
        last = np.flatnonzero(flag & np.concatenate([(flag[1:] == 0) | (which[1:] != which[:-1]), [1]]).astype(np.int8))
        whose = which[edge]
        place = _pack(low[whose] + edge - begin[whose], last - edge + 1, np.zeros(len(edge), np.int64))
        take = pa.array(whose)
        yield pa.RecordBatch.from_arrays([table.column("doc_id").take(take).combine_chunks(), table.column("th").take(take).combine_chunks(), pa.array(place)], names=["doc_id", "th", "place"])

    small_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, place long")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([press.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "th", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, packed binary")


def _bodies(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments: (key, n, kinds, doc_id, th, place, windows, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                row, key, n, kinds, place, windows, body = [], [], [], [], [], [], []
                for k, (packed, wanted) in enumerate(zip(part.column("packed").to_pylist(), part.column("wanted").to_pylist(), strict=True)):
                    raw = unpress.decompress(packed)
                    for w in wanted:
                        low, run_, _ = _unpack(w["place"])
                        row.append(k)
                        key.append(w["key"])
                        n.append(w["n"])
                        kinds.append(w["kinds"])
                        place.append(w["place"])
                        windows.append(run_)
                        body.append(raw[low : low + run_ - 1 + length])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(kinds, pa.int64()), part.column("doc_id").take(at), part.column("th").take(at), pa.array(place, pa.int64()), pa.array(windows, pa.int32()), pa.array(body, pa.binary())], names=["key", "n", "kinds", "doc_id", "th", "place", "windows", "body"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "th", "packed", "wanted").mapInArrow(run, f"key long, n int, kinds long, doc_id {kind}, th long, place long, windows int, body binary")


def _windows(bodies: DataFrame, length: int) -> DataFrame:
    """Every window of segments by two hashes: (a, b, n, doc_id, th, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            body = batch.column("body").to_pylist()
            data = np.frombuffer(b"".join(body), np.uint8)
            count = batch.column("windows").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(body)), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.fromiter(map(len, body), np.int64, len(body))
            start = (np.cumsum(size) - size)[row] + inner
            low = _unpack(batch.column("place").to_numpy())[0][row] + inner
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(Hashes(data, base).of(start, start + length).view(np.int64)) for base in (_BASE, _BASE2)), batch.column("n").take(at), batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(_pack(low, np.ones_like(low), np.zeros_like(low)))],
                names=["a", "b", "n", "doc_id", "th", "place"],
            )

    kind = bodies.schema["doc_id"].dataType.simpleString()
    return bodies.mapInArrow(run, f"a long, b long, n int, doc_id {kind}, th long, place long")


def covered(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that lie in the windows of these places."""
    low, run, _ = _unpack(np.unique(places))
    order = np.argsort(low, kind="stable")
    low, high = low[order], (low + run - 1 + length)[order]
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return low[first], reach[np.append(first[1:] - 1, len(low) - 1)]


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """(doc_id, th, packed, places): every document with its repeated windows (null: none)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = _places(docs, length, gram, piece)
    many = rows.groupBy("key").agg(F.sum(F.when(F.col("n") < 0, 2).otherwise(F.col("n"))).alias("times")).where("times > 1").select("key")
    folder = shared_folder(spark, "suffixes")
    # of keys that repeat: the places. The keys are written first, so that both sides of the join are shuffled and a
    # key with very many places can be split
    repeated = kept(rows.join(kept(many, folder, "keys"), "key"), folder, "repeated")
    known = repeated.where("n < 0").select("doc_id", "th", "place")
    segs = repeated.where("n > 0").groupBy("key", "content").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "place")).alias("first"))
    kinds = segs.groupBy("key").agg(F.count("*").alias("kinds"))
    segs = kept(segs.join(kinds, "key").select("key", "content", F.least("n", F.lit(2)).cast("int").alias("n"), "kinds", "first.doc_id", "first.th", "first.place"), folder, "segments")
    # segments that occur more than once are repeated whole, wherever they are
    whole = repeated.where("n > 0").join(segs.where("n > 1").select("key", "content"), ["key", "content"]).select("doc_id", "th", "place")
    packed = _packed(docs)
    wanted = segs.where("kinds > 1").groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("key", "n", "place", "kinds")).alias("wanted"))
    bodies = _bodies(packed.join(wanted, (packed.th == wanted.t) & packed.doc_id.eqNullSafe(wanted.d)), length)
    found = known.unionByName(whole)
    if segs.where(F.col("kinds") > hot).isEmpty():
        found = found.unionByName(_match(bodies.repartition("key").sortWithinPartitions("key"), length))
    else:  # written, so that the texts are not dealt out again for each use
        bodies = kept(bodies, folder, "bodies")
        found = found.unionByName(_match(bodies.where(F.col("kinds") <= hot).repartition("key").sortWithinPartitions("key"), length))
        each = _windows(bodies.where(F.col("kinds") > hot), length)
        twice = kept(each.groupBy("a", "b").agg(F.sum("n").alias("times")).where("times > 1").select("a", "b"), folder, "windows")
        found = found.unionByName(each.where("n = 1").join(twice, ["a", "b"]).select("doc_id", "th", "place"))
    places = found.groupBy("doc_id", "th").agg(F.collect_set("place").alias("places")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "places")
    return packed.join(places, (packed.th == places.t) & packed.doc_id.eqNullSafe(places.d), "left").select("doc_id", "th", "packed", "places")


def _finish(df: DataFrame, length: int, made: str, one) -> DataFrame:
    names = [x.strip().split()[0] for x in made.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for packed, places in zip(part.column("packed").to_pylist(), part.column("places"), strict=True):
                    raw = unpress.decompress(packed)
                    low, high = covered(places.values.to_numpy(), length) if places.is_valid else ((), ())
                    kept, at = [], 0
                    for a, b in zip(low, high, strict=True):
                        kept.append(raw[at:a])
                        at = b
                    rows.append(one(raw, b"".join([*kept, raw[at:]]), len(low)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {made}")


def report(docs: DataFrame, length: int = LENGTH, **kw) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _finish(removals(docs, length, **kw), length, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda raw, kept, n: (len(raw), len(raw) - len(kept), n, sha256(kept)))


def deduplicated(docs: DataFrame, length: int = LENGTH, **kw) -> DataFrame:
    """doc_id and the text that is left; bytes of characters that were cut in two are dropped."""
    return _finish(removals(docs, length, **kw), length, "text string", lambda raw, kept, n: (kept.decode("utf-8", "ignore"),))
