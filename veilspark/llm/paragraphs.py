"""Repeated paragraphs by MinHash bands, exact Jaccard and components.

A paragraph is a passage of ``WIDTH`` words (split at ASCII white space, A-Z
lowered), wherever it begins and however it is broken into lines; its elements
are its five-word shingles. So every place of a text begins a paragraph, and
shorter stock lines are none of their own.

*Bands.* Under each of ``BANDS`` seeds the least shingle hash of a paragraph is
its band. Consecutive paragraphs with one least hash are a segment, of which
there is about one every 24 words and band. Paragraphs of similarity 0.8 share
a band with probability 1 - 0.2**BANDS, which is 0.96; equal ones always do.

*Verification.* Segments that are equal as a whole are one node. Where a bucket
holds different segments, an exact join (rarest shingles first, so that only
segments that can reach the threshold meet) finds those of which paragraphs at
the same place relative to the least shingle have Jaccard similarity 0.8 or
more. The edges of a spanning forest go on, with the words that match.

*Classes.* Components of these edges are classes. Of each class the first
segment stays; of every later one the words go that match an earlier one.

Large buckets are dealt into parts, and each pair of parts is a task of its
own; no bucket is capped.

Defined cases: null texts and texts under ``WIDTH`` words have no paragraphs;
repeats in one document go too; first means the smallest document id (null
last), then the text's hash, then the place; repeated rows get the same result,
and rows equal in id and text are one document; ties of minima mean nothing;
very long texts are worked on in pieces; an empty table gives an empty result.
Columns other than doc_id and text are not looked at, so their names may clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import kept, sha256, shared_folder, slices, small_batches, with_checkpoints
from .components import components
from .suffixes import Hashes, _mix, _pack, _packed, _power, _sliding_least, _unpack

SHINGLE = 5
WIDTH = 50
THRESHOLD = 0.8
BANDS = 2
#: Different segments of one bucket that make a part.
CELL = 2048
#: Bytes of a piece of a long text.
PIECE = 1 << 20

_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a block."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[data], [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _shingles(word: np.ndarray) -> np.ndarray:
    n = max(0, len(word) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out += word[j : j + n] * np.uint64(pow(_STEP, j + 1, 1 << 64))
    return _mix(out)


def _contents(word: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of runs of words: polynomials over these."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * _power(_STEP, len(word)), dtype=np.uint64)])
    back = _power(pow(_STEP, -1, 1 << 64), len(word) + 1)
    return _mix((sums[first + words] - sums[first]) * back[first] + words.astype(np.uint64))


def pieces(raw: bytes, width: int = WIDTH, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(first word, bytes) of pieces that overlap so that each paragraph lies in exactly one."""
    if len(raw) <= size:
        yield 0, raw
        return
    start, end = _words(np.frombuffer(raw, np.uint8))
    at = 0
    while True:
        stop = max(at + width, int(np.searchsorted(end, start[at] + size, side="right"))) if at < len(start) else at
        if stop >= len(start):
            yield at, raw[start[at] :] if at < len(start) else b""
            return
        yield at, raw[start[at] : end[stop - 1]]
        at = stop - width + 1


def segments(texts: list[bytes], width: int = WIDTH, bands: int = BANDS) -> tuple[np.ndarray, ...]:
    """(text, first word, paragraphs, least shingle's place minus first word, bucket, node) of the segments of a block of texts."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    start, end = _words(data)
    size = width - SHINGLE + 1
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    inside = np.flatnonzero(text[: max(0, len(text) - width + 1)] == text[width - 1 :])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    begin = np.searchsorted(text, np.arange(len(texts)))
    word = Hashes(data).of(start, end)
    shingle = _shingles(word)
    low_bits = np.uint64((1 << 32) - 1)
    out = []
    for band in range(bands):
        h = _mix(shingle + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # of equal hashes the last counts
        least = _sliding_least(h & ~low_bits | low_bits - np.arange(len(h), dtype=np.uint64), size)[inside]
        value, place = least >> np.uint64(32), (low_bits - (least & low_bits)).astype(np.int64)
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(inside) != 1) | (text[inside[1:]] != text[inside[:-1]])])
        head = np.flatnonzero(new)
        rest = np.diff(np.append(head, len(inside)))
        heads, runs = [], []
        while len(head):  # again only where a least hash comes back: a segment's paragraphs all hold its least shingle
            run = np.minimum(rest, place[head] - inside[head] + 1)
            heads.append(head)
            runs.append(run)
            more = rest > run
            head, rest = (head + run)[more], (rest - run)[more]
        head, run = np.concatenate(heads), np.concatenate(runs)
        low, off = inside[head], place[head] - inside[head]
        bucket = _mix(h[place[head]] ^ np.uint64(band + 1))
        node = _mix(_contents(word, low, run - 1 + width) ^ _mix(bucket + off.astype(np.uint64)))
        out.append((text[low], low - begin[text[low]], run, off, bucket, node))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(docs: DataFrame, width: int, bands: int, piece: int) -> DataFrame:
    """(doc_id, th, bucket, node, place) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, owner, shift = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for at, part in pieces((t or "").encode(), width, piece):
                    own.append(part)
                    owner.append(i)
                    shift.append(at)
            done = 0
            while done < len(own):
                upto, held = done, 0
                while upto < len(own) and (upto == done or held + len(own[upto]) <= piece):
                    held += len(own[upto])
                    upto += 1
                text, low, count, off, bucket, node = segments(own[done:upto], width, bands)
                at = pa.array(np.array(owner[done:upto])[text])
                place = _pack(low + np.array(shift[done:upto])[text], count, off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(bucket.view(np.int64)), pa.array(node.view(np.int64)), pa.array(place)], names=["doc_id", "th", "bucket", "node", "place"])
                done = upto

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, bucket long, node long, place long")


def _bodies(joined: DataFrame, width: int, first: str) -> DataFrame:
    """(bucket, parts, node, off, shingles, first) of the wanted segments of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, wanted in zip(batch.column("packed"), batch.column("wanted"), strict=True):
                made = []
                for _, part in pieces(unpress.decompress(packed.as_py()), SHINGLE):
                    data = np.frombuffer(part.lower(), np.uint8)
                    made.append(_shingles(Hashes(data).of(*_words(data))))
                shingle = np.concatenate(made)
                table = pa.RecordBatch.from_struct_array(wanted.values)
                low, count, off = _unpack(table.column("first").field("place").to_numpy())
                body = pa.array([shingle[a : a + n + width - SHINGLE].tobytes() for a, n in zip(low.tolist(), count.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([table.column("bucket"), table.column("parts"), table.column("node"), pa.array(off.astype(np.int32)), body, table.column("first")], names=["bucket", "parts", "node", "off", "shingles", "first"])

    return joined.select("packed", "wanted").mapInArrow(run, f"bucket long, parts int, node long, off int, shingles binary, first {first}")


def _trees(n: int, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The least member of each node's tree."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[k])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[k], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _alike(a: np.ndarray, b: np.ndarray, low: int, high: int, size: int, threshold: float, plain: bool) -> tuple[int, int] | None:
    """First and last of the places ``low`` to ``high`` at which paragraphs of two rows have sets of shingles that reach the threshold."""
    a, b = a[low : high + size - 1], b[low : high + size - 1]
    if plain:
        # n of ``size`` shingles in common are n / (2 * size - n)
        need = np.ceil(2 * size * threshold / (1 + threshold) - 1e-9)
        held = np.concatenate([[0], np.cumsum(a == b)])
        good = np.flatnonzero(held[size:] - held[:-size] >= need)
        if len(good):
            return low + int(good[0]), low + int(good[-1])
    else:
        need = 1
    a, b = a.tolist(), b.tolist()
    both = set(a) & set(b)
    x, y = ([0, *accumulate(e in both for e in p)] for p in (a, b))
    good = []
    for k in range(len(a) - size + 1):
        if x[k + size] - x[k] < need or y[k + size] - y[k] < need:
            continue
        p, q = set(a[k : k + size]), set(b[k : k + size])
        n = len(p & q)
        if n >= threshold * (len(p) + len(q) - n) - 1e-9:
            good.append(k)
    return (low + good[0], low + good[-1]) if good else None


def join_segments(cell: np.ndarray, bodies: list[np.ndarray], off: np.ndarray, width: int = WIDTH, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(i, k, low, high), i < k: links of segments of one cell that hold like paragraphs; cells are in order.

    The words ``low`` to ``high`` of segment k, counted from its least shingle, match words of segment i. Links join
    all segments of a cell that are linked through others.
    """
    size, n = width - SHINGLE + 1, len(bodies)
    length = np.fromiter(map(len, bodies), np.int64, n)
    left, run = size - 1 - off, length - size + 1
    # rows are aligned at the least shingle; every paragraph of a segment holds it
    grid, held = np.zeros((n, 2 * size - 1), np.uint64), np.zeros((n, 2 * size - 1), bool)
    row = np.repeat(np.arange(n), length)
    column = left[row] + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    grid[row, column], held[row, column] = np.concatenate(bodies), True
    number = np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]]))
    own = _mix(number.astype(np.uint64) + np.uint64(1))

    # paragraphs with equal sets have equal sums of hashes: each segment is linked to the first that holds one
    place, hashes, fewest = np.arange(size), _mix(grid), np.full(n, size)
    total = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(hashes, 1, dtype=np.uint64)], 1)
    total = total[:, size:] - total[:, :-size]
    ordered = np.sort(grid, 1)
    twice = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0)).any(1)
    counted = {}
    for i in np.flatnonzero(twice).tolist():  # repeated shingles count once
        back, last = np.full(2 * size - 1, -1), {}
        for c, e in enumerate(grid[i].tolist()):
            back[c], last[e] = last.get(e, -1), c
        every = np.arange(2 * size - 1)
        counts = counted[i] = (every >= place[:, None]) & (every < place[:, None] + size) & (back < place[:, None])
        total[i] = np.where(counts, hashes[i], 0).sum(1, dtype=np.uint64)
        fewest[i] = counts.sum(1)[left[i] : left[i] + run[i]].min()
    s, k = np.nonzero((place >= left[:, None]) & (place < (left + run)[:, None]))
    key = _mix(total[s, k] ^ own[s])
    order = np.argsort(key)
    s, k, key = s[order], k[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    head = np.repeat(np.minimum.reduceat(s, new), np.diff(np.append(new, len(key))))
    pair, k = (head * n + s)[head != s], k[head != s]
    order = np.lexsort((k, pair))
    pair, k = pair[order], k[order]
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(pair))[: len(new)] - 1
    i, j = pair[new] // n, pair[new] % n
    found = list(zip(i.tolist(), j.tolist(), (k[new] - size + 1).tolist(), (k[last] - size + 1 + width).tolist(), strict=True))
    label = _trees(n, i, j)

    # shingles that several trees of a cell hold; a segment that has too few of them in each paragraph is done
    trees = np.bincount(number, label == np.arange(n))
    open_ = (trees > 1)[number]
    at = np.flatnonzero(open_[row])
    if not len(at):
        return found
    key = _mix(grid[row[at], column[at]] ^ own[row[at]])
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    tree = label[row[at]]
    shared = (np.minimum.reduceat(tree, first) != np.maximum.reduceat(tree, first))[group]
    mark = np.zeros(grid.shape, np.int64)
    mark[row[at[shared]], column[at[shared]]] = 1
    often = np.zeros(grid.shape, np.int64)
    often[row[at], column[at]] = np.diff(np.append(first, len(at)))[group]
    sums = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(mark, 1)], 1)
    most = (sums[:, size:] - sums[:, :-size]).max(1)
    # how many shingles of a paragraph a like one holds at least: with n of ``size`` in common they are n / (2 * size - n) alike
    least, full = (int(np.ceil(x - 1e-9)) for x in (size * threshold, 2 * size * threshold / (1 + threshold)))
    mixed = np.isin(number, number[twice])
    need = np.where(twice, np.ceil(threshold * fewest - 1e-9), np.where(mixed, least, full)).astype(np.int64)
    left_over = np.flatnonzero(open_ & (most >= need))
    if not len(left_over):
        return found
    _, code = np.unique(grid[left_over], return_inverse=True)
    code = code.reshape(len(left_over), -1)
    at = dict(zip(left_over.tolist(), code, strict=True))
    mine = np.zeros(code.max() + 1, bool)
    # the shingles of each tree
    held_by: dict[int, set[int]] = {}
    index: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in left_over.tolist():
        own = at[i][held[i]]
        # of the shared shingles all but ``need`` - 1 hold one of any like segment
        values, where = np.unique(at[i][mark[i] > 0], return_index=True)
        if twice[i]:  # of each paragraph's set the rarest, of which a like one holds one
            rare = np.lexsort((at[i], often[i]))
            sets = counted[i][left[i] : left[i] + run[i], rare]
            most = sets.sum(1) - np.ceil(threshold * sets.sum(1) - 1e-9) + 1
            prefix = np.unique(at[i][rare[(sets & (np.cumsum(sets, 1) <= most[:, None])).any(0) & (mark[i][rare] > 0)]])
        else:
            prefix = values[np.lexsort((values, often[i][mark[i] > 0][where]))][: len(values) - int(need[i]) + 1]
        prefix = [(int(number[i]), e) for e in prefix.tolist()]
        near = np.unique(np.array([k for e in prefix for k in index[e]], np.int64))
        mine[own] = True
        trees = np.unique(label[near]).tolist()
        if twice[i] and trees:  # all trees at once: there are few different shingles, so many trees hold some
            order = np.argsort(at[i], kind="stable")
            kinds = at[i][order]
            new = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
            has = np.add.reduceat(counted[i].T[order].astype(float), new)
            every = kinds[new].tolist()
            holds = np.array([[e in held_by[tree] for e in every] for tree in trees], float)
            good = (holds @ has >= threshold * has.sum(0) - 1e-9)[:, left[i] : left[i] + run[i]].any(1)
            trees = [tree for tree, ok in zip(trees, good.tolist(), strict=True) if ok]
        for tree in trees:
            if label[i] == tree or tree not in held_by:  # this one's tree, or what that was called
                continue
            # the whole tree must hold enough of one paragraph here, and this one enough of one there
            if not twice[i]:
                sums = [0, *accumulate(e in held_by[tree] for e in own.tolist())]
                if max(b - a for a, b in zip(sums, sums[size:])) < need[i]:
                    continue
            there, done, step = near[label[near] == tree], 0, 32
            while done < len(there):  # most often one of the first is alike
                some = there[done : done + step]
                done, step = done + step, 4 * step
                hit = np.zeros((len(some), 2 * size), np.int16)
                np.cumsum(mine[np.stack([at[k] for k in some.tolist()])] & held[some], 1, out=hit[:, 1:])
                low, high = np.maximum(left[i], left[some]), np.minimum(left[i] + run[i], left[some] + run[some])
                enough = (hit[:, size:] - hit[:, :-size] >= need[some, None]) & (place >= low[:, None]) & (place < high[:, None])
                for t in np.flatnonzero(enough.any(1)).tolist():
                    k = int(some[t])
                    if twice[k] and not (counted[k][low[t] : high[t]] @ mine[at[k]].astype(np.int64) >= threshold * counted[k][low[t] : high[t]].sum(1) - 1e-9).any():
                        continue
                    if like := _alike(grid[i], grid[k], int(low[t]), int(high[t]), size, threshold, not (twice[i] or twice[k])):
                        found.append((k, i, like[0] - size + 1, like[1] - size + 1 + width))
                        old = int(label[i])
                        label[label == old] = tree
                        held_by[tree] |= held_by.pop(old, set())
                        done = len(there)
                        break
        mine[own] = False
        held_by.setdefault(int(label[i]), set()).update(own.tolist())
        for e in prefix:
            index[e].append(i)
    return found


def _links(rows: DataFrame, cell: int, width: int, threshold: float) -> DataFrame:
    """Edges (u, v, low, high) from (cell, node, off, shingles, first): words ``low`` to ``high`` of node v match some of u, which is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * cell:
                table = pa.Table.from_batches(held)
                key = table.column("cell").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last cell may go on
                if cut:
                    yield from cells(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size -= cut
        if size:
            yield from cells(pa.Table.from_batches(held))

    def cells(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, off = (table.column(c).to_numpy() for c in ("cell", "node", "off"))
        made = join_segments(key, [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], off.astype(np.int64), width, threshold)
        if made:
            i, k, low, high = (np.array(x) for x in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[k], low + off[k], high + off[k])], names=["u", "v", "low", "high"])

    small_batches(rows.sparkSession)
    return rows.repartition("cell").sortWithinPartitions("cell", "first").drop("first").mapInArrow(run, "u long, v long, low long, high long")


def removals(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, threshold: float = THRESHOLD, cell: int = CELL, piece: int = PIECE) -> DataFrame:
    """(doc_id, th, packed, found): documents with their segments that belong to classes of two or more.

    Of ``found``: first word and words of the segment, words that go (none: null), the document of the class's first
    segment, whether that is this segment (``first``), whether the class is of several documents, and the class.
    """
    spark = docs.sparkSession
    with_checkpoints(spark)
    folder = shared_folder(spark, "paragraphs")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = kept(_segments(docs, width, bands, piece), folder, "segments")
    many = kept(rows.groupBy("bucket").count().where("count > 1").select("bucket"), folder, "buckets")
    repeated = kept(rows.join(many, "bucket", "left_semi"), folder, "repeated")
    doc = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")
    where = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "place")
    nodes = kept(repeated.groupBy("bucket", "node").agg(F.min(where).alias("first"), F.max(doc).alias("last"), F.count("*").alias("times")), folder, "nodes")
    mixed = kept(nodes.groupBy("bucket").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"), F.count("*").alias("kinds")).where("kinds > 1"), folder, "mixed")
    wanted = nodes.join(mixed, "bucket").groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list(F.struct("bucket", "parts", "node", "first")).alias("wanted"))
    packed = _packed(docs)
    # of repeated rows one is enough to read a segment; the others give the same node again
    bodies = _bodies(packed.join(wanted, (packed.th == wanted.t) & packed.doc_id.eqNullSafe(wanted.d)), width, nodes.schema["first"].dataType.simpleString())
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = bodies.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "node", "off", "shingles", "first")
    edges = kept(_links(dealt, cell, width, threshold), folder, "links")
    tree = components(edges)
    classes = kept(nodes.join(tree, "node", "left").withColumn("class", F.coalesce("component", "node")), folder, "classes")
    heads = classes.groupBy("class").agg(F.min("first").alias("head"), F.max("last").alias("last"), F.sum("times").alias("size")).where("size > 1")
    lost = edges.groupBy(F.col("v").alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = F.struct(F.col("head.x").alias("x"), F.col("head.doc_id").alias("doc_id"), F.col("head.th").alias("th")) != F.col("last")
    of = kept(classes.drop("last").join(heads.select("class", "head", "last"), "class").join(lost, "node", "left")
        .select(F.col("node").alias("n"), "class", F.col("first").alias("mine"), F.col("head.doc_id").alias("head_doc"), (F.col("first") == F.col("head")).alias("leads"), shared.alias("shared"), "low", "high"), folder, "found")
    found = repeated.join(of, repeated.node == of.n).withColumn("here", where.eqNullSafe(F.col("mine")))
    found = found.select("doc_id", "th", "place", F.when(F.col("here"), F.col("low")).otherwise(F.lit(0)).alias("low"), F.when(F.col("here"), F.col("high")).otherwise(F.shiftrightunsigned("place", 8).bitwiseAND(0xFFFFF) + width - 1).alias("high"), "head_doc", (F.col("here") & F.col("leads")).alias("first"), "shared", "class")
    per = found.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("place", "low", "high", "head_doc", "first", "shared", "class")).alias("found"))
    return packed.join(per, (packed.th == per.t) & packed.doc_id.eqNullSafe(per.d), "left").select("doc_id", "th", "packed", "found")


def cut(raw: bytes, found: list[dict], width: int = WIDTH) -> tuple[bytes, int, int, int]:
    """The text without the words that go, the number of words and of those that go, and of runs of these.

    A class's first segment stays whole where it overlaps later ones of its class; a line that loses all its words goes.
    """
    if not any(f["high"] is not None for f in found):
        return raw, len(raw.split()), 0, 0
    data = np.frombuffer(raw, np.uint8)
    start, end = _words(data)
    out = np.zeros(len(start), bool)
    stays = {}
    for f in found:
        if f["first"]:
            low, run, _ = _unpack(np.int64(f["place"]))
            stays[f["class"]] = (int(low), int(low + run - 1 + width))
    for f in found:
        if f["high"] is not None:
            low = int(_unpack(np.int64(f["place"]))[0])
            a, b = low + f["low"], low + f["high"]
            head = stays.get(f["class"])
            if head and head[0] <= a < head[1]:
                a = head[1]
            out[a:b] = True
    if not out.any():
        return raw, len(start), 0, 0
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start)
    edges = np.concatenate([[-1], breaks, [len(raw)]])
    kept, done = [], 0
    for i in np.unique(line[out]).tolist():
        if i > done:
            kept.append(raw[edges[done] + 1 : edges[i]])
        done = i + 1
        a, b = np.searchsorted(line, [i, i + 1])
        left = ~out[a:b]
        if not left.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
        low = [int(edges[i]) + 1 if k == 0 else int(start[a + k]) for k in edge[::2]]
        high = [int(edges[i + 1]) if k == b - a else int(end[a + k - 1]) for k in edge[1::2]]
        kept.append(b" ".join(raw[p:q] for p, q in zip(low, high, strict=True)))
    if done < len(edges) - 1:
        kept.append(raw[edges[done] + 1 :])
    return b"\n".join(kept), len(start), int(out.sum()), int((np.diff(np.concatenate([[0], out.astype(np.int8)])) == 1).sum())


def _apply(df: DataFrame, made: str, one, width: int) -> DataFrame:
    names = [x.strip().split()[0] for x in made.split(",")]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    kinds = [arrow[x.strip().split()[1]] for x in made.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, own in zip(batch.column("packed"), batch.column("found"), strict=True):
                own = own.as_py() or []
                rows.append(one(own, *cut(unpress.decompress(packed.as_py()), own, width)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {made}")


def report(docs: DataFrame, width: int = WIDTH, **kw) -> DataFrame:
    """doc_id, n_words, n_removed (words), n_spans (runs of these), kept_sha256 (of the text left) and class_doc_ids: of each
    class that several documents share, and that has a paragraph here, the document that holds the first one."""

    def one(found: list[dict], kept: bytes, words: int, gone: int, spans: int) -> tuple:
        return words, gone, spans, sha256(kept), sorted({f["head_doc"] for f in found if f["shared"] and f["head_doc"] is not None})

    return _apply(removals(docs, width, **kw), "n_words long, n_removed long, n_spans long, kept_sha256 string, class_doc_ids array<long>", one, width)


def deduplicated(docs: DataFrame, width: int = WIDTH, **kw) -> DataFrame:
    """doc_id and the text that is left."""
    return _apply(removals(docs, width, **kw), "text string", lambda found, kept, *_: (kept.decode("utf-8", "ignore"),), width)
