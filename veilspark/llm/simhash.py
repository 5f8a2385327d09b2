"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints have 64 bits: bit i is one if it is one in more than half of the
text's shingle hashes. Equal fingerprints are one node. Two fingerprints that
differ in at most ``RADIUS`` bits agree on at least two of ``RADIUS + 2``
bands, so each two bands with their values are the root of a trie over the
fingerprints that share them, and all links are found within such tries: pairs of trie nodes are
traversed together, with the bits that differ so far, and given up as soon as
these exceed the radius. Many tries are traversed side by side, level by level.

A trie of many fingerprints is dealt into ``CELL``-sized parts by a hash, and
every pair of parts is a task of its own; nothing is capped or sampled. A trie
gives the edges of a spanning forest of its links, not all pairs, and
``components`` unites the forests.

Defined cases: null and empty texts and those of white space have fingerprint
zero and are linked like others; null ids are kept as they are; repeated rows
are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import kept, shared_folder, slices, small_batches, with_checkpoints
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one trie that make a part; a task takes in two parts at most.
CELL = 16384
#: Pairs of trie nodes that are expanded in one step.
STEP = 1 << 20


def fingerprint(text: bytes) -> int:
    """Of 4-word shingles, repeats included; fewer words are one shingle; no words give zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return _majority(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), n)


def _majority(digests: bytes, n: int) -> int:
    """Digests are big-endian; sums are taken in blocks, since texts may be very long."""
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        count += np.unpackbits(raw[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes())


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed long."""
    keep = [f for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = np.array([fingerprint((t or "").encode()) for t in batch.column(text).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(made)], names=[f.name for f in keep] + [out])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` long"]))


class Forest:
    """Union-find over row numbers; ``edges`` gets a row pair for every union."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def labels(self) -> np.ndarray:
        """Root of every row, all paths shortened."""
        p = np.array(self.parent)
        while (q := p[p]).tolist() != p.tolist():
            p = q
        self.parent = p.tolist()
        return p

    def unite(self, pairs: Iterator[tuple[int, int]]) -> None:
        find, parent, edges = self.find, self.parent, self.edges
        for a, b in pairs:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((a, b))


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_join(values: np.ndarray, roots: list[tuple[int, int, int, int]], radius: int = RADIUS) -> Forest:
    """Links rows whose values differ in at most ``radius`` bits, for the given pairs of tries.

    A root is (low, high, low, high): two ranges of rows, each with its values
    in order and so a binary trie; equal ranges are a self-join. A node at
    depth d is a range of rows that agree on the first d bits.
    """
    forest = Forest(len(values))
    start = np.array(roots, np.int64).reshape(-1, 4)
    stack = [(0, start, np.zeros(len(start), np.int64))] if len(start) else []
    while stack:
        depth, pair, diff = stack.pop()
        if len(pair) > STEP:
            stack += [(depth, pair[STEP:], diff[STEP:]), (depth, pair[:STEP], diff[:STEP])]
            continue
        # small pairs are compared outright
        sizes = (pair[:, 1] - pair[:, 0]) * (pair[:, 3] - pair[:, 2])
        done = (sizes <= 16) | (depth == 64)
        if done.any():
            own, n = pair[done], sizes[done]
            which = np.repeat(np.arange(len(own)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            width = (own[:, 3] - own[:, 2])[which]
            a, b = own[which, 0] + at // width, own[which, 2] + at % width
            near = (a != b) & (_count(values[a] ^ values[b]) <= radius)
            a, b = a[near], b[near]
            if len(a):
                root = forest.labels()
                open_ = root[a] != root[b]
                forest.unite(zip(a[open_].tolist(), b[open_].tolist(), strict=True))
            pair, diff = pair[~done], diff[~done]
        if not len(pair):
            continue
        # rows of a node are in order: the next bit splits its range at one place
        bit = np.uint64(1) << np.uint64(63 - depth)
        ones = np.concatenate([[0], np.cumsum((values & bit) != 0)])
        left = pair[:, 1] - (ones[pair[:, 1]] - ones[pair[:, 0]])
        right = pair[:, 3] - (ones[pair[:, 3]] - ones[pair[:, 2]])
        same = (pair[:, 0] == pair[:, 2]) & (pair[:, 1] == pair[:, 3])
        low, high = np.stack([pair[:, 0], left], 1), np.stack([left, pair[:, 1]], 1)
        low2, high2 = np.stack([pair[:, 2], right], 1), np.stack([right, pair[:, 3]], 1)
        parts, bits = [], []
        for i in (0, 1):
            for j in (0, 1):
                d = diff + (i != j)
                ok = (d <= radius) & (high[:, i] > low[:, i]) & (high2[:, j] > low2[:, j])
                if (i, j) == (1, 0):
                    ok &= ~same
                parts.append(np.stack([low[ok, i], high[ok, i], low2[ok, j], high2[ok, j]], 1))
                bits.append(d[ok])
        pair, diff = np.concatenate(parts), np.concatenate(bits)
        if len(pair) > 4096:
            # pairs of nodes whose rows are all in one tree of the forest have nothing to add
            root = forest.labels()
            change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            whole = lambda x, y: change[x] == change[y - 1]
            dull = whole(pair[:, 0], pair[:, 1]) & whole(pair[:, 2], pair[:, 3]) & (root[pair[:, 0]] == root[pair[:, 2]])
            pair, diff = pair[~dull], diff[~dull]
        if len(pair):
            stack.append((depth + 1, pair, diff))
    return forest


def _keys(f: Column, radius: int) -> list[Column]:
    """Two of radius + 2 bands of the 64 bits, every choice: values within the radius agree on at least one."""
    edge = [64 * i // (radius + 2) for i in range(radius + 3)]
    bands = [(64 - b, b - a) for a, b in zip(edge, edge[1:])]
    value = lambda band: F.shiftrightunsigned(f, band[0]).bitwiseAND((1 << band[1]) - 1)
    return [
        F.lit(i << 48) + value(x) * (1 << 24) + value(y)
        for i, (x, y) in enumerate(combinations(bands, 2))
    ]


def links(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Edges (u, v) of spanning forests of the links between distinct fingerprints in ``nodes`` (a column fingerprint)."""
    spark = nodes.sparkSession
    keyed = nodes.select("fingerprint", F.explode(F.array(*_keys(F.col("fingerprint"), radius))).alias("key"))
    many = keyed.groupBy("key").count().where("count > 1")
    joined = keyed.join(many, "key").withColumn("parts", F.ceil(F.col("count") / cell).cast("int"))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    # a part meets every other part once: the cell is named by the smaller and the larger of both
    cells = joined.withColumn("part", part).select(
        "fingerprint", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("fingerprint", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * cell:
                table = pa.Table.from_batches(held)
                last = table.column("cell")[-1].as_py()
                cut = int(np.searchsorted(table.column("cell").to_numpy(), last))  # the last cell may go on
                if cut:
                    yield from join(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from join(pa.Table.from_batches(held))

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("cell").to_numpy()
        side = table.column("side").to_numpy()
        value = table.column("fingerprint").to_numpy().view(np.uint64)
        order = np.lexsort((value, side, key))
        key, side, value = key[order], side[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() + [len(key)]
        roots = []
        for a, b in zip(first, first[1:]):
            middle = a + int(np.searchsorted(side[a:b], 1))
            # a cell with two sides is of two parts: each part's own pairs are another cell's
            roots.append((a, b, a, b) if middle == b else (a, middle, middle, b))
        forest = trie_join(value, roots, radius)
        if forest.edges:
            e = np.array(forest.edges)
            yield pa.RecordBatch.from_arrays([pa.array(value[e[:, 0]].view(np.int64)), pa.array(value[e[:, 1]].view(np.int64))], names=["u", "v"])

    small_batches(spark)
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id: the smallest key reachable)."""
    with_checkpoints(df.sparkSession)
    prints = fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text").checkpoint()
    nodes = prints.groupBy("fingerprint").agg(F.min("key").alias("least"))
    found = components(links(nodes.select("fingerprint"), radius))
    folder = shared_folder(df.sparkSession, "simhash")
    # both sides of each join are shuffled anew, so that a tree or a fingerprint with very many rows can be split
    tree = kept(nodes.join(found, nodes.fingerprint == found.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("tree")), folder, "trees")
    least = kept(tree.groupBy("tree").agg(F.min("least").alias("component_id")), folder, "least")
    of = kept(tree.join(least, "tree").select("fingerprint", "component_id"), folder, "components")
    return prints.join(of, "fingerprint").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``df`` of each near-duplicate class: that with the least key (null last), then the least hash of its text.

    Rows equal in key and text count as one, so one of them stays; different texts under one key are told apart.
    """
    # none of these is null, so the join and the last step deal rows out alike
    name = {"_n": F.col(key).isNull(), "_k": F.coalesce(F.col(key).cast("string"), F.lit("")), "_t": F.xxhash64(text)}
    row = F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("v"), *[c.alias(n) for n, c in name.items()])
    found = near_duplicates(df.select(row.alias("row"), F.col(text).alias("text")), "row", "text", radius)
    first = found.where("row = component_id").select("row._n", "row._k", "row._t").distinct()
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in name.items()])
    return own.join(first, list(name), "left_semi").dropDuplicates(list(name)).select("_row.*")
