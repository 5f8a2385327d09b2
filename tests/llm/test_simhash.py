import random

import numpy as np
import xxhash

from veilspark.llm import simhash as S
from veilspark.llm.components import components


def brute_print(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints, radius=4):
    out = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, prints):
            for b, y in zip(ids, prints):
                if bin(x ^ y).count("1") <= radius and out[a] != out[b]:
                    out[a] = out[b] = min(out[a], out[b])
                    changed = True
    return out


def test_trie_join_finds_all_links():
    rng = random.Random(1)
    for n, spread in ((60, 6), (300, 10), (3000, 12)):
        base = [rng.getrandbits(64) for _ in range(max(1, n // 60))]
        vals = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(spread), rng.randint(0, spread // 2))) for _ in range(n)})
        v = np.array(vals, np.uint64)
        forest = S.trie_join(v, [(0, len(v), 0, len(v))])
        root = forest.labels()
        x = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
        for a, b in zip(*np.nonzero(x)):
            assert root[a] == root[b]
        assert all(np.bitwise_count(v[a] ^ v[b]) <= 4 for a, b in forest.edges)


def texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "é", "x", "gamma y", "delta", "İ", "fox"]
    out = [None, "", " \t\n", "one", "ONE", "a b c", "a b c d", "x" * 5000]
    for _ in range(30):
        t = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 150))]
        out.append(" ".join(t))
        for _ in range(rng.randint(0, 4)):
            u = list(t)
            u[rng.randrange(len(u))] = "changed"
            out.append("\x0b".join(u))
    return out


def test_components_column(spark):
    ts = texts()
    ids = [5 * i + 3 for i in range(len(ts))]
    df = spark.createDataFrame(list(zip(ids, ts, [1] * len(ts))), "doc_id long, text string, fingerprint int")
    prints = [brute_print(t) for t in ts]
    want = brute_components(ids, prints)
    rows = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    assert len(rows) == len(ts)
    for i, p in zip(ids, prints):
        assert rows[i].fingerprint == f"{p:016x}"
        assert rows[i].component_id == want[i]
    kept = {r.doc_id for r in S.keep_one(df.unionByName(df)).collect()}
    assert kept == set(want.values())
    assert S.keep_one(df.unionByName(df)).count() == len(kept)
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_hot_values_are_dealt_in_cells(spark):
    rng = random.Random(9)
    vals = list({rng.getrandbits(16) for _ in range(400)})
    nodes = spark.createDataFrame([(v,) for v in vals], "fingerprint long")
    got = {r.node: r.component for r in components(S.links(nodes, cell=16)).collect()}
    want = brute_components(sorted(vals), sorted(vals))
    assert all(got.get(v, v) == want[v] for v in vals)


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(None, 4), (7, 7), (1, 2)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(df.limit(0)).collect() == []


def test_keep_one_tells_texts_under_one_key_apart(spark):
    rng = random.Random(9)
    text = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, 1), (1, b, 2), (1, b, 3), (2, a, 4), (None, c, 5), (None, c, 6), (None, a, 7), (3, None, 8), (4, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = S.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, c), (1, a), (1, b), (3, "")])
    long = spark.createDataFrame([(1, a + " x" * 200_000), (2, a + " x" * 200_000), (3, c)], "doc_id long, text string")
    assert {r.doc_id for r in S.keep_one(long).collect()} == {1, 3}
    assert S.keep_one(df.limit(0)).collect() == []
