import hashlib
import random
from collections import Counter

import numpy as np

from veilspark.llm import suffixes as S


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                gone[i : i + n] = True
        g = gone[: len(r)]
        kept = bytes(b for b, x in zip(r, g) if not x)
        out.append((len(r), int(g.sum()), int((np.diff(gone.astype(int)) == 1).sum() + (len(r) > 0 and gone[0])), hashlib.sha256(kept).hexdigest()))
    return out


def test_family_finds_repeats_across_batches():
    rng = np.random.default_rng(1)
    words = rng.integers(97, 100, (900, 4), np.uint8).view("S4").ravel()
    family = S.IndexFamily()
    for i in range(0, 900, 30):
        family.add(words[i : i + 30], np.arange(i, i + 30))
    count = Counter(words.tolist())
    assert set(family.repeated().tolist()) == {i for i, w in enumerate(words.tolist()) if count[w] > 1}
    rng = np.random.default_rng(2)
    family = S.IndexFamily()
    for i in range(64):
        family.add(np.frombuffer(rng.bytes(800), "S8"), np.arange(100 * i, 100 * i + 100))
    sizes = [len(x.suffix) for x in family.levels]
    assert len(sizes) <= 7 and family.merges >= 32 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def corpus():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices("abcdefé \n", k=n))
    passage, other = text(400), text(300)
    docs = [None, "", "short", "z" * 1000, "ab" * 300, passage, passage[:199], passage + "x", "to to " * 80]
    for i in range(60):
        t = text(rng.randint(0, 500))
        if rng.random() < 0.5:
            a = rng.randrange(200)
            t += passage[a : a + rng.randint(150, 400)] + text(rng.randint(0, 200))
        if rng.random() < 0.3:
            t += other
        docs.append(t)
    near = text(1500)
    for i in range(15):
        k = rng.randrange(1500)
        docs.append(near[:k] + "Q" + near[k + 1 :])
    return docs + docs[20:26]


def check(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n int")
    rows = {r.doc_id: tuple(r)[1:] for r in S.report(df, **kw).collect()}
    want = brute(docs, kw.get("length", 200))
    for i in range(len(docs)):
        assert rows[i] == want[i], (i, docs[i], rows[i], want[i])


def test_report(spark):
    check(spark, corpus())


def test_hot_keys_and_small_ranges(spark):
    check(spark, corpus(), hot=3)
    check(spark, corpus(), length=40, gram=8, hot=5)


def test_pieces_of_long_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcd", k=3000))
    raw = [(long + "x" + long[500:1500]).encode()]
    whole = S.segments(raw, 40, 8)
    assert whole[2].sum() == len(raw[0]) - 39
    check(spark, [long + "x" + long[500:1500], long[:700]], piece=333)


def test_cases(spark):
    df = spark.createDataFrame([(None, "y" * 300), (None, "y" * 300), (3, None), (3, "w" * 250), (3, "w" * 250)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in S.report(df).collect())
    assert rows == [(-1, 300, 300, 1), (-1, 300, 300, 1), (3, 0, 0, 0), (3, 250, 250, 1), (3, 250, 250, 1)]
    assert S.report(df.limit(0)).collect() == []
    assert {r.text for r in S.deduplicated(df).collect()} == {""}


def test_keys_take_what_equal_windows_share():
    rng = random.Random(5)
    text = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    stock, passage = [text(60) for _ in range(5)], text(500)
    raw = [text(300) + s + text(300) for s in stock for _ in range(20)]
    key = S.segments(raw)[4]
    assert len(set(key.tolist())) == len(key)  # texts that share 60 bytes have no equal windows
    raw = [text(rng.randrange(90)) + passage[a : a + 320] + text(rng.randrange(90)) for a in range(0, 180, 9)]
    for length, gram in ((200, 40), (41, 8), (8, 8), (9, 8)):
        of = {}
        for t, low, run, off, key, _ in zip(*(x.tolist() for x in S.segments(raw, length, gram)), strict=True):
            for i in range(run):
                assert of.setdefault(raw[t][low + i : low + i + length], (key, off - i)) == (key, off - i)
        assert set(of) == {t[i : i + length] for t in raw for i in range(len(t) - length + 1)}


def test_texts_are_dealt_out_twice_at_most(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    plan = S.removals(df, hot=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # packed for the result, families, windows
