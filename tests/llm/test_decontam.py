import hashlib
import random
import re

from veilspark.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(t, items):
    w = words(t)
    hit, ids = set(), set()
    for item, text in items:
        q = words(text)
        n = min(13, len(q))
        grams = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                ids.add(item)
    ids = sorted(map(str, ids - {None}))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def data():
    rng = random.Random(3)
    vocab = ["the", "Of", "é", "日本", "x1", "foo", "bar-baz", "K", "ÉA"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(1, 12)] + [(50, None), (51, "one two"), (52, "one two"), (None, "zz top")]
    docs = [None, "", "...", "one", "one two", "ONE, two! " * 40, "zz top"]
    for _ in range(60):
        t = text(rng.randint(1, 80))
        if rng.random() < 0.6:
            t += (rng.choice(items)[1] or "").upper() + text(rng.randint(0, 300))
        docs.append(t)
    return items, list(enumerate(docs))


def test_report(spark):
    items, docs = data()
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, n_words int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (D.BLOCK_BYTES, 300):  # one block and many
        rows = {r.doc_id: tuple(r)[1:] for r in D.report(df, bench, block_bytes=most).collect()}
        for i, t in docs:
            assert rows[i] == brute(t, items), t
    assert D.report(df.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 for r in D.report(df, bench.limit(0)).collect())


def test_clean_and_cut(spark):
    items, docs = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id long, text string, n_hit string")
    kept = {r.doc_id for r in D.clean(df, bench).collect()}
    assert kept == {i for i, t in docs if not brute(t, items)[-1]}
    long = [x for x in items if len(words(x[1])) >= 1]
    out = {r.doc_id: r.text for r in D.cut(df, bench).collect()}
    assert len(out) == len(docs) and out[0] is None
    for i, t in docs:
        n, hit = brute(t, long)[:2]
        assert len(words(out[i])) == n - hit
