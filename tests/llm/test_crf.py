import itertools
import random
import zlib

import numpy as np

from veilspark.llm import crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    chain = crf.Chain(1)
    chain.step = rng.normal(size=(2, 2))
    e = rng.normal(size=(3, 5)) * 2
    mask = np.arange(5) < np.array([[5], [3], [1]])
    p, pairs = chain.marginals(np.where(mask, e, 0), mask)
    for r, n in enumerate((5, 3, 1)):
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[r, i] * s[i] for i in range(n)) + sum(chain.step[a, b] for a, b in zip(s, s[1:])))
            total += w
            one += w * np.array(s)
            for a, b in zip(s, s[1:]):
                two[a, b] += w
        assert np.allclose(p[r, :n], one / total)
        assert np.allclose(pairs[r], two / total)


def corpus(n=600):
    rng = random.Random(0)
    vocab = ["".join(rng.choices(["an", "ti", "ou", "re", "st", "li"], k=rng.randint(1, 4))) for _ in range(300)]
    good = lambda: " ".join(rng.choices(vocab, k=rng.randint(4, 30))).capitalize() + "."
    bad = lambda: rng.choice([lambda: " ".join([rng.choice(vocab)] * 20), lambda: " ".join(w.upper() + "!!" for w in rng.choices(vocab, k=12)), lambda: " ".join(w + rng.choice(["###", "%%%"]) for w in rng.choices(vocab, k=12))])()
    docs, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.7)
        t = [(good if q else bad)() for _ in range(rng.randint(1, 12))]
        if not q and rng.random() < 0.5:
            t = [good(), *t]
        docs.append((i, "\n".join(t)))
        if i % 3:
            labels.append((i, q))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    docs += [(10_001, None), (10_002, ""), (10_003, "\n\n"), (10_004, "word " * 50_000), (None, "x")]
    d = spark.createDataFrame([(a, b, 0.0) for a, b in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in crf.report(d, lab).collect()}
    assert len(rows) == len(docs)
    truth = dict(labels)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(rows[i].predicted, q) for i, q in truth.items() if rows[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(held) > 40
    assert rows[10_001].score == rows[10_002].score
    kept = crf.accepted(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in rows.values())
    assert {r.score for r in crf.report(d, lab.limit(0)).collect()} == {0.5}
    assert crf.report(d.limit(0), lab).collect() == []


def test_equal_texts_get_equal_scores_in_any_batch(spark):
    docs, labels = corpus(200)
    chain = crf.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    texts = [t for _, t in docs]
    assert chain.scores(texts).tolist() == [float(chain.scores([t])[0]) for t in texts]


def test_transitions_count(spark):
    """Lines of one document speak for each other: without transitions the held-out likelihood is lower."""
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    chain = crf.fit(d, lab)
    assert chain.step[0, 0] + chain.step[1, 1] - chain.step[0, 1] - chain.step[1, 0] > 1
    held = [(t, q) for (i, t), q in ((docs[i], q) for i, q in labels) if zlib.crc32(str(i).encode()) % 5 == 0]
    emission = [chain.emission(crf.lines.rows(t)[0])[None] for t, _ in held]
    loss = lambda: -sum(np.log(np.clip(p if q else 1 - p, 1e-9, 1)).sum() for p, (_, q) in zip([chain.marginals(e, np.ones(e.shape, bool))[0] for e in emission], held))
    with_, chain.step = loss(), np.zeros((2, 2))
    assert with_ < loss()
