import itertools
import random

import public_tokenizers as P

from veilspark.llm import tokencount as T


def greedy(word, initial, inner):
    n, at, words = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in words), None)
        if end is None:
            return -1
        n, at, words = n + 1, end, inner
    return n


def test_small_vocabularies():
    rng = random.Random(1)
    for _ in range(150):
        every = ["".join(x) for k in (1, 2, 3, 4, 5) for x in itertools.product("abc", repeat=k)]
        initial, inner = set(rng.sample(every, rng.randint(1, 20))), set(rng.sample(every, rng.randint(0, 20)))
        a = T.Automaton(sorted(initial), sorted(inner))
        for w in every[:200] + ["".join(rng.choices("abcd", k=rng.randint(1, 20))) for _ in range(60)]:
            assert a.count(w) == greedy(w, initial, inner), (w, initial, inner)


def test_columns(spark):
    path = P.path("piece_bpe_32k.model")
    initial, inner = map(set, T.pieces(path))
    texts = [None, "", "  \n", "Hello wonderful tokenisation of texts.", "a" * 3000, "日本語のテキスト 🙂 été", "x▁y unbelievable unbelievable"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in T.counts(df, path).collect():
        n = [greedy(w, initial, inner) for w in (texts[r.doc_id] or "").split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(abs(x) for x in n), n.count(-1))
    assert T.counts(df.limit(0), path).collect() == []
