import random
import time

import numpy as np

from veilspark.llm import paragraphs as G

WIDTH = 24


def shingled(text, width):
    w = (text or "").encode().lower().split()
    return [frozenset(tuple(w[k : k + 5]) for k in range(i, i + width - 4)) for i in range(len(w) - width + 1)]


def brute(docs, width):
    """Pairs of documents with paragraphs of similarity 0.8 or more, by comparing all; and those with equal ones."""
    own = [(i, shingled(t, width)) for i, t in docs]
    near, equal = set(), set()
    for a, (i, x) in enumerate(own):
        for k, y in own[:a]:
            if set(x) & set(y):
                equal.add((k, i))
            if any(len(p & q) >= 0.8 * len(p | q) - 1e-9 for p in set(x) for q in set(y)):
                near.add((k, i))
    return near, equal


def corpus():
    rng = random.Random(11)
    vocab = [a + b for a in ("an", "ti", "É", "re", "mu", "ko") for b in ("ou", "x", "st", "日", "lo", "pe")]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    shared, stock = [line(60) for _ in range(3)], line(16)
    docs = [(0, None), (1, ""), (2, "one two\n\none two"), (3, "a b c d e"), (4, line(WIDTH - 1))]
    for i in range(5, 50):
        t = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            t.insert(rng.randrange(len(t)), stock)
        if rng.random() < 0.4:
            s = rng.choice(shared).split()
            a = rng.randrange(20)
            s = s[a : a + rng.randint(20, 50)]
            for _ in range(rng.choice([0, 0, 1, 1])):
                s[rng.randrange(len(s))] = "edit" + str(rng.randint(0, 5))
            t.insert(rng.randint(0, len(t)), " ".join(s))
        docs.append((i, rng.choice(["\n", " ", "\r\n  "]).join(t)))
    return docs


def test_classes_join_documents_that_share_paragraphs(spark):
    docs = corpus()
    near, equal = brute(docs, WIDTH)
    assert len(near) > len(equal) > 20
    df = spark.createDataFrame([(i, t, [1]) for i, t in docs], "doc_id long, text string, class_doc_ids array<int>")
    for cell, piece in ((G.CELL, G.PIECE), (4, 200)):
        # the fewer shingles, the more bands it takes
        found = G.removals(df, WIDTH, bands=6, cell=cell, piece=piece).collect()
        member = {}
        for r in found:
            for f in r.found or []:
                member.setdefault(f["class"], set()).add(r.doc_id)
        linked = {(a, b) for m in member.values() for a in m for b in m if a < b}
        assert equal <= linked and len(near & linked) >= 0.95 * len(near)
        # classes are components of true links
        parent = {i: i for i, _ in docs}
        find = lambda a: a if parent[a] == a else find(parent[a])
        for a, b in near:
            parent[find(b)] = find(a)
        assert all(find(a) == find(b) for a, b in linked)
    rows = {r.doc_id: r for r in G.report(df, WIDTH, bands=6).collect()}
    clean = {i for i, _ in docs} - {i for p in near for i in p}
    assert len(clean) > 10 and all(rows[i].class_doc_ids == [] for i in clean)
    assert all(rows[a].class_doc_ids and rows[b].class_doc_ids for a, b in equal)
    assert G.report(df.limit(0)).collect() == []


def test_what_is_cut_is_held_by_an_earlier_document(spark):
    docs = corpus()
    left = {r.doc_id: r.text for r in G.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), WIDTH, bands=6).collect()}
    first = lambda t: {tuple(p) for p in shingled(t, 5)}
    whole = [(i, first(t)) for i, t in docs]
    for n, (i, t) in enumerate(docs):
        before = set().union(*(s for _, s in whole[:n])) if n else set()
        own = (t or "").split()
        kept = left[i].split()
        # what stays is a subsequence, and a text without repeats stays as it is
        it = iter(own)
        assert all(w in it for w in kept)
        if not shingled(t, WIDTH) or not first(t) & before and len(set(shingled(t, WIDTH))) == len(shingled(t, WIDTH)):
            assert left[i] == (t or "")


def test_planted_passages(spark):
    """Passages of 51 words and more in the middle of lines, dealt over lines, or edited, are found; stock lines are not."""
    rng = random.Random(3)
    words = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    stock = words("stock", 40)
    docs, caught, clean = [], set(), set()
    for k in range(60):
        passage = words("p", rng.randint(51, 90))
        for _ in range(rng.choice([2, 2, 3])):
            a, b = words("h", rng.randint(0, 90)), words("t", rng.randint(0, 90))
            caught.add(len(docs))
            docs.append(rng.choice([" ", "\n"]).join(a + [rng.choice([" ", "\n"]).join(passage)] + b))
        clean.add(len(docs))
        docs.append(" ".join(words("c", 30)) + "\n" + " ".join(stock) + "\n" + " ".join(words("d", rng.randint(0, 200))))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r.doc_id: r for r in G.report(df).collect()}
    assert all(rows[i].class_doc_ids for i in caught)
    assert all(rows[i].class_doc_ids == [] and rows[i].n_removed == 0 for i in clean)
    assert sum(rows[i].n_removed for i in caught) >= 51 * 60


def test_edited_passages(spark):
    """Passages of which some words were changed, put in or left out."""
    rng = random.Random(5)
    words = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for _ in range(80):
        passage = words("p", 110)
        other = list(passage)
        other[55] = "new"
        if rng.random() < 0.5:
            other.insert(54, "more")
        else:
            del other[56]
        docs += [" ".join(words("a", 20) + passage), " ".join(other + words("b", 30))]
    rows = {r.doc_id: r.class_doc_ids for r in G.report(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert sum(rows[i] == [i // 2 * 2] for i in rows) >= 0.9 * len(docs)


def test_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (None, None), (8, "la " * 400 + "end"), (9, text.upper() + "\n" + text)], "doc_id long, text string")
    rows = G.deduplicated(df).collect()
    left = sorted((r.doc_id or 0, r.text) for r in rows)
    assert left[:2] == [(0, ""), (0, "")] and left[2:4] == [(7, text)] * 2
    assert left[4][1].split().count("la") >= G.WIDTH and left[5] == (9, "")
    ids = sorted((r.doc_id or 0, tuple(r.class_doc_ids)) for r in G.report(df).collect())
    assert ids == [(0, ()), (0, (7,)), (7, (7,)), (7, (7,)), (8, ()), (9, (7,))]


def test_pieces_hold_each_paragraph_once():
    rng = random.Random(2)
    raw = " ".join("x" * rng.randint(1, 30) + str(i) for i in range(500)).encode()
    words = raw.split()
    for size in (1, 100, 1000, 10**6):
        seen = []
        for at, part in G.pieces(raw, 10, size):
            own = part.split()
            assert own == words[at : at + len(own)]
            seen += range(at, at + len(own) - 9)
        assert seen == list(range(len(words) - 9))
    assert list(G.pieces(b" " * 50, 10, 20)) == [(0, b"")]


def test_segments_depend_on_words_only():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    texts = [" ".join(words).encode(), "\n".join(words).upper().encode(), b"", " ".join(["x", "y", "z", *words]).encode()]
    text, low, count, off, bucket, node = G.segments(texts)
    of = lambda i: list(zip(low[text == i].tolist(), count[text == i].tolist(), off[text == i].tolist(), bucket[text == i].tolist(), node[text == i].tolist()))
    assert of(0) and of(0) == of(1) and not of(2)
    assert sum(n for _, n, *_ in of(0)) == G.BANDS * (500 - G.WIDTH + 1)
    moved = {(a - 3, n, o, b, x) for a, n, o, b, x in of(3)}
    assert len(set(of(0)) - moved) <= G.BANDS


def test_links_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    size, width = 8, 12
    for _ in range(60):
        cell, bodies, off = [], [], []
        for c in range(rng.integers(1, 5)):
            base = [rng.integers(0, 400 if rng.random() < 0.7 else 12, 15) for _ in range(3)]
            for _ in range(rng.integers(1, 12)):
                x = base[rng.integers(3)].copy()
                x[rng.integers(0, 15, rng.integers(0, 5))] = rng.integers(400, 500, 1)
                a = int(rng.integers(0, 8))
                b = int(rng.integers(8, 16))
                if b - a >= size and a <= 7 < b:
                    cell.append(c)
                    bodies.append(x[a:b].astype(np.uint64))
                    off.append(7 - a)
        if not cell:
            continue
        want = []
        for i in range(len(cell)):
            for k in range(i):
                x, y = ({o - off[j]: set(bodies[j][o : o + size].tolist()) for o in range(len(bodies[j]) - size + 1)} for j in (i, k))
                if cell[i] == cell[k] and any(len(x[p] & y[p]) >= 0.8 * len(x[p] | y[p]) - 1e-9 for p in x if p in y):
                    want.append((k, i))
        got = G.join_segments(np.array(cell), bodies, np.array(off), width)
        assert all(i < k for i, k, *_ in got)
        trees = lambda e: G._trees(len(cell), np.array([a for a, *_ in e], int), np.array([b for _, b, *_ in e], int)).tolist()
        full = trees(want)
        # equal paragraphs at other places are links as well
        assert all(len({b for a, b in zip(full, trees(got)) if a == c}) == 1 for c in set(full))
        assert {(i, k) for i, k, *_ in got if i == k} == set()


def test_runs_of_one_word_are_no_hot_cell():
    rng = random.Random(6)
    texts = []
    for _ in range(4500):
        words = f"x{rng.randrange(400)}", "the", f"y{rng.randrange(400)}"
        times = rng.randint(8, 48)
        texts.append(" ".join(w for w in words for _ in range(times)).encode())
    text, low, run, off, bucket, node = G.segments(texts)
    kinds, count = np.unique(bucket, return_counts=True)
    own = np.flatnonzero(bucket == kinds[count.argmax()])
    own = own[np.unique(node[own], return_index=True)[1]]
    assert len(own) > 3000
    bodies = []
    for i in own.tolist():
        data = np.frombuffer(texts[text[i]], np.uint8)
        bodies.append(G._shingles(G.Hashes(data).of(*G._words(data)))[low[i] : low[i] + run[i] + G.WIDTH - G.SHINGLE])
    began = time.thread_time()
    found = G.join_segments(np.zeros(len(own), np.int64), bodies, off[own])
    assert found and time.thread_time() - began < 8
