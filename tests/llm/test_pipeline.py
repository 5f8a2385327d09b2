import hashlib
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from veilspark.llm import bpe

from .test_crf import corpus
from .test_decontam import brute as hits
from .test_secrets import S as secrets
from .test_simhash import brute_components, brute_print


def test_stages_and_run(spark, tmp_path):
    texts, labels = corpus(400)
    item = " ".join(f"benchword{i}" for i in range(20))
    docs = [(i, t, "en", "s", len(t)) for i, t in texts]
    docs += [(1000, texts[0][1], "en", "s", 5), (1001, "Clean words here. " + item, "en", "s", 5), (1002, None, "en", "s", 0), (1003, "", None, None, None), (1004, "Plain line with token = abcdefabcdef123456 inside. And more words here.", "en", "s", 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = []
    for name, f in corpus_pipeline.STAGES:
        new = f(spark, at, str(tmp_path))
        if name != "encoding":
            assert new.columns == at.columns
        new.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append({r.doc_id: r for r in at.collect()})
        assert len(outs[-1]) == at.count()
    truth = dict(labels)
    kept = outs[0]
    wrong = sum((i in kept) != bool(q) for i, q in truth.items())
    assert wrong < 0.03 * len(truth) and 1001 in kept and 1004 in kept
    ids = sorted(kept)
    comp = brute_components(ids, [brute_print(kept[i].text) for i in ids])
    assert set(outs[1]) == set(comp.values()) and all(outs[1][i] == kept[i] for i in outs[1])
    assert set(outs[2]) == {i for i, r in outs[1].items() if not hits(r.text, [(1, item)])[-1]} and 1001 not in outs[2]
    assert set(outs[3]) == set(outs[2])
    for i, r in outs[3].items():
        t, spans = outs[2][i].text, secrets.spans_of([outs[2][i].text or ""])[0]
        if not spans:
            assert r == outs[2][i]
        else:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text) and not re.search("[0-9a-f]{16}", r.text)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    for i, r in outs[4].items():
        t = outs[3][i].text or ""
        assert list(r.ids) == enc.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    full = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert full == outs[4]


def test_cases(spark, tmp_path):
    """No n_chars, further columns whose names the stages use themselves, repeated rows, no ids, no rows at all."""
    texts, labels = corpus(120)
    rows = [(i, t, f"r{i}", 1.5, 7) for i, t in texts] + [(texts[0][0], texts[0][1], "again", 0.0, 1)] + [(None, "A fine line without an id stands here.", "none", 0.0, 2), (None, "A fine line without an id stands here.", "none", 0.0, 2)]
    for folder, some in (("full", rows), ("empty", [])):
        at = f"{tmp_path}/{folder}"
        spark.createDataFrame(some, "doc_id long, text string, row string, quality_score double, _n int").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, at)
            assert docs.columns == ["doc_id", "text", "row", "quality_score", "_n"]
        got = corpus_pipeline.run(spark, at)
        assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
        ids = [r.doc_id for r in got.collect()]
        assert len(ids) == len(set(ids)) and (folder == "full") == bool(ids)
