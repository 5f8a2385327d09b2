import hashlib

import public_tokenizers as P
import tiktoken

from veilspark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello  world\n\n x's", "été ça ñandú 日本語 🙂", "\x00\x01\x7f  \t", "<|endoftext|> a" * 3, "aaaa" * 500, "a" * 5000, " ", "12345678 00"]


def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})


def test_every_token_and_texts():
    own, ref = bpe.codec(PATH, P.PATTERN), oracle()
    for t in TEXTS:
        assert own.encode(t or "") == ref.encode_ordinary(t or "")
        assert own.decode(own.encode(t or "")) == (t or "").encode()
    wrong = [t for t in own.tokens if own.model.encode(t.decode("latin-1").translate(own.table)) != [own.whole[t]]]
    assert len(wrong) < 20


def test_columns(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    ref = oracle()
    for i, t in enumerate(TEXTS):
        ids = ref.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).collect() == []
