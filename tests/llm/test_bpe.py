import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a", "Hello world's end, I'll they've", "a  b", "a   b \n c\n\n d", "\n x", "x \n", "tab\tin  it", "été ç ñandú ß", "日本語 テスト", "x y　z w", "\x1c\x1d a\x1f b",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "1234567 89,0.5", "🙂🙂 🙃", "�\x00\x01", "x" * 5000, "ab" * 3000 + " c", "!!!???...---" * 300, "é" * 700,
]


def library(text):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_equals_library():
    own = bpe.load(open(PATH, "rb").read())
    rnd = random.Random(3)
    more = ["".join(rnd.choice("ab e\n\t é1!'st ") for _ in range(rnd.randrange(60))) for _ in range(300)]
    t = tokenizers.Tokenizer.from_file(PATH)
    for text in [*TEXTS, *more]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        encoded = own.encode(text)
        assert list(memoryview(encoded).cast("I")) == ids, text
        assert own.decode(encoded) == t.decode(ids, skip_special_tokens=False), text


def test_heap_equals_scan():
    own = bpe.load(open(PATH, "rb").read())
    rnd = random.Random(5)
    for _ in range(200):
        ids = [own.byte[b] for b in "".join(rnd.choice("etaoin shrdlu") for _ in range(rnd.randrange(200))).encode()]
        assert own.scan(list(ids)) == own.heap(list(ids))


def test_frames(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "a b", None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        ids, text = library(r.text)
        assert (r.ids, r.decoded) == (ids, text)
    for r, q in zip(sorted(out, key=str), sorted(bpe.roundtrip(df, PATH, keep=["doc_id", "text"]).collect(), key=str), strict=True):
        assert q.n_tokens == len(r.ids) and q.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.roundtrip(df.limit(0), PATH).collect() == []
