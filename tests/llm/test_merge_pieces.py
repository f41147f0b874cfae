"""The agenda against the sentencepiece library: odd texts, random texts, the operator."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from wiretrace.llm.merge_pieces import MARK, MergeCoder, digest_pieces, encode_pieces

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIB = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD = [
    "", " ", "  ", "a", " a", "a ", "  a   b    c  ", "a\n\n b\tc", MARK, f"x{MARK}{MARK} y", "<0x0A>", "<s> </s> <unk>", "ｆｕｌｌ ﬁ 東京 😀👍🏽",
    "é é", "a\x00b", "￾ ‍", " " * 100, "ab" * 3000, "internationalisation " * 40, "\r\n\x0b\x0c",
]


@pytest.fixture(scope="module")
def coder():
    return MergeCoder(MODEL)


def test_odd_texts(coder):
    for text, ids in zip(ODD, coder.encode(ODD)):
        assert ids == LIB.encode(text), repr(text[:40])


def test_random_texts(coder):
    rng = random.Random(11)
    letters = "aaeiou thnrsl  \n.,XY09éß東" + MARK
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids == LIB.encode(text), repr(text)


def test_operator(spark):
    rows = [(k, ODD[k % len(ODD)], 1, "x") for k in range(60)] + [(None, "no id", None, None), (4, None, 2, ""), (4, None, 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t, _, _ in rows:
        ids = LIB.encode(t or "")
        want.append((k is None, k or 0, len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids))))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest_pieces(docs, MODEL).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(len(r.ids) for r in encode_pieces(docs, MODEL).collect()) == sorted(w[2] for w in want)
    assert digest_pieces(docs.limit(0), MODEL).collect() == []
