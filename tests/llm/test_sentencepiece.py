import random

import public_tokenizers
import pytest

from jsonloom.llm.sentencepiece_codec import codec, digests, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts_match_the_library(library):
    rng = random.Random(5)
    letters = [*" ▁\n\taebcdé😀中ñ<>0x\x00ﬁ1.", "the", "  ", "     ", "</s>", "<s>", "<0x0A>", "ing ", "zz"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "the " * 3000, " " * 300, "ab\n\n" * 50]
    c = codec(MODEL)
    got = c.encode(texts)
    assert got == library.encode(texts)
    assert [c.decode(x) for x in got] == [library.decode(x) for x in got]


def test_random_ids_decode_like_the_library(library):
    rng = random.Random(6)
    c = codec(MODEL)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 260), rng.randrange(260, 32000)]) for _ in range(6)]
        assert c.decode(ids) == library.decode(ids)


def test_rows(frame, library):
    import hashlib

    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "long " * 20000)]
    df = frame([(*r, None, None, None) for r in rows])
    got = sorted(digests(df, MODEL).collect(), key=str)
    assert len(got) == 6
    by = {r.id: r for r in got}
    ids = library.encode("long " * 20000)
    assert by[4].n_tokens == len(ids)
    assert by[4].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert by[2].n_tokens == by[3].n_tokens == 0
    assert by[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.id: r for r in encode_decode(df, MODEL).collect()}
    assert out[1].decoded == "a b" and out[1].ids == library.encode("a b")
    assert digests(df.limit(0), MODEL).count() == 0
