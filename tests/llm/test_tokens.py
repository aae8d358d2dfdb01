import random

import pytest

from quillrock.llm.queries import TOKENIZERS
from quillrock.llm.tokens import BYTE_BPE_PATTERN, _encoder, _forced, _ranks, cuts, encode_corpus, encode_text, fragments

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("least", [1, 7, 64])
def test_fragments_equal_whole(least):
    r = random.Random(least)
    whole = _encoder(PATH, BYTE_BPE_PATTERN)
    for alphabet in (" \n\t\r\x0b  ab's.,!é中1​", "the cat's 12 hats, <|endoftext|> \n\n"):
        for _ in range(2000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 200)))
            ids = encode_text(t, PATH, BYTE_BPE_PATTERN, least)
            assert ids == whole.encode_ordinary(t) and whole.decode(ids) == t


def test_pairs_stand_in_no_token():
    forced = _forced(PATH)
    assert not any(forced[t[i], t[i + 1]] for t in _ranks(PATH) for i in range(len(t) - 1))
    assert forced.any()


def test_chinese_and_mixed_texts_are_cut():
    """Runs of letters without a blank, and texts on both sides of the least size."""
    whole = _encoder(PATH, BYTE_BPE_PATTERN)
    r = random.Random(8)
    for size in (10, 511, 512, 513, 5_000):
        t = "".join(chr(r.randrange(0x4E00, 0xA000)) for _ in range(size))
        for text in (t, f"it's {t}'s 12{t}34 {t}", "x" + t + "\u3000" + t):
            assert encode_text(text, PATH, BYTE_BPE_PATTERN, 64) == whole.encode_ordinary(text)
            assert "".join(fragments(text, PATH, 64)) == text
    assert len(fragments(t, PATH, 64)) > 20 and len(cuts(t.encode(), _forced(PATH))) > 100


def test_operator(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hello <|endoftext|>", 9), (3, "Hello <|endoftext|>", 9), (4, "ab " * 100_000, 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(docs, PATH, BYTE_BPE_PATTERN).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and 50256 not in got[2][1] and got[4][1] == _encoder(PATH, BYTE_BPE_PATTERN).encode_ordinary("ab " * 100_000)
    assert encode_corpus(docs.limit(0), PATH, BYTE_BPE_PATTERN).count() == 0
