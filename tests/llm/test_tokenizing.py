import random

import pytest
from hypothesis import given, settings, strategies as st

from rankloom.llm import tokenizing as K


def _joined(text, mean):
    enc = K.encoder()
    ids = []
    for piece, start, end, extra in K.plan(text.encode(), enc, mean):
        own = enc.encode_ordinary(piece.decode())
        ids += own[start : len(own) - end] + extra
    return ids


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab'st 1_.,\n\té漢😀\u00a0-", max_size=1500), st.sampled_from([8, 32, 128]))
def test_pieces_join_to_the_ids_of_the_whole(text, mean):
    assert _joined(text, mean) == K.encoder().encode_ordinary(text)


def test_joins_without_near_blank_are_repaired():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh0123456789") for _ in range(rng.randint(60, 200))) for _ in range(60))
    plan = K.plan(text.encode(), K.encoder(), 64)
    assert any(extra for *_, extra in plan)
    assert _joined(text, 64) == K.encoder().encode_ordinary(text)


def test_shared_passages_give_shared_pieces():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = words(2000)
    a, b = ({p for p, *_ in K.plan((words(30) + " " + shared + " " + words(30)).encode(), K.encoder(), 512)} for _ in range(2))
    assert len(a & b) >= 0.7 * len(a)


def test_corpus(spark):
    pytest.importorskip("tiktoken")
    long = "policy claim desk " * 30_000
    rows = [(1, None, 0), (2, "", 0), (3, "  \n", 0), (4, "<|endoftext|> text", 0), (5, long, 0), (6, long + "end", 0), (7, "漢字" * 4000, 0), (8, "x", 0), (8, "x", 1)]
    got = {r.doc_id: r.ids for r in K.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()}
    enc = K.encoder()
    assert got == {i: enc.encode_ordinary(t or "") for i, t, _ in rows}
    assert got[1] == got[2] == [] and got[3]
    assert K.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{K.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Hello  world 123's", "añb\u00a0c\n\n x", "<|endoftext|>", "😀" * 9):
        assert K.encoder().encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_two_texts_under_one_id(spark):
    a, b = "first text " * 300, "another one " * 200
    got = sorted((list(r.ids) for r in K.encode_corpus(spark.createDataFrame([(1, a), (1, b), (1, a)], "doc_id long, text string")).collect()), key=len)
    assert got == sorted((K.encoder().encode_ordinary(t) for t in (a, b)), key=len)
