import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T, vectors as V
from rankloom.operators import chunking as C


def _one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<float>' if isinstance(v, list) and v and isinstance(v[0], float) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("word, want", [("contracts", "contract"), ("policies", "policy"), ("ss", "ss"), ("is", "is"), ("bolt's", "bolt"), ("boxes", "box"), ("glasses", "glasse"), ("running", "runn"), ("king", "king"), ("renewed", "renew"), ("red", "red"), ("", "")])
def test_stem(spark, word, want):
    assert _one(spark, T.stem(F.col("w")), w=word) == want
    assert _one(spark, T.stem_all(F.array("w")), w=word) == [want]


def test_tokens(spark):
    assert _one(spark, T.content_tokens(F.col("t")), t="The quick brown fox and a dog") == ["quick", "brown", "fox", "dog"]
    assert _one(spark, T.tokenize(F.col("t")), t="Éa-b  c's, ¿D? e") == ["éa-b", "c's", "d", "e"]
    assert _one(spark, T.tokenize(F.col("t")), t="") == []
    assert [_one(spark, T.estimate_tokens(F.col("t")), t=t) for t in ("", "a", "abcd", "abcde", "😀😀😀😀")] == [0, 1, 1, 2, 1]


@pytest.mark.parametrize(
    "keyword, text, want",
    [("2015", "in 2015000", False), ("2015", "in (2015).", True), ("2015", "2015-06-01", True), ("Avery Lancaster", "by Lancaster, Avery", True), ("Avery Lancaster", "Lancaster " + "x " * 30 + "Avery", False), ("contracts", "a contract", True), ("IQ", "IQTest", False), ("", "x", False), ("x", "", False), ("a\\Eb", "a eb", True), ("“Quote”", "the quote", True)],
)
def test_keyword_present(spark, keyword, text, want):
    assert _one(spark, T.keyword_present(F.col("k"), F.col("t")), k=keyword, t=text) is want


def test_sentences_match_the_sequential_ones(spark):
    rng = random.Random(1)
    parts = ["Dr. Lee came.", "He paid Inc. fees e.g. two", "No. 5 is it?", "\n\n", "(Yes!)", "what. now", "U.S. law.", '"Quoted."', "end"]
    for _ in range(40):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert _one(spark, T.split_sentences(F.col("t")), t=t) == C.sentences(t)


def test_cleaning_and_trimming(spark):
    assert _one(spark, T.clean_extracted(F.col("t")), t="a\r\nb ​c  d \n\n\n\ne﻿ ") == "a\nb c d\n\ne"
    assert _one(spark, T.trim_to_chars(F.col("t"), 20), t="One two three. Four five six.") == "One two three. Four f"[:20].strip()
    assert _one(spark, T.trim_to_chars(F.col("t"), 20), t="One two three four. Five") == "One two three four"
    assert _one(spark, T.trim_to_chars(F.col("t"), 50), t="short") == "short"
    assert _one(spark, T.context_header(F.col("c"), F.lit("a/b.md"), F.array(F.lit("H"), F.lit(""))), c="uploaded") == "[Context: a/b > H]\n"


def test_json_salvage(spark):
    get = lambda t: _one(spark, F.try_variant_get(T.salvage_json(F.col("t")), "$.k", "int"), t=t)
    assert [get(t) for t in ('{"k": 1}', 'so: {"k": 2} ok', "none", "{bad}", "")] == [1, 2, None, None, None]


def test_formatters(spark):
    f = lambda fn, v: _one(spark, fn(F.col("v")), v=float(v))
    assert [f(T.format_tokens, v) for v in (7, 1500, 2.5e6)] == ["7", "1.5k", "2.5M"]
    assert [f(T.format_duration, v) for v in (12, 1500, 61000)] == ["12 ms", "1.50 s", "1m 1s"]
    assert [f(T.format_cost, v) for v in (0, 0.0001, 0.005, 0.5, 2)] == ["$0", "$0.000100", "$0.00500", "$0.5000", "$2.00"]
    assert [f(T.format_bytes, v) for v in (5, 2048, 3 * 1048576)] == ["5 B", "2 KB", "3.0 MB"]
    assert f(T.format_score, float("nan")) == "—" and f(T.format_percent, 0.5) == "50%" and f(T.format_delta, 0.125) == "+12.5%"


def test_vectors(spark):
    assert abs(_one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - math.sqrt(0.5)) < 1e-6
    assert _one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert _one(spark, V.l2_normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert _one(spark, V.reference_similarity(F.col("a"), F.col("b")), a=[1.0], b=[-1.0]) == 0.0
    assert _one(spark, V.parse_vector(F.lit("[0.5,-1.5]")), a="x") == [0.5, -1.5]
    assert [_one(spark, V.clamp_weight(F.col("v")), v=v) for v in (0.0, 50.0, float("nan"), float("inf"))] == [1.0, 10.0, 5.0, 5.0]


def test_hash_id_is_stable_and_short():
    a, b = C.hash_id("some text"), C.hash_id("some texts")
    assert a != b and a == C.hash_id("some text") and re.fullmatch(r"[0-9a-z]{4,10}", a) and C.hash_id("")
