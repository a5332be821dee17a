import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from rankloom.llm import repetition as R

rng = random.Random(6)
fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def _slow(text):
    w = re.findall(r"[^\W_]+", text.lower())
    seen, mask = set(), [False] * len(w)
    for i in range(len(w) - 5):
        g = tuple(w[i : i + 6])
        if g in seen:
            mask[i : i + 6] = [True] * 6
        seen.add(g)
    return len(w), sum(mask)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_mask_against_brute_force(texts):
    ids = np.array([w for t in texts for w in t], np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = R.repeated_mask(ids, of)
    want = sum(_slow(" ".join(f"w{x}" for x in t))[1] for t in texts)
    assert got.sum() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_runs_of_four_bound_the_share(words):
    text = " ".join(f"w{x}" for x in words)
    n, repeated = _slow(text)
    assert repeated <= R.bound(n, R._different(text.split())) * n + 1e-9


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "EN", s, 1) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, share int")


def test_found_is_exact_in_clean_and_in_spam_sources(spark):
    half = fresh(40)
    rows = [(fresh(80), "clean") for _ in range(120)] + [(half + " " + half, "clean"), (half + ". " + fresh(60) + " " + half, "clean")]
    rows += [(" ".join([fresh(8)] * 12), "spam") for _ in range(110)] + [(fresh(50), "spam") for _ in range(10)]
    rows += [(None, "clean"), ("", "spam"), ("a b c", None), (fresh(10) * 1, None), ("word " * 19, "x"), ("word " * 20, "x"), ("word " * 50_000, "x")]
    want = {i for i, (t, _) in enumerate(rows) if (n := _slow(t or ""))[0] >= 20 and n[1] >= 0.25 * n[0]}
    docs = _docs(spark, rows)
    scored = R.outliers(docs)
    assert {r.doc_id for r in R.repetitive(docs, scored).collect()} == want
    d = {r.doc_id: r for r in scored.collect()}
    assert d[120].rejected and not d[3].rejected and not any(d[i].rejected for i in range(130, 140)) and d[130].suspect


def test_shares_of_null_empty_and_repeated_rows(spark):
    df = _docs(spark, [(None, "a"), ("", "a"), (fresh(30), "a"), (fresh(30), "a")])
    got = sorted((r.doc_id, r.words, r.share) for r in R.measure(df.union(df)).collect())
    assert got[0] == got[1] == (0, 0, 0.0) and len(got) == 8 and got[-1][1] == 30


def test_empty_table(spark):
    df = _docs(spark, [("x", "a")]).limit(0)
    assert R.repetitive(df, R.outliers(df)).collect() == [] and R.measure(df).collect() == []
