import random

import numpy as np

from rankloom.llm import leakage as L

rng = random.Random(8)
WORDS = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
ITEM = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(5)]
FILL = [" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(8)]


def _found(spark, docs, items=ITEM):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, kind int")
    return {(r.doc_id, r.item_id) for r in L.leaked(L.find_leaks(d, b)).collect()}


def test_runs_edits_and_near_misses(spark):
    w = ITEM[0].split()
    eleven, twelve = " ".join(w[5:16]), " ".join(w[5:17])
    edited = [x for n, x in enumerate(w) if n % 6]
    edited[20] = "differentword"
    far = " ".join(x + (" " + FILL[n % 8] if n % 9 == 8 else "") for n, x in enumerate(w))
    docs = [FILL[0] + " " + twelve + " " + FILL[1], FILL[0] + " " + eleven + " " + FILL[1], FILL[2] + "\n" + " ".join(edited) + "\n" + FILL[3], " ".join(reversed(w)), far, None, "", ITEM[1] + " " + ITEM[2], " ".join(w[:30]).upper()]
    assert _found(spark, docs) == {(0, 0), (2, 0), (7, 1), (7, 2), (8, 0)}


def test_disguises(spark):
    item = "Après l'été, Zoé Müller cited clause AB-12 & paid 1,234 crowns to the Größe office before noon on Friday, then left for good without any further notice to us"
    accents = item.replace("é", "e").replace("è", "e").replace("ü", "u").replace("ö", "o").replace("ß", "ss")
    tags = " ".join(f'<span class="hl">{w}</span>' if n % 2 else w for n, w in enumerate(item.replace("&", "&amp;").split()))
    links = " ".join(f"[{w}](/kb/ref)" if n % 4 == 0 else w for n, w in enumerate(item.split()))
    escaped = item.encode("ascii", "backslashreplace").decode().replace("\\xe", "\\u00e").replace("\\xf", "\\u00f").replace("\\xd", "\\u00d")
    quoted = "\n".join(f"> {n}: " + " ".join(item.split()[n * 5 : n * 5 + 5]) for n in range(7))
    numbered = "\n".join(f"{n}: " + " ".join(item.split()[n * 5 : n * 5 + 5]) for n in range(7))
    spaced = item.replace(" ", "\u00a0 ").upper()
    docs = [accents, tags, links, escaped, quoted, numbered, spaced, f"**{item}**"]
    assert _found(spark, docs, [item]) == {(i, 0) for i in range(8)}


def test_items_in_several_passes_and_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM[0]), (2, ITEM[4]), (2, ITEM[4])], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(ITEM)) + [(9, None), (10, "too short"), (0, ITEM[0])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked(L.find_leaks(d, b, items_a_pass=2)).collect()} == {(1, 0), (2, 4)}
    assert L.find_leaks(d, b.limit(0)).collect() == [] and L.find_leaks(d.limit(0), b).collect() == []


def test_longest_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 30)), r.integers(0, 6, r.integers(1, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert L.in_order(a, b) == t[-1, -1]


def test_passages_with_words_put_in_between(spark):
    spaced = [" ".join(x + (" foreign" + str(n) if n % 3 == 2 else "") for n, x in enumerate(i.split())) for i in ITEM[:3]]
    thin = " ".join(x + (" foreign" + str(n) if n % 2 else "") for n, x in enumerate(x for n, x in enumerate(ITEM[3].split()) if n % 5))
    wide = " ".join(x + " foreign" for x in ITEM[4].split())
    docs = [spaced[0], (FILL[0] + " ") * 7 + spaced[1] + " " + FILL[1] * 5, "x " * 127 + spaced[2], thin, wide]
    assert _found(spark, docs) == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_passages_equal_brute_force():
    r = np.random.default_rng(5)
    names = [f"w{i}" for i in range(60)]
    items = [[names[k] for k in r.integers(0, 60, n)] for n in (4, 7, 20, 33, 64, 90)]
    index = L.Index(list(range(len(items))), items)
    docs = []
    for _ in range(60):
        i = items[int(r.integers(0, len(items)))]
        kept = [x for x in i if r.random() > r.choice([0.1, 0.2, 0.25])]
        mixed = [y for x in kept for y in ([x, "other"] if r.random() < r.choice([0.1, 0.3, 0.5]) else [x])]
        docs.append(["a"] * int(r.integers(0, 200)) + mixed + [names[k] for k in r.integers(0, 60, int(r.integers(0, 200)))])
    coded = [np.array([index.vocabulary.get(x, index.size - 1) for x in d], np.int64) for d in docs]
    found = 0
    for w, stretches in zip(coded, index.stretches(coded)):
        got = {i for i, _, _ in L.leaks(w, index, stretches)}
        run = {i for i, x in enumerate(index.words) if any((w[a : a + L.RUN] == x[b : b + L.RUN]).all() for a in range(len(w) - L.RUN + 1) for b in range(len(x) - L.RUN + 1))}
        brute = {i for i, x in enumerate(index.words) if any(L.in_order(x, w[s : s + int(len(x) * L.PASSAGE)]) * 5 >= 4 * len(x) for s in range(len(w)))}
        assert got == run | brute
        found += len(brute - run)
    assert found > 10
