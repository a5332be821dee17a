import random

from hypothesis import given, settings, strategies as st

from rankloom.llm import splitting as S
from rankloom.sources.records import strip_blank


def _check(body, limit=20, overlap=4):
    pieces = S.Cutter(body, limit, overlap).pieces()
    covered = 0
    for n, (a, b) in enumerate(pieces):
        assert 0 < b - a <= limit * 4
        if n:
            assert a > pieces[n - 1][0] and covered - a <= overlap * 4
            assert not strip_blank(body[covered:a])
        covered = b
    assert not strip_blank(body[covered:] if pieces else body)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n!\u00a0\u200b漢😀", max_size=700))
def test_pieces_cover_the_body_within_the_limit(body):
    _check(body)


def test_cuts_fall_between_paragraphs_then_sentences():
    p = "One two three four five six. " * 2
    pieces = _check("\n\n".join([p.strip()] * 6), 20, 4)
    assert all(b == len("\n\n".join([p.strip()] * 6)) or "\n\n".join([p.strip()] * 6)[b - 1] == "." for _, b in pieces)


def test_without_boundaries_the_cut_is_hard():
    assert _check("x" * 200, 20, 4)[0] == (0, 80)


def test_sections_headings_and_fences():
    text = "intro\n# A\n\n body one \n## B\ntext\n```py\n# no heading\n```\n#### D\r\nlast\r\n#nohead\n####### seven\n"
    got = [(s.path, text[s.start : s.end]) for s in S.sections(text)]
    assert got == [([], "intro"), (["A"], "body one"), (["A", "B"], "text\n```py\n# no heading\n```"), (["A", "B", "", "D"], "last\r\n#nohead\n####### seven")]
    longer = "````\n```\n# x\n````\n# Y\nz"
    assert [s.path for s in S.sections(longer)] == [[], ["Y"]]
    assert [s.path for s in S.sections("~~~\n# x\n")] == [[]]


def test_oversized_sections_of_a_table(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["claim", "policy.", "desk"]) for _ in range(n))
    long = f"# T\n\n  {words(400)}\n## U\nshort"
    exact = "# T\n" + "y" * 1040
    rows = [("a", long, 1), ("a", long, 1), ("b", exact, 1), ("c", exact + "y", 1), ("d", None, 1), ("e", "", 1), ("f", " \u200b\u00a0 ", 1), (None, long, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, char_start int")
    got = {(r.doc_id, r.char_start) for r in S.oversized(S.split(df)).collect()}
    assert got == {("a", 7), ("c", 4), (None, 7)}
    assert S.split(df.limit(0)).collect() == []
    assert max(r.char_end - r.char_start for r in S.split(df).collect()) <= 1040


def test_long_runs_of_blanks_take_linear_time():
    import time

    began = time.time()
    text = "word" + " " * 200_000 + "word" + "\n" * 200_000
    assert all(b - a <= 1040 for s in S.sections(text) for a, b in S.Cutter(text[s.start : s.end]).pieces())
    assert time.time() - began < 5
