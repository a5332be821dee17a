import pytest

from rankloom.sources import records as R


@pytest.mark.parametrize(
    "record, fields",
    [('a,"b ""x"", c",', ["a", 'b "x", c', ""]), ('a,b "x",c', None), ('"a"x,b', None), ("", [""]), ("a\r", ["a"]), ('"a\nb",c\r\n', ["a\nb", "c"]), ("a\nb,c", None), ('"abc', None), ('a,"",b', ["a", "", "b"]), (",,", ["", "", ""]), ('a, "b"', None), ('"a",', ["a", ""]), ('\\"a\\"', None)],
)
def test_csv_fields(record, fields):
    assert R.csv_fields(record) == fields


@pytest.mark.parametrize("record, fine", [('{"a": 1}', True), ('{"a": NaN}', False), ("{'a': 1}", False), ('{"a": 1,}', False), ('{"a": 1} x', False), ("[1]", False), ("null", False), ('{"a": 1e400}', True), ("{" * 100_000, False), ('{"a": "x\ny"}', False)])
def test_json_object(record, fine):
    assert (R.json_object(record) is not None) == fine


def _parsed(spark, rows, uploads):
    r = spark.createDataFrame(rows, "row_id long, upload_id string, raw_line string, reason string, fmt string")
    u = spark.createDataFrame(uploads, "upload_id string, fmt string, header_line string, row_id long")
    return R.parse_records(r, u)


UPLOADS = [("c", "csv", "Question,Reference Answer,difficulty,asked_on", 1), ("j", "jsonl", None, 2), ("empty", "csv", None, 3)]
J = '{"query": "q", "gold_answer": "a"%s}'


def test_reasons(spark):
    cases = [
        ("c", "q,a,1,2024-02-29", None), ("c", "q,a,,", None), ("c", '"q, x","a ""b""",5,2023-01-01\r', None), ("c", "q,a,1", "column_count"), ("c", "q,a,1,2024-01-01,x", "column_count"), ("c", 'q,"a,1,2024-01-01', "broken_quoting"), ("c", 'q,a "b",1', "broken_quoting"),
        ("c", " ,a,9,x", "no_question"), ("c", "q,​,9,x", "no_answer"), ("c", "q,a,0,", "invalid_value"), ("c", "q,a,6,", "invalid_value"), ("c", "q,a,3.5,", "invalid_value"), ("c", "q,a,three,", "invalid_value"), ("c", "q,a,3,2023-02-29", "invalid_value"), ("c", "q,a,3,20240101", "invalid_value"),
        ("j", "  " + J % "" + " ", None), ("j", J % ', "Difficulty": "4", "asked-on": "2024-12-31"', None), ("j", J % ', "difficulty": null, "asked_on": ""', None), ("j", J % ', "difficulty": true', "invalid_value"), ("j", J % ', "difficulty": [1]', "invalid_value"), ("j", J % ', "asked_on": "2024-13-01"', "invalid_value"),
        ("j", "[]", "not_json"), ("j", '{"question": "", "prompt": "p", "answer": 5}', None), ("j", '{"question": ["x"], "answer": "a"}', "no_question"), ("j", '{"question": "q", "answer": null}', "no_answer"), ("j", '{"question": "q"}', "no_answer"), ("lost", J % "", None), ("empty", "q", "no_question"),
    ]
    blanks = [("c", None), ("c", ""), ("j", " \t ​\r")]
    rows = [(i, u, t, "x", "x") for i, (u, t, _) in enumerate(cases)] + [(100 + i, u, t, "x", None) for i, (u, t) in enumerate(blanks)]
    parsed = _parsed(spark, rows, UPLOADS)
    got = {r.row_id: r.reason for r in parsed.collect()}
    assert got == {i: why for i, (*_, why) in enumerate(cases)}
    assert {(r.row_id, r.reason) for r in R.skipped(parsed).collect()} == {(i, w) for i, w in got.items() if w}
    good = {r.row_id: r for r in R.loaded(parsed).collect()}
    assert set(good) == {i for i, w in got.items() if not w} and good[0].difficulty == 1 and str(good[0].asked_on) == "2024-02-29" and good[2].reference_answer == 'a "b"' and good[1].difficulty is None


def test_repeated_rows_and_empty_tables(spark):
    parsed = _parsed(spark, [(1, "c", "q,a,9,", None, None)] * 2, [*UPLOADS, UPLOADS[0]])
    assert parsed.count() == 2 and R.skipped(parsed).count() == 1
    none = _parsed(spark, [], UPLOADS)
    assert R.skipped(none).collect() == [] and R.loaded(none).collect() == []
    assert R.skipped(_parsed(spark, [(1, "c", "x", None, None)], [])).collect()[0].reason == "not_json"
    long = "q," + "a" * 2_000_000 + ",1,"
    assert R.skipped(_parsed(spark, [(1, "c", long, None, None)], UPLOADS)).collect() == []


def test_hot_values(spark):
    rows = [(i, "c", "q,a,bad," if i % 3 == 0 else "q,a,3,", None, None) for i in range(3000)]
    assert R.skipped(_parsed(spark, rows, UPLOADS)).count() == 1000
