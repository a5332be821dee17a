import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators import chunking as C
from rankloom.sources import corpus, datasets as D, store


def _files(spark, *texts):
    return spark.createDataFrame([(f"f{n}", t) for n, t in enumerate(texts)], "path string, text string")


def _csv_slow(text):
    """A reader that goes by character."""
    rows, row, field, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field += '"'
                i += 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"':
            quoted = True
        elif c == ",":
            row.append(field)
            field = ""
        elif c == "\n":
            rows.append([*row, field])
            row, field = [], ""
        elif c != "\r":
            field += c
        i += 1
    return [*rows, [*row, field]] if field or row else rows


@pytest.mark.parametrize("text", ['a,"say ""hi""",c', "a,b\r\nc,d\r\n", '"x\ny",z', "", ",", 'a"b"c,d', '"open,\nend', '""""', '"",""\n""', 'a,"b"" c"\n\n,"'])
def test_csv_rows(text):
    assert D.csv_rows(text) == _csv_slow(text)


def test_formats_and_reasons(spark):
    rows = [{"question": "Q1", "reference_answer": "A1", "keywords": ["k1", " k2 "], "category": "Multi-Hop"}, {"query": "Q2", "answer": 5, "type": "factual"}, 7, {"prompt": "Q3"}]
    messy = '{"Question": "a", "Ground-Truth": "b", "question_type": "bespoke-label"}\n\n{"question": ""}\nnot json\n[1]\n'
    csv = 'Question,reference answer,keywords\r\n"a, b","say ""hi""",x;y|z\r\n , ,\r\nonly,,\r\nshort\r\n'
    got = D.parse_files(_files(spark, json.dumps(rows), messy, csv, "  ", "free text")).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append((r.line, r.question, r.reference_answer, r.question_type if not r.reason else None, (r.reason or "")[:11]))
    assert by["f0"] == [(1, "Q1", "A1", "multi_hop", ""), (2, "Q2", "5", "direct_fact", ""), (3, None, None, None, "not an obje"), (4, "Q3", None, None, "no referenc")]
    assert by["f1"] == [(1, "a", "b", "other", ""), (3, None, None, None, "no question"), (4, None, None, None, "not valid J"), (5, None, None, None, "not an obje")]
    assert by["f2"] == [(2, "a, b", 'say "hi"', "other", ""), (4, "only", None, None, "no referenc"), (5, "short", None, None, "no referenc")]
    assert "f3" not in by and by["f4"][0][4] == "not valid J"
    first = [r for r in got if r.path == "f0" and not r.reason][0]
    assert first.expected_keywords == ["k1", "k2"] and [r for r in got if r.path == "f2"][0].expected_keywords == ["x", "y", "z"]


def test_accepted_ids_and_limit(spark):
    lines = "\n".join(json.dumps({"question": f"q{i}", "answer": "a"} | ({"id": "own"} if i == 1 else {})) for i in range(150))
    ok = D.accepted(D.parse_files(_files(spark, lines))).orderBy("pos").collect()
    assert len(ok) == 100 and ok[0].truncated and [r.id for r in ok[:3]] == ["q1", "own", "q3"]
    assert D.accepted(D.parse_files(_files(spark))).collect() == []


def test_question_types_lists_and_keys(spark):
    df = spark.createDataFrame([("Multi-Hop", '["a", " b "]'), ("factual", "x; y,z|"), (" what is ", "[broken"), (None, None), ("", "")], "t string, k string")
    got = [(r.a, r.b) for r in df.select(D.question_type(F.col("t")).alias("a"), D.string_array(F.col("k")).alias("b")).collect()]
    assert got == [("multi_hop", ["a", "b"]), ("direct_fact", ["x", "y", "z"]), ("definition", ["[broken"]), ("other", None), ("other", [])]
    m = spark.createDataFrame([({"Ques tion": "", "QUERY": "a", "que-ry": "b"},)], "m map<string,string>")
    assert m.select(D.pick(D.normal_keys(F.col("m")), ["question", "query"]).alias("x")).first().x in ("a", "b")
    assert spark.range(1).select(D.align_naming(F.lit("ACME Acme acme"), "acme", "bolt").alias("x")).first().x == "BOLT Bolt bolt"


def test_stratified_and_round_robin(spark):
    rows = [(f"i{n}", n, "a" if n % 3 else "b") for n in range(12)] + [("c0", 12, "c")]
    df = spark.createDataFrame(rows, "id string, pos int, question_type string")
    got = [(r.id, r.question_type) for r in D.stratified(df, 5).collect()]
    assert sorted(t for _, t in got) == ["a", "a", "b", "b", "c"]
    assert D.stratified(df, 50).count() == 13


def test_generated(spark):
    rows = [(1, "Q one?", "A", ["k1", "x", "k2"], "c1"), (2, " q  ONE? ", "B", ["kk"], "c2"), (3, "", "B", ["kk"], "c"), (4, "Q2", "B", ["x"], "c"), (5, "Q3", None, ["kk"], "c"), (6, "Q4", "B", ["k1", "k2", "k3", "k4", "k5", "k6"], "c6")]
    got = D.generated(spark.createDataFrame(rows, "seq int, question string, answer string, keywords array<string>, source string"), 5).collect()
    assert [(r.id, r.question, r.keywords, r.gold_chunk_ids) for r in got] == [("gen-1", "Q one?", ["k1", "k2"], ["c1"]), ("gen-2", "Q4", ["k1", "k2", "k3", "k4", "k5"], ["c6"])]


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "ä b.md").write_text("# x\n")
    (tmp_path / "top.TXT").write_text("text")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "skip.pdf").write_text("no")
    got = {(r.title, r.category, r.text) for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert got == {("sub dir/ä b.md", "sub dir", "# x\n"), ("top.TXT", "root", "text")}
    assert all(r.id.startswith("kb_") and len(r.id) == 15 for r in corpus.scan(spark, str(tmp_path)).collect())
    (tmp_path / "q.jsonl").write_text('{"question": "q", "reference_answer": "a", "keywords": ["k"], "category": "lookup"}\n\n{"question": "r"}\n')
    assert [(r.id, r.question_type) for r in D.read_shipped(spark, str(tmp_path / "q.jsonl")).collect()] == [("default-1", "direct_fact"), ("default-3", "other")]
    assert D.accepted(D.read_files(spark, str(tmp_path / "q.jsonl"))).count() == 1


def test_uploads(spark):
    text = "word " * 120
    rows = corpus.uploaded(spark.createDataFrame([("a", text), ("b", "short"), ("c", None), ("d", "y" * 240_010)], "title string, text string")).collect()
    assert [r.problem is None for r in rows] == [True, False, False, True] and rows[3].notice and len(rows[3].text) == 240_000 and rows[0].id.startswith("up_") and rows[0].id != rows[3].id
    assert corpus.pasted(spark, "p", text).first().title == "p.txt"
    files = spark.createDataFrame([("a.PDF", 10), ("b.exe", 10), ("c.md", 2_000_000), ("d.txt", 5)], "name string, bytes long")
    assert [r.problem for r in corpus.gate(files).collect()] == [None, "unsupported type", "too large", None]
    got = corpus.extract(spark.createDataFrame([("a.txt", bytearray("é".encode())), ("b.pdf", bytearray(b"x")), ("c.zip", bytearray(b"x"))], "name string, content binary")).collect()
    assert got[0].text == "é" and got[1].problem and got[2].problem == "unsupported type"


def test_fixed_windows(spark):
    text = "a" * 640 + " " * 800 + "b" * 300
    rows = C.fixed(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  "), (5, "short")], "doc_id int, text string")).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.char_start, r.char_end, len(r.text)) for r in rows] == [(1, 0, 0, 800, 640), (1, 2, 1280, 1740, 300), (5, 0, 0, 5, 5)]


def test_structural_chunks(spark):
    doc = "# Name\n\nintro text.\n\n## Skills\n" + "\n\n".join(f"Paragraph {i} " + "word " * 60 + "end." for i in range(8)) + "\n\n## Long\n" + "x" * 3000
    pieces = C.structural_pieces(doc)
    assert pieces[0][0] == ["Name"] and {tuple(p[0]) for p in pieces} == {("Name",), ("Name", "Skills"), ("Name", "Long")}
    assert all(len(p[3]) <= 1040 + 162 for p in pieces) and max(len(p[3]) for p in pieces if p[0][-1] == "Long") == 1040
    got = C.structural(spark.createDataFrame([(1, doc), (2, None), (3, " "), (4, "plain")], "doc_id int, text string")).collect()
    assert len({r.chunk_id for r in got}) == len(got) and {r.doc_id for r in got} == {"1", "4"} and got[-1].heading_path == []
    c = C.contextual(spark.createDataFrame([(1, doc, "a/b.md", "cat")], "doc_id int, text string, title string, category string")).orderBy("ordinal").first()
    assert c.embed_text.startswith("[Context: cat > a/b > Name]\n")


CH = "strategy string, chunk_id string, doc_id string, ordinal int, text string, embed_text string, context_header string, embedding array<float>"


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("a", "c1", "d", 0, "t", "e", None, [1.0]), ("a", "c2", "d", 1, "t", "e", None, None), ("b", "c1", "d", 0, "t", "e", None, [2.0])]
    store.upsert_chunks(path, spark.createDataFrame(rows, CH))
    store.upsert_chunks(path, spark.createDataFrame([("a", "c1", "other", 9, "new text", "e2", "h", [3.0]), ("a", "c3", "d", 2, "t", "e", None, None)], CH))
    got = {(r.strategy, r.chunk_id): (r.doc_id, r.text, r.embed_text, r.embedding) for r in spark.read.parquet(path).collect()}
    assert got[("a", "c1")] == ("d", "t", "e2", [3.0]) and got[("b", "c1")][3] == [2.0] and set(got) == {("a", "c1"), ("a", "c2"), ("a", "c3"), ("b", "c1")}
    assert [r.chunk_id for r in store.read_chunks(spark, path, "a").collect()] == ["c1", "c2", "c3"]
    assert {(r.strategy, r.chunks, r.embedded) for r in store.coverage(spark.read.parquet(path)).collect()} == {("a", 3, 1), ("b", 1, 1)}
    base = spark.createDataFrame(rows, CH).drop("strategy")
    assert store.seed(spark, path, {"a": lambda: base, "z": lambda: base}) == ["z"]
    store.clear(spark, path, "b")
    assert {r.strategy for r in spark.read.parquet(path).select("strategy").distinct().collect()} == {"a", "z"}
    store.write_one(str(tmp_path / "m"), spark.createDataFrame([("f1",)], "fingerprint string"))
    assert store.is_stale(spark.read.parquet(str(tmp_path / "m")), spark.createDataFrame([("f2",)], "fingerprint string")).first().stale


def test_migrations(spark):
    files = spark.createDataFrame([(1, "a\r\nb"), (2, "x"), (3, "y")], "version int, sql string")
    done = files.where("version < 3").select("version", store.checksum(F.when(F.col("version") == 1, "a\nb").otherwise("changed")).alias("checksum")).union(spark.createDataFrame([(9, "z")], "version int, checksum string"))
    assert {(r.version, r.state) for r in store.migration_states(files, done).collect()} == {(1, "applied"), (2, "modified"), (3, "pending"), (9, "missing")}
