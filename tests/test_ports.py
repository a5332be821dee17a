"""Ports that models stand behind, and what is written step by step: extraction, verdicts, embeddings, reports, migrations, broken files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom.operators import graph as G, models as P
from rankloom.sources import corpus, datasets as D, store


def test_embedding_goes_in_batches_and_is_normalised(spark):
    def port(texts, dimensions):
        assert len(texts) <= P.BATCH
        return [[float(len(t)), float(len(texts))] + [0.0] * (dimensions - 2) for t in texts]

    got = P.embed(spark.createDataFrame([(i, "x" * i if i else None) for i in range(200)], "id long, text string").coalesce(1), port=port).collect()
    assert len(got) == 200 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got)
    assert P.embed(spark.createDataFrame([], "text string")).collect() == []


def test_a_verdict_is_asked_for_twice(spark):
    def port(payload):
        return json.dumps({"verdict": "pass"}) if payload["n"] == 0 or payload["n"] == 1 and payload.get("terse") else "well, ..."

    asked = spark.createDataFrame([(str(n), json.dumps({"n": n})) for n in range(3)], "key string, payload string")
    got = {r.key: (r.reply, r.error) for r in P.ask(asked, P.judging(port)).collect()}
    assert got["0"][0] == got["1"][0] == '{"verdict": "pass"}' and got["2"][0] is None and "no valid verdict" in got["2"][1]


def test_extraction_by_calls_of_three_units(spark):
    texts = ["Maria Keller joined Apex Cover. Apex Cover grew.", None, "The office is in New Haven.", "bad", "Then Apex Cover met Orion Life."]
    units = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "nth long, unit string, text string")

    def port(batch):
        assert len(batch) <= 3
        if "bad" in batch:
            raise ValueError("no reply")
        return P.find_names(batch)

    rows = P.extract_graph(units, port).orderBy("seq").collect()
    assert [(r.name, r.units) for r in rows if r.kind == "entity"] == [("Maria Keller", ["u0"]), ("Apex Cover", ["u0"]), ("New Haven", ["u2"])]
    assert [(r.source, r.target) for r in rows if r.kind == "relationship"] == [("Maria Keller", "Apex Cover")]
    many = lambda batch: {"entities": [{"name": f"N{i}"} for i in range(20)], "relationships": [{"source": "N1", "target": f"N{i}"} for i in range(20)]}
    full = P.extract_graph(units, many)
    assert full.where("kind = 'entity'").count() == full.where("kind = 'relationship'").count() == 16
    merged = G.merge_entities(full.where("kind = 'entity'").select("seq", "name", "type", "description"))
    assert merged.count() == 8 and {r.type for r in merged.collect()} == {"CONCEPT"}
    assert P.extract_graph(units.limit(0)).collect() == []


def test_reports_and_points(spark):
    members = spark.createDataFrame([("c1", i, f"Name {i}") for i in range(30)] + [("c2", 0, "Storm claims")], "community string, nth int, entity string")
    got = {r.community: r for r in P.community_reports(members).collect()}
    assert got["c1"].summary.endswith("Name 24") and got["c2"].title == "Storm claims" and len(got["c1"].embedding) == 64
    q = spark.createDataFrame([(1, "storm claims", "c2"), (1, "storm claims", "c1"), (2, None, "c1")], "query_id int, text string, community string")
    assert {(r.query_id, r.community, r.score) for r in P.global_points(q, P.community_reports(members)).collect()} == {(1, "c2", 100), (1, "c1", 0), (2, "c1", 0)}


def test_migrations_run_once_in_order(spark, tmp_path):
    path, ran = str(tmp_path / "applied"), []
    scripts = {"0002": "b;\nc", "0001": "a"}
    assert store.migrate(spark, path, scripts, ran.append) == ["0001", "0002"] and [r.strip() for r in ran] == ["a", "b", "c"]
    assert store.migrate(spark, path, scripts, ran.append) == [] and len(ran) == 3

    def fails(sql):
        raise KeyError(sql)

    with pytest.raises(KeyError):
        store.migrate(spark, path, scripts | {"0003": "d"}, fails)
    assert store.migrate(spark, path, scripts | {"0003": "d"}, ran.append) == ["0003"]
    with pytest.raises(ValueError, match="0001"):
        store.migrate(spark, path, scripts | {"0001": "changed", "0003": "d"}, ran.append)
    (tmp_path / "applied.lock").write_text("")
    with pytest.raises(RuntimeError, match="lock"):
        store.migrate(spark, path, scripts, ran.append)


def test_files_broken_as_a_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": "q"')
    (tmp_path / "b.jsonl").write_text('{"question": 1\n{"question"\n')
    (tmp_path / "c.jsonl").write_text('{"question": "q", "answer": "a"}\nnot json\n')
    rows = D.read_files(spark, str(tmp_path))
    assert {(r.path.rsplit("/")[-1], r.problem) for r in D.broken(rows).collect()} == {("a.json", "not valid JSON"), ("b.jsonl", "no line is valid JSON")}
    with pytest.raises(ValueError, match="a.json"):
        D.read_files(spark, str(tmp_path), strict=True)
    assert D.read_files(spark, str(tmp_path / "c.jsonl"), strict=True).where(F.col("reason").isNull()).count() == 1


def test_word_files(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three &amp; four</w:t></w:r></w:p></w:body></w:document>')
    got = corpus.extract(spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"PK"))], "name string, content binary")).collect()
    assert got[0].text == "One\ttwo\n\nThree & four" and got[1].problem.startswith("could not be read")
