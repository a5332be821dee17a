"""Question sets from files: JSON arrays, JSON lines and CSV with lenient names, and the sampling of their questions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankloom.functions import text as T
from rankloom.operators.chunking import round_robin
from rankloom.sources.records import ANSWER_NAMES, GOLD_NAMES, ID_NAMES, KEYWORD_NAMES, QUESTION_NAMES, TYPE_NAMES, as_text, first_named, normal_key

MAX_QUESTIONS = 100
_TOKEN = re.compile(r'"[^"]*(?:"|\Z)|,|\n|[^",\n]+')
# The question types, and words that stand for them.
TYPES = "direct_fact multi_hop comparative temporal numerical relationship spanning holistic summarization definition procedural other".split()
SYNONYMS = {
    "direct_fact": "fact factual direct simple lookup",
    "multi_hop": "multihop multi reasoning inference",
    "comparative": "compare comparison",
    "temporal": "time date chronological",
    "numerical": "number numeric quantity count aggregation",
    "relationship": "relation relational connection entity",
    "spanning": "span spanning_docs crossdocument multidoc",
    "holistic": "global overall thematic theme",
    "summarization": "summary summarize summarisation",
    "definition": "define what_is",
    "procedural": "procedure howto process steps",
}
_BY_WORD = {w: t for t, words in SYNONYMS.items() for w in words.split()} | {t: t for t in TYPES}


def question_type(c: Column) -> Column:
    """A free-text type as one of the known ones, ``other`` for all else, null and blank."""
    word = F.regexp_replace(F.lower(T.trim_all(c)), f"[{T.WS}-]+", "_")
    table = F.create_map(*[F.lit(x) for pair in _BY_WORD.items() for x in pair])
    return F.coalesce(table[word], F.lit("other"))


def string_array(c: Column) -> Column:
    """A text as a list: a JSON array, else parts between ; , or |; trimmed, without empty ones."""
    t = T.trim_all(c)
    parts = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>"))
    split = F.coalesce(parts, F.split(t, "[;,|]"))
    return F.filter(F.transform(split, T.trim_all), lambda p: p.isNotNull() & (p != ""))


def normal_keys(m: Column) -> Column:
    """A map with keys in lower case without blanks, hyphens and underscores; of equal ones the last entry wins."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.regexp_replace(F.lower(T.trim_all(e["key"])), f"[{T.WS}_-]+", "").alias("k"), e["value"].alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def pick(m: Column, names: list[str]) -> Column:
    """The value of the first name that a map of normal keys has and that isn't empty."""
    return F.coalesce(*[F.when(m[n] != "", m[n]) for n in names])


def sniff(c: Column) -> Column:
    """SRC-7: the format of a file's text: json, jsonl or csv; jsonl where nothing else fits, null for a blank text."""
    t = T.trim_all(c)
    head = F.lower(F.split(t, "\n", 2)[0])
    return F.when(t == "", None).when(F.startswith(t, F.lit("[")), "json").when(F.startswith(t, F.lit("{")), "jsonl").when(F.contains(head, F.lit(",")) & F.contains(head, F.lit("question")), "csv").otherwise("jsonl")


def csv_rows(text: str) -> list[list[str]]:
    """SRC-10: rows of a lenient CSV text: a quote may begin and end anywhere in a field, doubled ones stand for one, carriage returns are dropped."""
    rows: list[list[str]] = []
    row: list[str] = []
    field = ""
    # Tokens: a quoted run, a comma, a line end, or plain text; a run directly after another is a doubled quote.
    after_run = False
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token[0] == '"':
            field += ('"' if after_run else "") + token[1:].removesuffix('"')
        elif token == ",":
            row.append(field)
            field = ""
        elif token == "\n":
            rows.append([*row, field])
            row, field = [], ""
        else:
            field += token.replace("\r", "")
        after_run = token[0] == '"'
    return [*rows, [*row, field]] if field or row else rows


def _records(text: str, fmt: str) -> Iterator[tuple[int, dict | None, str | None]]:
    """SRC-8, SRC-9, SRC-10: (line, record, why there is none) for each row of a file."""
    if fmt == "json":
        try:
            found = json.loads(text)
        except ValueError:
            yield 1, None, "not valid JSON"
            return
        for n, row in enumerate(found if isinstance(found, list) else [found]):
            yield (n + 1, row, None) if isinstance(row, dict) else (n + 1, None, "not an object")
    elif fmt == "csv":
        header, *rows = csv_rows(text)
        names = [normal_key(h) for h in header]
        for n, cells in enumerate(rows):
            if any(c.strip() for c in cells):
                yield n + 2, dict(zip(names, [*cells, *[""] * len(names)])), None
    else:
        for n, line in enumerate(text.split("\n")):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
            except ValueError:
                yield n + 1, None, "not valid JSON"
                continue
            yield (n + 1, row, None) if isinstance(row, dict) else (n + 1, None, "not an object")


def _listed(value) -> list[str]:
    if isinstance(value, str) and value.strip().startswith("["):
        try:
            value = json.loads(value)
        except ValueError:
            pass
    if isinstance(value, list):
        return [t for t in map(as_text, value) if t]
    text = as_text(value)
    for mark in ";|":
        text = text.replace(mark, ",")
    return [p.strip() for p in text.split(",") if p.strip()]


ROWS = "path string, format string, line int, reason string, id string, question string, reference_answer string, expected_keywords array<string>, question_type string, gold_chunk_ids array<string>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, text, fmt in zip(pdf["path"], pdf["text"], pdf["format"]):
            for line, row, why in _records((text or "").strip(), fmt) if fmt else ():
                if row is None:
                    out.append((path, fmt, line, why, None, None, None, None, None, None))
                    continue
                normal = {normal_key(k): v for k, v in row.items()}
                get = lambda names: first_named(normal, names)  # noqa: B023, E731
                q, a = as_text(get(QUESTION_NAMES)), as_text(get(ANSWER_NAMES))
                why = f"no question field (use one of {', '.join(QUESTION_NAMES)})" if not q else "no reference answer (use reference_answer, answer or expected_answer)" if not a else None
                out.append((path, fmt, line, why, as_text(get(ID_NAMES)) or None, q or None, a or None, _listed(get(KEYWORD_NAMES)), as_text(get(TYPE_NAMES)), _listed(get(GOLD_NAMES))))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ROWS.split(", ")])


def parse_files(files: DataFrame) -> DataFrame:
    """Every row of question files (path, text) with the reason it is skipped, if it is; blank files have none.

    A file is parsed as a whole (it may hold quoted line breaks); files are the unit of parallelism and bounded by the upload gate.
    """
    return files.select("path", "text", sniff(F.col("text")).alias("format")).mapInPandas(_parse, ROWS).withColumn("question_type", question_type(F.col("question_type")))


def broken(rows: DataFrame) -> DataFrame:
    """SRC-8, SRC-9: (path, problem) of files that can't be used at all: JSON that isn't valid, or JSON lines none of which is."""
    bad = F.col("reason") == "not valid JSON"
    return rows.where(F.col("format") != "csv").groupBy("path", "format").agg(F.min(F.coalesce(bad, F.lit(False))).alias("all_bad")).where("all_bad").select("path", F.when(F.col("format") == "json", "not valid JSON").otherwise("no line is valid JSON").alias("problem"))


def read_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """parse_files of the files under a path; ``strict`` raises ValueError where a file is broken as a whole."""
    rows = _read_files(spark, path)
    if strict and (bad := broken(rows).orderBy("path").first()):
        raise ValueError(f"{bad.path}: {bad.problem}")
    return rows


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def accepted(rows: DataFrame, most: int = MAX_QUESTIONS) -> DataFrame:
    """PRJ-2, PRJ-6: the usable rows of each file in order, at most ``most``: pos from 0, id q{n} where none is given, and whether there were more."""
    w = Window.partitionBy("path").orderBy("line")
    good = rows.where("reason is null").withColumn("pos", F.row_number().over(w) - 1).withColumn("truncated", F.count("*").over(Window.partitionBy("path")) > most)
    return good.where(F.col("pos") < most).withColumn("id", F.coalesce("id", F.concat(F.lit("q"), (F.col("pos") + 1).cast("string")))).drop("reason")


def skipped(rows: DataFrame) -> DataFrame:
    """The unusable rows with line and reason."""
    return rows.where("reason is not null").select("path", "line", "reason")


def read_shipped(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: a question set with fixed names (question, reference_answer, keywords, category), one JSON object a line; id default-{line}."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value")).where(T.trim_all(F.col("value")) != "")
    row = F.from_json("value", "question string, reference_answer string, keywords array<string>, category string").alias("r")
    return lines.select((F.col("n") + 1).alias("line"), row).select(F.concat(F.lit("default-"), F.col("line").cast("string")).alias("id"), (F.col("line") - 1).alias("pos"), "r.question", "r.reference_answer", F.col("r.keywords").alias("expected_keywords"), question_type(F.col("r.category")).alias("question_type"))


def align_naming(c: Column, old: str, new: str) -> Column:
    """A name replaced in a text in its three spellings: upper case, capitalised, lower case."""
    for a, b in ((old.upper(), new.upper()), (old.capitalize(), new.capitalize()), (old.lower(), new.lower())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def stratified(items: DataFrame, n: int) -> DataFrame:
    """n questions taken in turn from each type, the largest type first (of equal ones the one seen first), in their order by pos."""
    sized = items.withColumn("size", F.count("*").over(Window.partitionBy("question_type"))).withColumn("first", F.min("pos").over(Window.partitionBy("question_type")))
    return round_robin(sized, "question_type", [F.col("pos")], n, [F.desc("size"), F.col("first")]).drop("size", "first", "place")


def generated(raw: DataFrame, n: int) -> DataFrame:
    """PRJ-11: generated questions (seq, question, answer, keywords, source) fit for use: not blank, each once, with one to five keywords of two characters or more; id gen-{n}."""
    kept = F.slice(F.filter(F.transform("keywords", T.trim_all), lambda k: F.length(k) > 1), 1, 5)
    fit = raw.where((T.trim_all(F.col("question")) != "") & (T.trim_all(F.col("answer")) != "")).withColumn("keywords", kept).where(F.size("keywords") > 0)
    key = F.regexp_replace(F.lower(T.trim_all(F.col("question"))), f"[{T.WS}]+", " ")
    first = fit.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("nth = 1").orderBy("seq").limit(n)
    return first.withColumn("id", F.concat(F.lit("gen-"), F.row_number().over(Window.orderBy("seq")).cast("string"))).select("id", "question", "answer", "keywords", F.array("source").alias("gold_chunk_ids"))
