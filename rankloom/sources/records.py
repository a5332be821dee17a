"""Loading raw records of uploaded question sets: valid rows on one side, rejected rows with their reason on the other.

Structure is checked record by record (strict JSON object, RFC 4180 quoting, number of fields); values are checked once
for each distinct value of a column: the distinct values are cast in the JVM, the failing ones form a dictionary
with reasons, and that dictionary is joined back to the rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.session import cut

# Accepted field names, keys compared without case and separators, in order of priority.
QUESTION_NAMES = ["question", "query", "prompt", "input"]
ANSWER_NAMES = ["referenceanswer", "answer", "groundtruth", "expectedanswer", "gold", "goldanswer", "response"]
KEYWORD_NAMES = ["expectedkeywords", "keywords", "keyword", "expectedterms", "terms"]
TYPE_NAMES = ["questiontype", "type", "category", "kind", "class"]
GOLD_NAMES = ["goldchunkids", "goldchunks", "relevantchunks", "chunkids"]
ID_NAMES = ["id", "questionid", "itemid"]

# White space of any kind, with the zero-width ones that no \s covers.
SPACE = r"\s\u0085\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_EDGES = re.compile(rf"^[{SPACE}]+|[{SPACE}]+$")
_SEPARATORS = re.compile(r"[\s_-]+")
_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|$)|([^",\r\n]*)(?=,|$)')

PARSED = "row_id bigint, structure string, question string, answer string, keywords string, category string, item_id string, difficulty string, asked_on string"


def strip_blank(text: str) -> str:
    """text without white space of any kind at both ends."""
    return _EDGES.sub("", text)


def csv_fields(record: str) -> list[str] | None:
    """The fields of one RFC 4180 record, or None if it isn't quoted as that demands.

    A field is wholly quoted (quotes inside doubled, commas and line breaks allowed) or has no quote and no line break.
    """
    end = len(record)
    while end and record[end - 1] in "\r\n":
        end -= 1
    fields, at = [], 0
    body = record[:end]
    while True:
        m = _FIELD.match(body, at)
        if m is None or "\n" in body[m.end() : m.end() + 1]:
            return None
        fields.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at == len(body):
            return fields
        at += 1  # the comma


def _refuse(name: str):
    raise ValueError(name)


def json_object(record: str) -> dict | None:
    """The record as a strict JSON object, else None; the constants NaN and Infinity are no JSON."""
    try:
        value = json.loads(record, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def normal_key(key: str) -> str:
    return _SEPARATORS.sub("", key.strip().lower())


def first_named(row: dict, names: list[str]):
    """The value under the first name that is present and not the empty string; of equal normal keys the later one."""
    for name in names:
        if name in row and row[name] != "":
            return row[name]
    return None


def as_text(value) -> str:
    """A string without its edges, a number or truth value as JSON writes it, '' for all else."""
    if isinstance(value, str):
        return strip_blank(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    return ""


def _given(row: dict, name: str) -> str | None:
    """A value to be checked: None if it isn't given (missing, null or blank); lists and objects as JSON text."""
    value = row.get(name)
    if value is None:
        return None
    text = as_text(value) if isinstance(value, (str, bool, int, float)) else json.dumps(value)
    return text or None


def _many(value) -> str | None:
    return json.dumps([as_text(v) for v in value]) if isinstance(value, list) else as_text(value) or None


def _structure(fmt: str | None, header: str | None, raw: str | None) -> tuple:
    none = (None,) * 7
    if raw is None or not strip_blank(raw):
        return ("blank", *none)
    if (fmt or "").lower() == "csv":
        names = csv_fields(strip_blank(header or "")) or []
        fields = csv_fields(raw)
        if fields is None:
            return ("broken_quoting", *none)
        if len(fields) != len(names):
            return ("column_count", *none)
        row = dict(zip(map(normal_key, names), fields))
    else:
        found = json_object(strip_blank(raw))
        if found is None:
            return ("not_json", *none)
        row = {normal_key(k): v for k, v in found.items()}
    question, answer = as_text(first_named(row, QUESTION_NAMES)), as_text(first_named(row, ANSWER_NAMES))
    reason = "no_question" if not question else "no_answer" if not answer else None
    return (reason, question or None, answer or None, _many(first_named(row, KEYWORD_NAMES)), as_text(first_named(row, TYPE_NAMES)) or None, as_text(first_named(row, ID_NAMES)) or None, _given(row, "difficulty"), _given(row, "askedon"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in PARSED.split(", ")]
    for pdf in batches:
        rows = [(i, *_structure(f, h, r)) for i, f, h, r in zip(pdf["row_id"], pdf["fmt"], pdf["header_line"], pdf["raw_line"])]
        yield pd.DataFrame(rows, columns=names).astype({c: object for c in names[1:]})


def value_reason(column: Column, value: Column) -> Column:
    """Why a given value of a checked column is invalid, null if it is valid: casts only, no Python."""
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    level = F.when(value.rlike(r"^[+-]?\d{1,9}$"), value.cast("int"))
    return F.when(column == "difficulty", F.when(level.between(1, 5), None).otherwise("difficulty is no integer from 1 to 5")).when(column == "asked_on", F.when(day.isNotNull(), None).otherwise("asked_on is no existing date YYYY-MM-DD"))


def parse_records(rows: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every non-blank record with ``reason`` (null: valid) and ``detail``, and the fields of the valid ones.

    rows: row_id, upload_id, raw_line; uploads: upload_id, fmt, header_line; further columns are ignored. Reasons in
    order: not_json, broken_quoting, column_count, no_question, no_answer, invalid_value. A record whose upload is
    unknown is taken as jsonl. Blank and null records give no row; an empty table gives an empty result; a row that
    is delivered twice gives two rows with the same reason.

    A hot upload is split by the engine's skew join; the dictionary holds only invalid values and is salted, so that
    one bad value in a third of all rows doesn't end in one task.
    """
    heads = uploads.groupBy("upload_id").agg(F.max(F.struct("fmt", "header_line")).alias("u")).select("upload_id", "u.fmt", "u.header_line")
    joined = rows.select("row_id", "upload_id", "raw_line").join(heads, "upload_id", "left")
    parsed = cut(joined.select("row_id", "fmt", "header_line", "raw_line").mapInPandas(_parse, PARSED).where("structure is null or structure <> 'blank'"))
    salts = 8
    column = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("difficulty", "asked_on")]))
    pairs = parsed.where("structure is null").select(column.alias("p")).select("p.*").where("value is not null")
    invalid = pairs.distinct().withColumn("detail", value_reason(F.col("column"), F.col("value"))).where("detail is not null")
    salted = invalid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")
    out = parsed.withColumn("salt", salt)
    for c in ("difficulty", "asked_on"):
        d = salted.where(F.col("column") == c).select(F.col("value").alias(c), "salt", F.col("detail").alias(f"bad_{c}"))
        out = out.join(d, [c, "salt"], "left")
    detail = F.coalesce("bad_difficulty", "bad_asked_on")
    reason = F.coalesce("structure", F.when(detail.isNotNull(), "invalid_value"))
    return out.select("row_id", reason.alias("reason"), F.when(F.col("structure").isNull(), detail).alias("detail"), "question", "answer", "keywords", "category", "item_id", F.col("difficulty"), "asked_on")


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid records, typed."""
    return parsed.where("reason is null").select("row_id", "item_id", "question", F.col("answer").alias("reference_answer"), "keywords", "category", F.expr("try_cast(difficulty as int)").alias("difficulty"), F.expr("try_cast(asked_on as date)").alias("asked_on"))


def skipped(parsed: DataFrame) -> DataFrame:
    """The rejected records with the first reason that holds, each row_id once."""
    return parsed.where("reason is not null").select("row_id", "reason").distinct()
