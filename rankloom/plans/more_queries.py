"""Queries on uploads, lenient question files, model inputs and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom.functions import text as T, vectors as V
from rankloom.functions.text import WS
from rankloom.functions.ticks import nice_ticks
from rankloom.operators import chunking as C, graph as G, models as P
from rankloom.plans.corpus_queries import _IT, _items, _sources
from rankloom.plans.evaluation_queries import RESULTS, results
from rankloom.plans.graph_queries import _MEM, _entities, _members
from rankloom.session import table
from rankloom.sources import corpus, datasets as D


def upload_policy(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-4, SRC-5: documents taken as uploads: cleaned length, too short, trimmed."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("title"), "text")
    return corpus.uploaded(d).select("title", "chars", "problem", "notice")


def upload_gate(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-6: titles as file names, with their size."""
    s = _sources(spark, folder).select(F.when(F.length("doc_id") % 2 == 0, F.replace("title", F.lit(".md"), F.lit(".exe"))).otherwise(F.col("title")).alias("name"), (F.coalesce(F.length("text"), F.lit(0)) * 300).cast("long").alias("bytes"))
    return corpus.gate(s).groupBy("problem").agg(F.count("*").alias("n"))


def lenient_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-7..10, PRJ-1..5: each uploaded record read as a file of its own by the lenient reader, with the reason it is skipped."""
    up = table(spark, folder, "dataset_uploads").select("upload_id", "header_line")
    rows = table(spark, folder, "dataset_rows").join(up, "upload_id", "left")
    files = rows.select(F.col("row_id").cast("string").alias("path"), F.concat_ws("\n", "header_line", "raw_line").alias("text"))
    return D.parse_files(files).groupBy("format", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def generated_items(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-11: questions taken as generated ones: blank and repeated ones go, keywords are trimmed."""
    e = table(spark, folder, "evaluation_items").select("pos", "question", F.col("reference_answer").alias("answer"), F.col("expected_keywords").alias("keywords"), F.col("id").alias("source"))
    raw = e.withColumn("seq", F.row_number().over(Window.orderBy("pos", "source", F.coalesce("answer", F.lit("")))))
    return D.generated(raw, 40).select("id", "question", F.size("keywords").alias("n_keywords"))


def generated_questions(spark: SparkSession, folder: str) -> DataFrame:
    """MDL-8, CHK-10: questions written on chunks."""
    c = table(spark, folder, "stored_chunks").where("strategy = 'advanced' and length(text) >= 250")
    return c.select("id", P.generated_question(F.col("text")).alias("g")).select("id", "g.*")


def embed_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-8: documents of which a single blank is embedded."""
    t = T.embed_input(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", (t == " ").alias("blank"), F.length(t).alias("n"))


def gains(spark: SparkSession, folder: str) -> DataFrame:
    """MTH-1: what a grade at a rank is worth."""
    e = table(spark, folder, "events").select("event_id", (F.col("event_id") % 13 / 10 - 0.1).alias("grade"), (F.col("event_id") % 20 + 1).alias("rank"))
    return e.select("event_id", F.round(V.gain(F.col("grade")) * V.discount(F.col("rank")), 6).alias("worth"))


def explorer_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-3, SRT-4: answers by latency, longest first, those without one last; the third page of 25."""
    r = results(spark, folder).select("pos", "latency_ms").orderBy(F.desc_nulls_last("latency_ms"), "pos").limit(75)
    w = Window.orderBy(F.desc_nulls_last("latency_ms"), "pos")
    return r.withColumn("row", F.row_number().over(w)).where("row > 50")


def chunk_headers(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-8, JN-1, MDL-6: the lines before chunks: stored, written by a model for the first 120 without one, else on their place."""
    c = C.structural(_sources(spark, folder))
    stored = table(spark, folder, "stored_chunks").where("context_header is not null").select("chunk_id", F.col("context_header").alias("header"))
    return C.with_headers(c, stored, _sources(spark, folder)).select("chunk_id", "line")


def community_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-13: what a model is asked about the best ranked communities."""
    w = Window.partitionBy("community").orderBy("nth")
    pairs = _members(spark, folder).where("community_level = 0").withColumn("target", F.lead("entity").over(w)).where("target is not null")
    rel = pairs.groupBy(F.col("entity").alias("source"), "target").agg(F.count("*").alias("weight"))
    return G.community_prompts(_members(spark, folder), _entities(spark, folder), rel).select("community", "rank", F.length("prompt").alias("chars"))


def community_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """MDL-7: communities by title and first members."""
    c = table(spark, folder, "graph_communities")
    return c.select("id", F.md5(P.summarize(F.coalesce("title", F.lit("")), F.col("entity_ids"))).alias("md5"))


def axis_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """MTH-7: the ticks of an axis for each type's largest value."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.max("value").alias("top")).select("event_type", nice_ticks(F.col("top")).alias("ticks"))


QUERIES = {
    f.__name__: f
    for f in (upload_policy, upload_gate, lenient_files, generated_items, generated_questions, embed_inputs, gains, explorer_sorted, chunk_headers, community_prompts, community_summaries, axis_ticks)
}

_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')"
SQL = {
    "upload_policy": f"select doc_id::varchar as title, length(c)::int as chars, case when length(c) < 500 then 'fewer than 500 characters of text' end as problem, null::varchar as notice from (select doc_id, {_CLEAN} as c from documents)",
    "upload_gate": "with s as (select case when length(id) % 2 = 0 then replace(title, '.md', '.exe') else title end as name, coalesce(length(text), 0) * 300 as bytes from source_documents qualify row_number() over (partition by id order by loaded_at desc) = 1) select case when lower(regexp_extract(name, '\\.([^.]+)$', 1)) not in ('pdf', 'docx', 'txt', 'md') then 'unsupported type' when bytes > 1048576 then 'too large' end as problem, count(*) as n from s group by 1",
    "generated_items": f"""with e as (select row_number() over (order by pos, id, coalesce(reference_answer, '')) as seq, question, reference_answer as answer, list_filter(list_transform(expected_keywords, lambda k: trim(k)), lambda k: length(k) > 1)[1:5] as k from evaluation_items),
        f as (select * from e where regexp_replace(question, '[{WS}]', '', 'g') <> '' and regexp_replace(answer, '[{WS}]', '', 'g') <> '' and len(k) > 0 qualify row_number() over (partition by regexp_replace(regexp_replace(lower(question), '^[{WS}]+|[{WS}]+$', '', 'g'), '[{WS}]+', ' ', 'g') order by seq) = 1)
        select 'gen-' || row_number() over (order by seq) as id, question, len(k)::int as n_keywords from f qualify row_number() over (order by seq) <= 40""",
    "embed_inputs": f"select doc_id, t = ' ' as blank, length(t)::int as n from (select doc_id, case when coalesce(regexp_replace(text, '[{WS}]', '', 'g'), '') = '' then ' ' else text end as t from documents)",
    "gains": "select event_id, round((pow(2, least(1, greatest(0, event_id % 13 / 10 - 0.1))) - 1) / log2(event_id % 20 + 2), 6) as worth from events",
    "explorer_sorted": f"with {RESULTS} select pos, latency_ms, row from (select pos, latency_ms, row_number() over (order by latency_ms desc nulls last, pos)::int as row from r) where row between 51 and 75",
    "axis_ticks": "with t as (select event_type, max(value) / 4 as rough from events group by 1), s as (select *, pow(10, floor(log10(rough)) + 1) as size, if(floor(log10(rough)) = 0, 0.1, 0.05)::double as unit from t) select event_type, list_transform(range(0, 5), lambda i: round(i * ceil(round(rough / size / unit, 9)) * unit * size, 9)) as ticks from s",
    "community_summaries": "select id, md5(coalesce(title, '') || ': ' || array_to_string(entity_ids[1:25], ', ')) as md5 from graph_communities",
}
