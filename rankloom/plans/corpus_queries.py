"""Queries on chunking, sampling, stored chunks and question fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom.functions import text as T
from rankloom.functions.text import WS
from rankloom.operators import chunking as C
from rankloom.sources import corpus, datasets as D, store
from rankloom.session import latest, newest, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "source_documents")
    return newest(s.select("id", "loaded_at", "title", "category", "text"), ["id"], ["loaded_at"]).select(F.col("id").alias("doc_id"), "title", "category", "text")


def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-1: windows of all documents, each by a digest of its text."""
    return C.fixed(_docs(spark, folder)).select("doc_id", "ordinal", "char_start", "char_end", F.md5("text").alias("md5"))


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-1: number and length of windows by source and language."""
    d = table(spark, folder, "documents").select("doc_id", "source", F.lower("lang").alias("lang"))
    return C.fixed(_docs(spark, folder)).join(d, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def indexing_stats(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-13, MTH-9: size of the index of stored chunks by strategy."""
    out = None
    for s in ("advanced", "advanced-pro"):
        one = C.indexing_stats(table(spark, folder, "stored_chunks").where(F.col("strategy") == s)).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def structural_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-2..5, CHK-7: structure-aware chunks of the source documents."""
    return C.structural(_sources(spark, folder))


def contextual_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-6, TXT-16: the same with a line on their place in front of what is embedded."""
    return C.contextual(_sources(spark, folder)).select("doc_id", "chunk_id", "ordinal", "embed_text")


def hash_ids(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-11: short identifiers of documents."""
    ids = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else C.hash_id(t)), "string")
    return _docs(spark, folder).select("doc_id", ids(F.left("text", F.lit(160))).alias("hash"))


def round_robin_units(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-9: sixty chunks taken in turn from the documents."""
    c = table(spark, folder, "stored_chunks").where("strategy = 'advanced'").select("id", "doc_id", "ordinal")
    first = c.withColumn("first", F.min("id").over(Window.partitionBy("doc_id")))
    return C.round_robin(first, "doc_id", [F.col("ordinal"), F.col("id")], 60, [F.col("first")]).select("id", "place")


def generation_sources(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-10: forty chunks of 250 characters or more taken in turn from the documents, the longest of each first."""
    c = table(spark, folder, "stored_chunks").where("strategy = 'advanced' and length(text) >= 250").select("id", "doc_id", F.length("text").alias("n"))
    first = c.withColumn("first", F.min("id").over(Window.partitionBy("doc_id")))
    return C.round_robin(first, "doc_id", [F.desc("n"), F.col("id")], 40, [F.col("first")]).select("id", "place")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    e = latest(table(spark, folder, "evaluation_items").select("id", "loaded_at", "pos", "question", "question_type", "expected_keywords"), ["id"], ["loaded_at"])
    return e.withColumn("question_type", F.coalesce("question_type", F.lit("other")))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-11: fifty questions taken in turn from the types."""
    return D.stratified(_items(spark, folder).select("id", "pos", "question_type"), 50)


def truncated_set(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-6: the first hundred questions by position."""
    w = Window.orderBy("pos", "id")
    return _items(spark, folder).orderBy("pos", "id").limit(100).select("id", F.row_number().over(w).alias("place"))


def question_types(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-5: types in several spellings as known ones."""
    shown = F.when(F.col("pos") % 3 == 0, F.replace(F.upper("question_type"), F.lit("_"), F.lit("-"))).when(F.col("pos") % 3 == 1, F.concat(F.lit(" "), F.left("question_type", F.lit(5)))).otherwise(F.col("question_type"))
    return _items(spark, folder).select("id", D.question_type(shown).alias("type"))


def string_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-4: keywords written as JSON or with separators, as lists."""
    k = F.transform(F.coalesce("expected_keywords", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "[\\[\\],;|\"]", ""))
    text = F.when(F.col("pos") % 2 == 0, F.to_json(k)).otherwise(F.array_join(k, " ; "))
    return _items(spark, folder).select("id", F.array_join(D.string_array(text), "/").alias("keywords"))


def alias_pick(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-1, PRJ-3: fields under names of several spellings."""
    m = F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("Question"), F.lit(""), F.lit(" PROMPT"), F.col("question"))).when(F.col("pos") % 3 == 1, F.create_map(F.lit("que-ry"), F.col("question"), F.lit("Q"), F.lit("x"))).otherwise(F.create_map(F.lit("ques tion"), F.lit("first"), F.lit("question"), F.col("question")))
    return _items(spark, folder).select("id", D.pick(D.normal_keys(m), ["question", "query", "prompt", "input"]).alias("question"))


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14: stored chunks by strategy."""
    return store.coverage(table(spark, folder, "stored_chunks"))


def cached_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12: the chunks of a strategy in order; the predicate reaches the scan."""
    c = table(spark, folder, "stored_chunks").where(F.col("strategy") == "advanced-pro").select("id", "doc_id", "ordinal")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "id")))


def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2: a digest of titles and lengths, with totals."""
    return corpus.fingerprint(_sources(spark, folder).where("text is not null"))


def corpus_categories(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2, AGG-9: documents by category."""
    return corpus.categories(_sources(spark, folder))


def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """JN-1: chunks of a strategy without a stored vector."""
    c = table(spark, folder, "stored_chunks").select("strategy", "chunk_id", "embedding")
    return store.missing(c.select("strategy", "chunk_id").distinct(), c).select("strategy", "chunk_id")


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JN-2: chunks with their document's length, the chunks of lost documents included."""
    d = _sources(spark, folder).select("doc_id", F.length("text").alias("doc_chars"))
    return table(spark, folder, "stored_chunks").select("id", "doc_id", F.length("text").alias("chars")).join(d, "doc_id", "left").select("id", "chars", "doc_chars")


def renamed(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-7: a name replaced in its three spellings."""
    c = D.align_naming(F.concat_ws(" ", "question", F.upper("question"), F.lower("question")), "office", "bureau")
    return _items(spark, folder).select("id", F.md5(c).alias("md5"))


def migration_states(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-5: scripts against what was applied: nations as scripts."""
    n = table(spark, folder, "nation")
    files = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("version"), F.col("n_name").alias("sql"))
    done = n.where("n_nationkey > 5").select(F.col("n_nationkey").alias("version"), store.checksum(F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name"))).alias("checksum"))
    return store.migration_states(files, done)


QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, chunk_stats, indexing_stats, structural_chunks, contextual_chunks, hash_ids, round_robin_units, generation_sources, stratified_sample, truncated_set, question_types, string_arrays, alias_pick, coverage, cached_chunks,
        corpus_fingerprint, corpus_categories, cache_misses, chunk_documents, renamed, migration_states,
    )
}

_FIXED = f"""w as (select doc_id, i::int as ordinal, (i * 640)::int as char_start, least(i * 640 + 800, length(text))::int as char_end, regexp_replace(substr(text, i * 640 + 1, 800), '^[{WS}]+|[{WS}]+$', '', 'g') as t from (select doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 800) / 640))::bigint + 1)) as i from documents where length(text) > 0)),
    fx as (select * from w where t <> '')"""
_SRC = "src as (select id as doc_id, title, category, text from source_documents qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_IT = "it as (select id, pos, question, coalesce(question_type, 'other') as question_type, expected_keywords from evaluation_items qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_TYPES = "case " + " ".join(f"when w in ({', '.join(repr(x) for x in [t, *D.SYNONYMS.get(t, '').split()])}) then '{t}'" for t in D.TYPES) + " else 'other' end"

SQL = {
    "fixed_chunks": f"with {_FIXED} select doc_id, ordinal, char_start, char_end, md5(t) as md5 from fx",
    "chunk_stats": f"with {_FIXED} select source, lower(lang) as lang, count(*) as chunks, sum(length(t))::bigint as chars from fx join documents using (doc_id) group by 1, 2",
    "indexing_stats": "select strategy, count(*) as chunks, round(coalesce(avg(ceil(length(text) / 4)), 0), 6) as mean_tokens, sum(ceil(length(embed_text) / 4))::bigint as embedding_tokens, sum(256 + 2 * length(text) + 2 * length(embed_text))::bigint as bytes from stored_chunks where strategy in ('advanced', 'advanced-pro') group by 1",
    "round_robin_units": "with c as (select id, doc_id, row_number() over (partition by doc_id order by ordinal, id) as turn, min(id) over (partition by doc_id) as first from stored_chunks where strategy = 'advanced') select id, row_number() over (order by turn, first)::int as place from c qualify row_number() over (order by turn, first) <= 60",
    "generation_sources": "with c as (select id, row_number() over (partition by doc_id order by length(text) desc, id) as turn, min(id) over (partition by doc_id) as first from stored_chunks where strategy = 'advanced' and length(text) >= 250) select id, row_number() over (order by turn, first)::int as place from c qualify row_number() over (order by turn, first) <= 40",
    "stratified_sample": f"with {_IT}, c as (select id, pos, question_type, row_number() over (partition by question_type order by pos) as turn, count(*) over (partition by question_type) as size, min(pos) over (partition by question_type) as first from it) select id, pos, question_type from c qualify row_number() over (order by turn, size desc, first) <= 50",
    "truncated_set": f"with {_IT} select id, row_number() over (order by pos, id)::int as place from it qualify row_number() over (order by pos, id) <= 100",
    "question_types": f"with {_IT}, w as (select id, regexp_replace(lower(trim(case pos % 3 when 0 then replace(upper(question_type), '_', '-') when 1 then ' ' || left(question_type, 5) else question_type end)), '[ -]+', '_', 'g') as w from it) select id, {_TYPES} as type from w",
    "string_arrays": f"with {_IT} select id, array_to_string(list_filter(list_transform(coalesce(expected_keywords, []), lambda x: trim(regexp_replace(x, '[\\[\\],;|\"]', '', 'g'))), lambda x: x <> ''), '/') as keywords from it",
    "alias_pick": f"with {_IT} select id, question from it",
    "coverage": "select strategy, count(*) as chunks, count(embedding) as embedded from stored_chunks group by 1",
    "cached_chunks": "select id, doc_id, ordinal, row_number() over (partition by doc_id order by ordinal, id)::int as place from stored_chunks where strategy = 'advanced-pro'",
    "corpus_fingerprint": f"with {_SRC} select left(sha256(string_agg(title || ':' || length(text), '|' order by title || ':' || length(text))), 16) as fingerprint, count(*) as documents, sum(length(text))::bigint as chars from src where text is not null",
    "corpus_categories": f"with {_SRC} select category, count(*) as n from src group by 1",
    "cache_misses": "select strategy, chunk_id from stored_chunks group by 1, 2 having count(embedding) = 0",
    "chunk_documents": f"with {_SRC} select id, length(c.text)::int as chars, length(src.text)::int as doc_chars from stored_chunks c left join src using (doc_id)",
    "renamed": f"with {_IT} select id, md5(replace(replace(replace(concat_ws(' ', question, upper(question), lower(question)), 'OFFICE', 'BUREAU'), 'Office', 'Bureau'), 'office', 'bureau')) as md5 from it",
    "migration_states": "select n_nationkey as version, case when n_nationkey >= 20 then 'missing' when n_nationkey <= 5 then 'pending' when n_nationkey % 4 = 0 then 'modified' else 'applied' end as state from nation",
}
