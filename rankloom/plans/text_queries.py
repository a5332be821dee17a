"""Queries on text and vector functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import text as T, vectors as V
from rankloom.session import table

WS = T.WS
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: SQL of the functions, as macros of the oracle's text.
LOW = "lower(text)"
TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}''{WS}-]', ' ', 'g'), '[{WS}]+'), lambda w: w <> '')"
CONTENT = f"list_filter({TOKENS}, lambda w: length(w) > 1 and w not in ({STOP}))"


def sql_stem(w: str) -> str:
    """SQL for the stem of an expression."""
    b = f"(case when {w} like '%''s' then left({w}, length({w}) - 2) else {w} end)"
    n = f"length({b})"
    return (
        f"(case when {n} > 4 and {b} like '%ies' then left({b}, {n} - 3) || 'y' when {n} > 4 and {b} like '%es' and not {b} like '%ses' then left({b}, {n} - 2) "
        f"when {n} > 3 and {b} like '%s' and not {b} like '%ss' then left({b}, {n} - 1) when {n} > 5 and {b} like '%ing' then left({b}, {n} - 3) when {n} > 4 and {b} like '%ed' then left({b}, {n} - 2) else {b} end)"
    )


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-1: estimated tokens of every document."""
    return _docs(spark, folder).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-2, TXT-3: words and content words of every document."""
    return _docs(spark, folder).select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.size(T.content_tokens(F.col("text"))).alias("n_content"))


def stem_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-4: how often each stem occurs in the corpus."""
    return _docs(spark, folder).select(F.explode_outer(T.content_tokens(F.col("text"))).alias("word")).where("word is not null").groupBy(T.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("n"))


def normalized_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-5: a fingerprint of every normalised text."""
    n = T.normalize_for_match(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.length(n).alias("n"), F.md5(n).alias("md5"))


def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-8: a fingerprint of every cleaned text."""
    c = T.clean_extracted(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("md5"))


def trimmed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-9: every text trimmed to 1 000 characters."""
    t = T.trim_to_chars(F.col("text"), 1000)
    return _docs(spark, folder).select("doc_id", F.length(t).alias("n"), (F.length("text") > 1000).alias("trimmed"), F.md5(t).alias("md5"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-10: sentences of every document, and the longest of them."""
    s = T.split_sentences(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.size(s).alias("n"), F.array_max(F.transform(s, F.length)).alias("longest"))


def text_digests(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-12: digests as identifiers."""
    return _docs(spark, folder).select("doc_id", F.left(F.sha1(F.col("text").cast("binary")), F.lit(12)).alias("sha1"), F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(16)).alias("sha256"))


def entity_keys(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-13, TXT-14: keys and names of customers, suppliers and nations as entities."""
    names = table(spark, folder, "customer").select(F.col("c_name").alias("name")).union(table(spark, folder, "supplier").select("s_name")).union(table(spark, folder, "nation").select("n_name"))
    return names.select("name", T.entity_key(F.concat(F.lit("  "), F.replace("name", F.lit("#"), F.lit(" #\t")))).alias("key"), T.entity_name(F.col("name")).alias("plain")).distinct()


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-15: groups of documents with the same beginning."""
    return _docs(spark, folder).where("text is not null").groupBy(F.md5(T.near_duplicate_key(F.col("text"))).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def context_headers(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-16: the context line of every stored chunk."""
    c = table(spark, folder, "stored_chunks")
    return c.select("id", T.context_header(F.col("category"), F.col("doc_title"), F.col("heading_path")).alias("header"))


def prompt_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-17: chunks as they stand in a prompt."""
    c = table(spark, folder, "stored_chunks")
    return c.select("id", F.md5(T.context_block(F.col("ordinal"), F.col("doc_title"), F.col("heading_path"), F.col("text"))).alias("md5"))


def salvaged_json(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-18: a number out of JSON that stands in prose."""
    e = table(spark, folder, "events")
    wrapped = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("Here: "), "props", F.lit(" done"))).when(F.pmod("event_id", F.lit(3)) == 1, F.col("props")).otherwise(F.lit("no json"))
    return e.select("event_id", F.try_variant_get(T.salvage_json(wrapped), "$.k", "int").alias("k"))


def formatted(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-19: values of events as they are shown."""
    v = F.col("value")
    return table(spark, folder, "events").select("event_id", T.format_tokens(F.round(v * 500) * 10 + 3).alias("tokens"), T.format_duration(F.round(v * 100) * 10 + 3).alias("duration"), T.format_bytes(F.round(v * 2000) * 10 + 3).alias("bytes"))


def keyword_matches(spark: SparkSession, folder: str) -> DataFrame:
    """TXT-6, TXT-7: which expected keywords of an item occur in its own reference answer."""
    items = table(spark, folder, "evaluation_items").where("reference_answer is not null").select("id", "reference_answer", F.explode("expected_keywords").alias("keyword"))
    return items.select("id", "keyword", T.keyword_present(F.col("keyword"), F.col("reference_answer")).alias("present")).distinct()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def l2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-3: the norm before and after normalisation."""
    scaled = F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))
    return _vectors(spark, folder).select("vec_id", F.round(V.norm(scaled), 4).alias("before"), F.round(V.norm(V.l2_normalize(scaled)), 4).alias("after"))


def neighbour_cosines(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-1, VEC-2, VEC-4: similarity of each vector to the next one."""
    a = _vectors(spark, folder).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    j = a.join(b, "vec_id")
    e, n = F.col("embedding"), F.col("next")
    return j.select("vec_id", F.round(V.dot(e, n), 6).alias("dot"), F.round(V.cosine(e, n), 6).alias("cosine"), F.round(V.reference_similarity(e, n), 6).alias("similarity"))


def vector_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-15: vectors written as text and read again."""
    return _vectors(spark, folder).select("vec_id", (V.parse_vector(V.vector_literal(F.col("embedding"))) == F.col("embedding")).alias("same"), F.size(V.parse_vector(V.vector_literal(F.col("embedding")))).alias("n"))


def call_costs(spark: SparkSession, folder: str) -> DataFrame:
    """MTH-5: the cost of every event read as a model call."""
    e = table(spark, folder, "events")
    model = F.when(F.col("event_type") == "signup", "gpt-5-2025-08-07").when(F.col("event_type") == "view", "text-embedding-3-small").when(F.col("event_type") == "click", "gpt-5-mini").otherwise("some-model")
    tokens = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.round(V.call_cost(model, tokens * 10, tokens * 3, tokens * 2), 9).alias("cost"))


def weights_clamped(spark: SparkSession, folder: str) -> DataFrame:
    """MTH-4, MTH-6: values as relationship weights, and relative to their type's mean."""
    e = table(spark, folder, "events")
    means = e.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return e.join(F.broadcast(means), "event_type").select("event_id", F.round(V.clamp_weight(F.col("value")), 6).alias("weight"), F.round(V.relative_delta(F.col("value"), F.col("mean")), 6).alias("delta"))


QUERIES = {
    f.__name__: f
    for f in (
        estimate_tokens, token_counts, stem_vocabulary, normalized_lengths, clean_texts, trimmed_texts, sentence_counts, text_digests, entity_keys, near_duplicates, context_headers, prompt_blocks,
        salvaged_json, formatted, keyword_matches, l2_normalized, neighbour_cosines, vector_round_trip, call_costs, weights_clamped,
    )
}

_NORMAL = lambda t: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[‘’]', '''', 'g'), '[^\\p{{L}}\\p{{N}}''%$.{WS}-]', ' ', 'g'), '[{WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double))"

SQL = {
    "estimate_tokens": "select doc_id, ceil(length(text) / 4)::int as tokens from documents",
    "token_counts": f"select doc_id, len({TOKENS})::int as n_tokens, len({CONTENT})::int as n_content from documents",
    "stem_vocabulary": f"select {sql_stem('w')} as stem, count(*) as n from (select unnest({CONTENT}) as w from documents) group by 1",
    "normalized_lengths": f"select doc_id, length(n)::int as n, md5(n) as md5 from (select doc_id, {_NORMAL('text')} as n from documents)",
    "clean_texts": f"select doc_id, length(c)::int as n, md5(c) as md5 from (select doc_id, {_CLEAN} as c from documents)",
    "trimmed_texts": f"""with h as (select doc_id, text, left(text, 1000) as head from documents), c as (select *, greatest(coalesce(nullif(strpos(reverse(head), chr(10) || chr(10)), 0) * -1 + length(head) - 1, -1),
        coalesce(nullif(strpos(reverse(head), ' .'), 0) * -1 + length(head) - 1, -1), coalesce(nullif(strpos(reverse(head), chr(10)), 0) * -1 + length(head), -1)) as pos from h),
        t as (select doc_id, text, case when length(text) <= 1000 then text else regexp_replace(left(head, case when pos > 800 then pos else 1000 end::int), '^[{WS}]+|[{WS}]+$', '', 'g') end as t from c)
        select doc_id, length(t)::int as n, length(text) > 1000 as trimmed, md5(t) as md5 from t""",
    "sentence_counts": f"""with g as (select doc_id, text, regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_])((?i:Co|Corp|Dr|e\\.g|etc|Fig|i\\.e|Inc|Jr|Ltd|Mr|Mrs|Ms|No|Prof|Sr|St|U\\.S|vs))\\.', '\\1\\2' || chr(2), 'g'),
        '([.!?])[{WS}]+([A-Z"''(\\[])', '\\1' || chr(1) || '\\2', 'g') as g from documents), s as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(g, '\\n{{2,}}', chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(replace(x, chr(2), '.'), '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '') as s from g) select doc_id, len(s)::int as n, list_max(list_transform(s, lambda x: length(x)))::int as longest from s""",
    "text_digests": "select doc_id, left(sha1(text), 12) as sha1, left(sha256(text), 16) as sha256 from documents",
    "entity_keys": "select distinct name, upper(regexp_replace(trim(replace(name, '#', ' #' || chr(9))), '[ \\t]+', ' ', 'g')) as key, trim(regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) as plain from (select c_name as name from customer union all select s_name from supplier union all select n_name from nation)",
    "near_duplicates": f"select md5(regexp_replace(lower(left(text, 120)), '[{WS}]+', ' ', 'g')) as key, count(*) as n, min(doc_id) as first from documents where text is not null group by 1 having count(*) > 1",
    "context_headers": "select id, '[Context: ' || array_to_string(list_filter(list_concat(case when category is null or category = 'uploaded' then [] else [category] end, [regexp_replace(doc_title, '\\.[^.]+$', '')], coalesce(heading_path, [])), lambda p: p is not null and p <> ''), ' > ') || ']' || chr(10) as header from stored_chunks",
    "prompt_blocks": "select id, md5('[' || ordinal || '] (source: ' || doc_title || case when len(heading_path) > 0 then ' > ' || array_to_string(heading_path, ' > ') else '' end || ')' || chr(10) || left(text, 4000)) as md5 from stored_chunks",
    "salvaged_json": "select event_id, case when event_id % 3 < 2 then (props::json ->> '$.k')::int end as k from events",
    "formatted": """select event_id, case when t >= 1e6 then printf('%.1fM', t / 1e6) when t >= 1e3 then printf('%.1fk', t / 1e3) else printf('%d', floor(t + 0.5)::bigint) end as tokens,
        case when d < 1000 then printf('%d ms', floor(d + 0.5)::bigint) when d < 60000 then printf('%.2f s', d / 1000) else printf('%dm %ds', floor(d / 60000)::bigint, floor((d - 60000 * floor(d / 60000)) / 1000 + 0.5)::bigint) end as duration,
        case when b >= 1048576 then printf('%.1f MB', b / 1048576) when b >= 1024 then printf('%.0f KB', b / 1024) else printf('%d B', b::bigint) end as bytes from (select event_id, round(value * 500) * 10 + 3 as t, round(value * 100) * 10 + 3 as d, round(value * 2000) * 10 + 3 as b from events)""",
    "keyword_matches": f"""with i as (select id, keyword, {_NORMAL('keyword')} as k, {_NORMAL('reference_answer')} as h from (select id, reference_answer, unnest(expected_keywords) as keyword from evaluation_items where reference_answer is not null)),
        w as (select *, list_transform(string_split(k, ' '), lambda x: {sql_stem('x')}) as kw, list_transform(string_split(h, ' '), lambda x: {sql_stem('x')}) as hs from i)
        select distinct id, keyword, case when k = '' or h = '' then false when regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(k) || '($|[^\\p{{L}}\\p{{N}}])') then true when len(kw) = 1 then list_contains(hs, kw[1])
        else len(list_filter(kw, lambda x: not list_contains(hs, x))) = 0 and list_max(list_transform(kw, lambda x: list_position(hs, x))) - list_min(list_transform(kw, lambda x: list_position(hs, x))) <= 4 * len(kw) end as present from w""",
    "l2_normalized": "select vec_id, round(sqrt(list_sum(list_transform(s, lambda x: x::double * x::double))), 4) as before, round(sqrt(list_sum(list_transform(s, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(s, lambda x: x::double * x::double))), 4) as after from (select vec_id, list_transform(embedding, lambda x: (x * 3::float)::float) as s from embeddings)",
    "neighbour_cosines": f"""with p as (select a.vec_id, a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1), d as (select vec_id, {_DOT.format(a='a', b='b')} as d, sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}) as n from p)
        select vec_id, round(d, 6) as dot, round(d / n, 6) as cosine, round(greatest(0, d / n), 6) as similarity from d""",
    "vector_round_trip": "select vec_id, true as same, len(embedding)::int as n from embeddings",
    "call_costs": """with e as (select event_id, (props::json ->> '$.k')::int as k, event_type as t from events), p as (select *, case t when 'signup' then 1.25 when 'view' then 0.02 when 'click' then 0.25 else 0.05 end::double as i, case t when 'signup' then 0.125 when 'view' then 0.02 when 'click' then 0.025 else 0.005 end::double as c,
        case t when 'signup' then 10 when 'view' then 0 when 'click' then 2 else 0.4 end::double as o from e) select event_id, round((greatest(0, k * 10 - k * 3) * i + k * 3 * c + k * 2 * o) / 1e6, 9) as cost from p""",
    "weights_clamped": "select event_id, round(coalesce(least(10, greatest(1, value)), 5), 6) as weight, round((value - m) / nullif(m, 0), 6) as delta from (select *, avg(value) over (partition by event_type) as m from events)",
}
