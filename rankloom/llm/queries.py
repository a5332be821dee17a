"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm import leakage, markup, neighbours, pairs, repetition, splitting, tokenizing
from rankloom.session import cut, latest, table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return leakage.leaked(leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaking documents by item and kind."""
    return leakage.report(leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat a quarter of their words or more."""
    documents = table(spark, folder, "documents")
    return repetition.repetitive(documents, repetition.outliers(documents))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated words of every document, the null and empty ones included."""
    return repetition.measure(table(spark, folder, "documents")).select("doc_id", "words", "repeated", "share")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "evaluation_items").select(F.col("id").alias("pair_id"), "loaded_at", "question", F.col("reference_answer").alias("answer"), F.lit(None).cast("boolean").alias("truncated"))
    said = table(spark, folder, "answer_responses").select(F.col("answer_id").cast("string").alias("pair_id"), "loaded_at", "question", "answer", "truncated")
    both = items.withColumn("origin", F.lit("evaluation_items")).unionByName(said.withColumn("origin", F.lit("answer_responses")))
    return latest(both, ["origin", "pair_id"], ["loaded_at"]).withColumn("pair_id", F.concat_ws(":", "origin", "pair_id"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.label(_pairs(spark, folder)).select(F.substring_index("pair_id", ":", 1).alias("origin"), F.expr("substr(pair_id, instr(pair_id, ':') + 1)").alias("pair_id"), "defect", "flagged")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every defective pair of evaluation_items and answer_responses with its defect."""
    return _labelled(spark, folder).where("defect is not null").select("origin", "pair_id", "defect")


def p1_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by origin and defect, and how many of them carry the flag."""
    return _labelled(spark, folder).groupBy("origin", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


TABLES = {"stored_chunks": "id", "graph_communities": "seq"}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of which one is among the five most similar of the other, in either table."""
    out = None
    for origin, key in TABLES.items():
        rows = table(spark, folder, origin).select(F.col(key).alias("key"), "embedding")
        found = neighbours.pairs(neighbours.most_similar(rows)).select(F.lit(origin).alias("origin"), "id_lo", "id_hi")
        out = found if out is None else out.unionByName(found)
    return out


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five communities most similar to each chunk whose id is divisible by 50, by greedy search on the graph of communities."""
    chunks = neighbours.usable(table(spark, folder, "stored_chunks").where(F.col("id") % 50 == 0).select(F.col("id").alias("key"), "embedding"))
    groups = cut(neighbours.classes(neighbours.usable(table(spark, folder, "graph_communities").select(F.col("seq").alias("key"), "embedding"))))
    nodes = groups.select("key", "vec")
    return neighbours.members(neighbours.greedy_search(chunks.withColumnRenamed("key", "query"), nodes, neighbours.build(nodes)), groups)


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "source_documents").select(F.col("id").alias("doc_id"), "loaded_at", "text"), ["doc_id"], ["loaded_at"]).select("doc_id", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of source_documents that must be cut."""
    return splitting.oversized(splitting.split(_sources(spark, folder)))


def p4_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all sections of source_documents."""
    return splitting.split(_sources(spark, folder))


def _marked(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    docs = table(spark, folder, "source_documents").select(F.col("id").alias("ref_id"), F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("version"), "text")
    stamp = F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("id").cast("string"), 20, "0"))
    chunks = table(spark, folder, "stored_chunks").select(F.col("chunk_id").alias("ref_id"), stamp.alias("version"), "text")
    return {"source_documents": docs, "stored_chunks": chunks}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of markup in every text of source_documents and stored_chunks."""
    out = None
    for origin, texts in _marked(spark, folder).items():
        last = latest(markup.kinds(texts), ["ref_id"], ["version"])
        rows = last.select(F.lit(origin).alias("origin"), "ref_id", F.explode("kinds").alias("markup"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every text of source_documents and stored_chunks."""
    out = None
    for origin, texts in _marked(spark, folder).items():
        rows = latest(markup.clean(texts), ["ref_id"], ["version"]).select(F.lit(origin).alias("origin"), "ref_id", "clean_text", "kinds")
        out = rows if out is None else out.unionByName(rows)
    return out


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return tokenizing.encode_corpus(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p3_found": p3_found, "p3_search": p3_search, "p4_found": p4_found, "p4_chunks": p4_chunks, "p5_found": p5_found, "p5_clean": p5_clean, "p6_ids": p6_ids, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_shares": p8_shares}
_REPEATED = """w as (select doc_id, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), []) as w from documents), g as (select doc_id, i, array_to_string(w[i:i + 5], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 4)) as i from w where len(w) >= 6)),
    r as (select distinct doc_id, i + k as p from (select doc_id, i, min(i) over (partition by doc_id, g) as first from g), range(0, 6) t(k) where first < i), n as (select doc_id, count(*) as n from r group by 1),
    s as (select w.doc_id, len(w)::int as words, coalesce(n, 0)::int as repeated from w left join n on n.doc_id = w.doc_id)"""
SQL: dict[str, str] = {
    "p8_found": f"with {_REPEATED} select doc_id from s where words >= 20 and repeated >= 0.25 * words",
    "p8_shares": f"with {_REPEATED} select doc_id, words, repeated, repeated / greatest(words, 1) as share from s",
}
