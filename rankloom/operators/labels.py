"""Graded relevance labels: which chunks hold the evidence for which question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankloom.functions import text as T
from rankloom.operators import blocks as X
from rankloom.session import cut

KEYWORD_WEIGHT, ANSWER_WEIGHT = 0.6, 0.4
THRESHOLD = 0.5
RESCUE, RESCUED = 0.25, 2


def _pieces(c):
    """Runs of letters and digits of a normalised text."""
    return F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def keyword_hits(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, doc_id, hits): how many keywords of an item occur in a chunk, where any does.

    items: item_id, keywords; chunks: doc_id, text. A keyword that occurs as a phrase has all its letter-and-digit runs
    in the text, one that occurs by its words has all their stems; so an equi-join on the rarest of them gives every candidate, and
    the exact test follows. Keywords without letter or digit are matched by all their words alone.
    """
    keys = items.select("item_id", F.posexplode("keywords").alias("nth", "keyword")).withColumn("k", T.normalize_for_match(F.col("keyword"))).where("k <> ''")
    prepared = chunks.select("doc_id", T.normalize_for_match(F.col("text")).alias("h")).where("h <> ''")
    tokens = lambda c: F.concat(
        F.transform(_pieces(c), lambda w: F.concat(F.lit("p:"), w)), F.transform(F.split(c, " "), lambda w: F.concat(F.lit("s:"), T.stem(w))))
    wanted = keys.select("k").distinct().select("k", F.explode(F.array_distinct(tokens(F.col("k")))).alias("token"))
    there = prepared.select("doc_id", F.explode_outer(F.array_distinct(tokens(F.col("h")))).alias("token")).where("token is not null").join(wanted.select("token").distinct(), "token", "left_semi")
    there = cut(there)  # read twice; only tokens of keywords are left
    counts = there.groupBy("token").agg(F.count("*").alias("df"))
    known = wanted.join(counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("kind", F.left("token", F.lit(2)))
    rarest = known.groupBy("k", "kind").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.min("df").alias("df")).where("df > 0")
    candidates = rarest.join(there, "token").select("k", "doc_id").distinct()
    found = candidates.join(prepared, "doc_id").where(T.keyword_in_normal(F.col("k"), F.col("h"))).select("k", "doc_id")
    return keys.join(found, "k").groupBy("item_id", "doc_id").agg(F.countDistinct("nth").alias("hits"))


def answer_share(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, doc_id, share): the share of the stems of an item's answer that a chunk holds, where it holds any."""
    asked = items.select("item_id", F.array_distinct(T.stems(F.col("answer"))).alias("s")).where(F.size("s") > 0)
    words = asked.select("item_id", F.size("s").alias("n"), F.explode("s").alias("stem"))
    there = chunks.select("doc_id", F.explode_outer(F.array_distinct(T.stems(F.col("text")))).alias("stem")).where("stem is not null").join(words.select("stem").distinct(), "stem", "left_semi")
    return words.join(there, "stem").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("share"))


def grades(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, doc_id, grade) for every positive grade; items: item_id, keywords, answer, gold.

    An item with gold chunks has grade 1 for those and no other label. Null keywords and answers count as none.
    """
    free = items.where(F.coalesce(F.size("gold"), F.lit(0)) <= 0)
    gold = items.where(F.size("gold") > 0).select("item_id", F.explode(F.array_distinct("gold")).alias("doc_id"), F.lit(1.0).alias("grade"))
    sizes = free.select("item_id", F.size("keywords").alias("n"))
    hit = keyword_hits(free, chunks).join(sizes, "item_id").select("item_id", "doc_id", (F.col("hits") / F.col("n")).alias("k"))
    both = hit.join(answer_share(free, chunks), ["item_id", "doc_id"], "full_outer")
    grade = F.least(F.lit(1.0), KEYWORD_WEIGHT * F.coalesce("k", F.lit(0.0)) + ANSWER_WEIGHT * F.coalesce("share", F.lit(0.0)))
    return both.select("item_id", "doc_id", F.round(grade, 9).alias("grade")).where("grade > 0").unionByName(gold)


def needed(items: DataFrame, where: str, hits: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, doc_id, grade, above): what ranking metrics need of the grades of all texts of an index that holds the items' keywords.

    That is each item's k best and its hits (query_id, doc_id), and how many texts of all reach the threshold. Items as for grades.
    """
    free = items.where(F.coalesce(F.size("gold"), F.lit(0)) <= 0)
    gold = items.where(F.size("gold") > 0).select("item_id", F.explode(F.array_distinct("gold")).alias("doc_id"), F.lit(1.0).alias("grade"), F.lit(0).cast("long").alias("above"))
    stems = F.array_distinct(T.stems(F.coalesce("answer", F.lit(""))))
    keys = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), T.normalize_for_match), lambda x: x.isNotNull() & (x != ""))
    parts = free.select(F.col("item_id").alias("query_id"), stems.alias("s"), keys.alias("k"), F.size("keywords").alias("n"))
    share = lambda weight, n, c: F.array_repeat(weight / F.greatest(n, F.lit(1)), F.size(c))
    asked = parts.select("query_id", F.concat(X.term_ids(F.col("s")), F.transform("k", X.keyword_id)).alias("terms"), F.concat(share(ANSWER_WEIGHT, F.size("s"), "s"), share(KEYWORD_WEIGHT, F.col("n"), "k")).alias("weights"))
    wanted = hits.groupBy("query_id").agg(F.collect_list("doc_id").alias("wanted"))
    found = X.search(asked.where(F.size("terms") > 0).join(wanted, "query_id", "left"), where, k, count=THRESHOLD).where("score > 0")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.col("score").alias("grade"), "above").dropDuplicates(["item_id", "doc_id"]).unionByName(gold)


def rescue(graded: DataFrame) -> DataFrame:
    """Grades after promotion: where no grade of an item reaches the threshold, its best two with some evidence are set to it.

    ``unsupported`` tells items for which there is nothing to promote. Ties go to the smaller doc_id. ``above`` is passed on.
    """
    w = Window.partitionBy("item_id")
    best = F.max("grade").over(w)
    place = F.row_number().over(w.orderBy(F.desc("grade"), "doc_id"))
    raised = (best < THRESHOLD) & (F.col("grade") >= RESCUE) & (place <= RESCUED)
    return graded.select("item_id", "doc_id", F.when(raised, F.greatest("grade", F.lit(THRESHOLD))).otherwise(F.col("grade")).alias("grade"), (best < RESCUE).alias("unsupported"), *[c for c in graded.columns if c == "above"])
