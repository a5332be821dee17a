"""Model ports: what language and embedding models do, behind functions that can be replaced and replayed.

A port is a function on a pandas batch of prompts. The ones given here work offline and give the same reply each time, so
every pipeline runs and can be tested without a network. A table of recorded replies, keyed by a digest of model, stage and prompt,
answers first where it is given; a reply that fails becomes a row with an error, never the end of a job.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import text as T

DIMENSIONS = 64
BATCH = 96
_WORD = re.compile(r"[^\W_]+")


def embed_text(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of a text by hashed words; a blank text is embedded as a blank."""
    v = np.zeros(dimensions, np.float64)
    for w in _WORD.findall(text.lower()) or [" "]:
        h = xxhash.xxh64_intdigest(w)
        v[h % dimensions] += 1 if h >> 32 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def embed_batch(texts: list[str], dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """The offline embedding port: a vector for each of at most BATCH texts, in their order."""
    return [embed_text(t, dimensions) for t in texts]


def embed(rows: DataFrame, column: str = "text", dimensions: int = DIMENSIONS, into: str = "embedding", port: Callable[[list[str], int], list] = embed_batch) -> DataFrame:
    """MDL-1: rows with a unit vector of a text column, asked of the port in batches of BATCH texts; a null text counts as a blank one."""
    names = rows.columns
    out = rows.withColumn(into, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[column]]
            found = [np.asarray(v, np.float64) for a in range(0, len(texts), BATCH) for v in port(texts[a : a + BATCH], dimensions)]
            yield pdf.assign(**{into: [(v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist() for v in found]})[[*names, into]]

    return rows.mapInPandas(run, out)


@dataclass
class Settings:
    """How often and how long a call is tried again, and what is taken as passing."""

    attempts: int = 4
    first_wait: float = 0.4
    longest_wait: float = 8.0
    passing: tuple = (408, 429)
    sleep: Callable[[float], None] = field(default=time.sleep)


class ModelError(Exception):
    """A call that failed, with the status the service gave, if any."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def retried(call: Callable[[], object], settings: Settings | None = None) -> object:
    """MDL-9: the reply of a call, tried again after growing waits while it fails in a way that may pass."""
    s = settings or Settings()
    for n in range(s.attempts):
        try:
            return call()
        except ModelError as e:
            if n + 1 == s.attempts or not (e.status is None or e.status in s.passing or e.status >= 500):
                raise
            s.sleep(min(s.longest_wait, s.first_wait * 2**n) * (1 + random.random() * 0.25))
    raise AssertionError


def is_reasoning(model: str) -> bool:
    """MDL-10: models that think before they answer take other settings."""
    return re.match(r"gpt-5|o[134]", model) is not None


def prompt_key(model: Column, stage: Column, system: Column, user: Column) -> Column:
    """The key under which a reply is recorded."""
    return F.sha2(F.concat_ws("\u001f", model, stage, system, user).cast("binary"), 256)


REPLIES = "key string, reply string, error string"


def ask(prompts: DataFrame, port: Callable[[dict], str], recorded: DataFrame | None = None) -> DataFrame:
    """prompts (key, payload JSON, ...) with reply and error; recorded (key, reply) answers first, the port the rest, each key once.

    A port that raises gives an error, its row stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, payload in zip(pdf["key"], pdf["payload"]):
                try:
                    rows.append((key, retried(lambda: port(json.loads(payload))), None))  # noqa: B023
                except Exception as e:
                    rows.append((key, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["key", "reply", "error"])

    todo = prompts.select("key", "payload").dropDuplicates(["key"])
    if recorded is not None:
        todo = todo.join(recorded.select("key"), "key", "left_anti")
    replies = todo.mapInPandas(run, REPLIES)
    if recorded is not None:
        replies = replies.unionByName(recorded.select("key", "reply", F.lit(None).cast("string").alias("error")).dropDuplicates(["key"]))
    return prompts.join(replies, "key", "left")


def judging(port: Callable[[dict], str]) -> Callable[[dict], str]:
    """MDL-3: a port whose reply must be a JSON object: one that isn't is asked for once more, tersely; then it is an error."""

    def ask_twice(payload: dict) -> str:
        for terse in (False, True):
            reply = port(payload | {"terse": True} if terse else payload)
            try:
                if isinstance(json.loads(reply), dict):
                    return reply
            except (TypeError, ValueError):
                continue
        raise ModelError("no valid verdict in two replies", 400)

    return ask_twice


# Units asked about together, and the most entities and relationships taken of one reply.
UNITS_A_CALL, MOST_FOUND = 3, 8
_NAME = re.compile(r"[A-Z][\w&'-]*(?: (?:of|the|and|de|of the) (?=[A-Z])| [A-Z][\w&'-]*)+|\b[A-Z]{2,}\b")


def find_names(texts: list[str]) -> dict:
    """The offline extraction port: names by capitals, related where they share a sentence."""
    entities: dict[str, str] = {}
    related: dict[tuple[str, str], str] = {}
    for sentence in (s for t in texts for s in re.split(r"(?<=[.!?])\s+|\n+", t)):
        names = list(dict.fromkeys(m[0] for m in _NAME.finditer(sentence)))
        for n in names:
            entities.setdefault(n, sentence[:200])
        for a, b in zip(names, names[1:]):
            related.setdefault((a, b), sentence[:200])
    return {"entities": [{"name": n, "type": "CONCEPT", "description": d} for n, d in entities.items()], "relationships": [{"source": a, "target": b, "description": d, "weight": 1} for (a, b), d in related.items()]}


FOUND = "seq bigint, kind string, name string, type string, description string, source string, target string, weight double, units array<string>"


def extract_graph(units: DataFrame, port: Callable[[list[str]], dict] = find_names) -> DataFrame:
    """GRF-1, MDL-7: what a model finds in units (nth from 0, unit, text): rows of kind entity or relationship, seq in the order found.

    UNITS_A_CALL units in a row are one call, of which MOST_FOUND entities and as many relationships are taken; a call that fails or
    gives no valid reply is left out. An entity belongs to the units of its call that hold its name, to all of them where none does.
    merge_entities and merge_relationships take it from here. Null texts are empty ones.
    """
    calls = units.groupBy(F.floor(F.col("nth") / UNITS_A_CALL).cast("long").alias("call")).agg(F.sort_array(F.collect_list(F.struct("nth", F.col("unit").cast("string").alias("unit"), F.coalesce("text", F.lit("")).alias("text")))).alias("u"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for call, u in zip(pdf["call"], pdf["u"]):
                try:
                    reply = retried(lambda: port([x["text"] for x in u]))  # noqa: B023
                    entities, related = list(reply.get("entities") or [])[:MOST_FOUND], list(reply.get("relationships") or [])[:MOST_FOUND]
                    made = []
                    for n, e in enumerate(entities):
                        inside = [x["unit"] for x in u if str(e["name"]).lower() in x["text"].lower()] or [x["unit"] for x in u]
                        made.append((call * 100 + n, "entity", str(e["name"]), e.get("type"), e.get("description"), None, None, None, inside))
                    for n, r in enumerate(related):
                        made.append((call * 100 + MOST_FOUND + n, "relationship", None, None, r.get("description"), str(r["source"]), str(r["target"]), float(r.get("weight") or 1), [x["unit"] for x in u]))
                except Exception:  # a failed call is skipped, the others go on
                    continue
                rows += made
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FOUND.split(", ")])

    return calls.mapInPandas(run, FOUND)


def global_points(questions: DataFrame, reports: DataFrame) -> DataFrame:
    """MDL-7: (query_id, community, score): how far each of the communities picked for a question helps, 0 to 100, by shared stems.

    questions: query_id, text, community; reports: community, title, summary.
    """
    j = questions.join(reports, "community")
    return j.select("query_id", "community", F.round(100 * overlap(F.col("text"), F.concat_ws("\n", "title", "summary"))).cast("int").alias("score"))


def community_reports(members: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """GRF-13: (community, title, summary, embedding) of communities (community, nth, entity): named by their first member, summarised by the first 25, embedded as title and summary."""
    first = members.where(F.col("nth") < 25).groupBy("community").agg(F.sort_array(F.collect_list(F.struct("nth", "entity"))).alias("m"))
    named = first.select("community", F.col("m")[0]["entity"].alias("title"), F.transform("m", lambda x: x["entity"]).alias("names"))
    told = named.select("community", "title", summarize(F.col("title"), F.col("names")).alias("summary"))
    return embed(told.withColumn("_t", F.concat_ws("\n", "title", "summary")), "_t", dimensions).drop("_t")


# The offline ports, as column expressions where that is enough.


def rewrite(question: Column) -> Column:
    """MDL-4: a question as a search query: its content words; a rewrite of three characters or fewer isn't taken."""
    q = F.array_join(T.content_tokens(question), " ")
    return F.when(F.length(q) > 3, q)


def usable_queries(question: Column, proposed: Column, most: int) -> Column:
    """The question first, then proposed queries of more than three characters, each once whatever its case, ``most`` proposals at most."""
    bare = F.transform(proposed, lambda p: T.trim_all(F.regexp_replace(p, "^[\"'“”]+|[\"'“”]+$", "")))
    good = F.slice(F.filter(bare, lambda p: F.length(p) > 3), 1, most)
    every = F.concat(F.array(question), good)
    return F.filter(every, lambda p, i: ~F.exists(F.slice(every, F.lit(1), i), lambda before: F.lower(before) == F.lower(p)))


def variants(question: Column) -> Column:
    """Other ways to ask: the content words, the longer ones, the words in reverse."""
    words = T.content_tokens(question)
    return F.array(F.array_join(words, " "), F.array_join(F.filter(words, lambda w: F.length(w) > 5), " "), F.array_join(F.reverse(words), " "))


def parts(question: Column) -> Column:
    """The parts of a question joined by and, or commas."""
    return F.filter(F.transform(F.split(question, r"(?i)\band\b|[,;]"), T.trim_all), lambda p: F.length(p) > 3)


# Words that make a question broad, or one of several hops.
_BROAD = r"(?i)\b(overall|summari[sz]e|overview|themes?|in general|all of|everything|main)\b"
_HOPS = r"(?i)\b(who|which|whose)\b.*\b(that|who|whose|which|before|after|and)\b"


def route(question: Column) -> Column:
    """struct(category, k, decompose): broad, multi_hop or specific; k between 3 and 5."""
    category = F.when(F.regexp_like(question, F.lit(_BROAD)), "broad").when(F.regexp_like(question, F.lit(_HOPS)), "multi_hop").otherwise("specific")
    return F.struct(category.alias("category"), F.when(category == "specific", 3).otherwise(5).alias("k"), (category == "multi_hop").alias("decompose"))


def normal_route(category: Column, k: Column) -> Column:
    """A reply's route made valid: an unknown category is specific; k is rounded and between 3 and 5, 5 if it is no number."""
    valid = F.when(category.isin("specific", "broad", "multi_hop"), category).otherwise("specific")
    n = F.when(k.isNull() | F.isnan(k.cast("double")), F.lit(5)).otherwise(F.least(F.lit(5), F.greatest(F.lit(3), F.floor(k.cast("double") + 0.5)))).cast("int")
    return F.struct(valid.alias("category"), n.alias("k"))


def rerank_score(question: Column, text: Column) -> Column:
    """MDL-5: 0 to 10: the share of the question's stems that a passage holds."""
    q = F.array_distinct(T.stems(question))
    return F.when(F.size(q) > 0, 10.0 * F.size(F.array_intersect(q, F.array_distinct(T.stems(text)))) / F.size(q)).otherwise(0.0)


def answer(question: Column, context: Column) -> Column:
    """MDL-2: the sentence of the context that shares most words with the question, the first of equal ones; empty without a context.

    The signature has no reference answer: it can't leak into an answer.
    """
    asked = F.array_distinct(T.stems(question))
    scored = F.transform(T.split_sentences(context), lambda s, i: F.struct(F.size(F.array_intersect(asked, F.array_distinct(T.stems(s)))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], F.lit(""))


def overlap(a: Column, b: Column) -> Column:
    """The share of a's stems that b holds, 0 if a has none."""
    s = F.array_distinct(T.stems(a))
    return F.coalesce(F.when(F.size(s) > 0, F.size(F.array_intersect(s, F.array_distinct(T.stems(b)))) / F.size(s)), F.lit(0.0))


def judge(question: Column, reply: Column, reference: Column, context: Column) -> Column:
    """MDL-3: struct(faithfulness, factual_correctness, answer_relevance, verdict) by shared words; zeros and fail for an empty reply."""
    empty = T.trim_all(F.coalesce(reply, F.lit(""))) == ""
    faith, fact, rel = overlap(reply, context), overlap(reference, reply), overlap(question, reply)
    verdict = F.when(fact >= 0.75, "pass").when(fact >= 0.4, "partial").otherwise("fail")
    zero = lambda c: F.round(F.when(empty, 0.0).otherwise(c), 6)
    return F.struct(zero(faith).alias("faithfulness"), zero(fact).alias("factual_correctness"), zero(rel).alias("answer_relevance"), F.when(empty, "fail").otherwise(verdict).alias("verdict"))


def summarize(title: Column, members: Column) -> Column:
    """MDL-7: a community's summary: its first members by name."""
    return F.concat(title, F.lit(": "), F.array_join(F.slice(members, 1, 25), ", "))


def chunk_header(document: Column, chunk: Column) -> Column:
    """MDL-6: a sentence on where a chunk stands: the first of the first 6 000 characters of its document; null if it has eight characters or fewer."""
    first = F.regexp_replace(F.get(T.split_sentences(F.left(document, F.lit(6000))), F.lit(0)), f"[{T.WS}]+", " ")
    return F.when((F.length(first) > 8) & chunk.isNotNull(), first)


def generated_question(text: Column) -> Column:
    """MDL-8: struct(question, answer, keywords) on a chunk: its first sentence as the answer, its longest words as keywords."""
    first = F.get(T.split_sentences(text), F.lit(0))
    words = F.array_distinct(F.filter(T.content_tokens(first), lambda w: F.length(w) > 5))
    return F.struct(F.concat(F.lit("What is said about "), F.array_join(F.slice(words, 1, 2), " and "), F.lit("?")).alias("question"), first.alias("answer"), F.slice(words, 1, 5).alias("keywords"))
