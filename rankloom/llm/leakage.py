"""Evaluation passages inside a training corpus: which documents hold which items, wholly or in part.

A document leaks an item if it holds RUN consecutive words of it, or SHARE of its words in their order within one
passage. Words are compared after undoing case, accents, punctuation, spacing, line marks, markup and escapes.

Candidates for runs are shared blocks of BLOCK consecutive words. Candidates for passages are counted: a passage that lacks
at most n - need of the n words of an item holds at least k of its n - need + k rarest ones, whatever is replaced, deleted
or put in between. The documents are cut into overlapping stretches, each passage lies in one, and where a stretch holds
fewer of the rare words than that, no passage is lost by leaving it out. All others are verified exactly.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.batches import slices

RUN = 12
SHARE = 0.8
#: A passage has at most this many words for each word of the item.
PASSAGE = 1.5
BLOCK = 4
#: Scores held at a time (stretches by items).
SCORES = 1_000_000
#: Items are searched in blocks of so many, each with a pass over the corpus: what a task holds doesn't grow with the items.
ITEMS_A_PASS = 5_000

_TAG = re.compile(r"<[^<>]*>")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\[nrtbf]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+")
_BROKEN = re.compile(r"(?<=\w)-\r?\n[ \t>|*#]*(?=[a-z])")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_TARGET = re.compile(r"\]\([^()\s]*(?:\s\"[^\"]*\")?\)|\[\^?\d{1,3}\]")
_LINE_NUMBER = re.compile(r"^[ \t>|]*\d{1,6}[:.)\]|][ \t]+", re.M)
_WORD = re.compile(r"[^\W_]+")


def _octets(pattern_text: str, mark: str) -> str:
    raw = bytes.fromhex(pattern_text.replace(mark, ""))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def plain(text: str | None) -> str:
    """The text in lower case without accents, escapes, tags, link targets and hidden characters."""
    t = text or ""
    if "\\" in t:
        t = _ESCAPE.sub(" ", _UNICODE.sub(lambda m: chr(int(m[1], 16)), t))
    if "%" in t:
        t = _PERCENT.sub(lambda m: _octets(m[0], "%"), t)
    if "=" in t:
        t = _QUOTED.sub(lambda m: _octets(m[0], "="), t.replace("=\r\n", "").replace("=\n", ""))
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "<" in t:
        t = _TAG.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", _HIDDEN.sub("", t))
        t = "".join(c for c in t if not unicodedata.combining(c)).replace("ß", "ss")
    if "-" in t:
        t = _BROKEN.sub("", t)
    if "](" in t or "[" in t:
        t = _TARGET.sub(" ", t)
    return t.lower()


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    return _WORD.findall(plain(text))


def readings(text: str | None) -> list[list[str]]:
    """The words of a text, and once more without numbers at the start of lines where there are any: they may be line marks or words."""
    t = plain(text)
    bare = _LINE_NUMBER.sub("", t)
    return [_WORD.findall(t)] + ([_WORD.findall(bare)] if len(bare) < len(t) else [])


_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class _Level:
    """Items of about one length: the longest passage, the rare words each must show, and postings of those by word."""

    length: int
    items: np.ndarray
    least: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray


@dataclass
class Index:
    """The items of one pass: vocabulary, blocks, rare words."""

    ids: list
    texts: list[list[str]]
    vocabulary: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.size = len(self.vocabulary) + 1
        self.words = [np.array([self.vocabulary[w] for w in t], np.int64) for t in self.texts]
        spread = np.zeros(self.size)
        for w in self.words:
            spread[np.unique(w)] += 1
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.offset = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        keys, item, at = [], [], []
        for i, w in enumerate(self.words):
            k = self.blocks(w)
            keys.append(k)
            item.append(np.full(len(k), i))
            at.append(np.arange(len(k)))
        keys, item, at = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, np.uint64), (item, np.int64), (at, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]
        self.known = np.unique(self.keys)
        self.need = [-(-len(w) * 4 // 5) for w in self.words]
        self.reach = [int(len(w) * PASSAGE) for w in self.words]
        levels: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) >= BLOCK:
                levels.setdefault(1 << (self.reach[i] - 1).bit_length(), []).append(i)
        self.levels = [self.rare(length, members, spread) for length, members in sorted(levels.items())]

    def rare(self, length: int, members: list[int], spread: np.ndarray) -> _Level:
        """The rarest words of items whose passages have at most ``length`` words, by word."""
        least, pieces = [], []
        for local, i in enumerate(members):
            w = self.words[i]
            least.append(max(1, len(w) // 5))
            word, times = np.unique(w[np.lexsort((w, spread[w]))][: len(w) - self.need[i] + least[-1]], return_counts=True)
            pieces.append(np.stack([word, np.full(len(word), local), times]))
        table = np.concatenate(pieces, 1)
        word, item, times = table[:, np.argsort(table[0], kind="stable")]
        return _Level(length, np.array(members), np.array(least), np.searchsorted(word, np.arange(self.size + 1)), item, times)

    def stretches(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """For every document (item, from, to) of the stretches that may hold a passage of the item."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        sizes = np.array([len(w) for w in docs], np.int64)
        if not sizes.sum():
            return out
        word = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), sizes)
        at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for level in self.levels:
            number = np.maximum(1, -(-sizes // level.length) - 1)
            first = np.cumsum(number) - number
            counts = np.diff(level.starts)
            some = counts[word] > 0
            part, of, which = at[some] // level.length, doc[some], word[some]
            own, before = part < number[of], part > 0  # a stretch is two parts long and begins with each part
            keys = np.unique(np.concatenate([(first[of] + part)[own] * self.size + which[own], (first[of] + part - 1)[before] * self.size + which[before]]))
            stretch, which = keys // self.size, keys % self.size
            width = len(level.items)
            step = max(1, SCORES // width)
            for low in range(0, int(number.sum()), step):
                a, b = np.searchsorted(stretch, [low, low + step])
                times = counts[which[a:b]]
                where = np.repeat(level.starts[which[a:b]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                score = np.bincount((np.repeat(stretch[a:b], times) - low) * width + level.item[where], level.times[where])
                for k in np.flatnonzero(score >= np.tile(level.least, -(-len(score) // width))[: len(score)]).tolist():
                    n = low + k // width
                    d = int(np.searchsorted(first, n, "right")) - 1
                    begin = (n - int(first[d])) * level.length
                    out[d].append((int(level.items[k % width]), begin, begin + 2 * level.length))
        return out

    def blocks(self, w: np.ndarray) -> np.ndarray:
        n = len(w) - BLOCK + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(BLOCK):
            key = (key ^ (w[j : j + n] + 1).astype(np.uint64)) * _MIX
        return key

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, item, place in the item) of every block they share."""
        unknown = np.concatenate([[0], np.cumsum(w == self.size - 1)])
        n = len(w) - BLOCK + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3
        places = np.flatnonzero(unknown[BLOCK:] == unknown[:n])
        key = self.blocks(w)[places]
        there = np.searchsorted(self.known, key)
        found = (there < len(self.known)) & (self.known[np.minimum(there, len(self.known) - 1)] == key) if len(self.known) else np.zeros(len(key), bool)
        places, key = places[found], key[found]
        first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        counts = last - first
        where = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place, item, at = np.repeat(places, counts), self.item[where], self.at[where]
        start = self.offset[item] + at
        same = np.ones(len(place), bool)
        for j in range(BLOCK):  # equal keys of different words drop out
            same &= w[place + j] == self.flat[start + j]
        return place[same], item[same], at[same]


def in_order(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in passage.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def passage(item: np.ndarray, w: np.ndarray, need: int, reach: int) -> int:
    """Words of the item in their order within ``reach`` words of w, or fewer than ``need`` if no place has as many."""
    inside = np.concatenate([[0], np.cumsum(np.isin(w, item))])
    if inside[-1] < need:
        return 0
    enough = inside[np.minimum(np.arange(len(w)) + reach, len(w))] - inside[:-1] >= need
    best = 0
    for s in np.flatnonzero(enough & np.isin(w, item[: len(item) - need + 1])).tolist():
        best = max(best, in_order(item, w[s : s + reach]))
        if best >= need:
            break
    return best


def leaks(w: np.ndarray, index: Index, stretches: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(item, kind, words found) for one document given as vocabulary numbers, with its stretches."""
    out = []
    done = set()
    place, item, at = index.hits(w)
    if len(place):
        order = np.lexsort((place, place - at, item))
        place, item, at = place[order], item[order], at[order]
        diagonal = place - at
        start = np.ones(len(place), bool)
        start[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
        runs = np.flatnonzero(start)
        lengths = np.diff([*runs, len(place)]) + BLOCK - 1
        for i in np.unique(item[runs[lengths >= RUN]]).tolist():
            done.add(i)
            out.append((i, "run", int(lengths[item[runs] == i].max())))
    for i, a, b in stretches:
        if i not in done and (best := passage(index.words[i], w[a:b], index.need[i], index.reach[i])) >= index.need[i]:
            done.add(i)
            out.append((i, "passage", best))
    return out


FOUND = "doc_id bigint, item_id bigint, kind string, words int"


def _search(items: list[tuple[int, list[str]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index([i for i, _ in items], [t for _, t in items])
        lookup, none = index.vocabulary.get, index.size - 1
        for pdf in slices(batches):
            read = [(n, np.array([lookup(x, none) for x in reading], np.int64)) for n, text in enumerate(pdf["text"]) for reading in readings(text)]
            best: dict[tuple[int, int], tuple[str, int]] = {}
            for (n, w), stretches in zip(read, index.stretches([w for _, w in read])):
                for i, kind, found in leaks(w, index, stretches):
                    best[n, i] = max(best.get((n, i), ("", 0)), (kind, found))
            docs = pdf["doc_id"].tolist()
            rows = [(docs[n], index.ids[i], *b) for (n, i), b in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "words"])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """doc_id, item_id, kind (run or passage) and the words found, for every leak in the whole texts.

    The items are a stated query set: they are read in blocks of ``items_a_pass`` (held by each task), the documents are
    scanned once a block and never shuffled. Items with fewer than BLOCK words and null texts are no items and give no row;
    rows that occur twice give their leaks twice; other columns are ignored.
    """
    spark = documents.sparkSession
    passes, held = [], []
    for row in benchmark.select("item_id", "text").where("text is not null").dropDuplicates(["item_id"]).toLocalIterator():
        held.append((row.item_id, words(row.text)))
        if len(held) >= items_a_pass:
            passes.append(held)
            held = []
    passes += [held] if held else []
    out = spark.createDataFrame([], FOUND)
    for items in passes:
        out = out.unionByName(documents.select("doc_id", "text").mapInPandas(_search(items), FOUND))
    return out


def leaked(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "item_id").distinct()


def report(found: DataFrame) -> DataFrame:
    """How many documents leak each item, by kind."""
    return found.groupBy("item_id", "kind").agg(F.countDistinct("doc_id").alias("documents"))
