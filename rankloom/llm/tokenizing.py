"""Encoding of a whole corpus with a public byte-level BPE: content-defined pieces are encoded once and joined.

A text's bytes are cut where a rolling hash of the last WINDOW bytes hits a pattern, so equal passages of different
texts give equal pieces, wherever they stand. Each distinct piece is encoded once. At a cut the ids of the two pieces
need not be those of the whole text; a join is repaired by encoding the words around the cut anew, from a place before it to a
place after it where the tokenizer's own word pattern breaks in the piece as in the whole text. From there on the ids agree exactly.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.batches import slices

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
WINDOW = 16
#: A piece ends on average after so many bytes, and has at least MIN_PIECE.
MEAN_PIECE = 1024
MIN_PIECE = 64
#: A cut is moved on to the next break of the word pattern, if one is that near; else the join is repaired.
NEAR = 32
# Fixed value: the word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer of a folder of vocabularies; special tokens are ordinary text for it."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


def cuts(data: np.ndarray, mean: int = MEAN_PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut UTF-8 bytes, and at which of these cuts the word pattern certainly breaks.

    It breaks before a blank that stands between a printing ASCII character and an ASCII letter or digit.
    """
    n = len(data)
    if n < 2 * MIN_PIECE:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    gear = _GEAR[data]
    h = np.zeros(n, np.uint32)
    for i in range(WINDOW):
        h[i:] += gear[: n - i] << np.uint32(i)
    hits = np.flatnonzero(h >> np.uint32(8) < (1 << 24) // mean) + 1
    hits = hits[hits < n]
    breaks = np.flatnonzero((data[1:-1] == 32) & _SOLID[data[:-2]] & _WORDLIKE[data[2:]]) + 1
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.searchsorted(breaks, hits)
    nearest = breaks[np.minimum(at, len(breaks) - 1)] if len(breaks) else np.full(len(hits), n + NEAR)
    snapped = (nearest >= hits) & (nearest - hits <= NEAR)
    places = np.where(snapped, nearest, hits)
    whole = (data[np.minimum(places, n - 1)] & 0xC0) != 0x80  # not inside a character
    out, safe, last = [], [], 0
    for p, s, w in zip(places.tolist(), snapped.tolist(), whole.tolist()):
        if w and p - last >= MIN_PIECE and n - p >= MIN_PIECE:
            out.append(p)
            safe.append(s)
            last = p
    return np.array(out, np.int64), np.array(safe, bool)


def _breaks(data: bytes, start: int, end: int) -> np.ndarray:
    """Places in data[start:end] where the word pattern certainly breaks."""
    a = np.frombuffer(data, np.uint8)[start:end]
    return np.flatnonzero((a[1:-1] == 32) & _SOLID[a[:-2]] & _WORDLIKE[a[2:]]) + 1 + start if len(a) > 2 else np.zeros(0, np.int64)


def plan(data: bytes, enc, mean: int = MEAN_PIECE, repair: bool = True) -> list[tuple[bytes, int, int, list[int]]]:
    """The pieces of a text with the repair of each: (piece, ids to drop at its start, at its end, ids to put after it).

    Joined as ``ids[drop_start : len - drop_end] + extra`` in order, they are exactly the ids of the whole text. Where a
    piece has no place of agreement in reach, the pieces are encoded as one. Without ``repair`` the pieces alone are right.
    """
    places, safe = cuts(np.frombuffer(data, np.uint8), mean)
    edges = [0, *places.tolist(), len(data)]
    text = lambda a, b: data[a:b].decode("utf-8")
    joins = {}
    keep = [0]
    for k, ok in enumerate(safe.tolist()):
        p, before, after = edges[k + 1], keep[-1], edges[k + 2]
        if not ok:
            left, right = _breaks(data, before, p), _breaks(data, p, after)
            floor = joins[before][1] if before in joins else before
            left = left[left >= floor]
            if not len(left) or not len(right):
                continue  # nothing agrees between the neighbouring cuts: no cut here
            joins[p] = (int(left[-1]), int(right[0]))
        keep.append(p)
    keep.append(len(data))
    out = []
    for a, b in zip(keep, keep[1:]):
        if not repair:
            out.append((data[a:b], 0, 0, []))
            continue
        start = len(enc.encode_ordinary(text(a, joins[a][1]))) if a in joins else 0
        end, extra = 0, []
        if b in joins:
            end = len(enc.encode_ordinary(text(joins[b][0], b)))
            extra = enc.encode_ordinary(text(*joins[b]))
        out.append((data[a:b], start, end, extra))
    return out


USES = "doc_id bigint, whole bigint, seq int, drop_start int, drop_end int, extra array<int>, key binary"


def _plans(batches: Iterator[pd.DataFrame], folder: str, vocabulary: str, mean: int, repair: bool = True):
    enc = encoder(folder, vocabulary)
    for pdf in slices(batches):
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            data = (text or "").encode("utf-8", "replace")
            yield doc, data, plan(data, enc, mean, repair)


def _in_frames(rows: Iterator[tuple], names: list[str], size: int = 5_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def _uses(folder: str, vocabulary: str, mean: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = _plans(batches, folder, vocabulary, mean)
        rows = ((doc, whole, seq, start, end, extra or None, xxhash.xxh3_128_digest(piece)) for doc, data, pieces in plans for whole in (xxhash.xxh3_64_intdigest(data) >> 1,) for seq, (piece, start, end, extra) in enumerate(pieces))
        yield from _in_frames(rows, ["doc_id", "whole", "seq", "drop_start", "drop_end", "extra", "key"])

    return run


def _distinct_pieces(folder: str, vocabulary: str, mean: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = _plans(batches, folder, vocabulary, mean, repair=False)
        yield from _in_frames(((xxhash.xxh3_128_digest(p[0]), p[0]) for *_, pieces in plans for p in pieces), ["key", "piece"])

    return run


def _encode(folder: str, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for pdf in batches:
            ids = [np.asarray(enc.encode_ordinary(p.decode("utf-8")), "<u2").tobytes() for p in pdf["piece"]]
            yield pd.DataFrame({"key": pdf["key"], "packed": ids})

    return run


JOINED = "doc_id bigint, ids array<int>"


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for packed, starts, ends, extras in zip(pdf["packed"], pdf["starts"], pdf["ends"], pdf["extras"]):
            if starts is None:
                out.append(np.frombuffer(b"".join(packed), "<u2").astype(np.int32))
                continue
            ids = []
            for p, start, end, extra in zip(packed, starts, ends, extras):
                own = np.frombuffer(p, "<u2")
                ids.append(own[start : len(own) - end])
                if extra is not None:
                    ids.append(np.asarray(extra))
            out.append(np.concatenate(ids).astype(np.int32))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": out})


def encode_corpus(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, mean: int = MEAN_PIECE) -> DataFrame:
    """doc_id and ids of every text, without special tokens and without any clean-up.

    Null and empty texts both give an empty list; blank ones are encoded. A doc_id that occurs twice with the same text counts once, with different texts once for each.
    Ids must be below 65 536, since they travel in two bytes. The texts are cut twice (cheap; joins are repaired once), so that nothing but distinct
    pieces, keys and packed ids is shuffled and no copy of the corpus is written; a piece that a third of all texts share is
    one row of the dictionary, and its uses are split by the engine's skew join.
    """
    texts = documents.select("doc_id", "text")
    pieces = texts.mapInPandas(_distinct_pieces(folder, vocabulary, mean), "key binary, piece binary")
    encoded = pieces.dropDuplicates(["key"]).mapInPandas(_encode(folder, vocabulary), "key binary, packed binary")
    uses = texts.mapInPandas(_uses(folder, vocabulary, mean), USES).join(encoded, "key")
    parts = uses.groupBy("doc_id", "whole").agg(F.sort_array(F.collect_set(F.struct("seq", "drop_start", "drop_end", "extra", "packed"))).alias("p"))
    repaired = F.exists("p", lambda x: (x["drop_start"] > 0) | (x["drop_end"] > 0) | x["extra"].isNotNull())
    each = lambda name: F.transform("p", lambda x: x[name])
    columns = [each("packed").alias("packed"), *[F.when(repaired, each(c)).alias(a) for c, a in (("drop_start", "starts"), ("drop_end", "ends"), ("extra", "extras"))]]
    return parts.select("doc_id", *columns).mapInPandas(_assemble, JOINED)
