"""Splitting oversized items at natural boundaries, with headings, offsets and a bounded overlap.

A document falls into sections at its heading lines; a section's body is cut into pieces of at most LIMIT tokens. The
sorted arrays of its paragraph, sentence and word boundaries are searched by bisection for the last boundary
at which the prefix sum of tokens is still within the limit; the next piece starts at the first boundary that is at most
OVERLAP tokens back. Where there is no boundary, the cut is hard.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.batches import slices
from rankloom.sources.records import SPACE

LIMIT_TOKENS = 260
OVERLAP_TOKENS = 40
#: The estimate: a token has four characters (code points).
CHARS_PER_TOKEN = 4

_HEADING = re.compile(r"^(#{1,6})[ \t]+(?=\S)(.*)$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*\s+|(?<=[。！？])|\n+\s*")
_GAP = re.compile(rf"[{SPACE}]+")
_LEAD = re.compile(rf"[{SPACE}]*")
_BLANKS = "".join(c for c in map(chr, range(0x3100)) if _GAP.match(c)) + "\ufeff"


@dataclass
class Section:
    path: list[str]
    start: int
    end: int


def sections(text: str) -> list[Section]:
    """The non-blank sections of a text; start and end are code points, without white space at both ends of the body."""
    out: list[Section] = []
    path: list[str] = []
    fence = ""
    at = body = 0

    def close(end: int) -> None:
        chunk = text[body:end]
        lead = _LEAD.match(chunk).end()
        if lead < len(chunk):
            out.append(Section(list(path), body + lead, body + len(chunk.rstrip(_BLANKS))))

    for line in text.split("\n"):
        following = at + len(line) + 1
        bare = line.rstrip("\r")
        mark = _FENCE.match(bare)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif heading := _HEADING.match(bare):
            close(at)
            level = len(heading[1])
            path[:] = [*path[: level - 1], *[""] * (level - 1 - len(path)), heading[2].strip()]
            body = min(following, len(text))
        at = following
    close(len(text))
    return out


class Cutter:
    """Boundaries and token prefix sums of one body."""

    def __init__(self, body: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS, chars: int = CHARS_PER_TOKEN):
        self.body, self.limit, self.overlap = body, limit * chars, overlap * chars
        ends = lambda pattern: sorted({m.end() for m in pattern.finditer(body)} | {len(body)})
        self.levels = [ends(_PARAGRAPH), ends(_SENTENCE), ends(_GAP)]
        #: Prefix sums in parts of a token: a character counts one.
        self.sums = np.arange(len(body) + 1)

    def reach(self, start: int) -> int:
        """The last offset within the limit from start."""
        return int(np.searchsorted(self.sums, self.sums[start] + self.limit, "right")) - 1

    def cut(self, start: int, least: int) -> int:
        """The last paragraph boundary in reach if it leaves a piece of half the limit, else the last sentence boundary, else a word's, else a hard cut."""
        far = self.reach(start)
        for level, low in ((0, max(least, start + self.limit // 2)), (1, least), (0, least), (2, least)):
            k = bisect_right(self.levels[level], far) - 1
            if k >= 0 and self.levels[level][k] > low:
                return self.levels[level][k]
        return far

    def back(self, start: int, end: int) -> int:
        """Where the next piece starts: the first sentence boundary within the overlap before end, else the first word's, else end."""
        low = max(start + 1, end - self.overlap)
        for level in (1, 2):
            k = bisect_left(self.levels[level], low)
            if k < len(self.levels[level]) and self.levels[level][k] < end:
                return self.levels[level][k]
        return max(low, end - self.overlap) if end - start >= self.limit else end

    def pieces(self) -> list[tuple[int, int]]:
        out, start, done = [], 0, 0
        while done < len(self.body):
            end = len(self.body) if self.reach(start) >= len(self.body) else self.cut(start, done)
            trimmed = start + len(self.body[start:end].rstrip(_BLANKS))
            if trimmed > start:
                out.append((start, trimmed))
            start, done = (self.back(start, end), end) if end < len(self.body) else (end, end)
        return out


SCHEMA = "doc_id string, section_start bigint, section_chars int, heading_path array<string>, ordinal int, char_start bigint, char_end bigint, token_estimate int, text string"


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ordinal = 0
                for s in sections(text or ""):
                    for a, b in Cutter(text[s.start : s.end], limit, overlap).pieces():
                        chars = b - a
                        rows.append((doc, s.start, s.end - s.start, s.path, ordinal, s.start + a, s.start + b, -(-chars // CHARS_PER_TOKEN), text[s.start + a : s.start + b]))
                        ordinal += 1
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return run


def split(documents: DataFrame, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """The pieces of all sections of every text, none over the limit; needs doc_id and text, ignores other columns.

    Null, empty and blank texts give no piece. Consecutive pieces of a section share at most the overlap, and together
    they cover its body but for white space at the cuts. Each input row is split on its own: no shuffle, no state across rows.
    """
    return documents.select("doc_id", "text").mapInPandas(_split(limit, overlap), SCHEMA)


def oversized(pieces: DataFrame) -> DataFrame:
    """The sections that had to be cut, by the offset of their body: those with a piece that begins inside."""
    return pieces.where(F.col("char_start") > F.col("section_start")).select("doc_id", F.col("section_start").alias("char_start")).distinct()
