"""Repetition inside a single document: cheap statistics of each text, robust outliers of them, and the exact count for those.

A word is a run of letters and digits in lower case; it is repeated if it lies in a run of six words that occurred
before in the same text. Counting that exactly is dear, so it is done only where robust statistics ask for it: repeated runs of
four words (which bound the repeated words from above), repeated words, sentences and paragraphs form a vector of logit-like values; a
minimum-covariance-determinant estimate of each language and source gives centre and scatter, and a text is rejected by its Mahalanobis distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm.batches import slices
from rankloom.session import cut, small_or_join

RUN, PART = 6, 4
MIN_WORDS = 20
THRESHOLD = 0.25
#: The first is the one that bounds the share.
STATS = ["fours", "again", "sentences", "paragraphs"]
#: Upper 97.5 % point of chi-squared with as many degrees of freedom as STATS has entries.
CUTOFF = 11.143
#: Smallest standard deviation taken for a transformed statistic, so that a group without any spread has a scatter.
FLOOR = 0.05
#: Groups with fewer texts are judged with all other small groups of their language.
MIN_GROUP = 50
CORE = 0.75
STEPS = 2

_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n\s*\n")

SKETCH = "doc_id bigint, lang string, source string, words int, fours double, again double, sentences double, paragraphs double"
SHARES = "doc_id bigint, words int, repeated int, share double"


def repeated_mask(ids: np.ndarray, text_of: np.ndarray, run: int = RUN) -> np.ndarray:
    """For words (as integers) of texts laid end to end: whether each lies in a run that occurred before in its text."""
    n = len(ids) - run + 1
    mask = np.zeros(len(ids), bool)
    if n <= 0:
        return mask
    # Doubling names equal runs by equal integers without any collision: runs of 1, 2, 4, then of 6 words.
    _, two = np.unique(ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    if run != 6:
        raise ValueError("runs of six words")
    _, four = np.unique(two[:-2].astype(np.int64) * (int(two.max()) + 1) + two[2:], return_inverse=True)
    six = four[: n].astype(np.int64) * (int(two.max()) + 1) + two[4 : 4 + n]
    starts = np.flatnonzero(text_of[:n] == text_of[run - 1 :])
    order = starts[np.lexsort((six[starts], text_of[starts]))]  # stable: of equal runs the earliest start first
    same = np.zeros(len(order), bool)
    same[1:] = (six[order[1:]] == six[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    again = order[same]
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _extra(parts: list[str]) -> float:
    parts = [p for p in (p.strip().lower() for p in parts) if p]
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        words = [_WORD.findall((t or "").lower()) for t in pdf["text"]]
        counts = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        ids = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(words)), counts)
        repeated = np.bincount(text_of, weights=repeated_mask(ids, text_of), minlength=len(words)).astype(int)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": counts, "repeated": repeated, "share": repeated / np.maximum(counts, 1)})


def measure(documents: DataFrame) -> DataFrame:
    """One row for each input row: words, repeated words and their share of its whole text.

    Null and empty texts have no word and a share of 0; columns other than doc_id and text are ignored.
    """
    return documents.select("doc_id", "text").mapInPandas(_measure, SHARES)


def bound(words: int, fours: int) -> float:
    """The most that the share of repeated words can be, by the number of different runs of PART words.

    Repeated words come in stretches of six or more; a stretch of L words holds L - 3 runs of four, all of which stood before. So
    the repeated words are at most twice the runs of four that aren't the first of their kind.
    """
    return min(1.0, RUN / (RUN - PART + 1) * max(0, words - PART + 1 - fours) / words) if words else 0.0


def _different(words: list[str]) -> int:
    """The number of different runs of PART words."""
    return len(set(zip(*(words[i:] for i in range(PART)))))


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        rows = []
        for doc, lang, source, text in zip(pdf["doc_id"], pdf["lang"], pdf["source"], pdf["text"]):
            low = (text or "").lower()
            words = _WORD.findall(low)
            if len(words) >= MIN_WORDS:
                rows.append((doc, lang, source, len(words), bound(len(words), _different(words)), 1 - len(set(words)) / len(words), _extra(low.replace("\n", ". ").split(". ")), _extra(_PARAGRAPH.split(low))))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SKETCH.split(", ")])


def sketch(documents: DataFrame) -> DataFrame:
    """The cheap statistics of every text of at least MIN_WORDS words."""
    return documents.select("doc_id", "text", "lang", "source").mapInPandas(_sketch, SKETCH)


def transformed(share: Column) -> Column:
    """Logit of a share, kept finite: spreads shares near 0 and near 1."""
    return F.log((share + 0.02) / (1.02 - share))


def _moments(df: DataFrame) -> DataFrame:
    names = [f"t_{s}" for s in STATS]
    return df.groupBy("g").agg(
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j],
    )


#: The variance of the inner three quarters of a normal sample in four dimensions, as a share of the whole variance.
CONSISTENCY = 1 / 0.62

MODEL = "g string, centre array<double>, inverse array<double>, bound double"


def _invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    k = len(STATS)
    for pdf in batches:
        rows = []
        for r in pdf.to_dict("records"):
            c = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    c[i, j] = c[j, i] = np.nan_to_num(r[f"c_{i}_{j}"]) * CONSISTENCY
            c[np.diag_indices(k)] = np.maximum(c.diagonal(), 0) + FLOOR**2
            centre = [float(np.nan_to_num(r[f"m_t_{s}"])) for s in STATS]
            rows.append((r["g"], centre, np.linalg.inv(c).ravel().tolist(), centre[0] + float(np.sqrt(CUTOFF * c[0, 0]))))
        yield pd.DataFrame(rows, columns=["g", "centre", "inverse", "bound"])


def _distance() -> Column:
    names = [f"t_{s}" for s in STATS]
    k = len(names)
    d = [F.col(c) - F.col("centre")[i] for i, c in enumerate(names)]
    return sum((F.col("inverse")[i * k + j] * d[i] * d[j] for i in range(k) for j in range(k)), F.lit(0.0))


def outliers(documents: DataFrame) -> DataFrame:
    """Cheap statistics of each text of at least MIN_WORDS words, its squared robust distance, whether it is rejected, and
    ``suspect``: rejected, or of a group whose own accepted region reaches THRESHOLD.

    The estimate is a deterministic minimum covariance determinant: start from the coordinate-wise medians, keep the
    three quarters of a group with the smallest distances, take their mean and covariance, repeat. Every step is an
    aggregate over all texts; a group, of whatever size, is never gathered. Within a group the bound on the share of a text that isn't
    rejected is at most that of centre + sqrt(CUTOFF * variance); where this is below THRESHOLD, no text with a larger share
    is missed, and where it isn't, all texts of the group are suspects. So a source full of spam, which has no outliers, loses none.
    """
    stats = sketch(documents)
    key = F.concat_ws("/", F.lower(F.coalesce("lang", F.lit("?"))), F.coalesce("source", F.lit("?")))
    base = cut(stats.withColumn("key", key).withColumn("pool", F.lower(F.coalesce("lang", F.lit("?")))))
    t = base.select("*", *[transformed(F.col(s)).alias(f"t_{s}") for s in STATS])
    sizes = t.groupBy("key").agg(F.count("*").alias("n"))
    t = t.join(sizes, "key", "left").withColumn("g", F.when(F.col("n") >= MIN_GROUP, F.col("key")).otherwise(F.col("pool"))).drop("n", "key", "pool")
    names = [f"t_{s}" for s in STATS]
    medians = t.groupBy("g").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"md_{c}") for c in names])
    spread = t.join(medians, "g").groupBy("g").agg(
        *[F.first(f"md_{c}").alias(f"m_{c}") for c in names],
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"md_{c}")), CORE, 1000).alias(f"s_{c}") for c in names],
    )
    start = spread.select("g", *[f"m_{c}" for c in names], *[(F.pow(F.col(f"s_{a}"), 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, _ in enumerate(names) if i <= j])
    model = cut(start.mapInPandas(_invert, MODEL))
    for _ in range(STEPS):
        scored = t.join(model, "g").withColumn("d2", _distance()).select("g", *names, "d2")
        core = scored.groupBy("g").agg(F.percentile_approx("d2", CORE, 1000).alias("reach"))
        model = cut(_moments(scored.join(core, "g").where("d2 <= reach")).mapInPandas(_invert, MODEL))
    scored = t.join(model, "g").withColumn("distance", _distance())
    rejected = F.col("distance") > CUTOFF
    reaches = F.col("bound") >= float(np.log((THRESHOLD + 0.02) / (1.02 - THRESHOLD))) - 1e-9
    return scored.select("doc_id", "lang", "source", "words", *STATS, "distance", rejected.alias("rejected"), (rejected | reaches).alias("suspect"))


def repetitive(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """The texts whose share of repeated words is at least THRESHOLD, counted exactly among the suspects alone."""
    suspects = small_or_join(cut(scored.where("suspect").select("doc_id").distinct()))
    exact = measure(documents.select("doc_id", "text").join(suspects, "doc_id", "left_semi"))
    return exact.where((F.col("words") >= MIN_WORDS) & (F.col("repeated") >= F.lit(THRESHOLD) * F.col("words"))).select("doc_id").distinct()
