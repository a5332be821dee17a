"""Slices of Arrow batches bounded by the amount of text in them, so that long texts don't swell a worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

CHARS = 2_000_000


def slices(batches: Iterator[pd.DataFrame], column: str = "text", chars: int = CHARS) -> Iterator[pd.DataFrame]:
    """The rows of all batches in order, in slices of about ``chars`` characters of a column, one row at least."""
    for pdf in batches:
        lengths = pdf[column].str.len().fillna(0).to_numpy()
        part = (np.cumsum(lengths) - lengths) // chars
        for _, rows in pdf.groupby(part, sort=False) if len(pdf) else ():
            yield rows.reset_index(drop=True)
