"""Many patterns in one text, and the position-distance rank."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def positions(text: Column, keyword: str) -> Column:
    """0-based places of a keyword, overlapping ones too; pass normalised text."""
    n = len(keyword)
    ends = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(ends, lambda i: F.substr(text, i, F.lit(n)) == keyword), lambda i: i - 1)


def keyword_positions(text: Column, keywords: Iterable[str]) -> Column:
    """A map from each keyword that occurs to its places."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), positions(text, k).alias("v")) for k in dict.fromkeys(keywords) if k])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["v"]) > 0))


MISSES, STEPS = 2, 5


def rescore_value(words: Sequence[str], name: str | None) -> int:
    """Rank of a name by how closely the words follow each other in it: 5 << 52 | (7 - misses) << 48 | steps left << 44; 0 with more than two misses.

    Each word found moves on by its least distance to the place before, taken without sign; any move but one place uses up one of
    five steps, and with none left the words after it count as missed.
    """
    found, left, at = 0, STEPS, None
    for w in words:
        places = [i for i in range(len(name or "")) if w and name.startswith(w, i)]
        if not places:
            continue
        found += 1
        if at is None:
            at = places[0]
            continue
        move = min(abs(p - at) for p in places)
        at += move
        left -= move != 1
        if not left:
            break
    misses = len(words) - found
    return (5 << 52) | (7 - misses) << 48 | left << 44 if misses <= MISSES else 0


def rescore(name: Column, words: Sequence[str]) -> Column:
    """rescore_value over a column of normalised names."""

    @F.pandas_udf("long")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda n: rescore_value(words, n))

    return score(name)
