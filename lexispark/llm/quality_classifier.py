"""Quality by naive Bayes support vectors.

Features are indicators of n-grams of words and of word shapes, hashed to 2^18. A word's shape is its run-length
free string of character kinds (upper U, lower l, digit 9, other letters l, any other byte itself), marked if the word
equals the one before. Each indicator is scaled by the log-count ratio of the classes, and a linear model with hinge loss is fitted to the scaled
indicators, each row at unit length, by dual coordinate descent. A logistic curve over the margins, fitted to rows that the model has not seen, gives the score.

Nulls: a null or empty text has no indicators and gets the score of the bias; a null doc_id is allowed; labels without an id or value are not used. Repeated rows are scored alike. With no labels, or one class only, all
scores are 0.5. Texts and words of any length are read whole; rows of equal hashes or margins need no order, so there are no ties to settle. An empty table gives an empty result. Other
columns, of any name, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, table
from .supervised import fit, logistic, report, scored

BITS = 18
#: Labelled documents of each class that the model is fitted to, at most.
PER_CLASS = 5000

KIND = bytes(ord("U") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else ord("l") if 97 <= b <= 122 or b >= 128 else b for b in range(256))


RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    return RUN.sub(rb"\1", word.translate(KIND))


class Hashes(dict):
    """Hashes of words and of their shapes, kept for the words of recent texts."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        self[word] = v = (xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape(word), 2))
        return v


def indicators(text: bytes, hashes: Hashes) -> np.ndarray:
    """The distinct feature numbers of a text."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    both = np.array([hashes[w] for w in words], np.uint64)
    w, s = both[:, 0], both[:, 1].copy()
    s[1:][w[1:] == w[:-1]] ^= np.uint64(0x9E3779B97F4A7C15)
    odd = lambda x, k: x * np.uint64(k)
    streams = [w, s]
    if len(words) > 1:
        streams += [odd(w[:-1], 0xD6E8FEB86659FD93) + w[1:], odd(s[:-1], 0xA0761D6478BD642F) + s[1:]]
    if len(words) > 2:
        streams.append(odd(s[:-2], 0xE7037ED1A0B428DB) + odd(s[1:-1], 0x8EBC6AF09C88C6E3) + s[2:])
    ids = (mix64(np.concatenate(streams)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(ids) if len(ids) < 1 << 16 else np.flatnonzero(np.bincount(ids, minlength=1 << BITS))


def log_count_ratio(x: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([x[i] for i in np.flatnonzero(y == c)]), minlength=1 << BITS) + smooth for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(x: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + cost * sum of hinge losses, over rows of indicators scaled by r and to unit length; y is 1 or -1.

    Each step solves one dual variable exactly, within 0 and its class's cost, and keeps w in step.
    """
    share = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (-1, 1)}
    norms = [max(1e-12, float(np.sqrt((r[f] ** 2).sum()))) for f in x]
    w, bias, alpha, order = np.zeros(len(r)), 0.0, np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            f = x[i]
            v = r[f] / norms[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / (float(v @ v) + 1), 0.0), cost * share[y[i]])
            if (d := (new - alpha[i]) * y[i]) != 0:
                alpha[i] = new
                w[f] += d * v
                bias += d
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def margin(f: np.ndarray, model: dict) -> float:
    """Of the row of indicators f."""
    if not len(f):
        return model["bias"]
    return float(model["scaled"][f].sum()) / max(1e-12, math.sqrt(float(model["square"][f].sum()))) + model["bias"]


def linear(x: list[np.ndarray], y: np.ndarray) -> dict:
    r = log_count_ratio(x, y)
    w, bias = dual_coordinate_descent(x, r, np.where(y == 1, 1, -1))
    return {"scaled": (w * r).astype(np.float32), "square": (r * r).astype(np.float32), "bias": float(bias)}


def train(texts: list[bytes], y: np.ndarray) -> dict:
    hashes = Hashes()
    x = [indicators(t, hashes) for t in texts]
    aside = np.arange(len(y)) % 4 == 3
    both = lambda m: len(set(y[m].tolist())) == 2
    if not (both(aside) and both(~aside)):
        aside = np.zeros(len(y), bool)
    model = linear([x[i] for i in np.flatnonzero(~aside)], y[~aside])
    rest = np.flatnonzero(aside) if aside.any() else np.arange(len(y))
    m = np.array([[margin(x[i], model)] for i in rest])
    return model | {"curve": logistic(m, y[rest].astype(float))}


def scorer(model: dict) -> Callable[[bytes], float]:
    hashes, (slope, at) = Hashes(), model["curve"]

    def score(text: bytes) -> float:
        z = slope * margin(indicators(text, hashes), model) + at
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """docs (doc_id, text) to (doc_id, score)."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels, "quality", per_class, train), scorer).select("doc_id", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)
