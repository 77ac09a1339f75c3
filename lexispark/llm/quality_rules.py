"""Quality rules with line labels from a linear-chain conditional random field.

Each line of a text (split at \\n) with a word is labelled content or boilerplate by Viterbi decoding; a text is
kept if it passes the base rules and its content lines hold at least half of its lines' bytes.

The field has two labels, transition weights and weights for binary line features: shares of symbols, capitals, digits and bars, line length,
ending, repeats of earlier lines and of words within the line. Nobody has labelled lines, so they are hidden: the supervision is the quality mark of whole
documents, which is no function of the features. Training alternates two steps over a bounded sample. First the lines' posterior under the present
field is moved, by one weight for each document, until the expected boilerplate share is at least MOST in documents of low quality and at most
LEAST in the others. Then the field's likelihood under these soft labels is climbed, with gradients from the forward-backward recursion. So the
field itself finds which signs tell low documents apart, and how lines follow each other: a plain line amid junk goes with its neighbours.

The sample is the PER_CLASS labelled ids of each class with the smallest hashes, never those of the held-out fold, of each text at most LINES successive lines from a place
drawn by its hash. Copies and the table's size do not change it.

Nulls: a null or empty text has no words, fails the base rules and is not kept; a null doc_id is allowed. Texts of any length are judged whole. Repeated rows get equal
results, and content wins ties. An empty table gives an empty result. Without labels of both classes every line is content, and the base rules alone decide. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import supervised
from .common import table, utf8

#: Labelled documents of each class that the field is fitted to, at most, and successive lines of each.
PER_CLASS, LINES = 400, 40
#: Expected boilerplate shares that low documents reach and others stay within, while the field is trained.
MOST, LEAST = 0.8, 0.05
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
UPPER, DIGITS, LOWER = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(97, 123))
HIGH = bytes(range(128, 256))
FEATURES = ("bias", "symbols5", "symbols15", "bars", "shout", "digits", "short", "few words", "long words", "no end", "seen", "seen twice", "repeats30", "repeats60", "marks", "first", "last")


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[128:192].sum() - sum(counts[b] for b in SPACE))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, int(sum(counts[b] for b in SYMBOLS)), dup, repeat_words(words)


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key = ids[:n]
    for k in range(1, size):  # exact: pairs are renumbered before the next word joins them
        key = np.unique(key, return_inverse=True)[1] * len(number) + ids[k : k + n]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    ends = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(times[at] > 1)
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + size, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def line_features(lines: list[bytes]) -> np.ndarray:
    """lines x FEATURES, of lines that have a word each."""
    seen: dict[bytes, int] = {}
    rows = []
    for k, line in enumerate(lines):
        w = line.split()
        n = len(line)
        low, up = n - len(line.translate(None, LOWER + HIGH)), n - len(line.translate(None, UPPER))
        sym, dig = n - len(line.translate(None, SYMBOLS)), n - len(line.translate(None, DIGITS))
        marks = line.count(b"!") + line.count(b"?")
        again = seen.get(line, 0)
        seen[line] = again + 1
        rep = sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w) - 1)
        size = (n - len(w) + 1) / len(w)
        rows.append((1, sym > 0.05 * n, sym > 0.15 * n, line.count(b"|") * 4 >= len(w), up > 2 * low and up > 3, dig > 0.3 * n, n < 25, len(w) < 4, size > 18, line.rstrip()[-1:] not in (b".", b"!", b"?", b":", b";", b'"', b")"), again > 0, again > 1, rep > 0.3 and len(w) > 3, rep > 0.6 and len(w) > 3, marks > 0.3 * len(w) and marks > 2, k == 0, k == len(lines) - 1))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def marginals(score: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sequences (sequences x lines x labels), run through the recursions together: probabilities of the labels, and expected transitions."""
    score = score * live[:, :, None]
    fore, back = np.zeros_like(score), np.zeros_like(score)
    fore[:, 0] = score[:, 0]
    for t in range(1, score.shape[1]):
        go = log_sum(fore[:, t - 1, :, None] + trans[None], 1) + score[:, t]
        fore[:, t] = np.where(live[:, t, None] > 0, go, fore[:, t - 1])
    for t in range(score.shape[1] - 2, -1, -1):
        go = log_sum(trans[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(live[:, t + 1, None] > 0, go, 0)
    z = log_sum(fore[:, -1], 1)[:, None, None]
    both = np.exp(fore[:, :-1, :, None] + trans[None, None] + (score + back)[:, 1:, None, :] - z[:, :, :, None]) * (live[:, 1:] * live[:, :-1])[:, :, None, None]
    return np.exp(fore + back - z) * live[:, :, None], both.sum(axis=(0, 1))


def constrained(score: np.ndarray, trans: np.ndarray, live: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals with each document's boilerplate scores raised or lowered until its expected share keeps within bounds."""
    n = live.sum(axis=1)

    def moved(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marginals(score + np.stack([np.zeros_like(by), by], axis=1)[:, None, :], trans, live)

    share = lambda p: p[:, :, 1].sum(axis=1) / n
    free = share(marginals(score, trans, live)[0])
    bad = np.where(low, free < MOST, free > LEAST)
    a, b = np.where(low, 0.0, -30.0), np.where(low, 30.0, 0.0)
    for _ in range(14):
        middle = (a + b) / 2
        over = share(moved(middle)[0]) > np.where(low, MOST, LEAST)
        a, b = np.where(over, a, middle), np.where(over, middle, b)
    return moved(np.where(bad, (a + b) / 2, 0.0))


def train(sequences: list[np.ndarray], low: np.ndarray, rounds: int = 8, steps: int = 25, rate: float = 1.0, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (features x 2) and transitions (2 x 2) from documents' lines and whether each document is of low quality."""
    k = len(FEATURES)
    w, trans = np.zeros((k, 2)), np.zeros((2, 2))
    filled = [i for i, s in enumerate(sequences) if len(s)]
    if len({bool(low[i]) for i in filled}) < 2:
        return w, trans
    sequences, low = [sequences[i] for i in filled], np.array([bool(low[i]) for i in filled])
    x = np.zeros((len(sequences), max(map(len, sequences)), k))
    live = np.zeros(x.shape[:2])
    for i, s in enumerate(sequences):
        x[i, : len(s)], live[i, : len(s)] = s, 1
    total = live.sum()
    for _ in range(rounds):
        soft, pairs = constrained(x @ w, trans, live, low)
        gold = np.einsum("stk,stl->kl", x, soft)
        speed = [np.zeros_like(w), np.zeros_like(trans)]
        for _ in range(steps):
            p, both = marginals(x @ w, trans, live)
            step = [(gold - np.einsum("stk,stl->kl", x, p)) / total - ridge * w, (pairs - both) / total - ridge * trans]
            for part, v, g in zip((w, trans), speed, step, strict=True):
                v *= 0.9
                v += g
                part += rate * v
    return w, trans


def viterbi(x: np.ndarray, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest labels, 1 for boilerplate; content wins ties."""
    score = (x @ w).tolist()
    (aa, ab), (ba, bb) = trans.tolist()
    a, b = score[0]
    back = []
    for sa, sb in score[1:]:
        back.append((0 if a + aa >= b + ba else 1, 0 if a + ab >= b + bb else 1))
        a, b = max(a + aa, b + ba) + sa, max(a + ab, b + bb) + sb
    at = 0 if a >= b else 1
    labels = [at]
    for step in reversed(back):
        labels.append(at := step[at])
    return np.array(labels[::-1])


def content_share(text: bytes, w: np.ndarray, trans: np.ndarray) -> float:
    """The share of the lines' bytes that content lines hold; 0 without words."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    if not lines:
        return 0.0
    size = np.array([len(x) for x in lines], np.float64)
    return float(size[viterbi(line_features(lines), w, trans) == 0].sum() / size.sum())


def stretch(text: bytes) -> np.ndarray:
    """The features of at most LINES successive lines, from a place drawn by the text's hash; taken in the whole text, so its first and last lines are its own."""
    x = line_features([line for line in text.split(b"\n") if line and not line.isspace()])
    at = xxhash.xxh64_intdigest(text, 9) % max(1, len(x) - LINES + 1)
    return x[at : at + LINES]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """The field, from documents (doc_id, text) and labels (doc_id, quality); one task trains it."""

    def learn(texts: list[bytes], quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = dict(zip(texts, (quality == 0).tolist(), strict=True))  # copies count once
        return train([stretch(t) for t in sorted(each)], np.array([each[t] for t in sorted(each)]))

    return supervised.fit(docs, labels, "quality", per_class, learn) or train([], np.empty(0))


def rules(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], min_content: float = MIN_CONTENT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double")
    def judge(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, trans = sent.value
        for s in bodies:
            rows = [(*base(t), content_share(t, w, trans)) for t in s]
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share"])

    found = docs.select("doc_id", judge(utf8("text")).alias("r")).select("doc_id", "r.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= min_content))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules(docs, fit(docs, table(spark, sf_dir, "labels")))
