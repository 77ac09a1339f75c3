"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained, one on toxic and one on ordinary text. Both begin with the same base: segments of
ordinary texts, chosen greedily for the byte n-grams that most documents have and no segment before them holds. It stands for the language
that both classes share, so that this cancels in the distance. (Where each class brings its own base, the language's chance matches drown the rest: recall on held-out rows
falls from 0.9 to nothing; `zstd --train` on each class has an area under the curve of 0.68.) The class's own part follows: n-grams that occur in more documents of
the class than of the other, by a ratio and by a likelihood ratio test over documents (near copies count once), put together again to the
stretches of running text that they cover, over word boundaries too. The shorter own part is filled up with line ends. (In the tables here
hardly anything stands out in the ordinary class, so its dictionary is the base; a larger base hides toxic words that share syllables with it: recall is 0.92 with 2 kB and 0.79 with 8.) Both
dictionaries are used raw. Matches are
as long as the n-grams at least and literals are left as they are, so the difference of the two compressed lengths is what the
matches save. Both end with a primer that starts each window as well: it pays for the block's headers, which would otherwise cost as much as a single match saves.

A text is lower-cased and cut into windows of eight words; each is compressed with both dictionaries. A document is
described by the windows that the toxic dictionary compresses better by a threshold, and by two higher ones. The threshold and a logistic curve over the counts are
calibrated by cross-fitting: on distances of sample documents to dictionaries trained without them.

Nulls: a null or empty text has one empty window and gets a score as well; a null doc_id is allowed; labels
without an id or value are not used. Texts of any length are read whole, window by window. Repeated rows are scored alike, and ties between segments go to the
smaller one, so reruns agree. With no labels, or one class only, all scores are 0.5. An empty table gives an empty result.
Columns other than doc_id and text are not read but are passed on by the filter; whatever they are called, they are kept.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table
from .supervised import fit, logistic, report, scored

WINDOW = 8
#: Labelled documents of each class that the model is fitted to, at most.
PER_CLASS = 2500
GRAM = 7
#: Bytes of each dictionary's two parts, at most; segments of the base, and the sample's documents that it is chosen from.
BASE, OWN, SEGMENT, BASE_DOCUMENTS = 2048, 16384, 48, 300
#: How a gram must stand out: ratio of document shares, and the test's statistic.
RATIO, LIKELIHOOD = 8, 14
FOLDS = 3
#: What the toxic documents of the sample weigh together in calibration, the ordinary ones being 1, however many there are of each.
BALANCE = 0.6
PRIMER = b"\x01\x02\x03\x04\x05\x06\x07\x08" * 2
#: The fast strategy with a target length is the one that leaves literals alone.
PARAMETERS = dict(window_log=17, chain_log=16, hash_log=17, search_log=1, min_match=GRAM, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)


def plain(text: bytes) -> bytes:
    return b" %b " % b" ".join(text.lower().split())


def grams(text: bytes) -> np.ndarray:
    """The n-grams of a text, each as a number."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(x) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | x[k : k + len(out)]
    return out


def document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams, sorted, and the number of texts that have each."""
    return np.unique(np.concatenate([np.unique(grams(t)) for t in texts]), return_counts=True)


def places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `known`, which is sorted and not empty, the wanted numbers are, and which of them are there."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def telling(own: list[bytes], other: list[bytes]) -> np.ndarray:
    """The n-grams, sorted, that stand out in the own class."""
    known, n = document_counts(own)
    others, times = document_counts(other)
    at, there = places(others, known)
    m, a, b = np.where(there, times[at], 0), len(own), len(other)
    share = (n + m) / (a + b)
    ratio = 2 * (n * np.log(n / (a * share)) + np.where(m > 0, m * np.log(np.maximum(m, 1) / (b * share)), 0))
    return known[(n * (b + 1) > RATIO * (m + 0.5) * (a + 1)) & (ratio >= LIKELIHOOD)]


def own_part(texts: list[bytes], marks: np.ndarray) -> bytes:
    """The stretches that the marked n-grams cover, those that cover most of the texts last."""
    found: Counter = Counter()
    for t in texts if len(marks) else ():
        edge = np.diff(np.concatenate([[0], places(marks, grams(t))[1].astype(np.int8), [0]]))
        spans: list[list[int]] = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + GRAM - 1).tolist(), strict=True):
            if spans and a < spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        found.update({t[a : min(b, a + SEGMENT)] for a, b in spans})
    kept, size, held = [], 0, b""
    for s, _ in sorted(found.items(), key=lambda x: (-x[1] * len(x[0]), x[0])):
        if size + len(s) >= OWN:
            break
        if s not in held:
            kept.append(s)
            size += len(s) + 1
            held += b"\n" + s
    return b"\n".join(reversed(kept))


def base_part(texts: list[bytes]) -> bytes:
    """Segments of the texts that hold n-grams of most texts, the best last; what a segment holds counts for no later one."""
    texts = texts[:: max(1, len(texts) // BASE_DOCUMENTS)]
    known, n = document_counts(texts)
    if not len(known):
        return b""
    live = np.where(n > 1, n, 0).astype(np.int64)
    best: list[tuple[int, bytes]] = []
    for t in texts:
        worth = np.concatenate([[0], np.cumsum(live[places(known, grams(t))[0]])])
        span = min(SEGMENT - GRAM + 1, len(worth) - 1)
        sums = worth[span:] - worth[:-span] if span else worth[:0]
        for a in range(0, len(sums), SEGMENT):
            k = a + int(sums[a : a + SEGMENT].argmax())
            best.append((-int(sums[k]), t[k : k + SEGMENT]))
    heapq.heapify(best)
    kept: list[bytes] = []
    while best and len(kept) * (SEGMENT + 1) < BASE:
        worth, s = heapq.heappop(best)
        at = places(known, np.unique(grams(s)))[0]
        now = -int(live[at].sum())
        if now == 0 or now > worth and best and now > best[0][0]:
            if now:
                heapq.heappush(best, (now, s))
            continue
        live[at] = 0
        kept.append(s)
    return b"\n".join(reversed(kept))


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> dict[int, bytes]:
    """The two dictionaries' contents, by class."""
    if not toxic or not ordinary:
        return {0: PRIMER, 1: PRIMER}
    base = base_part(ordinary)
    own = {1: own_part(toxic, telling(toxic, ordinary)), 0: own_part(ordinary, telling(ordinary, toxic))}
    size = max(map(len, own.values()))
    return {c: b"\n".join([b"\n" * 8, base, own[c].rjust(size, b"\n"), PRIMER]) for c in (0, 1)}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(**PARAMETERS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def distances(text: bytes, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """Of each window of the text, by how many bytes the toxic dictionary compresses it better."""
    w, t, o = text.lower().split(), toxic.compress, ordinary.compress
    windows = [b"%b %b " % (PRIMER, b" ".join(w[i : i + WINDOW])) for i in range(0, max(1, len(w)), WINDOW)]
    return np.array([len(o(x)) - len(t(x)) for x in windows], np.int64)


def features(d: np.ndarray, threshold: int) -> list[float]:
    """How many windows there are, how many and what share exceed the threshold and two above it, and the greatest distance."""
    out = [math.log1p(len(d))]
    for t in (threshold, threshold + 2, threshold + 4):
        over = int((d >= t).sum())
        out += [math.log1p(over), math.log1p(100 * over / len(d))]
    return [*out, max(0, int(d.max())) / 10]


def without_near_copies(words: list[set[bytes]], y: np.ndarray) -> list[int]:
    """One document of each class and bottom-3 sketch of its words: copies would pass for evidence."""
    first: dict[tuple, int] = {}
    for i, w in enumerate(words):
        first.setdefault((int(y[i]), *heapq.nsmallest(3, map(xxhash.xxh64_intdigest, w))), i)
    return sorted(first.values())


def train(texts: list[bytes], y: np.ndarray) -> dict:
    """Dictionaries from the whole sample; threshold and curve by cross-fitting."""
    kept = np.array(without_near_copies([set(t.lower().split()) for t in texts], y))
    fold = np.arange(len(kept)) % FOLDS
    z, bodies = y[kept], [plain(texts[i]) for i in kept]

    def contents(seen: np.ndarray) -> dict[int, bytes]:
        return train_dictionaries(*([bodies[i] for i in np.flatnonzero(seen & (z == c))] for c in (1, 0)))

    d: list[np.ndarray] = [np.empty(0)] * len(kept)
    for k in range(FOLDS):
        c = contents(fold != k)
        toxic, ordinary = compressor(c[1]), compressor(c[0])
        for i in np.flatnonzero(fold == k):
            d[i] = distances(texts[kept[i]], toxic, ordinary)
    best, worth = None, np.where(z == 1, BALANCE * (z == 0).sum() / max(1, (z == 1).sum()), 1.0)
    for threshold in range(1, 9):
        x = np.array([features(v, threshold) for v in d])
        w = logistic(x, z.astype(float), worth=worth)
        p = np.clip(1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ w))), 1e-9, 1 - 1e-9)
        loss = -np.mean(worth * np.where(z == 1, np.log(p), np.log(1 - p)))
        if best is None or loss < best[0] - 1e-6:
            best = (loss, threshold, w)
    final = contents(np.ones(len(kept), bool))
    return {"toxic": final[1], "ordinary": final[0], "threshold": best[1], "weights": best[2]}


def scorer(model: dict) -> Callable[[bytes], float]:
    toxic, ordinary, w = compressor(model["toxic"]), compressor(model["ordinary"]), model["weights"]

    def score(text: bytes) -> float:
        z = float(np.dot(features(distances(text, toxic, ordinary), model["threshold"]), w[:-1]) + w[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    return fit(docs, labels, "toxic", per_class, train)


def toxic_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """docs (doc_id, text) to (doc_id, score)."""
    return scored(docs.select("doc_id", "text"), fit_toxicity(docs, labels, per_class), scorer).select("doc_id", "score")


def drop_toxic(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept."""
    if model is None:
        return docs
    name = free_name(docs, "toxic")
    return scored(docs, model, scorer, name).where(F.col(name) < threshold).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)
