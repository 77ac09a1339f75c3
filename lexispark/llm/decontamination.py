"""Benchmark decontamination by SimHash windows.

Each word of a text starts a window for each size class; the windows' 64-bit fingerprints come from running sums
of the bits of their five-word shingles' hashes. Size classes are the items' sizes rounded down along a
geometric series, and an item is entered with its first, middle and last stretch of its class's size, so a text that
holds the item holds those stretches at distance zero.

Fingerprints are compared through four blocks of 16 bits, by two tables for each. One holds, for each value of the block, the distance to the nearest item's
block; these distances add up to a lower bound, which sieves the windows. The other is an index of the items by all block values within a quarter of the
radius: two fingerprints within the radius are that close in some block, so all of them are found, and of n items a window meets
some 4 * 137 * n / 65536, which get the exact distance. Each hit is laid over the whole item, one word either way, and
counts if the weighted Jaccard similarity of the shingles (each counts as often as it occurs) is at least 0.8.

The radius does not reach every passage of that similarity, so windows of one shingle are looked up at distance zero as well: a span
of similarity 0.8 holds at least 0.8 of the item's shingles. Where a text does, all spans of the item's length that hold as many are compared.
Spans are cut at the text's ends, so a text that is an item less some words at either end is compared as a whole.

The items are query rows: they are sent to the executors in blocks of MAX_ITEMS at most, one pass over the
documents for each block, so what is broadcast stays bounded. Texts are worked through as one stream in pieces of bounded
length that overlap by a window.

Words are compared with A-Z lower-cased. Nulls: a null or empty text or item has no windows and matches nothing; a null doc_id is allowed.
Rows that repeat, documents or items, are reported as often as they occur. Items of less than five words are one shingle. An empty
table on either side gives an empty result, and the filter then keeps everything. Other columns are not read but passed on by the filter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, free_name, map_arrow, mix64, table, utf8

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 8
MAX_ITEMS = 4_000
PIECE = 1 << 11
SIEVE = 1 << 20
GROWTH = 1.35


def shingle_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Of each run of `size` words, from the words' hashes; the whole sequence if there are fewer."""
    size = min(size, len(w))
    if not size:
        return np.empty(0, np.uint64)
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return mix64(h)


def running_bits(h: np.ndarray) -> np.ndarray:
    """(len + 1) x 64 running counts; differences are right modulo 2^16, and windows are shorter."""
    out = np.zeros((len(h) + 1, 64), np.int16)
    np.cumsum(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int16, out=out[1:])
    return out


def window_prints(sums: np.ndarray, shingles: int) -> np.ndarray:
    """Fingerprints of all windows of so many shingles."""
    ones = sums[shingles:] - sums[:-shingles]
    return np.packbits(ones > shingles // 2, axis=1).view(">u8").ravel().astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


@dataclass
class Index:
    """Items by size class. entries: for each class the fingerprints, items and offsets; near and found: its block tables, made where they are first used.

    seeds: the items' distinct shingles in order; those at k are in the items holders[starts[k] : starts[k + 1]]. sieve: which low bits seeds have.
    """

    ids: list = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    shingles: list[Counter] = field(default_factory=list)
    entries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    near: dict[int, list[np.ndarray]] = field(default_factory=dict)
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    seeds: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    holders: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    sieve: np.ndarray | None = None
    radius: int = RADIUS


def nearest(values: np.ndarray, bits: int) -> np.ndarray:
    """For each value of so many bits the distance to the nearest of the given ones."""
    out = np.full(1 << bits, bits, np.uint8)
    out[values] = 0
    for bit in range(bits):  # one bit after another: a distance is at most the neighbour's and one
        pair = out.reshape(-1, 2, 1 << bit)
        pair[:] = np.minimum(pair, pair[:, ::-1] + np.uint8(1))
    return out


def blocks_of(prints: np.ndarray) -> list[np.ndarray]:
    """The fingerprints' four blocks of 16 bits."""
    return list(prints.view(np.uint16).reshape(-1, 4).T)


def size_class(n: int) -> int:
    """The greatest member of 5, 6, 8, 10, 13, 17, ... that is at most n; less than five words are a class each."""
    at = SHINGLE
    while n >= (then := max(at + 1, int(at * GROWTH))):
        at = then
    return min(n, at)


def build(items: list[tuple[object, bytes]], radius: int = RADIUS) -> Index:
    index, found, hashes = Index(radius=radius), defaultdict(list), WordHashes()
    for key, text in items:
        w = np.array([hashes[x] for x in text.lower().split()], np.uint64)
        if not len(w):
            continue
        size = size_class(len(w))
        for off in sorted({0, (len(w) - size) // 2, len(w) - size}):
            h = shingle_hashes(w[off : off + size], SHINGLE)
            found[size].append((int(window_prints(running_bits(h), len(h))[0]), len(index.ids), off))
        index.ids.append(key)
        index.sizes.append(len(w))
        index.shingles.append(Counter(shingle_hashes(w, SHINGLE).tolist()))
    for size, rows in found.items():
        prints = np.array([r[0] for r in rows], np.uint64)
        index.entries[size] = prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    long_ = [i for i, n in enumerate(index.sizes) if n >= SHINGLE]
    if long_:
        flat = np.concatenate([np.fromiter(index.shingles[i], np.uint64) for i in long_])
        of = np.repeat(long_, [len(index.shingles[i]) for i in long_])
        order = np.argsort(flat, kind="stable")
        index.seeds, starts = np.unique(flat[order], return_index=True)
        index.holders, index.starts = of[order], np.append(starts, len(flat))
        index.sieve = np.zeros(SIEVE, bool)
        index.sieve[index.seeds & np.uint64(SIEVE - 1)] = True
    return index


def reach(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most `radius` of them set."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.int64)


def directory(values: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block value the entries within so many bits of it: starts by value, and the entries."""
    near = (values.astype(np.int64)[:, None] ^ reach(bits, radius)[None, :]).ravel()
    order = np.argsort(near, kind="stable")
    starts = np.zeros((1 << bits) + 1, np.int64)
    np.cumsum(np.bincount(near, minlength=1 << bits), out=starts[1:])
    return starts, (order // len(reach(bits, radius))).astype(np.int32)


def hits(prints: np.ndarray, size: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Windows and entries within the radius."""
    known, _, _ = index.entries[size]
    if size not in index.near:
        index.near[size] = [nearest(v, 16) for v in blocks_of(known)]
        # within the radius, some of the four blocks is within a quarter of it
        index.found[size] = [directory(v, 16, index.radius // 4) for v in blocks_of(known)]
    bound = np.zeros(len(prints), np.uint8)
    for near, values in zip(index.near[size], blocks_of(prints), strict=True):
        bound += near[values]
    maybe = np.flatnonzero(bound <= index.radius)
    at, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(maybe), 1 << 12):
        part = maybe[k : k + (1 << 12)]
        for (starts, entries), values in zip(index.found[size], blocks_of(prints[part]), strict=True):
            first, n = starts[values], starts[values.astype(np.int64) + 1] - starts[values]
            i = np.repeat(np.arange(len(part)), n)
            j = entries[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            real = np.bitwise_count(prints[part[i]] ^ known[j]) <= index.radius
            at.append(part[i[real]])
            of.append(j[real].astype(np.int64))
    pairs = np.unique(np.concatenate(at) * len(known) + np.concatenate(of))  # several blocks may find the same
    return pairs // len(known), pairs % len(known)


def seeded(h: np.ndarray, first: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, places in h of the item's shingles) where a text holds enough of them for the threshold."""
    at = np.flatnonzero(index.sieve[h & np.uint64(SIEVE - 1)])
    seed = np.minimum(np.searchsorted(index.seeds, h[at]), len(index.seeds) - 1)
    doc = np.searchsorted(first, at, "right") - 1
    real = (index.seeds[seed] == h[at]) & (at + SHINGLE <= first[doc + 1])
    at, seed, doc = at[real], seed[real], doc[real]
    least = np.array([threshold * max(1, n - SHINGLE + 1) for n in index.sizes])
    ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
    for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
        kinds, times = np.unique(seed[a:b], return_counts=True)
        held = np.zeros(len(index.ids), np.int64)
        for k, n in zip(kinds.tolist(), times.tolist(), strict=True):
            held[index.holders[index.starts[k] : index.starts[k + 1]]] += n
        enough = np.flatnonzero((held > 0) & (held >= least - 1e-9))
        if len(enough):
            items_of = {k: set(index.holders[index.starts[k] : index.starts[k + 1]].tolist()) for k in kinds.tolist()}
            for item in enough.tolist():
                yield int(doc[a]), item, at[a:b][[item in items_of[k] for k in seed[a:b].tolist()]]


def search(texts: list[bytes], index: Index, hashes: WordHashes, threshold: float = SIMILARITY) -> list[tuple[int, int, int, float, int]]:
    """(text, item, first word, similarity, words) of the best place of each item in each text that reaches the threshold."""
    if not index.ids:
        return []
    split = [t.lower().split() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in split])])
    w = np.fromiter((hashes[x] for words in split for x in words), np.uint64, int(first[-1]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    longest = max(index.entries)

    def verify(prints: np.ndarray, size: int, start: int) -> None:
        """Hits among the fingerprints of windows that start at word `start` and on."""
        at, of = hits(prints, size, index)
        _, items, offs = index.entries[size]
        doc = np.searchsorted(first, at + start, "right") - 1
        for p, j, d in zip((at + start).tolist(), of.tolist(), doc.tolist(), strict=True):
            item, lo, hi = int(items[j]), int(first[d]), int(first[d + 1])
            for q in (p - int(offs[j]), p - int(offs[j]) - 1, p - int(offs[j]) + 1):
                a, end = max(q, lo), min(q + index.sizes[item], hi)
                if p + size > hi or (d, q, item) in tried:
                    continue
                tried.add((d, q, item))
                s = similarity(Counter(shingle_hashes(w[a:end], SHINGLE).tolist()), index.shingles[item])
                if s >= threshold and ((d, item) not in best or (-s, a - lo) < (-best[d, item][0], best[d, item][1])):
                    best[d, item] = (s, a - lo, end - a)

    for size in index.entries:
        if size < SHINGLE and len(w) >= size:  # one shingle is the whole window
            verify(window_prints(running_bits(shingle_hashes(w, size)), 1), size, 0)
    def lay(d: int, item: int, places: np.ndarray, h: np.ndarray) -> None:
        """The best of all spans that hold enough of the item's shingles, which are at `places`."""
        lo, hi, n, m = int(first[d]), int(first[d + 1]), index.sizes[item], index.sizes[item] - SHINGLE + 1
        q = np.arange(int(places[0]) - m + 1, int(places[-1]) + 1)
        a, end = np.maximum(q, lo), np.minimum(q + n, hi)
        size = np.maximum(end - a - SHINGLE + 1, 1)
        has = np.minimum(np.searchsorted(places, q + m) - np.searchsorted(places, q), size)
        most = has / (m + size - has)  # no span is more similar than this
        for k in np.lexsort((q, -most)).tolist():
            top, at, _ = best.get((d, item), (threshold, hi, 0))
            if most[k] < top:
                break
            if most[k] == top and a[k] - lo >= at:
                continue
            s = similarity(Counter(h[a[k] : end[k] - SHINGLE + 1].tolist()), index.shingles[item])
            if s >= threshold and (-s, a[k] - lo) < (-top, at):
                best[d, item] = (s, int(a[k]) - lo, int(end[k] - a[k]))

    sizes = [s for s in index.entries if s >= SHINGLE]
    if sizes and len(w) >= SHINGLE:
        h = shingle_hashes(w, SHINGLE)
        for d, item, places in seeded(h, first, index, threshold):
            lay(d, item, places, h)
        for a in range(0, len(h), PIECE):
            sums = running_bits(h[a : a + PIECE + longest])
            for size in sizes:
                m = size - SHINGLE + 1
                if len(sums) > m:
                    verify(window_prints(sums, m)[:PIECE], size, a)
    return [(d, i, at, s, n) for (d, i), (s, at, n) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, max_items: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about max_items / 2, so that none exceeds max_items."""
    n = benchmark.count()
    blocks = -(-2 * n // max_items) if n > max_items else 1
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", utf8("text").alias("body")).collect()
        yield sorted((r["item_id"], bytes(r["body"])) for r in rows if r["item_id"] is not None) + [(None, bytes(r["body"])) for r in rows if r["item_id"] is None]


def leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """docs (doc_id, text) and benchmark (item_id, text) to (doc_id, item_id, start_word, n_words, similarity), one row for each item that a document holds."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, start_word long, n_words long, similarity double"
    out = None
    for items in item_blocks(benchmark, max_items):
        sent = docs.sparkSession.sparkContext.broadcast(build(items))
        hashes = WordHashes()

        def f(b: pa.RecordBatch, sent=sent, hashes=hashes) -> pa.RecordBatch:
            index, found = sent.value, []
            texts = b.column("body").to_pylist()
            for k in range(0, len(texts), 256):
                found += [(k + d, i, at, s, n) for d, i, at, s, n in search(texts[k : k + 256], index, hashes)]
            ids = b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
            cols = [ids, pa.array([index.ids[x[1]] for x in found], None if found else pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.float64())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = map_arrow(docs.select("doc_id", utf8("text").alias("body")), f, schema)
        out = part if out is None else out.union(part)
    return out


def leaky(sent: Broadcast):
    """A column function: does the text hold an item of the index?"""

    @F.pandas_udf("boolean")
    def holds(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for s in bodies:
            out = np.zeros(len(s), bool)
            for k in range(0, len(s), 256):
                for d, *_ in search(list(s[k : k + 256]), sent.value, hashes):
                    out[k + d] = True
            yield pd.Series(out)

    return holds(utf8("text"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of docs that hold no item, all columns kept."""
    kept = docs
    for items in item_blocks(benchmark, max_items):
        sent = docs.sparkSession.sparkContext.broadcast(build(items))
        name = free_name(kept, "leaky")
        kept = kept.withColumn(name, leaky(sent)).where(~F.col(name)).drop(name)
    return kept


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
