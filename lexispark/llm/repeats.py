"""Repeats of `window` symbols or more, across and within documents: what the two substring operators share.

A symbol is a word or a byte. Each window of a text is filed under its least seed (a run of `seed` symbols, by a hash;
the first of equals), so windows of equal content are filed under equal seeds at equal offsets, and a seed that occurs once in the corpus
clears all its windows. The steps:

1. runs: consecutive windows with the same least seed make one row (anchor, hash of the run's whole content). There are
   about 2 / (window - seed + 2) rows for each symbol; windows themselves are never shuffled.
2. dup: anchors that occur twice or more, counted with map-side aggregation. If all runs of an anchor have the
   same content, all their windows repeat.
3. contexts: for the other anchors each distinct content is fetched once, as what stands left and right of
   the seed, from one document that holds it.
4. resolve: for each anchor the operator's own method tells which windows of a content occur in another content as well, or
   whether the content itself occurs twice.
5. split: an anchor of more than HOT contents is first split, by a shuffle, into groups that agree further on both sides of the seed. Its windows, which
   reach o symbols to the left of the seed, are halved by o: all windows of the range [a, b) hold the a symbols on the left and span - b + 1 on the right that
   are next to the seed, so only contents that agree on these can share one. What lies beyond the range's reach is cut off, and contents that are
   now equal become one row. Groups that are still too large are halved again; a range of a single o leaves one row for a group, so this ends after log2(span)
   steps. A passage that very many documents share, each in its own surroundings, never meets in one task, and each group goes through step 4.
6. The windows found go back to all contents that became one row, which are dealt to tasks by their number, with a copy of the windows for each such task: never
   more copies than contents. They go back to all runs of a content, and by document to the texts.

No step forms pairs of documents. Texts of any length are read whole, in segments that overlap by a window. Documents are told apart by id and text hash, null-safe, so rows that repeat entirely
count as two places and get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sent, shared, utf8, written

#: Contents of one group that one task resolves, at most (some 1 MB); larger groups are split.
HOT = 2_000
#: Contents which became one row that one task takes, about, when its windows go back to them; more are dealt to several tasks.
DEAL = 256
#: Windows that are worked on at once.
SEGMENT = 1 << 18
LOW = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n at least."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(b, m, 1 << 64))])
    return _powers


def runs(sym: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """start, windows, seed's offset from start, anchor, content hash: of each run of windows with the same least seed."""
    out = []
    for at in range(0, max(0, len(sym) - window + 1), SEGMENT):
        x = sym[at : at + SEGMENT + window - 1]
        up, down = powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        seeds = (sums[seed:] - sums[: len(sums) - seed]) * down[: len(x) - seed + 1]
        key = (mix64(seeds) & ~LOW) | np.arange(len(seeds), dtype=np.uint64)
        width, span = 1, window - seed + 1
        while width < span:  # key[i] becomes the least of `width` seeds from i on
            step = min(width, span - width)
            key = np.minimum(key[: len(key) - step], key[step:])
            width += step
        pos = (key & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        last = np.concatenate([first[1:], [len(pos)]]) - 1
        content = (sums[last + window] - sums[first]) * down[first]
        out.append((first + at, last - first + 1, pos[first] - first, mix64(seeds[pos[first]] + np.uint64(1)), mix64(content)))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: Contents: how often one stands there, windows, symbols left of the seed, what stands left and right of it, and the range of windows that the group is for.
COLUMNS = ["anchor", "content", "times", "n", "off", "lead", "tail", "lo", "hi"]
SCHEMA = "anchor long, content long, times long, n int, off int, lead binary, tail binary, lo int, hi int"
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]], list[list[int]]]


class Repeats:
    """symbols: of a text, as uint64. unit: bytes that a symbol takes in a context. context: the bytes of symbols i to j of a text's parts."""

    def __init__(self, window: int, seed: int, symbols: Callable[[bytes], np.ndarray], unit: int, resolve: Resolver, hot: int = HOT):
        if not 0 < seed < window:
            raise ValueError("the seed must be shorter than the window")
        self.window, self.seed, self.symbols, self.unit, self.resolve, self.hot = window, seed, symbols, unit, resolve, hot

    def context(self, sym: np.ndarray, i: int, j: int) -> bytes:
        part = sym[i:j]
        return part.tobytes() if self.unit == 8 else part.astype(np.uint8).tobytes()

    def spans(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, th, body) to (s_id, s_th, spans): for each document with repeats a set of structs (start, wins), windows start + wins[0] to start + wins[1] and so on."""
        key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long"
        window, seed, symbols = self.window, self.seed, self.symbols

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, parts = [], []
                for k, text in enumerate(b.column("body").to_pylist()):
                    r = runs(symbols(text), window, seed)
                    rows.append(np.full(len(r[0]), k))
                    parts.append(r)
                if rows:
                    take = pa.array(np.concatenate(rows).astype(np.int64))
                    start, n, off, anchor, content = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), pa.array(start), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], names=["doc_id", "th", "start", "n", "off", "anchor", "content"])

        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in find(batches):
                yield b.select(["anchor", "content"])

        counted = docs.select("doc_id", "th", "body").mapInArrow(anchors, "anchor long, content long").groupBy("anchor").agg(F.count("*").alias("times"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        dup = shared(counted.where("times > 1").select(F.col("anchor").alias("of"), (F.col("lo") != F.col("hi")).alias("mixed")))
        found = docs.select("doc_id", "th", "body").mapInArrow(find, f"{key}, start long, n int, off int, anchor long, content long")
        # the two larger intermediate tables are Parquet, which takes a third of a checkpoint's room
        repeated = written(found.join(dup, F.col("anchor") == F.col("of")).drop("of"), "repeated")
        flags = self.flags(docs, repeated.where("mixed"), key)
        same = repeated.where("not mixed").select("doc_id", "th", "start", F.array(F.lit(0), F.col("n") - 1).alias("wins"))
        part = (
            repeated.where("mixed").join(flags, (F.col("anchor") == F.col("f_anchor")) & (F.col("content") == F.col("f_content"))).select("doc_id", "th", "start", "wins")
        )
        return same.union(part).groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("start", "wins")).alias("spans"))

    def flags(self, docs: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
        """(f_anchor, f_content, wins): of each content with windows that repeat, the first and last of each stretch of them."""
        window, seed, symbols = self.window, self.seed, self.symbols
        one = mixed.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "start", "n", "off")).alias("at"))
        one = shared(one)
        wanted = one.select(F.col("at.doc_id").alias("w_id"), F.col("at.th").alias("w_th"), F.struct("anchor", "content", "times", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.off").alias("off")).alias("w")).groupBy("w_id", "w_th").agg(F.collect_set("w").alias("wanted"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for text, wants in zip(b.column("body").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                    sym = symbols(text)
                    for w in wants:
                        p = w["start"] + w["off"]
                        out.append((w["anchor"], w["content"], w["times"], w["n"], w["off"], self.context(sym, w["start"], p), self.context(sym, p + seed, w["start"] + w["n"] - 1 + window)))
                if out:
                    cols = list(zip(*out, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "content", "times", "n", "off", "lead", "tail"])

        rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & F.col("th").eqNullSafe(F.col("w_th"))).select("body", "wanted")
        schema = "anchor long, content long, times long, n int, off int, lead binary, tail binary"
        fetched = written(rows.mapInArrow(fetch, schema), "contents")
        return self.resolved(fetched.withColumns({"lo": F.lit(0), "hi": F.lit(window - seed + 1)}))

    def resolved(self, contents: DataFrame) -> DataFrame:
        """flags of contents (anchor, content, times, n, off, lead, tail, lo, hi), large groups split first."""
        span, unit = self.window - self.seed, self.unit
        large = shared(contents.groupBy("anchor").agg(F.count("*").alias("contents")).where(F.col("contents") > self.hot).select(F.col("anchor").alias("h_anchor")))
        n = large.count()
        if not n:
            return self.settled(contents)
        large = sent(large, n)
        settled = self.settled(contents.join(large, F.col("anchor") == F.col("h_anchor"), "left_anti"))

        def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest = lambda *x: xxhash.xxh3_64_intdigest(b"|".join(b"%d" % v if isinstance(v, int) else b"%d:%b" % (len(v), v) for v in x)) - (1 << 63)
            for batch in batches:
                out = []
                for anchor, content, times, n, off, lead, tail, lo, hi in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                    mid = (lo + hi) // 2
                    for a, b in ((lo, mid), (mid, hi)):
                        first, last = max(a, off - n + 1), min(b - 1, off)
                        if first <= last:
                            group = digest(anchor, a, b, lead[(off - a) * unit :], tail[: (span - b + 1) * unit])
                            left, right = lead[(off - last) * unit :], tail[: (span - first) * unit]
                            out.append((anchor, content, off - last, group, digest(left, right, last, first), times, last - first + 1, last, left, right, a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), *TYPES], strict=True)], names=["p_anchor", "p_content", "shift", *COLUMNS])

        halves = written(contents.join(large, F.col("anchor") == F.col("h_anchor"), "left_semi").dropDuplicates(["anchor", "content"]).mapInArrow(halve, f"p_anchor long, p_content long, shift int, {SCHEMA}"), "halves")
        fewer = written(halves.groupBy("anchor", "content").agg(F.sum("times").alias("times"), *[F.first(c).alias(c) for c in COLUMNS[3:]], F.count("*").alias("halves")).select(*COLUMNS, "halves"), "contents")
        moved = self.back(halves, fewer, self.resolved(fewer.select(*COLUMNS))).select("p_anchor", "p_content", F.transform("wins", lambda w: w + F.col("shift")).alias("wins")).groupBy("p_anchor", "p_content").agg(F.flatten(F.collect_list("wins")).alias("wins"))
        return settled.union(moved.select(F.col("p_anchor").alias("f_anchor"), F.col("p_content").alias("f_content"), "wins"))

    def back(self, halves: DataFrame, fewer: DataFrame, flags: DataFrame) -> DataFrame:
        """halves with the flags of the rows that they became; a row of many halves has a copy of its flags for each task that these are dealt to."""
        halves = halves.select("p_anchor", "p_content", "shift", "anchor", "content")
        same = (F.col("anchor") == F.col("f_anchor")) & (F.col("content") == F.col("f_content"))
        many = fewer.where(F.col("halves") > DEAL).select(F.col("anchor").alias("m_anchor"), F.col("content").alias("m_content"), F.ceil(F.col("halves") / DEAL).cast("int").alias("tasks"))
        n = many.count()
        if not n:
            return halves.join(flags, same)
        many, tasks = sent(many, n), F.coalesce("tasks", F.lit(1))
        dealt = halves.join(many, (F.col("anchor") == F.col("m_anchor")) & (F.col("content") == F.col("m_content")), "left").select(*halves.columns, F.pmod("p_content", tasks).alias("task"))
        copies = flags.join(many, (F.col("f_anchor") == F.col("m_anchor")) & (F.col("f_content") == F.col("m_content")), "left").select(*flags.columns, F.explode(F.sequence(F.lit(0), tasks - 1)).alias("of_task"))
        return dealt.join(copies, same & (F.col("task") == F.col("of_task")))

    def settled(self, contents: DataFrame) -> DataFrame:
        """flags of contents whose groups fit a task."""
        resolve = self.resolve

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def done(rows: list[tuple]) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True))
                wins = resolve(np.array(cols[0], np.int64), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4], np.int64), list(cols[5]), list(cols[6]))
                some = [i for i, w in enumerate(wins) if w]
                return pa.RecordBatch.from_arrays([pa.array([cols[0][i] for i in some], pa.int64()), pa.array([cols[1][i] for i in some], pa.int64()), pa.array([wins[i] for i in some], pa.list_(pa.int32()))], names=["f_anchor", "f_content", "wins"])

            for b in batches:  # sorted by anchor: all but the last anchor's rows are complete
                for row in zip(*(b.column(c).to_pylist() for c in COLUMNS[:7]), strict=True):
                    if not held or row[:2] != held[-1][:2]:  # documents that repeat entirely fetch a content more than once
                        held.append(row)
                if len(held) > 8000:
                    cut = next((i for i in range(len(held) - 1, 0, -1) if held[i - 1][0] != held[-1][0]), 0)
                    if cut:
                        yield done(held[:cut])
                        held = held[cut:]
            if held:
                yield done(held)

        return contents.select(*COLUMNS[:7]).repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(settle, "f_anchor long, f_content long, wins array<int>")


def stretches(flags: np.ndarray) -> list[int]:
    """First and last place of each stretch of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1]).ravel().tolist()


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of n symbols the windows in spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        w = np.array(s["wins"], np.int64) + s["start"]
        np.add.at(edge, w[0::2], 1)
        np.add.at(edge, w[1::2] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, th, body): the columns that tell documents apart, and the text as bytes."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), utf8("text").alias("body"))


def joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & F.col("th").eqNullSafe(F.col("s_th")), "left").select("doc_id", "body", "spans")
