"""Suffix-array dedup over bytes by deep-shallow sorting.

The suffix array is a sparse one: the suffixes that start at the anchors (see `repeats`), which every string of 200 bytes
contains at least one of. Only anchors that occur more than once, in differing surroundings, need sorting at all. Their
suffixes are sorted by multikey quicksort down to a shallow depth, and groups that still agree there go to a blind trie:
suffixes descend by branching bytes alone, are compared once with the leaf that they reach, and are
inserted where they part from it; walking the trie gives their order and longest common prefixes. The reversed prefixes in front
of the anchors are sorted in the same way. Equal strings of 200 bytes lie within one stretch of each of the two orders, so runs of
long enough common prefixes name the classes whose pairs are counted.

Texts are UTF-8 bytes; matches never cross documents. Nulls: a null or empty text has no bytes; a null doc_id is allowed. Rows that repeat
are repeats of each other. Texts shorter than 200 bytes lose nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .repeats import Repeats, covered, joined, stretches, with_key

WINDOW, SEED = 200, 64
#: Depth to which multikey quicksort goes.
SHALLOW = 6
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 5) for b in range(256)], np.uint64)


def byte_symbols(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Nodes are [depth, {byte: node or leaf}], leaves lists of equal strings' numbers; -1 is the end of a string."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while len(node) == 2 and isinstance(node[1], dict):
            path.append(node)
            d = node[0]
            node = node[1].get(s[d] if d < len(s) else -1) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        d = common(s, other)
        if d == len(s) == len(other):
            node.append(i)
            return
        mine, theirs = (s[d] if d < len(s) else -1), (other[d] if d < len(other) else -1)
        above = None
        for p in path:
            if p[0] == d:
                p[1][mine] = [i]
                return
            if p[0] > d:
                break
            above = p
        below = self.root if above is None else above[1][s[above[0]] if above[0] < len(s) else -1]
        new = [d, {theirs: below, mine: [i]}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = new

    def walk(self, lead: int, order: list[int], lcp: list[int]) -> None:
        """Appends the strings in order, the first with the given common prefix."""
        stack = [(self.root, lead)]
        while stack:
            node, before = stack.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                d = node[0]
                kids = sorted(node[1].items(), reverse=True)
                stack += [(kid, before if k == len(kids) - 1 else d) for k, (_, kid) in enumerate(kids)]
            else:
                order += node
                lcp += [before, *[len(self.strings[node[0]])] * (len(node) - 1)]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The strings' order and, for each, the longest common prefix with the one before it (-1 for the first)."""
    order: list[int] = []
    lcp: list[int] = []
    stack = [(list(range(len(strings))), 0, -1)] if strings else []
    while stack:
        part, d, lead = stack.pop()
        if len(part) == 1:
            order.append(part[0])
            lcp.append(lead)
        elif d >= shallow:
            trie = BlindTrie(strings)
            for i in part:
                trie.insert(i)
            trie.walk(lead, order, lcp)
        elif part:
            at = {i: strings[i][d] if d < len(strings[i]) else -1 for i in part}
            pivot = sorted((at[part[0]], at[part[len(part) // 2]], at[part[-1]]))[1]
            less, same, more = ([i for i in part if at[i] < pivot], [i for i in part if at[i] == pivot], [i for i in part if at[i] > pivot])
            if more:
                stack.append((more, d, d))
            if pivot < 0:  # all at their end, and so equal
                order += same
                lcp += [lead, *[d] * (len(same) - 1)]
            else:
                stack.append((same, d + 1, d if less else lead))
                if less:
                    stack.append((less, d, lead))
    return order, lcp


def sort_groups(anchor: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the strings, anchor by anchor, and the common prefixes in that order, -1 where an anchor begins."""
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    rank, lcp = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(strings)], strict=True):
        order, common_prefix = deep_shallow(strings[a:b])
        rank[np.array(order) + a] = np.arange(a, b)
        lcp[a:b] = common_prefix
    return rank, lcp


def suffix_classes(anchor: np.ndarray, times: np.ndarray, n: np.ndarray, off: np.ndarray, lead: list[bytes], tail: list[bytes], span: int = WINDOW - SEED) -> list[list[int]]:
    """For each content the stretches of windows that another content of its anchor has too, or that occur in a content found twice.

    A window reaches o bytes left of the seed and span - o right of it. Rows come sorted by anchor.
    """
    rows = len(anchor)
    left_rank, left_lcp = sort_groups(anchor, [x[::-1] for x in lead])
    right_rank, right_lcp = sort_groups(anchor, tail)
    flag = np.zeros((rows, span + 1), bool)
    for o in range(span + 1):
        live = np.flatnonzero((o <= off) & (o > off - n))
        if not len(live):
            continue
        left, right = np.cumsum(left_lcp < o)[left_rank[live]], np.cumsum(right_lcp < span - o)[right_rank[live]]
        if o == 0:
            left = np.cumsum(left_lcp < 0)[left_rank[live]]
        if o == span:
            right = np.cumsum(right_lcp < 0)[right_rank[live]]
        _, at = np.unique(left * (rows + 1) + right, return_inverse=True)
        flag[live, o] = np.bincount(at, weights=times[live])[at] > 1
    return [stretches(flag[i, off[i] - n[i] + 1 : off[i] + 1][::-1]) for i in range(rows)]


class ByteRepeats(Repeats):
    """Contexts hold the bytes themselves, not the numbers that stand for them in hashes."""

    def context(self, sym: np.ndarray, i: int, j: int) -> bytes:
        return RANK[np.searchsorted(SORTED, sym[i:j])].tobytes()


RANK = np.argsort(BYTES).astype(np.uint8)
SORTED = np.sort(BYTES)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept): the bytes that no repeat covers; n_spans counts the stretches removed."""
    keyed = with_key(docs)
    spans = ByteRepeats(WINDOW, SEED, byte_symbols, 1, suffix_classes).spans(keyed)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, s in zip(b.column("body").to_pylist(), b.column("spans").to_pylist(), strict=True):
            if not s:
                rows.append((len(text), 0, 0, text))
                continue
            gone = covered(len(text), s, WINDOW)
            rows.append((len(text), int(gone.sum()), len(stretches(gone)) // 2, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(joined(keyed, spans), f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
