"""Substring dedup over words by seed and extend.

Documents meet on winnowed anchors: seeds of eight words, the least in each window of 35. For each
anchor the matches are extended to the left and to the right, word by word and for all occurrences at once: two
occurrences match o words to the left if their running hashes agree there, and r to the right likewise, so the windows in
both extensions are found without looking at pairs of documents. Windows that follow each other join up into maximal repeats, and only repeats of
35 words or more, a whole window, remain. See `repeats` for how this is spread out.

Nulls: a null or empty text has no words (its kept text is empty); a null doc_id is allowed. Rows that repeat are repeats of each other and lose all
their windows' words. Texts shorter than a window lose nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, map_arrow, mix64, table
from .repeats import Repeats, covered, joined, stretches, with_key

WINDOW, SEED = 35, 8
_hashes = WordHashes()


def word_symbols(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter((_hashes[w] for w in words), np.uint64, len(words))


def extend(anchor: np.ndarray, times: np.ndarray, n: np.ndarray, off: np.ndarray, lead: list[bytes], tail: list[bytes], span: int = WINDOW - SEED) -> list[list[int]]:
    """For each content the stretches of windows that another content of its anchor has too, or that occur in a content found twice.

    A window reaches o words left of the seed and span - o right of it.
    """
    rows = len(anchor)

    def running(parts: list[np.ndarray]) -> np.ndarray:
        """rows x (span + 1) hashes of the first 0, 1, ... words of each part."""
        words = np.zeros((rows, span), np.uint64)
        for i, p in enumerate(parts):
            words[i, : min(span, len(p))] = p[:span]
        out = np.zeros((rows, span + 1), np.uint64)
        for k in range(span):
            out[:, k + 1] = mix64(out[:, k] * np.uint64(0xBF58476D1CE4E5B9) + words[:, k] + np.uint64(k + 1))
        return out

    left = running([np.frombuffer(x, np.uint64)[::-1] for x in lead])
    right = running([np.frombuffer(x, np.uint64) for x in tail])
    reach = np.arange(span + 1)
    key = mix64(left * np.uint64(0x94D049BB133111EB) + right[:, ::-1]) ^ mix64(anchor.view(np.uint64)[:, None] * np.uint64(64) + reach[None, :].astype(np.uint64))
    live = (reach[None, :] <= off[:, None]) & (reach[None, :] > (off - n)[:, None])
    _, at = np.unique(key[live], return_inverse=True)
    seen = np.bincount(at, weights=np.broadcast_to(times[:, None], key.shape)[live])[at] > 1
    flag = np.zeros(key.shape, bool)
    flag[live] = seen
    return [stretches(flag[i, off[i] - n[i] + 1 : off[i] + 1][::-1]) for i in range(rows)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, n_removed, kept): the words that no repeat covers, joined by single spaces."""
    keyed = with_key(docs)
    spans = Repeats(WINDOW, SEED, word_symbols, 8, extend).spans(keyed)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, s in zip(b.column("body").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words = text.split()
            gone = covered(len(words), s, WINDOW)
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone.any() else words)
            rows.append((len(words), int(gone.sum()), kept))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return map_arrow(joined(keyed, spans), f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d),
windows AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS k FROM places),
often AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows JOIN often USING (k)),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
marked AS (SELECT words.r, w, p, coalesce(max(hits.i) OVER (PARTITION BY words.r ORDER BY p) >= p - 34, false) AS gone FROM words LEFT JOIN hits ON words.r = hits.r AND words.p = hits.i),
done AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN done USING (r)
"""
