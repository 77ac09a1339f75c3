"""Near-duplicate groups by SimHash, found through segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance, so a grid over them loses no link. The grid's cells: the segments are dealt to eight blocks; counts that
differ by 4 or less in sum leave at least four blocks untouched, so each fingerprint is filed under the counts of every choice of four (70 of
them), and fingerprints meet where all counts of a choice agree. (`blocks` sets how fine the grid is.) There the Manhattan bound sieves them, and the exact Hamming distance settles
what passes. Equal fingerprints are one row before the join; copies cost nothing.

Within a cell no pairs are listed: centres take the fingerprints in reach, and of two centres whose members can still link one link is
looked for, so a cell of a thousand near copies of a template leaves about a thousand links. Cells arrive sorted, so a task holds one of them at a time, 18 bytes a fingerprint.

Groups are the connected components over distinct fingerprints, by alternating large-star and small-star steps.

Nulls: a null text is an empty one (fingerprint zero); a null doc_id is allowed and never a group's id unless
its group has no other. Repeated rows share a fingerprint and so a group; ties between rows of one id go by row hashes. Very long texts are read whole, in pieces. An empty
table gives an empty result. Other columns are not read, and the filter keeps them whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_arrow, shared, table, utf8

SEED = 42
#: Blocks of the grid's segments; more make finer cells, and more of them.
BLOCKS = 8
#: Fingerprints of a cell that are compared pair by pair; rows of cells that are settled at once; parts that a group is dealt to.
SMALL, AT_ONCE, SALTS = 16, 1 << 18, 32
#: A fingerprint is a hot key if more than one row in so many has it.
HOT = 1000
#: The lower bit of each segment.
ODD = 0x5555555555555555


def simhash(text: bytes, shingle: int = 4) -> int:
    """A bit is 1 if set in over half the hashes of the text's shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    h, join = xxhash.xxh64_digest, b" ".join
    d = b"".join([h(join(w[i : i + shingle]), SEED) for i in range(max(1, len(w) - shingle + 1))])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(d), 1 << 16):  # very long texts in pieces
        ones += np.unpackbits(np.frombuffer(d[at : at + (1 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(d) // 8).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp), the fingerprint as a signed long; the carried columns stand between them."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([simhash(t, shingle) for t in b.column("body").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *carried)], pa.array(fp)], names=["doc_id", *carried, "fp"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *carried))
    return map_arrow(docs.select("doc_id", *carried, utf8("text").alias("body")), f, f"{schema}fp long")


def counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, two bits each."""
    high, odd = F.shiftrightunsigned(fp, 1), F.lit(ODD)
    return F.shiftleft(high.bitwiseAND(fp).bitwiseAND(odd), 1).bitwiseOR(high.bitwiseXOR(fp).bitwiseAND(odd))


def embedded(fp: np.ndarray) -> np.ndarray:
    """The counts in unary, 01 for one and 11 for two: they differ in as many bits as the counts differ."""
    high, odd = fp >> np.uint64(1), np.uint64(ODD)
    return ((high | fp) & odd) | ((high & fp & odd) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(embedded(a) ^ embedded(b))


def near(a: np.ndarray, b: np.ndarray | np.uint64, radius: int) -> np.ndarray:
    """Which fingerprints link: the Manhattan bound first, the exact distance for what passes."""
    out = manhattan(a, b) <= radius
    out[out] = np.bitwise_count((a ^ b)[out]) <= radius
    return out


def block_masks(blocks: int) -> list[int]:
    """The segments' bits dealt to so many blocks of about equal width."""
    at = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links connect among the distinct fingerprints of one cell, about one for each.

    Centres take what is in reach; two centres' members can only link if the centres are within three radii, and are compared until one link is found.
    """
    owner, centres, a, b = np.full(len(fps), -1), [], [], []
    for c in range(len(fps)):
        if owner[c] >= 0:
            continue
        free = np.flatnonzero(owner < 0)
        mine = free[near(fps[free], fps[c], radius)]
        owner[mine] = len(centres)
        centres.append(c)
        a.append(np.full(len(mine) - 1, c))
        b.append(mine[mine != c])
    root = list(range(len(centres)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    members = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner))[:-1])
    at = fps[centres]
    for i in range(len(centres)):
        for j in (np.flatnonzero(np.bitwise_count(at[i + 1 :] ^ at[i]) <= 3 * radius) + i + 1).tolist():
            if find(i) == find(j):
                continue
            for x in members[i].tolist():
                hit = members[j][near(fps[members[j]], fps[x], radius)]
                if len(hit):
                    a.append(np.array([x]))
                    b.append(hit[:1])
                    root[find(i)] = find(j)
                    break
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, radius: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints (fp) to links (a < b) within `radius` bits that connect the same fingerprints as all such links do.

    Cells of at most SMALL fingerprints give all their links, larger ones a forest, so the links grow with the fingerprints, not with their pairs. A link leaves
    the first cell that its two share; one that a cell leaves out there is made up for by that cell's others.
    """
    if not 0 <= radius < blocks <= 16:
        raise ValueError(f"radius must be below {blocks}, and that at most 16")
    each = block_masks(blocks)
    chosen = [sum(1 << i for i in c) for c in combinations(range(blocks), blocks - radius)]
    masks = [sum(each[i] for i in range(blocks) if c >> i & 1) for c in chosen]
    cells = F.array(*[F.struct(F.lit(k).cast("short").alias("choice"), F.lit(m - (1 << 64) if m >> 63 else m).alias("mask")) for k, m in enumerate(masks)])
    filed = fps.select("fp", counts(F.col("fp")).alias("counts"), F.explode(cells).alias("m")).select("m.choice", F.col("counts").bitwiseAND(F.col("m.mask")).alias("cell"), "fp")
    # for each set of blocks, the first choice that lies within it
    first = np.array([next((k for k, c in enumerate(chosen) if c & shared_ == c), -1) for shared_ in range(1 << blocks)])

    def settle(choice: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole cells, rows sorted by cell."""
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (choice[1:] != choice[:-1])])
        start, number = np.flatnonzero(new), np.cumsum(new)
        size = np.diff(np.append(start, len(cell)))
        small = np.repeat(size <= SMALL, size)
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((number[k:] == number[:-k]) & small[k:])
            i = i[near(fp[i], fp[i + k], radius)]
            xs.append(i)
            ys.append(i + k)
        for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            x, y = forest(fp[a : a + n], radius)
            xs.append(x + a)
            ys.append(y + a)
        x, y = np.concatenate(xs), np.concatenate(ys)
        differ, common = embedded(fp[x]) ^ embedded(fp[y]), np.zeros(len(x), np.int64)
        for i, m in enumerate(each):
            common |= ((differ & np.uint64(m)) == 0).astype(np.int64) << i
        here = first[common] == choice[x]
        x, y = fp[x[here]].view(np.int64), fp[y[here]].view(np.int64)
        return np.minimum(x, y), np.maximum(x, y)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int16, np.int64, np.uint64)]
        out = lambda x, y: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
        for batch in batches:  # sorted by cell: all but the last cell's rows are complete
            held = [np.concatenate([h, batch.column(c).to_numpy().view(h.dtype)]) for h, c in zip(held, ("choice", "cell", "fp"), strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1:]) | (held[1] != held[1][-1:]))
            if len(held[0]) >= AT_ONCE and len(last):
                yield out(*settle(*(h[: last[-1] + 1] for h in held)))
                held = [h[last[-1] + 1 :] for h in held]
        if len(held[0]):
            yield out(*settle(*held))

    return filed.repartition("choice", "cell").sortWithinPartitions("choice", "cell").mapInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root), the root being a component's smallest node; nodes without edges are left out.

    Large-star hangs a node's greater neighbours, small-star its smaller ones, on the smallest neighbour, until
    nothing changes. Each step is one aggregate with a map-side minimum and one join that AQE can split at a hub.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "at")
        hung = both.join(least, F.col("a") == F.col("at"))
        if large:
            hung = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            hung = hung.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("root").alias("b"))
        return hung.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = shared(edges.where(F.col("a") != F.col("b")))
    seen = mark(now)
    while seen[0]:
        now = shared(star(star(now, True), False))
        if (then := mark(now)) == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def linked(fps: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """Of the distinct fingerprints (fp, least), those with links: (of, least, root)."""
    roots = shared(components(links(fps.select("fp"), radius, blocks)))
    return fps.join(roots, F.col("fp") == F.col("node")).select(F.col("fp").alias("of"), "least", "root")


def groups(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp, root, component_id)."""
    marked = shared(fingerprints(docs, shingle))
    fps = shared(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    named = shared(linked(fps, radius, blocks))
    # a group's fingerprints are dealt to SALTS tasks, and its id is sent to each; fingerprints without links name themselves
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("group"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    ids = named.join(least, (F.col("root") == F.col("group")) & (F.pmod(F.xxhash64("of"), F.lit(SALTS)) == F.col("part"))).select("of", "root", "component_id")
    all_ids = fps.join(ids, F.col("fp") == F.col("of"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("root"), F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "times")
    # fewer than HOT fingerprints can have more than one row in HOT each, so these are sent out; the others are joined by fingerprint
    hot = F.col("times") * HOT > marked.count()
    often = F.broadcast(all_ids.where(hot))
    of, kept = F.col("fp") == F.col("of"), ("doc_id", "fp", "root", "component_id")
    return marked.join(often, of).select(*kept).union(marked.join(often, of, "left_anti").join(all_ids.where(~hot), of).select(*kept))


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """The rows of docs, all columns kept, one of each group: that of the smallest doc_id, rows that tie by a hash; a null id comes last.

    Rows are chosen by two hashes of all their columns, so the texts are shuffled once; rows that repeat entirely leave one.
    The hashes go with the fingerprints, as a doc_id may stand for rows of several groups.
    """
    # Spark's hashes pass over nulls, so which columns are null is hashed too
    row = [*docs.columns, F.concat(*[F.col(c).isNull().cast("string") for c in docs.columns])]
    one, two = free_name(docs, "k1"), free_name(docs, "k2")
    keyed = docs.withColumns({one: F.xxhash64(*row), two: F.hash(*row)})
    marked = fingerprints(keyed, shingle, (one, two))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(one).alias("k1"), F.col(two).alias("k2"))
    fps = shared(marked.groupBy("fp").agg(F.min(rank).alias("least")))
    roots = linked(fps, radius, blocks)
    named = fps.join(roots.select("of", "root"), F.col("fp") == F.col("of"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    chosen = shared(named.groupBy("root").agg(F.min("least").alias("row")).select(F.col("row.k1").alias(one), F.col("row.k2").alias(two)))
    return keyed.join(chosen, [one, two]).dropDuplicates([one, two]).select(*docs.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
