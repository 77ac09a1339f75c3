"""SimHash groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lexispark.llm import simhash_dedup as sd


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows):
    fps = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(zip([r[0] for r in rows], fps, strict=True))), key=str)


def near_copies():
    r = random.Random(4)
    out = []
    for _ in range(6):
        base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(150)] = "EDIT"
            out.append(" ".join(w))
    return list(enumerate(out)) + [(100, None), (101, ""), (102, "A b"), (103, "a B"), (None, "a b"), (None, "alone here"), (104, "É x y z w")]


def test_groups(spark):
    rows = near_copies()
    found = sd.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in found.collect()), key=str)
    assert got == slow_groups(rows)
    assert len({g for _, _, g in got}) < 30


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked_sets(fps, pairs):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    sets = {}
    for f in fps:
        sets.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("blocks", [6, 8, 9])
def test_links_connect_what_all_links_do(spark, blocks):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    got = [tuple(x) for x in sd.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4, blocks).collect()]
    want = [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    assert set(got) <= {tuple(sorted(p)) for p in want} and len(got) == len(set(got))
    assert linked_sets([signed(f) for f in fps], got) == linked_sets([signed(f) for f in fps], want)


def test_links_of_a_template_grow_with_its_fingerprints(spark):
    """A thousand near copies have some 100,000 links within four bits; about as many leave the join as there are fingerprints, in each of few cells."""
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(1200)}
    got = [tuple(x) for x in sd.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()]
    assert len(linked_sets([signed(f) for f in fps], got)) == 1 and len(got) < 20 * len(fps)


def test_forest_against_all_pairs():
    r = random.Random(9)
    fps = np.array(sorted({sum(1 << b for b in r.sample(range(20), r.randint(0, 9))) << 3 for _ in range(400)}), np.uint64)
    a, b = sd.forest(fps, 2)
    x = fps.tolist()
    want = [(p, q) for i, p in enumerate(x) for q in x[:i] if (p ^ q).bit_count() <= 2]
    got = list(zip(fps[a].tolist(), fps[b].tolist(), strict=True))
    assert all((p ^ q).bit_count() <= 2 for p, q in got) and len(got) < len(x)
    assert linked_sets(x, got) == linked_sets(x, want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in sd.components(edges).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_keep_one(spark, odd, none):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, root string")
    kept = sd.keep_one(df)
    assert kept.columns == df.columns
    want = {g for _, _, g in slow_groups(rows)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)
    once = sd.keep_one(odd).collect()
    assert len({r["doc_id"] for r in once}) == len(once) and sd.keep_one(none).count() == 0
    assert sd.groups(none).count() == 0


def test_keep_one_by_rows_not_ids(spark):
    """Rows of one id, null or not, and of different texts are groups of their own."""
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(8)]
    rows = [(None, t, "s") for t in texts[:4]] + [(None, texts[0], "s"), (7, texts[4], "s"), (7, texts[5], "s"), (8, texts[5], "s"), (7, texts[6], "s"), (None, texts[6], "s"), (9, texts[7], None), (9, None, texts[7])]
    kept = sd.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in kept) == sorted([(t, 0) for t in texts[:4]] + [(t, 7) for t in texts[4:7]] + [(texts[7], 9), ("", 9)])


def test_odd(spark, odd):
    got = sd.groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
