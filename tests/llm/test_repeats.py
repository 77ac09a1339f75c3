"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import repeats, substring_dedup, suffix_dedup


def brute(seqs, size):
    """Which symbols a window that starts elsewhere too covers."""
    c = Counter(bytes(s[i : i + size]) if isinstance(s, bytes) else tuple(s[i : i + size]) for s in seqs for i in range(len(s) - size + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - size + 1):
            if c[bytes(s[i : i + size]) if isinstance(s, bytes) else tuple(s[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def texts(seed):
    """Passages shared by many texts in differing surroundings, copies, edits, and repeats within a text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 7)))
    words = lambda n: [word() for _ in range(n)]
    passages = [words(r.randint(36, 90)) for _ in range(4)]
    out = []
    for _ in range(40):
        t = words(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = word()
            t += p[r.randint(0, 5) : len(p) - r.randint(0, 5)] + words(r.randint(0, 12))
        out.append(" ".join(t))
    return [*out, out[0], out[1], out[1], "z " * 200, None, "", "short"]


@pytest.mark.parametrize("hot", [2_000, 5, 1])
def test_words_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats.Repeats.__init__, "__defaults__", (hot,))
    data = texts(1)
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    seqs = [(t or "").encode().split() for t in data]
    for i, (s, gone) in enumerate(zip(seqs, brute(seqs, 35), strict=True)):
        assert (got[i]["n_words"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(s), sum(gone), b" ".join(w for w, g in zip(s, gone, strict=True) if not g))
    assert sum(r["n_removed"] for r in got.values()) > 100


@pytest.mark.parametrize("hot", [2_000, 5, 1])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats.Repeats.__init__, "__defaults__", (hot,))
    data = texts(2) + ["é" * 250, "ab" * 300]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    seqs = [(t or "").encode() for t in data]
    for i, (s, gone) in enumerate(zip(seqs, brute(seqs, 200), strict=True)):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(s), sum(gone), spans, bytes(b for b, g in zip(s, gone, strict=True) if not g))


def made(plan, kind):
    """Rows that the plan's nodes of a kind have made."""
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.longMetric("numOutputRows").value() if kind in name and (kind != "Join" or str(plan.joinType()) == "Inner") else 0
    return own + sum(made(p, kind) for p in below)


@pytest.mark.parametrize("deal", [256, 3, 1])
def test_windows_go_back_without_more_copies_than_contents(spark, monkeypatch, deal):
    """One passage in many texts, each with an edit and surroundings of its own."""
    monkeypatch.setattr(repeats.Repeats.__init__, "__defaults__", (5,))
    monkeypatch.setattr(repeats, "DEAL", deal, raising=False)
    r = random.Random(4)
    words = lambda n: ["".join(r.choice("abcde") for _ in range(5)) for _ in range(n)]
    passage, data = words(70), []
    for _ in range(60):
        p = list(passage)
        p[r.randrange(len(p))] = "edit"
        data.append(" ".join(words(10) + p + words(10)))
    df = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"))
    got = {row["doc_id"]: bytes(row["kept"]) for row in df.collect()}
    seqs = [t.encode() for t in data]
    assert got == {i: bytes(b for b, g in zip(s, gone, strict=True) if not g) for i, (s, gone) in enumerate(zip(seqs, brute(seqs, 200), strict=True))}
    plan = df._jdf.queryExecution().executedPlan()
    assert made(plan, "Generate") <= made(plan, "Join")
    assert (made(plan, "Generate") > 0) == (deal < 256)  # copies only where a row has more contents than a task takes


def test_odd_rows(spark, odd, none):
    words = substring_dedup.remove_repeats(odd).collect()
    assert len(words) == odd.count() and {r["n_removed"] for r in words if r["doc_id"] is None} == {0}
    assert {r["n_removed"] for r in words if r["doc_id"] == 5} == {400}  # the same word 400 times
    raw = suffix_dedup.remove_repeats(odd).collect()
    assert {r["n_removed"] for r in raw if r["doc_id"] == 8} == {20_000}
    assert [r["n_bytes"] for r in raw if r["doc_id"] in (0, 1)] == [0, 0]
    assert substring_dedup.remove_repeats(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(3000))
    sym = suffix_dedup.byte_symbols(text)
    whole = repeats.runs(sym, 200, 64)
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    cut = repeats.runs(sym, 200, 64)
    place = lambda x: {int(s) + k: (int(s + o), int(a)) for s, n, o, a, _ in zip(*x, strict=True) for k in range(n)}
    assert place(whole) == place(cut) and len(place(whole)) == 3000 - 199


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12).map(str.encode), max_size=30))
def test_deep_shallow_sorts(strings):
    for shallow in (0, 2, 6):
        order, lcp = suffix_dedup.deep_shallow(strings, shallow)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        for k in range(len(order)):
            want = -1 if not k else suffix_dedup.common(strings[order[k - 1]], strings[order[k]])
            assert lcp[k] == want


def test_digest(spark, small):
    r = substring_dedup.op6_substring_dedup(spark, small).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
